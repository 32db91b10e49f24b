"""Palettes: expansion by tints and shades, and mapping colours to the nearest entry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..coerce import let
from ..functions import color

#: Our own default base palette (named web colours); any table idx, name, hex may stand in.
BASE = (
    ("Red", "#ff0000"), ("Crimson", "#dc143c"), ("Coral", "#ff7f50"), ("Orange", "#ffa500"), ("Gold", "#ffd700"),
    ("Yellow", "#ffff00"), ("Khaki", "#f0e68c"), ("Olive", "#808000"), ("Lime", "#00ff00"), ("Forest", "#228b22"),
    ("Green", "#008000"), ("Sea", "#2e8b57"), ("Teal", "#008080"), ("Cyan", "#00ffff"), ("Turquoise", "#40e0d0"),
    ("Sky", "#87ceeb"), ("Steel", "#4682b4"), ("Royal", "#4169e1"), ("Blue", "#0000ff"), ("Navy", "#000080"),
    ("Indigo", "#4b0082"), ("Violet", "#ee82ee"), ("Magenta", "#ff00ff"), ("Plum", "#dda0dd"), ("Pink", "#ffc0cb"),
    ("Brown", "#a52a2a"), ("Sienna", "#a0522d"), ("Black", "#000000"), ("Gray", "#808080"), ("White", "#ffffff"),
)
#: Percent ranges (start, end, step) of tints and shades for the two qualities.
LEVELS = {"high": ((100, 20, 5), (95, 60, 5)), "ultra": ((100, 8, 2), (98, 50, 2))}


def percents(start: int, end: int, step: int) -> list[int]:
    """From start down to end by step; the end is always there."""
    out = list(range(start, end - 1, -max(1, abs(step))))
    return out if out and out[-1] == end else [*out, end]


def base_palette(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, n, h) for i, (n, h) in enumerate(BASE)], "idx int, name string, hex string")


def expanded(base: DataFrame, quality: str = "high") -> DataFrame:
    """seq, name, hex, rgb, lab: each base colour, its tints, its shades; the first of equal colours keeps its name."""
    tints, shades = ([p for p in percents(*r) if p < 100] for r in LEVELS[quality])
    kinds = [("", 100), *((" Tint ", p) for p in tints), *((" Shade ", p) for p in shades)]
    levels = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(p).alias("pct")) for k, p in kinds])
    rows = base.where(color.hex_strict(F.col("hex")).isNotNull()).select("idx", "name", color.hex_strict(F.col("hex")).alias("c"), F.posexplode(levels).alias("n", "level"))
    pct, kind = F.col("level.pct"), F.col("level.kind")
    mixed = F.when(kind == " Tint ", color.blend(F.col("c"), color.rgb(255, 255, 255), (100 - pct) / 100.0)).when(kind == " Shade ", color.blend(F.col("c"), color.rgb(0, 0, 0), 1 - pct / 100.0)).otherwise(F.col("c"))
    named = rows.select((F.col("idx") * 1000 + F.col("n")).alias("seq"), F.when(kind == "", F.col("name")).otherwise(F.concat("name", kind, pct.cast("string"), F.lit("%"))).alias("name"), color.to_hex(mixed).alias("hex"))
    first = named.groupBy("hex").agg(F.min(F.struct("seq", "name")).alias("first"))
    out = first.select("first.seq", "first.name", "hex", color.hex_strict(F.col("hex")).alias("rgb"))
    return out.withColumn("lab", color.lab(F.col("rgb")))


def entries(palette: DataFrame) -> Column:
    """The palette as one array in order, for use as a scalar: a palette is some thousand entries at most."""
    return palette.agg(F.array_sort(F.collect_list(F.struct("seq", "name", "hex", "lab"))).alias("entries")).scalar()


def nearest(lab: Column, palette: Column) -> Column:
    """The entry (distance, seq, name, hex) nearest in Lab, the first of equals."""
    # the colour is bound first, so that it is worked out once and not for each entry
    return let({"lab": lab}, lambda v: F.array_min(F.transform(palette, lambda p: F.struct(color.delta_e(v["lab"], p["lab"]).alias("distance"), p["seq"].alias("seq"), p["name"].alias("name"), p["hex"].alias("hex")))))


def mapped(nodes: DataFrame, palette: DataFrame, raw: str = "raw") -> DataFrame:
    """``nodes`` with the entry nearest to each colour; what is no mappable colour has none.

    Each distinct colour is measured against the palette once, then joined back.
    """
    key = F.lower(F.trim(F.coalesce(raw, F.lit(""))))
    keyed = nodes.withColumn("key", F.when(color.mappable(F.col(raw)), key))
    distinct = keyed.select("key").where("key IS NOT NULL").distinct().withColumn("c", color.css(F.col("key"))).where("c IS NOT NULL")
    found = distinct.withColumns({"lab": color.lab(F.col("c")), "entries": entries(palette)}).select("key", nearest(F.col("lab"), F.col("entries")).alias("best"))
    return keyed.join(found, "key", "left").drop("key")


def used(mapped_nodes: DataFrame, seq: str, shown: int = 40) -> DataFrame:
    """How many entries were used, and the first ``shown`` of them in order of first use, with how many more."""
    first = mapped_nodes.where("best IS NOT NULL").groupBy("best.name").agg(F.min(seq).alias("at"))
    every = first.agg(F.array_sort(F.collect_list(F.struct("at", "name"))).alias("names"))
    names = F.transform("names", lambda x: x["name"])
    more = F.size("names") - shown
    text = F.array_join(F.slice(names, 1, shown), ", ")
    return every.select(F.size("names").cast("long").alias("used"), F.when(F.size("names") == 0, "none").when(more > 0, F.concat(text, F.lit(" (+"), more.cast("string"), F.lit(" more)"))).otherwise(text).alias("summary"))
