"""SVG text: colours mapped to a palette, sizes made sure of, embedding; and tracing parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..coerce import half_up
from ..functions import color
from ..functions.text import escape_xml

#: Tracing presets by detail level 1 to 5.
LTRES, PATHOMIT = (1.2, 0.85, 0.6, 0.38, 0.22), (12, 7, 3, 1, 0)
CYCLES = (3, 4, 5, 6, 8)
COLOURS = {("high", "srgb"): (36, 56, 84, 120, 170), ("ultra", "srgb"): (96, 148, 224, 320, 420), ("high", "pms"): (64, 96, 136, 188, 248), ("ultra", "pms"): (128, 196, 280, 360, 460)}
UPSCALE, EDGE = {"high": (1.0, 1.15, 1.3, 1.6, 2.0), "ultra": (1.4, 1.8, 2.2, 2.8, 3.4)}, {"high": 3200, "ultra": 5200}

PAINT = r"(?:fill|stroke|stop-color)"


def paints(svg: Column) -> Column:
    """The paint values of a document, of attributes and style properties, in order of place."""
    attrs = F.regexp_extract_all(svg, F.lit(rf"(?i)\s{PAINT}\s*=\s*\"([^\"]*)\""), F.lit(1))
    styles = F.flatten(F.transform(F.regexp_extract_all(svg, F.lit(r"(?i)\sstyle\s*=\s*\"([^\"]*)\""), F.lit(1)), lambda s: F.regexp_extract_all(s, F.lit(rf"(?i)(?:^|[;\s]){PAINT}\s*:\s*([^;]+)"), F.lit(1))))
    return F.concat(attrs, styles)


def recoloured(svg: Column, mapping: Column) -> Column:
    """``svg`` with each paint value that ``mapping`` (array of key, hex) names replaced."""
    def swap(text: Column, m: Column) -> Column:
        raw = F.regexp_replace(m["key"], r"([\\.\[\]{}()*+?^$|])", r"\\$1")
        text = F.regexp_replace(text, F.concat(F.lit(rf"(?i)(\s{PAINT}\s*=\s*\")\s*"), raw, F.lit(r"\s*(\")")), F.concat(F.lit("$1"), m["hex"], F.lit("$2")))
        return F.regexp_replace(text, F.concat(F.lit(rf"(?i)([;\"\s]{PAINT}\s*:\s*)"), raw, F.lit(r"\s*(?=[;\"])")), F.concat(F.lit("$1"), m["hex"]))

    return F.aggregate(mapping, svg, swap)


def mapped(documents: DataFrame, palette: DataFrame) -> DataFrame:
    """Documents (doc_id, svg) with their colours mapped: svg_mapped, and the names used in order."""
    from .palette import entries, nearest

    nodes = documents.select("doc_id", F.posexplode(paints(F.col("svg"))).alias("seq", "raw")).where(color.mappable(F.col("raw")))
    keyed = nodes.withColumn("key", F.lower(F.trim("raw")))
    distinct = keyed.select("key").distinct().withColumn("c", color.css(F.col("key"))).where("c IS NOT NULL").withColumns({"lab": color.lab(F.col("c")), "entries": entries(palette)}).select("key", nearest(F.col("lab"), F.col("entries")).alias("best"))
    first = keyed.join(distinct, "key").groupBy("doc_id", "key", "best").agg(F.min("seq").alias("seq"))
    # mapped values may be keys themselves, so each is protected until all are in place
    per_doc = first.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("seq", "key", F.concat(F.lit("\u0001"), F.substring("best.hex", 2, 6)).alias("hex"), F.col("best.name").alias("name")))).alias("m"))
    out = documents.join(per_doc, "doc_id", "left")
    empty = F.array().cast("array<struct<seq:int,key:string,hex:string,name:string>>")
    m = F.coalesce("m", empty)
    return out.select("doc_id", F.translate(recoloured(F.col("svg"), m), "\u0001", "#").alias("svg_mapped"), F.array_distinct(F.transform(m, lambda x: x["name"])).alias("used"))


def sized(svg: Column, width: Column, height: Column) -> Column:
    """The first svg tag with width, height and viewBox, added where missing."""
    attrs = F.regexp_extract(svg, r"(?i)<svg\b([^>]*)>", 1)
    w, h = width.cast("string"), height.cast("string")
    more = F.concat(
        F.when(attrs.rlike(r"\bwidth\s*="), "").otherwise(F.concat(F.lit(' width="'), w, F.lit('"'))),
        F.when(attrs.rlike(r"\bheight\s*="), "").otherwise(F.concat(F.lit(' height="'), h, F.lit('"'))),
        F.when(attrs.rlike(r"\bviewBox\s*="), "").otherwise(F.concat(F.lit(' viewBox="0 0 '), w, F.lit(" "), h, F.lit('"'))),
    )
    before = F.regexp_extract(svg, r"(?is)^(.*?)<svg\b[^>]*>", 1)
    rest = F.regexp_extract(svg, r"(?is)^.*?<svg\b[^>]*>(.*)$", 1)
    return F.when(svg.rlike(r"(?i)<svg\b[^>]*>"), F.concat(before, F.lit("<svg"), attrs, more, F.lit(">"), rest)).otherwise(F.coalesce(svg, F.lit("")))


def embedded(name: Column, width: Column, height: Column, data_url: Column) -> Column:
    """A document that holds an image as it is."""
    size = [F.greatest(x, F.lit(1)).cast("string") for x in (width, height)]
    box = F.concat(F.lit('width="'), size[0], F.lit('" height="'), size[1], F.lit('"'))
    return F.when(
        F.coalesce(data_url, F.lit("")) != "",
        F.concat_ws("\n", F.lit('<?xml version="1.0" encoding="UTF-8"?>'), F.concat(F.lit('<svg xmlns="http://www.w3.org/2000/svg" version="1.1" '), box, F.lit(' viewBox="0 0 '), size[0], F.lit(" "), size[1], F.lit('">')), F.concat(F.lit("  <metadata>source: "), escape_xml(name), F.lit("</metadata>")), F.concat(F.lit('  <image x="0" y="0" '), box, F.lit(' preserveAspectRatio="none" href="'), data_url, F.lit('"/>')), F.lit("</svg>")),
    ).otherwise("")


def trace_options(spark: SparkSession) -> DataFrame:
    """Twenty rows: level, quality, palette and the parameters each stands for."""
    rows = []
    for level in range(1, 6):
        for quality in ("high", "ultra"):
            ultra = quality == "ultra"
            for kind in ("srgb", "pms"):
                i = level - 1
                rows.append((level, quality, kind, max(0.06, LTRES[i] * (0.66 if ultra else 1.0)), max(0, PATHOMIT[i] - ultra), COLOURS[quality, kind][i], CYCLES[i] + 3 * ultra + 2 * (kind == "pms"), 1 if ultra or level >= 4 else 2, UPSCALE[quality][i], EDGE[quality]))
    return spark.createDataFrame(rows, "level int, quality string, palette string, ltres double, pathomit int, colours int, cycles int, roundcoords int, upscale double, most_edge int")


def trace_size(images: DataFrame, options: DataFrame) -> DataFrame:
    """Images (level, quality, palette, width, height) with their options and the size they are traced at."""
    longest = F.greatest("width", "height")
    scale = F.least(F.col("upscale"), F.when(longest > 0, F.col("most_edge") / longest).otherwise(F.col("upscale")))
    up = F.when(scale > 1.02, scale).otherwise(1.0)
    out = images.join(F.broadcast(options), ["level", "quality", "palette"])  # twenty rows
    return out.withColumns({"scale": up, "trace_width": F.greatest(F.lit(1.0), half_up(F.col("width") * up)).cast("long"), "trace_height": F.greatest(F.lit(1.0), half_up(F.col("height") * up)).cast("long")})
