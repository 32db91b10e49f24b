"""Painting: covering rectangles, order, z-order, glyph places."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..coerce import half_up
from ..functions import geom
from .first_best import first_best


def erase_rects(ops: DataFrame, keys: list[str], page_height: Column) -> DataFrame:
    """A rectangle under each op's base and current place, in page points from the bottom, each once.

    Equal to a tenth of a point is the same; colour doesn't count, the first painted stays.
    """
    rects = ops.select(*keys, "op_seq", F.posexplode(F.array(F.struct(F.col("base_rect").alias("r"), F.col("fill").alias("fill")), F.struct(F.col("current_rect").alias("r"), F.col("fill").alias("fill")))).alias("part", "e"))
    r = F.col("e.r")
    flat = rects.select(*keys, "op_seq", "part", r["left"].alias("x"), (page_height - (r["top"] + r["height"])).alias("y"), F.greatest(r["width"], F.lit(0.2)).alias("w"), F.greatest(r["height"], F.lit(0.2)).alias("h"), F.col("e.fill").alias("fill"))
    tenths = {f"k{c}": half_up(F.col(c) * 10).cast("long") for c in "xywh"}
    return first_best(flat.withColumns(tenths), [*keys, *tenths], [F.col("op_seq"), F.col("part")], ["op_seq", "part", "x", "y", "w", "h", "fill"])


def commands(ops: DataFrame, keys: list[str], mode: str) -> DataFrame:
    """mask and text commands with paint_seq, a page at a time.

    ``vector`` paints all masks, then all texts; ``exact`` each op's masks before its text, so that a later
    op's mask may cover an earlier text.
    """
    parts = F.array(F.struct(F.lit("mask").alias("kind"), F.lit(0).alias("part")), F.struct(F.lit("mask").alias("kind"), F.lit(1).alias("part")), F.struct(F.lit("text").alias("kind"), F.lit(2).alias("part")))
    rows = ops.select(*keys, "op_seq", "value", F.explode(parts).alias("p")).select(*keys, "op_seq", "value", "p.kind", "p.part").where((F.col("kind") == "mask") | (F.trim(F.coalesce("value", F.lit(""))) != ""))
    phase = [F.col("kind") == "text"] if mode == "vector" else []
    return rows.withColumn("paint_seq", F.row_number().over(Window.partitionBy(*keys).orderBy(*phase, "op_seq", "part")))


def restacked(objects: DataFrame, keys: list[str], chosen: Column, front: bool) -> DataFrame:
    """Chosen objects before all others of their page, or behind, in their own order."""
    rank = F.when(chosen, F.lit(1 if front else -1)).otherwise(F.lit(0))
    return objects.withColumn("new_z", F.row_number().over(Window.partitionBy(*keys).orderBy(rank, "z")) - 1)


def glyphs(runs: DataFrame, keys: list[str]) -> DataFrame:
    """Each character of ``value`` with the x where it is drawn, from x, size, tracking and stretch.

    The advances before a character are the sum over the characters before it in the same row, so no
    shuffle is needed.
    """
    advance = (geom.export_width_of(F.lit(1), F.col("size")) + F.col("tracking") * F.col("size")) * F.col("stretch")
    chars = F.filter(F.split("value", ""), lambda c: c != "")
    return runs.select(*keys, "x", advance.alias("advance"), F.posexplode(chars).alias("pos", "glyph")).select(*keys, "pos", "glyph", (F.col("x") + F.col("pos") * F.col("advance")).alias("x"))
