"""Drawn shapes, zoom and scale, and how a document is exported."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..coerce import clamp, half_up


def drawn(drags: DataFrame) -> DataFrame:
    """``shape`` of a drag from (x0, y0) to (x1, y1): its bounds, and radii for an ellipse."""
    w, h = F.abs(F.col("x1") - F.col("x0")), F.abs(F.col("y1") - F.col("y0"))
    round_ = F.col("kind") == "ellipse"
    return drags.withColumn("shape", F.struct(F.least("x0", "x1").alias("left"), F.least("y0", "y1").alias("top"), w.alias("width"), h.alias("height"), F.when(round_, w / 2).alias("rx"), F.when(round_, h / 2).alias("ry")))


#: Kinds of drawings that have a fill, and kinds of texts.
FILLED, WORDS = ("rect", "ellipse", "triangle", "polygon"), ("i-text", "text", "textbox")


def painted(objects: DataFrame, chosen: Column, style: dict[str, object]) -> DataFrame:
    """Style of chosen objects by kind: drawings take the stroke, shapes the fill, texts the text's colour, size and family, boxes its colour alone."""
    box, word, shape = F.col("kind") == "text_box", F.col("kind").isin(*WORDS), F.col("kind").isin(*FILLED)
    new = {k: F.lit(v) for k, v in style.items()}
    of = lambda when, column, value: F.when(chosen & when, value).otherwise(F.col(column))
    return objects.withColumns(
        {
            "stroke": of(~box, "stroke", new["stroke"]),
            "stroke_width": of(~box, "stroke_width", new["stroke_width"]),
            "fill": F.when(chosen & (word | box), new["text_color"]).otherwise(of(shape, "fill", new["fill"])),
            "font_size": of(word, "font_size", new["font_size"]),
            "font_family": of(word, "font_family", new["font_family"]),
        }
    )


def zoom_percent(value: Column) -> Column:
    """Whole percent, 50 to 200; 100 for what is no number."""
    odd = value.isNull() | F.isnan(value) | (F.abs(value) == float("inf"))
    return F.when(odd, 100.0).otherwise(half_up(clamp(value, 50.0, 200.0)))


def zoomed(size: Column, percent: Column) -> Column:
    return F.greatest(F.lit(1.0), half_up(size * (percent / 100.0)))


def fit_percent(stage: Column, width: Column) -> Column:
    """Zoom that fits a page to the stage's width, to the nearest five percent."""
    percent = F.greatest(stage - 40.0, F.lit(320.0)) / F.greatest(width, F.lit(1.0)) * 100.0
    return clamp(F.floor(percent / 5 + 0.5) * 5.0, 50.0, 200.0)


def render_scale(stage: Column, width: Column, unknown: float = 1.0) -> Column:
    fit = F.greatest(stage - 40.0, F.lit(320.0)) / F.greatest(width, F.lit(1.0))
    return F.when(F.coalesce(stage, F.lit(0.0)) == 0, unknown).otherwise(clamp(fit, 0.6, 1.6))


def strategy(exact_ready: Column, vector_works: Column) -> Column:
    """Exact if the engine is there; else vector text over the page; else pictures of it."""
    return F.when(exact_ready, "exact").when(vector_works, "vector").otherwise("raster")
