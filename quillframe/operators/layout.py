"""Scanned runs and recognised words to text boxes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..coerce import clamp, layer, number_or, within
from ..functions import geom, text


def placed(items: DataFrame, page_width: float, page_height: float, scale: float = 1.0) -> DataFrame:
    """Boxes of raw items (str, transform, width, height, ascent, descent), blank and degenerate ones dropped.

    The item's matrix is brought to page pixels, y downwards; boxes keep inside the page.
    """
    m = [F.col("transform")[i] for i in range(6)]
    value = text.item(F.col("str"))
    tall = F.greatest(F.hypot(m[2] * scale, m[3] * scale), F.abs(number_or(F.col("height"), 0.0) * scale), F.lit(8.0))
    out = layer(items, value=value).where(text.visible(F.col("value")))
    out = layer(out, font_height=tall, wide=F.abs(number_or(F.col("width"), 0.0) * scale), x=m[4] * scale, y=page_height - m[5] * scale)
    ascent, descent = F.coalesce("ascent", F.lit(0.82)), F.abs(F.coalesce("descent", F.lit(-0.18)))
    fh, chars = F.col("font_height"), F.length("value")
    wide = F.when(F.col("wide") < 2, F.greatest(chars * fh * 0.45, F.lit(8.0))).otherwise(F.col("wide"))
    out = layer(
        out,
        left=F.greatest(F.least(F.col("x"), F.lit(page_width - 2)), F.lit(0.0)),
        top=F.greatest(F.least(F.col("y") - fh * ascent, F.lit(page_height - 2)), F.lit(0.0)),
        w=wide,
        h=F.greatest(fh * (ascent + descent), fh * 1.05, F.lit(9.0)),
    )
    out = layer(out, w=F.least("w", page_width - F.col("left")), h=F.least("h", page_height - F.col("top"))).where("w >= 2 AND h >= 2")
    return normalised(out, F.col("value"), page_width, page_height)


def normalised(boxes: DataFrame, value: Column, page_width: float, page_height: float) -> DataFrame:
    """Boxes far wider or taller than their text drawn in; font_size estimated."""
    size = F.greatest(F.least("font_height", F.col("h") * 0.96), F.lit(8.0))
    out = layer(boxes, font_size=size)
    measured = geom.page_width_of(F.length(value), F.col("font_size"))
    roomy = F.greatest(measured * 1.03 + 2, F.lit(8.0))
    w = F.when((measured > 0) & (F.col("w") > roomy * 1.12), roomy).otherwise(F.col("w"))
    line = F.greatest(F.col("font_size") * 1.25 + 2, F.lit(9.0))
    h = F.when(F.col("h") > line * 1.45, line).otherwise(F.col("h"))
    # at least 2 by 2 again: nothing degenerate is left to drop, and no filter copies these columns further down
    return out.withColumns({"w": within(w, F.lit(2.0), page_width - F.col("left")), "h": within(h, F.lit(2.0), page_height - F.col("top"))})


def recognised(words: DataFrame, page_width: float, page_height: float, least_confidence: float = 35.0) -> DataFrame:
    """Boxes of recognised words (text, confidence, bbox) that are sure and large enough."""
    from ..coerce import trimmed

    b = F.col("bbox")
    out = layer(words, value=trimmed(F.coalesce("text", F.lit(""))), w=b["x1"] - b["x0"], h=b["y1"] - b["y0"])
    out = out.where((F.col("value") != "") & (F.col("w") >= 4) & (F.col("h") >= 4) & (F.coalesce("confidence", F.lit(0.0)) >= least_confidence))
    out = layer(out, left=F.greatest(F.least(b["x0"], F.lit(page_width - 2)), F.lit(0.0)), top=F.greatest(F.least(b["y0"], F.lit(page_height - 2)), F.lit(0.0)))
    out = layer(out, w=F.least("w", page_width - F.col("left")), h=F.least("h", page_height - F.col("top"))).where("w >= 2 AND h >= 2")
    return out.withColumn("font_size", F.greatest(F.col("h") * 0.78, F.lit(8.0)))


def built(config: DataFrame) -> DataFrame:
    """Floors and defaults of a new box over left, top, width, height, text, font_size, ..., ascent, ink offsets."""
    from ..coerce import text_or

    c = F.col
    return config.select(
        *[c(x) for x in config.columns if x.endswith("_id") or x.endswith("_seq")],
        F.greatest(number_or(c("left"), 0.0), F.lit(0.0)).alias("left"),
        F.greatest(number_or(c("top"), 0.0), F.lit(0.0)).alias("top"),
        F.greatest(number_or(c("width"), 0.0), F.lit(6.0)).alias("width"),
        F.greatest(number_or(c("height"), 0.0), F.lit(10.0)).alias("height"),
        F.coalesce(c("text"), F.lit("")).alias("text"),
        F.greatest(number_or(c("font_size"), 12.0), F.lit(8.0)).alias("font_size"),
        text_or(c("font_family"), "Arial, sans-serif").alias("font_family"),
        text_or(c("font_weight"), "400").alias("font_weight"),
        text_or(c("font_style"), "normal").alias("font_style"),
        number_or(c("char_spacing"), 0.0).alias("char_spacing"),
        F.greatest(number_or(c("scale_x"), 1.0), F.lit(0.5)).alias("scale_x"),
        clamp(F.coalesce(c("ascent"), F.lit(0.82)), 0.5, 0.95).alias("ascent"),
        clamp(F.coalesce(c("ink_x"), F.lit(0.0)), -4.0, 4.0).alias("ink_x"),
        clamp(F.coalesce(c("ink_y"), F.lit(0.0)), -3.0, 3.0).alias("ink_y"),
        F.greatest(F.coalesce(c("pad_x"), F.lit(0.0)), F.lit(0.0)).alias("pad_x"),
        F.greatest(F.coalesce(c("pad_y"), F.lit(0.0)), F.lit(0.0)).alias("pad_y"),
        text_or(c("source"), "pdf").alias("source"),
    )


def not_scanned(pages: DataFrame, scanned: DataFrame, keys: list[str]) -> DataFrame:
    """Pages that no box came from yet: scanning again adds nothing."""
    return pages.join(scanned.select(*keys).distinct(), keys, "left_anti")


def boxes_of(pdf: DataFrame, ocr: DataFrame) -> DataFrame:
    """Both kinds side by side, kept apart by source."""
    return pdf.withColumn("source", F.lit("pdf")).unionByName(ocr.withColumn("source", F.lit("ocr")), allowMissingColumns=True)


def readiness(boxes: DataFrame, keys: list[str]) -> DataFrame:
    return boxes.groupBy(*keys).agg(F.bool_or(F.col("source") == "pdf").alias("pdf_ready"), F.bool_or(F.col("source") == "ocr").alias("ocr_ready"), F.count("*").alias("boxes"))
