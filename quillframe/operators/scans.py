"""Scans of decoded pages: nested spans, items with their styles, pages with their editor entries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def spans(pages: DataFrame, keys: list[str], column: str = "blocks") -> DataFrame:
    """A row for each span of text blocks (type 0) whose bbox has four numbers, in order of place: block, line, span, rect, font, size, ..."""
    blocks = pages.select(*keys, F.posexplode(column).alias("block", "b")).where("b.type = 0")
    lines = blocks.select(*keys, "block", F.posexplode("b.lines").alias("line", "l"))
    every = lines.select(*keys, "block", "line", F.posexplode("l.spans").alias("span", "s")).where(F.size("s.bbox") == 4)
    box = F.col("s.bbox")
    return every.select(
        *keys, "block", "line", "span",
        F.struct(box[0].alias("left"), box[1].alias("top"), (box[2] - box[0]).alias("width"), (box[3] - box[1]).alias("height")).alias("rect"),
        F.coalesce("s.font", F.lit("")).alias("font"), F.coalesce("s.size", F.lit(0.0)).alias("size"), F.col("s.color").alias("color"), F.coalesce("s.flags", F.lit(0)).alias("flags"),
    )


def styled(items: DataFrame, styles: DataFrame) -> DataFrame:
    """Items with the style of their font name, defaults where it has none or gaps."""
    out = items.join(styles, "font_name", "left")
    return out.withColumns({"ascent": F.coalesce("ascent", F.lit(0.82)), "descent": F.abs(F.coalesce("descent", F.lit(-0.18))), "font_family": F.coalesce("font_family", F.lit(""))})


def entries(pages: DataFrame, objects: DataFrame, keys: list[str]) -> DataFrame:
    """Pages of a document with their editor entry, by position; pages without one, or with nothing to export, are passed over."""
    from .edits import exportable_pages

    return pages.join(exportable_pages(objects, keys).where("exportable"), keys)


def one_page(outputs: DataFrame, number) -> DataFrame:
    """The output of one page; a number of 0 or null asks for none."""
    return outputs.where((F.coalesce(number, F.lit(0)) != 0) & (F.col("page") == number))


def with_font_bytes(faces: DataFrame, files: DataFrame) -> DataFrame:
    """Faces (url) with the bytes of their files (url, content), null where there are none: a table read before stands in for the network."""
    return faces.join(files.select("url", F.col("content").alias("font_bytes")), "url", "left")
