"""Splitting by page ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..coerce import leading_int
from .first_best import first_best


def sanitised(ranges: DataFrame, pages: Column) -> DataFrame:
    """from_page and to_page: leading whole numbers, 1 and the last page where there are none, inside the document, in order."""
    low = F.greatest(F.lit(1), F.least(pages, F.coalesce(leading_int(F.col("from_raw")), F.lit(1))))
    high = F.greatest(F.lit(1), F.least(pages, F.coalesce(leading_int(F.col("to_raw")), pages)))
    return ranges.where(pages > 0).withColumns({"from_page": F.least(low, high).cast("long"), "to_page": F.greatest(low, high).cast("long")})


def once(ranges: DataFrame, keys: list[str]) -> DataFrame:
    """Equal ranges once, the first added."""
    return first_best(ranges, [*keys, "from_page", "to_page"], [F.col("range_idx")], ["range_idx"])


def pages_of(ranges: DataFrame) -> DataFrame:
    """A row for each page of each range; pages in two ranges come twice."""
    return ranges.withColumn("page", F.explode(F.sequence("from_page", "to_page")))


def without(ranges: DataFrame, position: Column) -> DataFrame:
    return ranges.where(F.col("range_idx") != position)
