"""Export requests and dropped files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import REQUEST
from .first_best import first_best


def parsed(bodies: DataFrame, body: str) -> DataFrame:
    """Bodies read as requests: status 200, or 400 with what is wrong; content, operations.

    A body that is no JSON is an empty request.
    """
    read = bodies.withColumns({"__r": F.from_json(body, REQUEST, {"mode": "PERMISSIVE"}), "__list": F.coalesce(F.get_json_object(body, "$.operations"), F.lit("")).startswith("[")})
    none = F.coalesce("__r.pdfBase64", F.lit("")) == ""
    error = F.when(none, "no content").when(~F.col("__list"), "operations is no list")
    return read.select(*bodies.columns, F.when(error.isNull(), 200).otherwise(400).alias("status"), error.alias("error"), F.unbase64("__r.pdfBase64").alias("content"), F.col("__r.operations").alias("operations"))


def picked(files: DataFrame, key: str) -> DataFrame:
    """Of files dropped together (seq, mime, name) the first of the right type, else the first with the right ending."""
    by_type, by_name = F.col("mime") == "application/pdf", F.lower("name").endswith(".pdf")
    ranked = files.where(by_type | by_name).withColumn("rank", F.when(by_type, 0).otherwise(1))
    return first_best(ranked, [key], [F.col("rank"), F.col("seq")], ["seq", "name"])
