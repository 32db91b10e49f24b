"""Messages: templates by language with fallbacks, and status lines by dictionary, then pattern."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import fill_template

#: A small default table; any lang, key, template may stand in.
DEFAULT = (("en", "loaded", "Loaded {n} pages"), ("en", "range", "Pages {from} to {to}"), ("fr", "loaded", "Charge {n} pages"), ("fr", "range", "Pages {from} a {to}"))
#: Our default status lines, whole ones and patterns in the order they are tried.
WHOLE = (("Ready.", "Pret."), ("Undo", "Annuler"), ("Redo", "Refaire"))
PATTERNS = ((r"^Page (\d+) of (\d+)$", "Page $1 sur $2"), (r"^Zoom (\d+)%$", "Zoom a $1 %"), (r"^Loaded (\d+) pages\.$", "$1 pages"))


def templates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(DEFAULT), "lang string, key string, template string")


def rendered(asked: DataFrame, table: DataFrame, fallback: str) -> DataFrame:
    """``asked`` (lang, key, values) with template and message: the language's, the fallback language's, or the key."""
    own = table.withColumnRenamed("template", "own")
    other = table.where(F.col("lang") == fallback).select("key", F.col("template").alias("other"))
    out = asked.join(own, ["lang", "key"], "left").join(other, "key", "left").withColumn("template", F.coalesce("own", "other", "key")).drop("own", "other")
    return out.withColumn("message", fill_template(F.col("template"), F.col("values")))


def translated(statuses: DataFrame, spark: SparkSession, whole=WHOLE, patterns=PATTERNS) -> DataFrame:
    """``statuses`` with ``shown``: the dictionary's line, else the first pattern's, else as it is."""
    lines = spark.createDataFrame(list(whole), "status string, line string")
    out = statuses.join(lines, "status", "left")
    shown = F.when(F.col("line").isNotNull(), F.col("line"))
    for form, to in patterns:
        shown = shown.when(F.col("status").rlike(form), F.regexp_replace("status", form, to))
    return out.withColumn("shown", shown.otherwise(F.col("status"))).drop("line")
