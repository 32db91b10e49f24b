"""What both vector searches share: which rows take part, and classes of equal vectors."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import pick


def usable(table: DataFrame, vector: str = "embedding", zero: bool = True) -> DataFrame:
    """vec_id, v (array<double>): rows with an id and a vector of finite components; without ``zero``, no zero vectors."""
    inf = F.lit(float("inf"))
    rows = pick(table, vec_id="long", **{vector: "array<double>"}).withColumnRenamed(vector, "v")
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull())
    good = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < inf))
    rows = rows.where(good)
    return rows if zero else rows.where(F.exists("v", lambda x: x != 0))


def classes(rows: DataFrame, is_query: Column) -> DataFrame:
    """rep (least vec_id), v, copies, queries (how many query rows) of each distinct vector."""
    return rows.groupBy("v").agg(F.min("vec_id").alias("rep"), F.countDistinct("vec_id").alias("copies"), F.sum(is_query.cast("long")).alias("queries")).where("rep IS NOT NULL")


def expand(tops: DataFrame, rows: DataFrame, reps: DataFrame, is_query: Column, k: int) -> DataFrame:
    """query_id, rank, vec_id, score out of each query class's best classes.

    ``tops`` (q, rep, score) holds the k best classes of class q, its own among them where it has
    copies. Of each class the k + 1 least ids are enough: one of them may be the query itself.
    """
    named = rows.join(reps.select("v", "rep"), "v").select("rep", "vec_id").distinct()
    least = Window.partitionBy("rep").orderBy("vec_id")
    members = named.withColumn("n", F.row_number().over(least)).where(F.col("n") <= k + 1).select("rep", "vec_id")
    queries = named.where(is_query).select(F.col("rep").alias("q"), F.col("vec_id").alias("query_id"))
    best = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    # k + 1 candidates a query class, the same for all of its queries
    found = tops.join(members, "rep").withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1).select("q", "vec_id", "score")
    own = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    out = queries.join(found, "q").where("vec_id <> query_id").withColumn("rank", F.row_number().over(own).cast("int"))
    return out.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def matrix(column, dim: int, dtype=np.float64) -> np.ndarray:
    """Rows of an Arrow list column as a matrix; shorter vectors are padded with zeros."""
    flat, at = column.flatten().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy())
    if (at == dim).all():
        return flat.astype(dtype).reshape(-1, dim)
    out = np.zeros((len(at), dim), dtype=dtype)
    start = np.cumsum(at) - at
    for i, (a, n) in enumerate(zip(start, at, strict=True)):
        out[i, :n] = flat[a : a + n]
    return out
