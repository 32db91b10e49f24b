"""Sharding by sampled splitters: near-equal bytes in each shard, equal texts side by side.

Records are ordered by (64-bit hash of the text, doc_id, row number), the number being given when keys are written. A size-weighted sample of
these keys gives quantile boundaries of many more ranges than shards; every record finds its range
by binary search. Ranges that come out overfull are subdivided by a fresh sample of their own keys, and looked
at again, until none is overfull that holds more than one record.
Exact byte and row totals of the ranges then turn each record's running sum inside its range into
its place in the whole order, and equal steps of bytes become the shards. No range is larger than a
few times the target, so the only sorts are of small ranges, and a group of copies that holds a
third of all rows spreads over many ranges because doc_id is part of the key.

Defined cases: a null text has no bytes (size 8, checksum 0). Repeated rows are kept, each with a
slot of its own. Null ids sort first. An empty table gives an empty result. A group of equal texts
stays in one shard when that moves the border by at most ``tolerance`` of a shard; larger groups
are split, since equal bytes are the law. Further columns of the input are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import Scratch, pick

ROWS_PER_RANGE = 20_000
MOST_RANGES = 32_768
SAMPLES_PER_RANGE = 32
OVERFULL = 2.0
ROUNDS = 12
KEY = ("key", "tie", "number")


def _splitters(keyed: DataFrame, ranges: int, mean_size: float, rows: int, seed: int) -> np.ndarray:
    """Quantiles of a size-weighted sample of at most about 2 * ranges * SAMPLES_PER_RANGE keys."""
    want = ranges * SAMPLES_PER_RANGE
    u = (F.pmod(F.xxhash64(F.lit(seed), *KEY), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    # one exponential clock per record, rate proportional to size: P(chosen) = 1 - exp(-c * size)
    rate = F.lit(want / (rows * mean_size)) * F.col("size")
    chosen = keyed.where(-F.log(u) < rate).select(*KEY, ((1.0 / (1.0 - F.exp(-rate))) * F.col("size")).alias("w"))
    got = chosen.toPandas()
    if not len(got):
        return np.zeros((0, 3), dtype=np.int64)
    got = got.sort_values(list(KEY), kind="stable")
    total = got["w"].to_numpy().cumsum()
    at = np.searchsorted(total, total[-1] * np.arange(1, ranges) / ranges)
    return np.unique(got[list(KEY)].to_numpy(dtype=np.int64)[np.minimum(at, len(got) - 1)], axis=0)


def _packed(columns: list[np.ndarray]) -> np.ndarray:
    """Keys as bytes that sort as the numbers do."""
    flat = np.column_stack([(c.astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63)).astype(">u8") for c in columns])
    return np.ascontiguousarray(flat).view(f"S{8 * len(columns)}").ravel()


def _with_range(keyed: DataFrame, cuts: np.ndarray, name: str) -> DataFrame:
    """Ordinal of the range of a key; ``cuts`` is bounded by some MOST_RANGES rows of 24 bytes."""
    spark = keyed.sparkSession
    shared = spark.sparkContext.broadcast(np.ascontiguousarray(cuts))

    @F.pandas_udf("int")
    def ordinal(key: pd.Series, tie: pd.Series, number: pd.Series) -> pd.Series:
        bounds = shared.value
        own = [x.to_numpy(np.int64) for x in (key, tie, number)]
        out = np.searchsorted(bounds[:, 0], own[0], side="left")
        some = np.flatnonzero(np.searchsorted(bounds[:, 0], own[0], side="right") > out)
        if len(some):  # a border inside a group of equal texts
            out[some] = np.searchsorted(_packed(list(bounds.T)), _packed([x[some] for x in own]), side="right")
        return pd.Series(out.astype(np.int32))

    return keyed.withColumn(name, ordinal(*KEY))


def shard_documents(docs: DataFrame, shards: int = 24, tolerance: float = 0.01, seed: int = 7) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of ``docs``."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "shards")
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = scratch.table(
        pick(docs, doc_id="long", text="string").select(
            "doc_id",
            (F.octet_length(text) + F.lit(8)).cast("long").alias("size"),
            F.crc32(text).alias("text_crc32"),
            F.xxhash64(text, F.col("text").isNull()).alias("key"),
            F.coalesce("doc_id", F.lit(-(1 << 63))).alias("tie"),
            # written once and read from there on, so it stays
            F.monotonically_increasing_id().alias("number"),
        ),
        "keys",
    )
    rows, total = keyed.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    ranges = int(min(MOST_RANGES, max(8 * shards, -(-rows // ROWS_PER_RANGE))))
    cuts = _splitters(keyed, ranges, total / max(rows, 1), max(rows, 1), seed) if rows else np.zeros((0, 3), np.int64)
    ranged = _with_range(keyed, cuts, "range")
    for again in range(ROUNDS):
        sums = ranged.groupBy("range").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).toPandas()  # a row a range
        over = sums[(sums["bytes"] > OVERFULL * total / ranges) & (sums["rows"] > 1)]
        if not len(over) or len(sums) > 2 * MOST_RANGES:
            break
        # subdivide: a sample from the overfull ranges alone, dense enough to halve each
        inside = ranged.where(F.col("range").isin([int(x) for x in over["range"]]))
        n, size = int(over["rows"].sum()), int(over["bytes"].sum())
        more = _splitters(inside, int(min(MOST_RANGES, 4 * max(len(over), size * ranges // total))), size / n, n, seed + 1 + again)
        merged = np.unique(np.concatenate([cuts, more]), axis=0)
        if len(merged) == len(cuts):
            break
        cuts = merged
        ranged = _with_range(keyed, cuts, "range")
    ranged = scratch.table(ranged, "ranged")
    totals = ranged.groupBy("range").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).orderBy("range").toPandas()
    offsets = pd.DataFrame(
        {
            "range": totals["range"].astype("int32"),
            "byte_base": (totals["bytes"].cumsum() - totals["bytes"]).astype("int64"),
            "row_base": (totals["rows"].cumsum() - totals["rows"]).astype("int64"),
        }
    )
    # at most MOST_RANGES * 2 rows of 20 bytes: bounded, so it may be broadcast
    bases = F.broadcast(spark.createDataFrame(offsets, "range int, byte_base long, row_base long"))
    order = Window.partitionBy("range").orderBy(*KEY)
    placed = ranged.join(bases, "range").select(
        "*",
        (F.col("byte_base") + F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")).alias("byte_at"),
        (F.col("row_base") + F.row_number().over(order) - 1).alias("row_at"),
    )
    if rows:
        step = F.lit(total / shards)
        group = Window.partitionBy("range", "key")
        begin = F.min("byte_at").over(group)
        span = F.sum("size").over(group)
        at = F.when(span <= step * tolerance, begin).otherwise(F.col("byte_at"))
        placed = placed.withColumn("shard", F.least(F.lit(shards - 1), F.floor(at / step).cast("int")))
    else:
        placed = placed.withColumn("shard", F.lit(0))
    placed = scratch.table(placed.select("doc_id", "size", "text_crc32", "shard", "row_at"), "placed")
    first = F.broadcast(placed.groupBy("shard").agg(F.min("row_at").alias("first_row")))  # one row a shard
    return placed.join(first, "shard").select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        (F.col("row_at") - F.col("first_row")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
