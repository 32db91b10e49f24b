"""Mixing sources to target weights by subset-sum budget fitting.

Each source takes floor(target / size) whole passes of its documents, and a subset for what is left
of its budget. The subset comes from exact counts of documents by token length: a proportional share
of every length first, then the largest lengths that fit, then a bounded-knapsack dynamic program
over the last few thousand tokens, run on bit sets. Which documents of a length go is settled by a
seeded hash of doc_id, so reruns agree.

Only counts by (source, length, hash cell) are shuffled; the program sees one row per (source,
length), whatever number of documents that is, and the chosen number spreads over 4,096 hash cells
per length, so that only the one cell on the border needs its documents ranked. Sources are numbered and
their targets found by aggregates, whatever their number; a plan of up to ``most_sources`` rows is
broadcast, a longer one merged.

Defined cases: a null text has no words; its document is taken as often as its source's passes say,
which adds nothing. Null sources form one source, last in order. Repeated rows count each. Very long
texts are counted whole. Ties of the seeded hash go by doc_id, then by a hash of the row; rows that
are equal in all columns are taken for one another. Further columns, whatever their names, only count towards that hash.
An empty table gives an empty result; a source of no words has target 0 and takes nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import Scratch
from ._text import scan

CELLS = 4096
DP_TOKENS = 1 << 15
MOST_SOURCES = 100_000


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes = np.zeros(batch.num_rows, dtype=np.int64)
        for w in scan(batch.column("text"), hashes=False):
            sizes[w.first : w.first + len(w.count)] = w.count
        keep = [batch.column(n) for n in batch.schema.names if n != "text"]
        names = [n for n in batch.schema.names if n != "text"]
        yield pa.RecordBatch.from_arrays([*keep, pa.array(sizes)], names=[*names, "size"])


def targets(sizes: list[int], weights: list[float], share: float = 1.0, most: float = 3.0) -> list[float]:
    """Budgets by weight; whoever passes ``most`` times its size stops there, the rest reshare."""
    left, open_, out = share * sum(sizes), [i for i, s in enumerate(sizes)], [0.0] * len(sizes)
    while open_:
        whole = sum(weights[i] for i in open_)
        want = {i: left * weights[i] / whole for i in open_}
        full = [i for i in open_ if want[i] > most * sizes[i]]
        if not full:
            for i in open_:
                out[i] = want[i]
            break
        for i in full:
            out[i] = most * sizes[i]
            left -= out[i]
        open_ = [i for i in open_ if i not in set(full)]
    return out


def fit_counts(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each length to take, their sum as near to ``budget`` as the program finds.

    Never above the budget. Exact (the nearest reachable sum) whenever budget <= DP_TOKENS.
    """
    n = np.zeros(len(lengths), dtype=np.int64)
    whole = int((lengths * counts).sum())
    if budget >= whole:
        return counts.copy()
    if budget <= 0:
        return n
    if budget > DP_TOKENS:
        # leave the program about DP_TOKENS to place, out of every length
        n = (counts.astype(object) * (budget - DP_TOKENS) // whole).astype(np.int64)
    left = budget - int((lengths * n).sum())
    order = np.argsort(-lengths)
    for i in order:
        if left <= DP_TOKENS:
            break
        more = min(int(counts[i] - n[i]), (left - DP_TOKENS) // int(lengths[i]))
        n[i] += more
        left -= more * int(lengths[i])
    reach, steps, full = 1, [], (1 << (left + 1)) - 1
    for i in np.argsort(lengths):
        length, room = int(lengths[i]), int(counts[i] - n[i])
        room, part = min(room, left // length), 1
        while room > 0 and not reach >> left & 1:  # parts of 1, 2, 4, ... copies cover every number up to room
            part = min(part, room)
            before = reach
            reach |= (reach << part * length) & full
            if reach != before:
                steps.append((int(i), part, before))
            room -= part
            part *= 2
        if reach >> left & 1:
            break
    at = reach.bit_length() - 1
    for i, part, before in reversed(steps):
        if not before >> at & 1:
            at -= part * int(lengths[i])
            n[i] += part
    return n


def _listed(sized: DataFrame, weights: tuple[float, ...], scratch: Scratch) -> DataFrame:
    """source (null last), kind, source_size: sources in order of code point, numbered by exact places, their weights repeating."""
    found = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = [F.col("source").isNull(), F.col("source")]  # UTF-8 bytes sort as code points do
    ranged = scratch.table(found.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "sources")
    sizes = ranged.groupBy("part").agg(F.count("*").alias("n")).orderBy("part").collect()  # a row a partition
    base, at = [], 0
    for r in sizes:
        base.append((r["part"], at))
        at += r["n"]
    bases = F.broadcast(ranged.sparkSession.createDataFrame(base, "part int, base long"))
    place = F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1
    listed = ranged.withColumn("place", place).join(bases, "part")
    return scratch.table(listed.select("source", "source_size", F.pmod(F.col("base") + F.col("place"), F.lit(len(weights))).cast("int").alias("kind")), "listed")


def _targeted(listed: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """``listed`` with target: as ``targets``, by aggregates over the sources that are still open, a round each."""
    total = listed.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("kind") + 1)
    level, before = 0.0, -1
    while True:
        full = F.col("source_size") * most < weight * level
        got = listed.groupBy("kind").agg(F.sum(F.when(full, F.col("source_size")).otherwise(0)).alias("held"), F.count_if(full).alias("full"), F.count("*").alias("n")).collect()  # a row a weight
        closed, left = sum(r["full"] for r in got), share * total - most * sum(r["held"] for r in got)
        whole = sum(float(weights[r["kind"]]) * (r["n"] - r["full"]) for r in got)
        if closed == before or not whole:
            break
        before, level = closed, max(level, left / whole)
    return listed.withColumn("target", F.when(F.col("source_size") * most < weight * level, F.col("source_size") * most).otherwise(weight * level))


def mix_documents(docs: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), share: float = 1.0, most: float = 3.0, seed: int = 11, most_sources: int = MOST_SOURCES) -> DataFrame:
    """Every row of ``docs`` with doc_id, source, size, source_size, target, taken, passes (taken / size) and row_key.

    row_key is a hash of all of the row's columns: rows that share it are equal.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "mix")
    base = docs.select(*[F.col(c).cast(kind).alias(c) for c, kind in (("doc_id", "long"), ("source", "string"), ("text", "string"))], row_key(docs).alias("row_key"))
    sized = base.mapInArrow(_count_words, "doc_id long, source string, row_key long, size long")
    sized = scratch.table(sized.withColumn("h", F.xxhash64(F.lit(seed), "doc_id", "row_key")).withColumn("cell", F.pmod("h", F.lit(CELLS)).cast("int")), "sizes")
    listed = _listed(sized, weights, scratch)
    plan = _targeted(listed, weights, share, most)
    passes = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(int(most)))).otherwise(0).cast("int")
    plan = plan.withColumn("passes", passes).withColumn("budget", F.when(F.col("passes") < most, F.round("target").cast("long") - F.col("passes") * F.col("source_size")).otherwise(0))
    plan = scratch.table(plan.select(F.struct("source").alias("s"), "source_size", "target", "passes", "budget"), "plan")
    # broadcast up to a checked number of sources, merged beyond it
    plan = F.broadcast(plan) if plan.count() <= most_sources else plan.hint("merge")
    cells = scratch.table(sized.where("size > 0").groupBy(F.struct("source").alias("s"), "size", "cell").agg(F.count("*").alias("n")), "cells")

    def choose(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("size")
        n = fit_counts(pdf["size"].to_numpy(np.int64), pdf["n"].to_numpy(np.int64), int(pdf["budget"].iloc[0]))
        return pd.DataFrame({"source": pdf["source"], "size": pdf["size"], "chosen": n})

    lengths = cells.groupBy("s", "size").agg(F.sum("n").alias("n"))
    fitted = (
        lengths.join(plan.select("s", "budget"), "s")
        .select("s.source", "size", "n", "budget")
        .groupBy("source")
        .applyInPandas(choose, "source string, size long, chosen long")
        .where("chosen > 0")
    )
    fitted = scratch.table(fitted.select(F.struct("source").alias("s"), "size", "chosen"), "chosen")
    before = Window.partitionBy("s", "size").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    room = (
        cells.withColumn("ahead", F.coalesce(F.sum("n").over(before), F.lit(0)))
        .join(fitted.hint("merge"), ["s", "size"])
        .select("s", "size", "cell", "n", F.greatest(F.lit(0), F.least("n", F.col("chosen") - F.col("ahead"))).alias("room"))
        .where("room > 0")
    )
    keyed = sized.select("doc_id", "source", F.struct("source").alias("s"), "size", "cell", "h", "row_key")
    spots = keyed.join(room.hint("merge"), ["s", "size", "cell"], "left")
    # whole cells are in; only documents of cells that are partly in need a rank
    inside = spots.withColumn("state", F.when(F.col("room").isNull(), 0).when(F.col("room") >= F.col("n"), 2).otherwise(1))
    rank = F.row_number().over(Window.partitionBy("s", "size", "cell").orderBy("h", "doc_id", "row_key"))
    edge = inside.where("state = 1").withColumn("r", rank).withColumn("extra", (F.col("r") <= F.col("room")).cast("int")).drop("r")
    rest = inside.where("state <> 1").withColumn("extra", (F.col("state") == 2).cast("int"))
    every = rest.unionByName(edge)
    return (
        every.join(plan.select("s", "source_size", "target", "passes"), "s")
        .withColumn("passes", F.col("passes") + F.col("extra"))
        .select("doc_id", "source", "size", "source_size", "target", (F.col("size") * F.col("passes")).cast("long").alias("taken"), F.col("passes").cast("int").alias("passes"), "row_key")
    )


def row_key(docs: DataFrame) -> Column:
    """A hash of the row, nulls told apart from what stands beside them."""
    return F.xxhash64(*[x for c in docs.columns for x in (F.col(f"`{c}`"), F.col(f"`{c}`").isNull())])


def repeated(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with each row as many times as the mix takes it."""
    taken = mix_documents(docs, **options).groupBy(F.struct("doc_id").alias("__id"), F.col("row_key").alias("__key")).agg(F.sum("passes").alias("__n")).where("__n > 0")
    # equal rows become one, repeated as often as all of them are taken
    once = docs.groupBy(F.struct(F.col("doc_id").cast("long").alias("doc_id")).alias("__id"), row_key(docs).alias("__key")).agg(F.min(F.struct(*[F.col(f"`{c}`") for c in docs.columns])).alias("__row"))
    each = once.join(taken.hint("merge"), ["__id", "__key"]).select("__row", F.explode(F.sequence(F.lit(1), F.col("__n"))).alias("__pass"))
    return each.select("__row.*")
