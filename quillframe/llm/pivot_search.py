"""Exact top-k search by inner product on a pivot-distance index.

A vector x is lifted to (x, sqrt(M^2 - |x|^2)), M the largest norm; a query q to (q, 0). Then
|x' - q'|^2 = M^2 + |q|^2 - 2 <x, q>, so the nearest lifted vectors have the largest inner products,
and the triangle inequality holds. Each vector is keyed by its nearest pivot and its distance from
it; the keys of a pivot are cut at quantiles into rings (annuli), sorted by distance. A query visits
rings by the least distance that the triangle inequality allows, d(q', ring) >= max(0, d(q, p) - outer,
inner - d(q, p)), in rounds whose rows grow SIXTEENFOLD, and stops when that bound rules out its
k-th best score so far. Each round hands on only what beats that score.

Pivots and ring borders come from a bounded sample (``SAMPLE`` rows) and only steer; every row is
indexed, and scores are exact integers. Sizes held on the driver and broadcast: pivots and ring
statistics, at most MOST_PIVOTS * MOST_RINGS rows. Rings are stored in blocks of at most BLOCK
rows, queries meet them in packs of at most PACK, so no group grows with the corpus. Equal vectors are
one class until the end, so a vector that a third of all rows share costs one row.

Defined cases: vectors null or with null or non-finite components take no part, as row or query; a
null vec_id neither. Vectors of different length compare as if padded with zeros. Repeated rows
with one id count once. Ties go to the smaller vec_id. Other columns are ignored, whatever their names. Components beyond 2^62 / 1024 saturate; inner products beyond 64 bits are
computed exactly and then clipped to 64 bits. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import Scratch
from ._vectors import classes, expand, matrix, usable

SAMPLE = 4096
MOST_PIVOTS, MOST_RINGS = 64, 64
BLOCK, PACK = 2048, 512
FIRST_ROWS, SIXTEENFOLD = 1024, 16
SLACK = 1e-6


class Index(NamedTuple):
    pivots: np.ndarray  # lifted, float64
    edges: np.ndarray  # ring borders of each pivot
    longest: float  # M^2
    dim: int

    def lifted(self, x: np.ndarray) -> np.ndarray:
        x = x.astype(np.float64)
        rest = np.sqrt(np.maximum(self.longest - (x * x).sum(axis=1), 0.0))
        return np.column_stack([x, rest])

    def keys(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(pivot, ring, distance) of each row."""
        d = distances(self.lifted(x), self.pivots)
        p = d.argmin(axis=1)
        own = d[np.arange(len(p)), p]
        return p, (self.edges[p] <= own[:, None]).sum(axis=1), own


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    d = (x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None, :] - 2.0 * (x @ y.T)
    return np.sqrt(np.maximum(d, 0.0))


def fit_index(sample: np.ndarray, longest: float, rows: int) -> Index:
    """Pivots spread over the sample farthest first, ring borders at its quantiles."""
    n_pivots = int(np.clip(np.sqrt(rows / 64), 1, MOST_PIVOTS))
    n_rings = int(np.clip(rows / (n_pivots * 256), 1, MOST_RINGS))
    index = Index(np.zeros((1, sample.shape[1] + 1)), np.zeros((1, 0)), longest, sample.shape[1])
    lifted = index.lifted(sample)
    chosen = [0]
    near = distances(lifted, lifted[:1])[:, 0]
    while len(chosen) < min(n_pivots, len(lifted)):
        chosen.append(int(near.argmax()))
        near = np.minimum(near, distances(lifted, lifted[chosen[-1:]])[:, 0])
    pivots = lifted[chosen]
    d = distances(lifted, pivots)
    p = d.argmin(axis=1)
    own = d[np.arange(len(p)), p]
    shares = np.arange(1, n_rings) / n_rings
    edges = np.array([np.quantile(own[p == i], shares) if (p == i).any() else np.zeros(n_rings - 1) for i in range(len(pivots))]).reshape(len(pivots), n_rings - 1)
    return index._replace(pivots=pivots, edges=edges)


def exact_products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of int64 rows, exact; beyond 64 bits clipped."""
    if not q.size or not x.size:
        return np.zeros((len(q), len(x)), dtype=np.int64)
    most = float(np.abs(q).astype(np.float64).max()) * float(np.abs(x).astype(np.float64).max()) * q.shape[1]
    if most < 2.0**53:
        return (q.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
    if most < 2.0**62:
        return q @ x.T
    wide = q.astype(object) @ x.astype(object).T
    return np.clip(wide, -(1 << 63), (1 << 63) - 1).astype(np.int64)


def _keyed(shared):
    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            p, ring, d = index.keys(matrix(batch.column("v"), index.dim, np.int64))
            cell = p * (index.edges.shape[1] + 1) + ring
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(p.astype(np.int32)), pa.array(d)], names=[*batch.schema.names, "cell", "pivot", "d"])

    return keyed


def _pack(ids: str, dim: int, *more: str):
    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        x = matrix(pa.array(pdf["v"], pa.list_(pa.int64())), dim, np.int64)
        out = {"cell": pdf["cell"].iloc[:1], "ids": [pdf[ids].to_numpy(np.int64).tobytes()], "m": [x.tobytes()]}
        return pd.DataFrame(out | {c: [pdf[c].to_numpy(np.int64).tobytes()] for c in more})

    return pack


def _visits(shared, stats, k: int, lo: int, hi: int):
    """(cell) rows for each query whose turn it is: rings whose rows, in order of bound, lie in (lo, hi]."""

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, (cell, pivot, inner, outer, count) = shared.value, stats.value
        for batch in batches:
            x = matrix(batch.column("v"), index.dim, np.int64).astype(np.float64)
            floor = batch.column("kth").to_numpy(zero_copy_only=False).astype(np.float64)
            flat = np.column_stack([x, np.zeros(len(x))])
            d = distances(flat, index.pivots)[:, pivot]
            least = np.maximum(0.0, np.maximum(d - outer[None, :], inner[None, :] - d) * (1 - SLACK) - SLACK * (1 + d))
            square = (x * x).sum(axis=1)
            at, to = [], []
            for i in range(len(x)):
                order = np.argsort(least[i], kind="stable")
                before = np.cumsum(count[order]) - count[order]
                best = (index.longest + square[i] - least[i, order] ** 2) / 2
                go = (before >= lo) & (before < hi) & (best * (1 + SLACK) + SLACK * (1 + abs(best)) + 1 >= floor[i])
                at.append(np.full(go.sum(), i))
                to.append(cell[order[go]])
            at = np.concatenate(at) if at else np.zeros(0, np.int64)
            to = np.concatenate(to) if to else np.zeros(0, np.int32)
            rows = pa.array(at.astype(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(to.astype(np.int32)), *[batch.column(c).take(rows) for c in ("rep", "v", "kth")]], names=["cell", "rep", "v", "kth"])

    return visits


def _scored(dim: int, k: int):
    """(q, rep, score): what a block adds to each query's k best, if it beats the k-th so far."""

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                q, kth, ids = (np.frombuffer(row[c], np.int64) for c in ("q_ids", "q_kth", "ids"))
                s = exact_products(np.frombuffer(row["q_m"], np.int64).reshape(len(q), dim), np.frombuffer(row["m"], np.int64).reshape(len(ids), dim))
                qs, reps, scores = [], [], []
                for i in range(len(q)):
                    hit = np.flatnonzero((s[i] >= kth[i]) & (ids != q[i]))
                    if len(hit) > k:
                        hit = hit[np.lexsort((ids[hit], -s[i, hit].astype(np.float64), ))] if abs(s[i]).max() < 1 << 53 else hit[sorted(range(len(hit)), key=lambda j: (-int(s[i, hit[j]]), int(ids[hit[j]])))]
                        hit = hit[:k]
                    qs.append(np.full(len(hit), q[i]))
                    reps.append(ids[hit])
                    scores.append(s[i, hit])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in (qs, reps, scores)], names=["q", "rep", "score"])

    return scored


LOWEST = -(1 << 63)


def top_k(vectors: DataFrame, k: int = 10, every: int = 100, scale: int = 1024) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows for each row whose vec_id ``every`` divides."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "pivot")
    limit = F.lit(float(1 << 62))
    whole = F.transform("v", lambda x: F.floor(F.least(limit, F.greatest(-limit, x * scale))).cast("long"))
    rows = scratch.table(usable(vectors).select("vec_id", whole.alias("v")), "rows")
    is_query = F.col("vec_id") % every == 0
    reps = scratch.table(classes(rows, is_query), "classes")
    square = F.aggregate("v", F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))
    n, longest, dim = reps.agg(F.count("*"), F.coalesce(F.max(square), F.lit(0.0)), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    dim = max(dim, 1)
    sample = reps.orderBy(F.xxhash64("rep")).limit(SAMPLE).select("v").toArrow()
    x = matrix(sample.column("v").combine_chunks(), dim, np.int64) if n else np.zeros((1, dim), np.int64)
    index = fit_index(x.astype(np.float64), longest * (1 + 1e-9), max(n, 1))
    shared = spark.sparkContext.broadcast(index)
    keyed = scratch.table(reps.mapInArrow(_keyed(shared), "v array<long>, rep long, copies long, queries long, cell int, pivot int, d double"), "keyed")
    stats = keyed.groupBy("cell", "pivot").agg(F.min("d"), F.max("d"), F.count("*")).orderBy("cell").collect()  # MOST_PIVOTS * MOST_RINGS rows
    columns = [np.array([r[i] for r in stats]) for i in range(5)]
    cells = spark.sparkContext.broadcast((columns[0].astype(np.int32), columns[1].astype(np.int64), columns[2].astype(float), columns[3].astype(float), columns[4].astype(np.int64)))
    sizes = F.broadcast(spark.createDataFrame([(int(r[0]), -(-int(r[4]) // BLOCK)) for r in stats], "cell int, blocks int"))
    blocks = keyed.join(sizes, "cell").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks"))).groupBy("cell", "block").applyInPandas(_pack("rep", dim), "cell int, ids binary, m binary")
    blocks = scratch.table(blocks, "blocks")
    asking = scratch.table(keyed.where("queries > 0").select("rep", "v", F.lit(LOWEST).cast("long").alias("kth")), "asking")
    tops, best, lo, hi = None, Window.partitionBy("q").orderBy(F.desc("score"), "rep"), 0, FIRST_ROWS
    while True:
        state = asking if tops is None else asking.drop("kth").join(tops.groupBy("q").agg(F.min("score").alias("s"), F.count("*").alias("n")), F.col("q") == F.col("rep"), "left").select("rep", "v", F.when(F.col("n") >= k, F.col("s")).otherwise(F.lit(LOWEST)).alias("kth"))
        visits = scratch.table(state.mapInArrow(_visits(shared, cells, k, lo, hi), "cell int, rep long, v array<long>, kth long"), "visits")
        packs = visits.join(F.broadcast(visits.groupBy("cell").agg(F.ceil(F.count("*") / PACK).alias("packs"))), "cell")  # a row a ring
        packed = packs.withColumn("pack", F.pmod(F.xxhash64("rep"), F.col("packs"))).groupBy("cell", "pack").applyInPandas(_pack("rep", dim, "kth"), "cell int, ids binary, m binary, kth binary")
        met = packed.select("cell", F.col("ids").alias("q_ids"), F.col("m").alias("q_m"), F.col("kth").alias("q_kth")).join(blocks, "cell")
        found = met.mapInArrow(_scored(dim, k), "q long, rep long, score long")
        both = found if tops is None else found.unionByName(tops)
        tops = scratch.table(both.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k).select("q", "rep", "score"), "tops")
        if hi >= n:
            break
        lo, hi = hi, hi * SIXTEENFOLD
    own = keyed.where("queries > 0 AND copies > 1").select("rep", "v")
    # exact below 64 bits, clipped beyond: a sum that the doubles put well beyond isn't added up
    wide = F.aggregate("v", F.lit(0).cast("decimal(38,0)"), lambda acc, x: (acc + x.cast("decimal(19,0)") * x.cast("decimal(19,0)")).cast("decimal(38,0)"))
    most = F.lit(-LOWEST - 1)
    product = F.when(square >= 1e19, most).otherwise(F.least(wide, most.cast("decimal(38,0)")).cast("long"))
    mine = own.select(F.col("rep").alias("q"), "rep", product.alias("score"))
    return expand(tops.unionByName(mine), rows, reps, is_query, k)
