"""Approximate nearest neighbours on shifted space-filling curves.

Every vector is lifted as for inner products (a query to length M, a row by sqrt(M^2 - |x|^2)), turned and
projected to a few dimensions, shifted, and keyed by its place on a Hilbert curve; ``CURVES``
orderings differ in rotation and shift. Spark range-partitions each ordering; a row's place in it is exact.
Queries meet the rows within ``window`` places on any curve, and all rows met are reranked by the exact
inner product.

The window and the number of curves are calibrated, not guessed: for a bounded sample of queries (``PROBES``)
the true neighbours are found by one pass over all rows, and of the choices that would have found
``target`` of them the one that meets the fewest rows is taken. Data with structure get short windows; data
without any (independent components) get windows that near the whole table, on few curves, since
nothing less would find the neighbours. The target of 0.95 leaves room above a recall of 0.9 for queries outside the sample.

Held on the driver: rotations, the probes and their neighbours, one row per range partition. A curve is
stored in blocks of at most BLOCK rows, so no group grows with the corpus. Equal vectors are one class until the end.

Defined cases: vectors null, zero or with null or non-finite components take no part, as row or
query; a null vec_id neither. Different lengths compare as if padded with zeros. Repeated rows
with one id count once. Ties go to the smaller vec_id; finite vectors whose products overflow keep their
infinite scores. Other columns are ignored, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import Scratch, small_batches
from ._vectors import classes, expand, matrix, usable

CURVES, LEAST_CURVES, DIMS, BITS = 16, 2, 8, 6
PROBES, TARGET = 128, 0.95
BLOCK, MEETING = 4096, 8


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve (int64) of each row of integers below 2**bits; columns * bits <= 62.

    Gray-code form: each bit plane from the top exchanges or inverts the lower bits of the first
    axis, then the planes are Gray-decoded and interleaved.
    """
    axes = [cells[:, i].astype(np.int64) for i in range(cells.shape[1])]
    for bit in range(bits - 1, 0, -1):
        low = (1 << bit) - 1
        for i, axis in enumerate(axes):
            high = (axis >> bit & 1).astype(bool)
            swap = np.where(high, 0, (axes[0] ^ axis) & low)
            axes[0] = np.where(high, axes[0] ^ low, axes[0] ^ swap)
            if i:
                axes[i] = axes[i] ^ swap
    for i in range(1, len(axes)):
        axes[i] = axes[i] ^ axes[i - 1]
    flip = np.zeros(len(cells), dtype=np.int64)
    for bit in range(bits - 1, 0, -1):
        flip = np.where(axes[-1] >> bit & 1, flip ^ ((1 << bit) - 1), flip)
    key = np.zeros(len(cells), dtype=np.int64)
    for bit in range(bits - 1, -1, -1):
        for axis in axes:
            key = key << 1 | ((axis ^ flip) >> bit & 1)
    return key


class Curves(NamedTuple):
    turns: np.ndarray  # CURVES, dim + 1, DIMS
    shifts: np.ndarray
    reach: np.ndarray  # half the extent of each projected axis
    longest: float
    dim: int
    unit: float = 1.0  # what a component of 1 is measured by

    def keys(self, x: np.ndarray, query: bool) -> np.ndarray:
        x = x / self.unit
        square = (x * x).sum(axis=1)
        if query:
            y = np.column_stack([x * np.sqrt(self.longest / np.maximum(square, 1e-300))[:, None], np.zeros(len(x))])
        else:
            y = np.column_stack([x, np.sqrt(np.maximum(self.longest - square, 0.0))])
        out = np.empty((len(self.turns), len(x)), dtype=np.int64)
        for c, turn in enumerate(self.turns):
            z = (y @ turn + self.shifts[c]) / self.reach[c]
            out[c] = hilbert_keys(np.clip((z + 1) / 2 * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64), BITS)
        return out


def fit_curves(sample: np.ndarray, longest: float, seed: int = 5) -> Curves:
    rng = np.random.default_rng(seed)
    dim = sample.shape[1]
    dims = min(DIMS, dim + 1)
    turns = np.stack([np.linalg.qr(rng.normal(size=(dim + 1, dim + 1)))[0][:, :dims] for _ in range(CURVES)])
    y = np.column_stack([sample, np.sqrt(np.maximum(longest - (sample * sample).sum(axis=1), 0.0))])
    reach = np.maximum(np.stack([np.quantile(np.abs(y @ t), 0.995, axis=0) for t in turns]), 1e-300)
    shifts = rng.uniform(-0.15, 0.15, size=reach.shape) * reach
    return Curves(turns, shifts, reach * 1.15, longest, dim)


def _keyed(shared):
    """Each row once per curve, and once more as a query if it is one."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        curves = shared.value
        for batch in batches:
            x = matrix(batch.column("v"), curves.dim)
            ask = np.flatnonzero(batch.column("queries").to_numpy(zero_copy_only=False) > 0)
            rep = batch.column("rep").to_numpy(zero_copy_only=False)
            for at, query in ((np.arange(len(x)), False), (ask, True)):
                if len(at):
                    key = curves.keys(x[at], query)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.repeat(np.arange(len(key), dtype=np.int32), len(at))), pa.array(key.ravel()), pa.array(np.tile(rep[at], len(key))), pa.array(np.full(key.size, query))],
                        names=["curve", "key", "rep", "query"],
                    )

    return keyed


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Places of rows within the partition and curve; a query takes the place of the next row."""
    seen: dict[int, int] = {}
    for batch in batches:
        curve = batch.column("curve").to_numpy(zero_copy_only=False)
        rows = (~batch.column("query").to_numpy(zero_copy_only=False).astype(bool)).astype(np.int64)
        place = np.zeros(len(curve), dtype=np.int64)
        for c in np.unique(curve):
            own = curve == c
            total = np.cumsum(rows[own])
            place[own] = seen.get(int(c), 0) + total - rows[own]
            seen[int(c)] = seen.get(int(c), 0) + int(total[-1])
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(place)], names=[*batch.schema.names, "place"])


def ordered(keyed: DataFrame, scratch: Scratch) -> DataFrame:
    """curve, rep, query, place: exact places along each curve, by range partitions and their offsets."""
    spark = keyed.sparkSession
    ranged = keyed.repartitionByRange("curve", "key", "query", "rep").sortWithinPartitions("curve", "key", "query", "rep")
    local = scratch.table(ranged.mapInArrow(_numbered, "curve int, key long, rep long, query boolean, place long").withColumn("part", F.spark_partition_id()), "local")
    counts = local.groupBy("curve", "part").agg(F.sum(F.when(F.col("query"), 0).otherwise(1)).alias("n")).orderBy("curve", "part").collect()  # partitions + curves rows
    base, total = [], {}
    for r in counts:
        base.append((r["curve"], r["part"], total.get(r["curve"], 0)))
        total[r["curve"]] = total.get(r["curve"], 0) + int(r["n"])
    bases = F.broadcast(spark.createDataFrame(base, "curve int, part int, base long"))
    return local.join(bases, ["curve", "part"]).select("curve", "rep", "query", (F.col("base") + F.col("place")).alias("place"))


def _best(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> list[np.ndarray]:
    """(q, rep, score) of each query's k best of the rows, exact in double precision."""
    with np.errstate(over="ignore", invalid="ignore"):
        s = q @ x.T
        # what the order of additions may change; products that overflow are judged by their exact sum alone
        slack = 4.0 * q.shape[1] * np.finfo(float).eps * (np.sqrt((q * q).sum(axis=1))[:, None] * np.sqrt((x * x).sum(axis=1))[None, :])
        high, low = s + slack, s - slack
    sure = np.isfinite(high) & np.isfinite(low)
    own = q_ids[:, None] == ids[None, :]
    high, low = np.where(sure, high, np.inf), np.where(sure & ~own, low, -np.inf)
    take = min(k, low.shape[1])
    kth = np.partition(low, low.shape[1] - take, axis=1)[:, low.shape[1] - take]
    # all that may tie with the k-th or beat it stay in, to be told apart exactly and by id later
    at, to = np.nonzero((high >= kth[:, None]) & ~own)
    return [q_ids[at], ids[to], exact(q[at], x[to])]


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise inner products, summed from the first component to the last."""
    out = np.zeros(len(a))
    with np.errstate(over="ignore", invalid="ignore"):
        for j in range(a.shape[1]):
            out += a[:, j] * b[:, j]
    return out


def _probe(shared, probes, k: int):
    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dim, (q_ids, q) = shared.value.dim, probes.value
        best: list[np.ndarray] | None = None
        for batch in batches:
            for a in range(0, batch.num_rows, BLOCK):
                part = batch.slice(a, BLOCK)
                new = _best(q_ids, q, part.column("rep").to_numpy(zero_copy_only=False), matrix(part.column("v"), dim), k)
                best = new if best is None else [np.concatenate(x) for x in zip(best, new, strict=True)]
                order = np.lexsort((best[1], -np.nan_to_num(best[2], nan=-np.inf, posinf=np.inf, neginf=-np.inf), best[0]))
                best = [x[order] for x in best]
                first = np.searchsorted(best[0], best[0])
                keep = np.arange(len(best[0])) - first < k
                best = [x[keep] for x in best]
        if best is not None:
            yield pa.RecordBatch.from_arrays([pa.array(best[0]), pa.array(best[1]), pa.array(best[2])], names=["q", "rep", "score"])

    return probe


def _pack(pdf: pd.DataFrame) -> pd.DataFrame:
    ids = pdf["rep"].to_numpy(np.int64)
    return pd.DataFrame({"curve": pdf["curve"].iloc[:1], "block": pdf["block"].iloc[:1], "ids": [ids.tobytes()], "v": [b"".join(pdf["packed"])]})


def _met(dim: int, k: int):
    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                # one row at a time, without copies of the others
                q_ids, ids = (np.frombuffer(batch.column(c)[i].as_buffer(), np.int64) for c in ("q_ids", "ids"))
                q, x = (np.frombuffer(batch.column(c)[i].as_buffer(), np.float64).reshape(-1, dim) for c in ("q_v", "v"))
                out = _best(q_ids, q, ids, x, k)
                yield pa.RecordBatch.from_arrays([pa.array(a) for a in out], names=["q", "rep", "score"])

    return met


def _packed_vectors(dim: int):
    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column("v"), dim)
            yield pa.RecordBatch.from_arrays([batch.column("rep"), pa.array([r.tobytes() for r in x], pa.binary())], names=["rep", "packed"])

    return packed


def calibrate(places: DataFrame, true: DataFrame, rows: int, target: float) -> tuple[int, int]:
    """(curves, half-width) that would have found ``target`` of the true pairs (q, rep) at the least number of rows met; several curves always."""
    asked = places.where("query").join(F.broadcast(true.select("q").distinct()), F.col("rep") == F.col("q")).select("curve", "q", F.col("place").alias("q_place"))
    near = places.where("NOT query").join(F.broadcast(true.select(F.col("rep").alias("r"), "q")), F.col("rep") == F.col("r")).select("curve", "q", "rep", "place")
    # PROBES * k pairs on each curve
    gaps = near.join(asked, ["curve", "q"]).groupBy("q", "rep", "curve").agg(F.min(F.abs(F.col("place") - F.col("q_place"))).alias("gap")).toPandas()
    if not len(gaps):
        return LEAST_CURVES, rows
    table = gaps.pivot(index=["q", "rep"], columns="curve", values="gap").sort_index(axis=1).to_numpy()
    best = None
    for curves in range(LEAST_CURVES, table.shape[1] + 1):
        window = int(min(rows, np.quantile(table[:, :curves].min(axis=1), target, method="higher") + 1))
        met = curves * min(rows, 3 * max(64, window))
        if best is None or met < best[0]:
            best = (met, curves, window)
    return best[1], best[2]


def nearest(vectors: DataFrame, k: int = 20, every: int = 20, target: float = TARGET) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows found for each row whose vec_id ``every`` divides."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "hilbert")
    rows = scratch.table(usable(vectors, zero=False), "rows")
    is_query = F.col("vec_id") % every == 0
    reps = scratch.table(classes(rows, is_query), "classes")
    square = F.aggregate("v", F.lit(0.0), lambda acc, x: acc + x * x)
    # curves are laid over vectors by the largest component, so that no square overflows
    unit = reps.agg(F.max(F.array_max(F.transform("v", F.abs)))).first()[0] or 1.0
    part = F.aggregate("v", F.lit(0.0), lambda acc, x: acc + (x / unit) * (x / unit))
    n, longest, dim, asking = reps.agg(F.count("*"), F.coalesce(F.max(part), F.lit(0.0)), F.coalesce(F.max(F.size("v")), F.lit(0)), F.sum((F.col("queries") > 0).cast("long"))).first()
    if not n or not asking:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sample = matrix(reps.orderBy(F.xxhash64("rep")).limit(4096).select("v").toArrow().column("v").combine_chunks(), dim)
    shared = spark.sparkContext.broadcast(fit_curves(sample / unit, longest * (1 + 1e-12))._replace(unit=unit))
    places = scratch.table(ordered(reps.select("rep", "v", "queries").mapInArrow(_keyed(shared), "curve int, key long, rep long, query boolean"), scratch), "places")
    some = reps.where("queries > 0").orderBy(F.xxhash64("rep", F.lit(1))).limit(PROBES).select("rep", "v").toArrow()
    probes = spark.sparkContext.broadcast((some.column("rep").to_numpy(), matrix(some.column("v").combine_chunks(), dim)))
    best = Window.partitionBy("q").orderBy(F.desc(F.nanvl("score", F.lit(-float("inf")))), "rep")
    true = reps.select("rep", "v").mapInArrow(_probe(shared, probes, k), "q long, rep long, score double").withColumn("n", F.row_number().over(best)).where(F.col("n") <= k)
    true = scratch.table(true.select("q", "rep"), "true")  # PROBES * k rows
    curves, window = calibrate(places, true, n, target)
    places = places.where(F.col("curve") < curves)
    # blocks no longer than the window, so that a query meets three or, where windows are long, 2 * ceil(window / BLOCK) + 1
    size = int(min(BLOCK, max(64, window)))
    around = -(-window // size)
    flat = scratch.table(reps.select("rep", "v").mapInArrow(_packed_vectors(dim), "rep long, packed binary"), "flat")
    placed = places.withColumn("block", F.floor(F.col("place") / size)).join(flat, "rep")
    blocks = placed.where("NOT query").groupBy("curve", "block").applyInPandas(_pack, "curve int, block long, ids binary, v binary")
    packs = placed.where("query").groupBy("curve", "block").applyInPandas(_pack, "curve int, block long, ids binary, v binary")
    meeting = packs.select("curve", F.col("ids").alias("q_ids"), F.col("v").alias("q_v"), F.explode(F.sequence(F.col("block") - around, F.col("block") + around)).alias("block"))
    found = meeting.join(scratch.table(blocks, "blocks"), ["curve", "block"]).select("q_ids", "q_v", "ids", "v").mapInArrow(_met(dim, k), "q long, rep long, score double")
    tops = found.distinct().withColumn("n", F.row_number().over(best)).where(F.col("n") <= k).select("q", "rep", "score")
    mine = reps.where("queries > 0 AND copies > 1").select(F.col("rep").alias("q"), "rep", square.alias("score"))
    # a row of ``meeting`` holds up to two blocks, so few go in one batch
    with small_batches(spark, MEETING):
        tops = scratch.table(tops.unionByName(mine), "tops")
    return expand(tops, rows, reps, is_query, k)
