"""Quality classifier: ordinal cumulative-link regression on graded ratings.

P(grade <= j) = logistic(threshold_j - z), z the sum of hashed-text weights, one set of weights for
all grades and ordered thresholds between them. Features are present or absent: each distinct word
(ASCII lower case), each distinct word ending of up to three bytes, and how much of the text repeats
the word before; 2**22 buckets. Weights are at most zero: a feature is evidence of a defect or
nothing, so that a text without defects, short or long, in whatever language, scores z = 0, and
length alone never tells for or against a text.

Fitting uses at most ``most_rated`` rated documents (those of least seeded hash of doc_id; documents
with the same features once), screens features by their score statistic, counted in Spark, and runs a fixed
number of full-batch Adam steps in a fixed order, so reruns agree. The driver holds what passed the screening:
at most ``most_features`` buckets, the strongest, of the rated documents. Everything else is a pass over all texts:
scoring is map-only, and the weights sent out are bounded by the fitting sample.

Defined cases: a null or empty text has no features, so z = 0. Ratings of unknown documents, with
null grades, or repeated, are left out, left out and counted each. Without two grades to tell apart
every document gets the single grade (or the top one, where there are no ratings). Repeated rows
give repeated results; other columns pass through, but for ones with the names of the results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import Scratch, pick
from ._text import LOWER, Words, mix, scan

BITS = 22
REPEATS = (0.1, 0.2, 0.4)
SCREEN, LEAST_DOCS = 4.0, 4
STEPS, RATE, RIDGE = 200, 0.1, 1.0


def features(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(buckets of all documents one after another, n + 1 bounds): distinct ones of each document."""
    n = len(words.count)
    doc = words.doc()
    ending = np.zeros(len(words.start), dtype=np.uint64)
    length = words.end - words.start
    for j in (3, 2, 1):
        byte = LOWER[words.raw[np.maximum(words.end - j, 0)]] if len(words.end) else np.zeros(0, np.uint8)
        ending = ending * np.uint64(257) + np.where(length >= j, byte, 0).astype(np.uint64)
    shift = np.uint64(64 - BITS)
    again = np.zeros(len(doc), dtype=bool)
    again[1:] = (words.hash[1:] == words.hash[:-1]) & (doc[1:] == doc[:-1])
    share = np.bincount(doc[again], minlength=n) / np.maximum(words.count, 1)
    marks = [(np.flatnonzero(share >= r), mix(np.array([1000 + i], dtype=np.uint64))[0] >> shift) for i, r in enumerate(REPEATS)]
    at = np.concatenate([doc, doc, *[m for m, _ in marks]]).astype(np.uint64)
    bucket = np.concatenate([words.hash >> shift, mix(ending + np.uint64(77)) >> shift, *[np.full(len(m), b) for m, b in marks]])
    key = np.unique(at << np.uint64(BITS) | bucket)
    bounds = np.searchsorted(key >> np.uint64(BITS), np.arange(n + 1, dtype=np.uint64))
    return (key & np.uint64((1 << BITS) - 1)).astype(np.int32), bounds


class Ordinal(NamedTuple):
    buckets: np.ndarray  # sorted, int32
    weights: np.ndarray
    thresholds: np.ndarray  # one less than there are grades
    grades: np.ndarray

    def tails(self, z: np.ndarray) -> np.ndarray:
        """P(grade >= j) for each grade but the lowest."""
        return 1.0 / (1.0 + np.exp(np.clip(self.thresholds[None, :] - z[:, None], -60, 60)))


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for w in scan(batch.column("text")):
            flat, bounds = features(w)
            n = len(w.count)
            same = pa.array([hashlib.sha256(flat[a:b].tobytes()).digest()[:16] for a, b in zip(bounds, bounds[1:], strict=False)], pa.binary())
            lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(w.first, n), batch.column("grade").slice(w.first, n), same, lists], names=["doc_id", "grade", "same", "features"])


def _expit(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -60, 60)))


def _screened(rated: DataFrame, grades: list[int], counts: list[int], most_features: int) -> np.ndarray:
    """Buckets whose presence tells against the grades above some threshold, counted where the features are; the strongest ``most_features``."""
    total = sum(counts)
    held = rated.select("grade", F.explode("features").alias("bucket"))
    above = [F.sum((F.col("grade") >= g).cast("long")).alias(f"above{j}") for j, g in enumerate(grades[1:])]
    found = held.groupBy("bucket").agg(F.count("*").alias("n"), *above)
    scores = []
    for j in range(len(grades) - 1):
        mean = sum(counts[j + 1 :]) / total
        scores.append((F.col(f"above{j}") - F.col("n") * mean) / F.sqrt(F.col("n") * max(mean * (1 - mean), 1e-12)))
    found = found.where(F.col("n") >= LEAST_DOCS).withColumn("score", F.least(*scores) if len(scores) > 1 else scores[0]).where(F.col("score") < -SCREEN)
    return np.sort(found.orderBy("score", "bucket").limit(most_features).select("bucket").toArrow().column("bucket").to_numpy().astype(np.int32))


def fit(docs: DataFrame, ratings: DataFrame, most_rated: int = 12_288, seed: int = 3, most_features: int = 1 << 16) -> Ordinal:
    """The model of ``ratings`` (doc_id, grade) of ``docs`` (doc_id, text)."""
    rated = pick(ratings, doc_id="long", grade="int").where("doc_id IS NOT NULL AND grade IS NOT NULL")
    chosen = rated.orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id", "grade").limit(most_rated)
    # at most most_rated rows of 12 bytes
    texts = pick(docs, doc_id="long", text="string").join(F.broadcast(chosen), "doc_id")
    scratch = Scratch(docs.sparkSession, "rated")
    read = scratch.table(texts.mapInArrow(_featured, "doc_id long, grade int, same binary, features array<int>"), "read")
    once = scratch.table(read.groupBy("same", "grade").agg(F.first("features").alias("features")), "once")
    sizes = once.groupBy("grade").count().orderBy("grade").collect()  # a row a grade
    grades = [int(r["grade"]) for r in sizes]
    none = np.zeros(0)
    if len(grades) < 2:
        return Ordinal(none.astype(np.int32), none, none, np.array(grades, dtype=np.int64))
    buckets = _screened(once, grades, [int(r["count"]) for r in sizes], most_features)
    shared = docs.sparkSession.sparkContext.broadcast(buckets)  # most_features numbers

    def narrowed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [x[np.isin(x, shared.value, assume_unique=True)] for x in (np.asarray(f.values, dtype=np.int32) for f in batch.column("features"))]
            yield pa.RecordBatch.from_arrays([batch.column("grade"), batch.column("same"), pa.array([k.tobytes() for k in kept], pa.binary())], names=["grade", "same", "features"])

    # what passed the screening alone comes to the driver
    got = once.select("grade", "same", "features").mapInArrow(narrowed, "grade int, same binary, features binary").toArrow().sort_by([("same", "ascending"), ("grade", "ascending")])
    sets = [np.frombuffer(x, dtype=np.int32) for x in got.column("features").to_pylist()]
    scratch.drop(read, once)
    return fit_features(sets, got.column("grade").to_numpy().astype(np.int64), buckets)


def log_likelihood(model: Ordinal, sets: list[np.ndarray], grade: np.ndarray) -> float:
    """What fitting raises, by the definition: the balanced log-likelihood less the ridge, a document at a time."""
    y = np.searchsorted(model.grades, grade)
    share = np.bincount(y, minlength=len(model.grades)) / len(y)
    balance = 1.0 / np.sqrt(share[y])
    balance /= balance.mean()
    weights = dict(zip(model.buckets.tolist(), model.weights.tolist(), strict=True))
    total = 0.0
    for own, level, b in zip(sets, y.tolist(), balance.tolist(), strict=True):
        z = sum(weights.get(f, 0.0) for f in own.tolist())
        upto = [0.0, *(1.0 / (1.0 + np.exp(-(c - z))) for c in model.thresholds), 1.0]
        total += b * np.log(max(upto[level + 1] - upto[level], 1e-12))
    return total / len(y) - RIDGE * float((model.weights**2).sum()) / (2 * len(y))


def fit_features(sets: list[np.ndarray], grade: np.ndarray, buckets: np.ndarray) -> Ordinal:
    """Weights of ``buckets`` (sorted) and thresholds; ``sets`` hold buckets of these alone, ``grade`` two grades at least."""
    grades = np.unique(grade)
    y, n, steps = np.searchsorted(grades, grade), len(grade), len(grades) - 1
    f = np.searchsorted(buckets, np.concatenate(sets)) if len(sets) else np.zeros(0, np.int64)
    d = np.repeat(np.arange(n, dtype=np.int32), [len(s) for s in sets])
    balance = 1.0 / np.sqrt(np.bincount(y, minlength=steps + 1) / n)[y]
    balance /= balance.mean()
    below = np.array([np.mean(y <= j) for j in range(steps)])
    w, cut = np.zeros(len(buckets)), np.log(below / (1 - below))
    # the first threshold and logarithms of the gaps above it
    t = np.concatenate([cut[:1], np.log(np.maximum(np.diff(cut), 0.1))])
    state = [[np.zeros_like(x), np.zeros_like(x)] for x in (w, t)]
    for step in range(1, STEPS + 1):
        z = np.bincount(d, weights=w[f], minlength=n)
        cut = t[0] + np.concatenate([[0.0], np.cumsum(np.exp(t[1:]))])
        upper = np.where(y < steps, _expit(np.append(cut, np.inf)[y] - z), 1.0)
        lower = np.where(y > 0, _expit(np.concatenate([[-np.inf], cut])[y] - z), 0.0)
        p = np.maximum(upper - lower, 1e-12)
        by_upper = balance * np.where(y < steps, upper * (1 - upper), 0.0) / p / n
        by_lower = balance * np.where(y > 0, lower * (1 - lower), 0.0) / p / n
        gw = np.bincount(f, weights=(by_upper - by_lower)[d], minlength=len(w)) + RIDGE * w / n
        gc = np.bincount(y, weights=-by_upper, minlength=steps + 1)[:steps] + np.bincount(y, weights=by_lower, minlength=steps + 1)[1:]
        gt = np.concatenate([[gc.sum()], np.exp(t[1:]) * (gc[::-1].cumsum()[::-1][1:])])
        for x, g, (m, v) in zip((w, t), (gw, gt), state, strict=True):
            m *= 0.9
            m += 0.1 * g
            v *= 0.99
            v += 0.01 * g * g
            x -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        np.minimum(w, 0.0, out=w)
    cut = t[0] + np.concatenate([[0.0], np.cumsum(np.exp(t[1:]))])
    some = w < -1e-3
    return Ordinal(buckets[some].astype(np.int32), w[some], cut, grades)


def score(docs: DataFrame, model: Ordinal, name: str = "quality") -> DataFrame:
    """``docs`` with quality_grade (expected grade), quality_tail (chance of the top grade) beside its columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("struct<grade double, tail double>")
    def rate(texts: pd.Series) -> pd.DataFrame:
        m = shared.value
        table = np.zeros(1 << BITS)
        table[m.buckets] = m.weights
        z = np.zeros(len(texts))
        for w in scan(pa.Array.from_pandas(texts, type=pa.string())):
            flat, bounds = features(w)
            total = np.concatenate([[0.0], np.cumsum(table[flat])])
            z[w.first : w.first + len(w.count)] = total[bounds[1:]] - total[bounds[:-1]]
        if not len(m.thresholds):
            return pd.DataFrame({"grade": np.full(len(z), float(m.grades[-1]) if len(m.grades) else 0.0), "tail": np.ones(len(z))})
        tails = m.tails(z)
        return pd.DataFrame({"grade": np.round(m.grades[0] + tails @ np.diff(m.grades).astype(float), 6), "tail": np.round(tails[:, -1], 6)})

    scored = docs.withColumn("__rate", rate(F.col("text").cast("string")))
    own = (f"{name}_grade", f"{name}_tail")
    return scored.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in own], F.col("__rate.grade").alias(f"{name}_grade"), F.col("__rate.tail").alias(f"{name}_tail"))


def grades_of(labels: DataFrame) -> DataFrame:
    """Graded ratings out of the two labels: 0 toxic, 1 poor, 2 good; null where a label is missing."""
    return labels.select("doc_id", F.when(F.col("toxic").isNull() | F.col("quality").isNull(), None).when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).otherwise(2).alias("grade"))
