"""Vector searches against brute force."""

from __future__ import annotations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillframe.llm import hilbert_search, pivot_search

SCHEMA = "vec_id long, embedding array<double>, v string, rep int, label int"


def vectors(n=700, dim=16, seed=2):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim)) * rng.uniform(0.2, 1.5, size=(n, 1))
    x[50:120] = x[50]  # a common vector
    rows = [(i, x[i].tolist(), "a", 1, 2) for i in range(n)]
    rows[3] = (3, None, "a", 1, 2)
    rows[4] = (4, [1.0, None, *[0.0] * (dim - 2)], "a", 1, 2)
    rows[5] = (5, [float("nan")] * dim, "a", 1, 2)
    rows[6] = (6, [float("inf")] * dim, "a", 1, 2)
    rows[7] = (7, [0.0] * dim, "a", 1, 2)
    rows[8] = (8, [3e5] * dim, "a", 1, 2)
    rows += [rows[9], (None, x[1].tolist(), "a", 1, 2)]
    return rows


def usable(rows, zero):
    out = {}
    for i, e, *_ in rows:
        if i is not None and e is not None and all(v is not None and np.isfinite(v) for v in e) and (zero or any(e)):
            out[i] = np.array(e)
    return out


def test_exact_search(spark):
    rows = vectors()
    x = {i: [int(np.floor(1024 * v)) for v in e] for i, e in usable(rows, True).items()}
    got = {}
    for r in pivot_search.top_k(spark.createDataFrame(rows, SCHEMA)).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    want = {}
    for q in x:
        if q % 100 == 0:
            s = sorted((-sum(a * b for a, b in zip(x[q], x[c], strict=True)), c) for c in x if c != q)[:10]
            want[q] = [(n + 1, c, -v) for n, (v, c) in enumerate(s)]
    assert {q: sorted(v) for q, v in got.items()} == want


def test_exact_search_on_little(spark):
    assert pivot_search.top_k(spark.createDataFrame([], SCHEMA)).count() == 0
    one = spark.createDataFrame([(0, [1.0, 2.0], "a", 1, 2)], SCHEMA)
    assert pivot_search.top_k(one).count() == 0
    few = spark.createDataFrame([(0, [1.0], "a", 1, 2), (1, [1.0, 5.0], "a", 1, 2), (2, [], "a", 1, 2)], SCHEMA)
    assert [(r["query_id"], r["vec_id"], r["score"]) for r in sorted(pivot_search.top_k(few).collect(), key=lambda r: r["rank"])] == [(0, 1, 1024 * 1024), (0, 2, 0)]


def test_exact_products_beyond_64_bits():
    big = np.array([[1 << 62, 5]])
    assert pivot_search.exact_products(big, big)[0, 0] == (1 << 63) - 1
    a = np.array([[(1 << 31) + 1, 3]])
    assert pivot_search.exact_products(a, np.array([[1 << 30, 7]]))[0, 0] == ((1 << 31) + 1) * (1 << 30) + 21


def test_approximate_search_recall(spark):
    rows = vectors(1500)
    x = usable(rows, False)
    ids = np.array(sorted(x))
    m = np.array([x[i] for i in ids])
    got = {}
    for r in hilbert_search.nearest(spark.createDataFrame(rows, SCHEMA)).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == {i for i in x if i % 20 == 0}
    hits = 0
    for q, found in got.items():
        s = m @ x[q]
        order = [i for i in np.lexsort((ids, -s)) if ids[i] != q][:20]
        assert [f[0] for f in sorted(found)] == list(range(1, 21))
        for _, v, score in found:
            assert score == pytest.approx(float(np.dot(x[q], x[v])), rel=1e-12)
        keys = [(-f[2], f[1]) for f in sorted(found)]
        assert keys == sorted(keys)
        kth = s[order[-1]]
        hits += sum(f[2] >= kth - 1e-12 for f in found)
    assert hits / (20 * len(got)) >= 0.9


def test_few_blocks_go_in_one_batch(spark, monkeypatch):
    rng, met = np.random.default_rng(4), hilbert_search._met

    def watched(dim, k):
        inner = met(dim, k)

        def run(batches):
            def few():
                for b in batches:
                    assert b.num_rows <= 8
                    yield b

            return inner(few())

        return run

    monkeypatch.setattr(hilbert_search, "_met", watched)
    centres = rng.normal(size=(60, 8))
    rows = [(i, (centres[i % 60] + 0.01 * rng.normal(size=8)).tolist(), "a", 1, 2) for i in range(2400)]
    assert hilbert_search.nearest(spark.createDataFrame(rows, SCHEMA)).count() == 120 * 20


def test_approximate_search_on_little(spark):
    assert hilbert_search.nearest(spark.createDataFrame([], SCHEMA)).count() == 0
    few = spark.createDataFrame([(0, [1.0, 0.0], "a", 1, 2), (1, [1.0, 5.0], "a", 1, 2), (2, [0.0, 0.0], "a", 1, 2), (3, [1.0, 0.0], "a", 1, 2)], SCHEMA)
    got = sorted((r["rank"], r["vec_id"]) for r in hilbert_search.nearest(few).collect())
    assert got == [(1, 1), (2, 3)]


@settings(max_examples=20, deadline=None)
@given(st.integers(1, 4), st.integers(1, 3))
def test_hilbert_neighbours_differ_by_one_step(dims, bits):
    grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), axis=-1).reshape(-1, dims)
    key = hilbert_search.hilbert_keys(grid, bits)
    assert sorted(key.tolist()) == list(range(len(grid)))
    walk = grid[np.argsort(key)]
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_overflowing_products_are_found():
    q, x = np.array([[1e200, 0.0], [1.0, 2.0]]), np.array([[1e200, 0.0], [-1e200, 0.0], [1.0, 1.0], [1e200, 1e200]])
    at, to, score = hilbert_search._best(np.array([100, 101]), q, np.array([1, 2, 3, 4]), x, 2)
    got = {(int(a), int(b)): float(s) for a, b, s in zip(at, to, score, strict=True)}
    assert got[100, 1] == got[100, 4] == float("inf") and got[101, 4] == 1e200 + 2e200


def test_products_near_nothing_lose_no_neighbour():
    rng = np.random.default_rng(0)
    q, x = rng.normal(size=(20, 64)), rng.normal(size=(300, 64))
    x -= (x @ q[0])[:, None] * q[0] / (q[0] @ q[0])  # all at right angles to the first query
    at, to, score = hilbert_search._best(np.arange(20) + 1000, q, np.arange(300), x, 5)
    want = hilbert_search.exact(np.repeat(q[:1], 300, axis=0), x)
    assert set(np.lexsort((np.arange(300), -want))[:5]) <= set(to[at == 1000])
