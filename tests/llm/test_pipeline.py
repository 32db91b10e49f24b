"""The pipeline's stages, and the queries' registration."""

from __future__ import annotations

from collections import Counter

import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from quillframe.llm import mixing, quality
from quillframe.llm.queries import tokenizer_path

import __spark_entry__

from .fixtures import corpus, empty, frame

SF = "/root/testdata/sf0.001"


def test_stages_keep_the_columns_and_whole_run_matches(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    first = docs
    rows = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == first.columns and docs.dtypes == first.dtypes
        rows.append(docs.count())
    assert rows[1] <= rows[0] and rows[2] <= rows[1] and rows[3] <= rows[2] and rows[5] == rows[4] > 0
    assert docs.where(~F.col("round_trip")).count() == 0


ODD = [(1, "one two three four five six seven eight", "en", "s0"), (2, "one two three four five six seven eight", "fr", "s1"), (None, "no id here", "en", "s0"), (None, "no id here", "en", "s0"), (None, None, None, None), (3, None, "en", "s1"), (3, " \n", "en", "s1"), (3, "quite another text of the same id as those", "en", "s1"), (3, "and one more of that id which is unlike all others", "en", None), (4, "", "en", "s0"), (5, "repeated row of seven words in all", "en", "s0"), (5, "repeated row of seven words in all", "en", "s0"), (6, "and one more of that id which is unlike all others", "de", "s0")]


def brute_kept(rows, k=5, percent=80):
    """Rows that stay: a union-find over (doc_id, text), the least of each group; equal rows once; rows without id all."""
    nodes = sorted({(d, t) for d, t, _, _ in rows if d is not None}, key=lambda x: (x[0], x[1] or ""))
    sets = {n: shingles(n[1], k) for n in nodes}
    up = {n: n for n in nodes}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in nodes:
        for b in nodes:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                up[top(a)] = top(b)
    groups = {}
    for n in nodes:
        groups.setdefault(top(n), []).append(n)
    return groups


def shingles(text, k):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


@pytest.mark.parametrize("rows", [ODD, corpus(), ODD + ODD, [r for r in ODD if r[0] != 5]], ids=["odd", "corpus", "all twice", "no repeats"])
def test_near_copies_leave_one_each(spark, rows):
    kept = corpus_pipeline.drop_near_copies(spark, frame(spark, rows), SF)
    assert kept.columns == list(corpus_pipeline.COLUMNS)
    got = Counter((r["doc_id"], r["text"]) for r in kept.collect())
    groups = brute_kept(rows)
    assert sum(got.values()) == len(groups) + sum(d is None for d, *_ in rows)
    for d, t, _, _ in rows:
        if d is None:
            assert got[d, t] == sum(r[:2] == (d, t) for r in rows)
    for members in groups.values():
        here = [n for n in members if got[n]]
        assert len(here) == 1 and got[here[0]] == 1 and here[0][0] == min(d for d, _ in members)


def test_what_stays_doesnt_depend_on_other_rows(spark):
    base = [(None, "same text", "en", "s"), (None, "same text", "en", "s"), (1, "all by itself in here", "en", "s")]
    for rows in (base, [*base, base[2]]):
        got = Counter((r["doc_id"], r["text"]) for r in corpus_pipeline.drop_near_copies(spark, frame(spark, rows), SF).collect())
        assert got == Counter((d, t) for d, t, _, _ in base)


@pytest.mark.parametrize("rows", [ODD, corpus()], ids=["odd", "corpus"])
def test_mix_repeats_each_row_by_its_own_passes(spark, rows):
    docs = frame(spark, rows).select(*corpus_pipeline.COLUMNS)
    passes = Counter()
    for r in mixing.mix_documents(docs).collect():
        passes[r["row_key"]] += r["passes"]
    got = corpus_pipeline.mix(spark, docs, SF)
    assert got.columns == docs.columns and got.dtypes == docs.dtypes
    keyed = Counter(r["k"] for r in got.select(mixing.row_key(got).alias("k")).collect())
    assert keyed == +passes


def test_mix_meets_targets_without_ids(spark):
    rows = [(None, " ".join(f"w{i}x{j}" for j in range(10)), "en", f"s{i % 3}") for i in range(240)]
    docs = frame(spark, rows).select(*corpus_pipeline.COLUMNS)
    words = Counter()
    for r in corpus_pipeline.mix(spark, docs, SF).collect():
        words[r["source"]] += len(r["text"].split())
    for s, goal in zip(("s0", "s1", "s2"), (400, 800, 1200), strict=True):
        assert abs(words[s] - goal) <= 0.02 * goal


def test_lines_and_classes_by_content(spark):
    rows = [(i if i % 9 else None, f"text {i} of its own\nAll rights reserved", "en", f"s{i % 20}") for i in range(200)] + [(900, "All rights reserved", "en", "s1"), (901, None, "en", "s1"), (902, "", "en", "s1"), (903, "x\ny", "en", "s1")]
    got = Counter(r["text"] for r in corpus_pipeline.strip_lines(spark, frame(spark, rows), SF).collect())
    assert got == Counter([f"text {i} of its own" for i in range(200)] + [None, "", "x\ny"])
    docs = frame(spark, ODD)
    model = quality.fit(docs, quality.grades_of(spark.read.parquet(f"{SF}/labels.parquet")))
    want = Counter((r["doc_id"], r["text"]) for r in quality.score(docs, model).where("quality_tail >= 0.5").collect())
    assert Counter((r["doc_id"], r["text"]) for r in corpus_pipeline.classify(spark, docs, SF).collect()) == want


def test_stages_on_nothing(spark):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty(spark), SF).count() == 0, name


def test_the_last_stage_encodes_every_row(spark):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    got = Counter((r["doc_id"], r["n_tokens"]) for r in corpus_pipeline.encode(spark, frame(spark, ODD), SF).collect())
    assert got == Counter((d, None if t is None else len(library.encode(t))) for d, t, _, _ in ODD)


def test_every_operator_is_registered():
    names = __spark_entry__.queries()
    for n in range(1, 11):
        assert sum(x.startswith(f"op{n}_") for x in names) == 1
    assert "pipeline" in names
