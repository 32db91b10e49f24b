"""The operators on documents against brute force, and their odd cases."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillframe.llm import _common, _text, lines, mixing, near_dedup, passages, piece_fst, quality, sharding, token_store
from quillframe.llm._components import components
from quillframe.llm._common import Scratch
from quillframe.llm.queries import tokenizer_path

from .fixtures import corpus, empty, frame

ROWS = corpus()


def words_of(text):
    return (text or "").encode().lower().split()


# --- shared scanning


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=40)), max_size=8))
def test_scan_finds_words_and_equal_hashes(texts):
    texts = [None if t is None else t.encode("utf-8", "ignore").decode() for t in texts]
    seen = {}
    at = 0
    for w in _text.scan(pa.array(texts, pa.string()), most=32):
        for d, count in enumerate(w.count):
            own = words_of(texts[at + d])
            assert count == len(own)
            lo = int(w.bounds[d])
            for i, word in enumerate(own):
                assert seen.setdefault(word, w.hash[lo + i]) == w.hash[lo + i]
        at += len(w.count)
    assert len(set(seen.values())) == len(seen)


def test_workers_give_memory_back_after_each_task(monkeypatch):
    done = []
    monkeypatch.setattr(_common, "release", lambda: done.append(1))
    assert list(_common.tidy(lambda batches: (2 * b for b in batches))(iter([1, 2]))) == [2, 4] and done == [1]


# --- line dedup


BLANK = " \t\n\x0b\x0c\r"


def brute_lines(rows, min_sites, share):
    texts = {t for _, t, _, _ in rows if t is not None}
    words = {t: [w for w in re.split("[ \t\n\x0b\x0c\r]+", t) if w] for t in texts}
    md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
    mark = {t: min((md5(" ".join(w[i : i + 3])) for i in range(len(w) - 2)), default=md5(t)) for t, w in words.items()}
    sites = defaultdict(set)
    for _, t, _, source in rows:
        for k in {x.strip(BLANK) for x in (t or "").split("\n")} - {""}:
            sites[k, mark[t]].add((source and "s" + source or "", t))
    homes, n, marks = defaultdict(set), Counter(), Counter()
    for (k, _), held in sites.items():
        homes[k].add(min(s for s, _ in held))
        n[k] += len({t for _, t in held})
        marks[k] += 1
    bad = {k for k in n if len(homes[k]) >= min_sites and marks[k] >= share * n[k]}
    return bad, [None if t is None else "\n".join(x for x in t.split("\n") if x.strip(BLANK) not in bad) for _, t, _, _ in rows]


def test_lines_match_brute_force(spark):
    bad, want = brute_lines(ROWS, 3, 0.15)
    assert "All rights reserved by nobody." in bad
    got = lines.remove_boilerplate(frame(spark), min_sites=3)
    assert Counter(r["text"] for r in got.collect()) == Counter(want)
    assert got.columns.count("n_lines") == 1
    assert lines.remove_boilerplate(empty(spark)).count() == 0


HEAD, FOOT = ["Site header", "Home News Contact"], ["All rights reserved", "Contact us", "Terms of use"]


def test_header_and_footer_blocks_go_whole(spark):
    rows = [(i, "\n".join([*HEAD, f"body {i} says {i * 7}", *FOOT]), "en", f"s{i % 20}") for i in range(200)]
    got = lines.remove_boilerplate(frame(spark, rows)).collect()
    assert {r["doc_id"]: r["text"] for r in got} == {i: f"body {i} says {i * 7}" for i in range(200)}


def test_copied_documents_keep_their_lines(spark):
    rows = [(i, "a b c\nd e f\ng h i", "en", f"s{i}") for i in range(20)]
    assert {r["n_removed"] for r in lines.remove_boilerplate(frame(spark, rows)).collect()} == {0}


def test_near_copies_keep_their_lines_and_lose_boilerplate(spark):
    rng = np.random.default_rng(4)
    page = [[f"w{rng.integers(4000)}" for _ in range(40)] for _ in range(5)]
    rows = []
    for i in range(150):
        own = [list(x) for x in page]
        for _ in range(3):
            own[rng.integers(5)][rng.integers(40)] = f"edit{rng.integers(10**9)}"
        rows.append((i, "\n".join([" ".join(x) for x in own] + FOOT[:1]), "en", f"s{i % 20}"))
    rows += [(1000 + i, f"own words {i} and {i * i}\n{FOOT[0]}", "en", f"s{i % 20}") for i in range(60)]
    got = lines.remove_boilerplate(frame(spark, rows)).collect()
    assert {r["n_removed"] for r in got} == {1} and not any(FOOT[0] in r["text"] for r in got)


# --- near dedup


def brute_near(rows, k, percent):
    sets = {}
    for d, t, _, _ in rows:
        if d is not None:
            w = words_of(t)
            sets[d] = frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])
    up = {d: d for d in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                up[y] = x
    return {d: (len(s), top(d)) for d, s in sets.items()}


@pytest.mark.parametrize(("k", "percent"), [(3, 85), (5, 80)])
def test_near_matches_brute_force(spark, k, percent):
    want = brute_near(ROWS, k, percent)
    got = near_dedup.near_duplicates(frame(spark), k, percent).collect()
    assert len(got) == len(ROWS)
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]]
            assert r["kept"] == (r["doc_id"] == r["component_id"])


def test_near_on_nothing(spark):
    assert near_dedup.near_duplicates(empty(spark)).count() == 0
    assert near_dedup.near_duplicates(frame(spark, [(1, None, None, None), (2, " ", None, None)])).where("kept").count() == 2


def test_near_branches_and_blocks_lose_nothing(spark, monkeypatch):
    for name, value in (("NODE", 4), ("PAIRS", 8), ("SHINGLES", 400), ("LEVELS", 2)):
        monkeypatch.setattr(near_dedup, name, value)
    want = brute_near(ROWS, 3, 85)
    got = near_dedup.near_duplicates(frame(spark), 3, 85).where("doc_id IS NOT NULL").collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {d: c for d, (_, c) in want.items()}


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (501, 500), (7, 7)], "a long, b long")
    got = {r["node"]: r["root"] for r in components(links, Scratch(spark, "t")).collect()}
    assert got == {i: 0 for i in range(201)} | {500: 500, 501: 500}


# --- passages


def test_planted_passage_is_found_everywhere(spark):
    holders = [d for d, t, _, _ in ROWS if t and d is not None and ROWS[5][1].split("\n")[-1].split(" ")[30] in t]
    passage = None
    for d, t, _, _ in ROWS:
        if d is not None and (d // 3) % 11 == 5 and t and len(t.split()) > 100:
            passage = t
            break
    assert passage and holders
    got = passages.repeated_passages(frame(spark)).collect()
    text = {d: words_of(t) for d, t, _, _ in ROWS if d is not None}
    covered = defaultdict(set)
    for r in got:
        assert r["ref_doc_id"] < r["doc_id"] and r["end_word"] - r["start_word"] >= 50
        if r["edits"] == 0:
            assert text[r["doc_id"]][r["start_word"] : r["end_word"]] == text[r["ref_doc_id"]][r["ref_start_word"] : r["ref_end_word"]]
        covered[r["doc_id"]].update(range(r["start_word"], r["end_word"]))
    first, need = {}, defaultdict(set)
    for d in sorted(text):
        for i in range(len(text[d]) - 49):
            g = tuple(text[d][i : i + 50])
            if first.setdefault(g, d) != d:
                need[d].update(range(i, i + 50))
    assert need and all(len(need[d] & covered[d]) >= 0.9 * len(need[d]) for d in need)
    assert sum(len(need[d] & covered[d]) for d in need) >= 0.99 * sum(map(len, need.values()))
    assert passages.repeated_passages(empty(spark)).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 60), st.integers(0, 60), st.integers(1, 8)), min_size=1, max_size=9))
def test_chain_scores_match_brute_force(found):
    segs = np.array(sorted(found))
    out = passages.chains(segs)
    assert sorted(i for c in out for i in c) == list(range(len(segs)))
    gap, best = passages.GAP, [0.0] * len(segs)
    for j in range(len(segs)):
        p, r, n = segs[j]
        best[j] = n + max([0.0, *(best[i] - gap * ((p - a - m) + (r - b - m)) for i, (a, b, m) in enumerate(segs[:j]) if a + m <= p and b + m <= r)])
    c = out[0]
    total = sum(segs[i][2] for i in c) - gap * sum((segs[j][0] - segs[i][0] - segs[i][2]) + (segs[j][1] - segs[i][1] - segs[i][2]) for i, j in zip(c, c[1:], strict=False))
    assert total == pytest.approx(max(best))


def fresh_words(tag, n):
    return [f"{tag}{zlib.crc32(f'{tag} {i}'.encode()):x}" for i in range(n)]


@pytest.mark.parametrize(("size", "between"), [(100, 100), (60, 45), (100, 20)])
def test_passages_with_other_words_between_are_both_found(spark, size, between):
    x, y = fresh_words("x", size), fresh_words("y", size)
    rows = [(i, " ".join(fresh_words(f"a{i}", 30) + x + fresh_words(f"b{i}", between) + y + fresh_words(f"c{i}", 30)), "en", "s") for i in (1, 2)]
    got = passages.repeated_passages(frame(spark, rows)).collect()
    spans = sorted((r["start_word"], r["end_word"], r["edits"]) for r in got)
    if between == 20:
        assert spans == [(30, 50 + 2 * size, 20)]
    else:
        assert spans == [(30, 30 + size, 0), (30 + size + between, 30 + 2 * size + between, 0)]


def test_a_passage_whose_parts_first_stood_apart_is_found(spark):
    # 3, 4 and 7 of each ten share X + Y, whose parts stand alone before and between
    rows, want = [], set()
    for t in range(0, 160, 10):
        x, y, z = (fresh_words(f"{c}{t}", n) for c, n in (("x", 30), ("y", 30), ("z", 80)))
        for i, m in enumerate([x, y, x + y, x + y, x, y, x + y, z, z], t + 1):
            rows.append((i, " ".join(fresh_words(f"a{i}", 40) + m + fresh_words(f"b{i}", 40)), "en", "s"))
        want |= {(t + 4, 40, 100, t + 3, 40, 100, 0), (t + 7, 40, 100, t + 3, 40, 100, 0), (t + 9, 40, 120, t + 8, 40, 120, 0)}
    got = {(r["doc_id"], r["start_word"], r["end_word"], r["ref_doc_id"], r["ref_start_word"], r["ref_end_word"], r["edits"]) for r in passages.repeated_passages(frame(spark, rows)).collect()}
    assert got == want


def test_passages_with_edits_are_found(spark):
    rng = np.random.default_rng(7)
    rows, pairs = [], 60
    for t in range(pairs):
        p = fresh_words(f"p{t}", 60)
        q = list(p)
        for i in rng.choice(60, 6 if t % 2 else 9, replace=False):
            q[i] = f"edit{t}at{i}"
        rows += [(2 * t + k, " ".join(fresh_words(f"a{t} {k}", 60) + m + fresh_words(f"b{t} {k}", 60)), "en", "s") for k, m in enumerate((p, q))]
    got = {r["doc_id"]: r for r in passages.repeated_passages(frame(spark, rows)).collect()}
    assert all(r["ref_doc_id"] == d - 1 and r["identity"] >= 0.8 for d, r in got.items())
    assert len(got) >= 0.95 * pairs


@pytest.mark.parametrize("before", [1, 5, 20])
def test_inexact_passages_whose_parts_first_stood_apart_are_found(spark, before):
    # X and Y stand alone in ``before`` documents each; two later ones share X + Y, with edits in the second also where X and Y meet
    rows, want = [], {}
    for t in range(0, 600, 60):
        x, y = (fresh_words(f"{c}{t}", 34) for c in "xy")
        whole, other = x + y, x + y
        for i in (9, 32, 33, 34, 52):
            other[i] = f"edit{t}at{i}"
        if t % 120:
            del other[33]
        for i, m in enumerate([x, y] * before + [whole, other], t + 1):
            rows.append((i, " ".join(fresh_words(f"a{i}", 40) + m + fresh_words(f"b{i}", 40)), "en", "s"))
        want[t + 2 * before + 2] = (t + 2 * before + 1, 40, 40 + len(other), 40, 108, 5)
    got = {r["doc_id"]: (r["ref_doc_id"], r["start_word"], r["end_word"], r["ref_start_word"], r["ref_end_word"], r["edits"]) for r in passages.repeated_passages(frame(spark, rows)).collect()}
    assert got == want


def test_inexact_repeats_of_scattered_parts_are_found(spark):
    # every document but the first 80 holds 64 words of an earlier one, an edit in each 12; all are made of parts that stand in many
    rng = np.random.default_rng(6)
    pieces = [fresh_words(f"p{i}", 16) for i in range(24)]
    texts = [sum((pieces[i] for i in rng.integers(0, 24, 10)), []) for _ in range(80)]
    for d in range(80, 160):
        own = list(texts[d - 80][32:96])
        for i in range(int(rng.integers(0, 12)), 64, 12):
            own[i] = f"edit{d}at{i}"
        texts.append(fresh_words(f"a{d}", 30) + own + fresh_words(f"b{d}", 30))
    rows = [(d, " ".join(t), "en", "s") for d, t in enumerate(texts)]
    covered = defaultdict(set)
    for r in passages.repeated_passages(frame(spark, rows)).collect():
        covered[r["doc_id"]].update(range(r["start_word"], r["end_word"]))
    caught = sum(len(covered[d] & set(range(30, 94))) >= 32 for d in range(80, 160))
    assert caught >= 78


def test_every_exact_repeat_of_scattered_parts_is_covered(spark):
    rng = np.random.default_rng(5)
    pieces = [fresh_words(f"p{i}", 17) for i in range(24)]
    rows = [(d, " ".join(sum((pieces[i] for i in rng.integers(0, 24, 12)), [])), "en", "s") for d in range(120)]
    covered = defaultdict(set)
    for r in passages.repeated_passages(frame(spark, rows)).collect():
        covered[r["doc_id"]].update(range(r["start_word"], r["end_word"]))
    first, missed, need = {}, 0, 0
    for d, t, _, _ in rows:
        w = words_of(t)
        for i in range(len(w) - 49):
            if first.setdefault(tuple(w[i : i + 50]), d) != d:
                need += 1
                missed += not covered[d] >= set(range(i, i + 50))
    assert need > 100 and not missed


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.booleans(), st.integers(1, 30)), min_size=1, max_size=12))
def test_parts_hold_the_longest_stretch(stretches):
    same = np.concatenate([np.full(n, s) for s, n in stretches])
    a = np.arange(len(same), dtype=np.uint32)
    b = np.where(same, a, a + 1000).astype(np.uint32)
    found = passages.parts(a, b, np.array([[0, 0, len(a)]]), 20, 0.8)
    edge = np.concatenate([[0], np.cumsum(same)])
    whole = [(j - i, i, j) for i in range(len(a)) for j in range(i + 20, len(a) + 1) if 5 * (edge[j] - edge[i]) >= 4 * (j - i) and same[i] and same[j - 1]]
    assert bool(found) == bool(whole)
    assert sum(x1 - x0 for x0, x1, *_ in found) <= len(a)
    for x0, x1, y0, y1, wrong, length in found:
        assert (x0, x1) == (y0, y1) and length == x1 - x0 >= 20 and wrong == int((~same[x0:x1]).sum()) and 5 * (length - wrong) >= 4 * length
    taken = np.zeros(len(a), bool)
    for x0, x1, *_ in found:
        assert not taken[x0:x1].any()
        taken[x0:x1] = True
    # what is wholly equal and long enough is never lost
    at = 0
    for s, n in stretches:
        if s and n >= 20:
            assert taken[at : at + n].all()
        at += n


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=9), st.lists(st.integers(0, 3), max_size=9))
def test_edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(new[j] + 1, row[j + 1] + 1, row[j] + (x != y)))
        row = new
    assert passages.edits(np.array(a, np.uint32), np.array(b, np.uint32))[0] == row[-1]


def plain_edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(new[j] + 1, row[j + 1] + 1, row[j] + (x != y)))
        row = new
    return row[-1]


@pytest.mark.parametrize(("n", "letters", "changes"), [(300, 50, 3), (300, 2, 60), (120, 3, 200), (400, 1000, 0)])
def test_edit_distance_of_long_gaps(n, letters, changes):
    rng = np.random.default_rng(n + letters)
    a = rng.integers(0, letters, n).tolist()
    b = list(a)
    for _ in range(changes):
        i = int(rng.integers(len(b)))
        b[i : i + int(rng.integers(0, 2))] = [int(rng.integers(letters))] * int(rng.integers(0, 2))
    for x, y in ((a, b), (b, a), (a, a[::-1]), (a, a[:7]), ([1] + a[1:], [2] + a[1:150] + a[151:])):
        assert passages.edits(np.array(x, np.uint32), np.array(y, np.uint32))[0] == plain_edits(x, y)


def test_a_gap_of_three_hundred_words_is_aligned(spark):
    # the gap holds an edit in every third word, so no seed; and one word less
    x, y, gap = fresh_words("x", 400), fresh_words("y", 400), fresh_words("g", 300)
    other = [f"other{i}" if i % 4 == 1 else w for i, w in enumerate(gap) if i != 150]
    rows = [(1, " ".join(x + gap + y), "en", "s"), (2, " ".join(x + other + y), "en", "s")]
    (got,) = passages.repeated_passages(frame(spark, rows)).collect()
    assert (got["start_word"], got["end_word"], got["ref_end_word"]) == (0, 1099, 1100)
    assert got["edits"] == plain_edits(gap, other)


# --- sharding


def test_repeated_rows_and_null_ids_are_split(spark, monkeypatch):
    monkeypatch.setattr(sharding, "ROWS_PER_RANGE", 50)
    rows = [(None if i % 2 else 7, "one text of all rows", "en", "s") for i in range(2400)]
    got = sharding.shard_documents(frame(spark, rows), shards=8).groupBy("shard").agg(F.sum("size").alias("b")).collect()
    sizes = [r["b"] for r in got]
    assert len(sizes) == 8 and max(sizes) < 1.03 * min(sizes)


def test_shards(spark):
    got = sharding.shard_documents(frame(spark), shards=7).collect()
    assert len(got) == len(ROWS)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t, _, _ in ROWS)
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
        assert r["law"] == "bytes" and r["grown_shard"] is None
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.shard_documents(empty(spark)).count() == 0


def test_a_hot_text_is_split_evenly(spark):
    rows = [(i, "same text " * 5 if i % 3 else f"own {i} " * 7, "en", "s") for i in range(3000)]
    got = sharding.shard_documents(frame(spark, rows), shards=8).groupBy("shard").agg(F.sum("size").alias("b")).collect()
    sizes = [r["b"] for r in got]
    assert len(sizes) == 8 and max(sizes) < 1.03 * min(sizes)


# --- mixing


def test_mix(spark):
    got = mixing.mix_documents(frame(spark)).collect()
    assert len(got) == len(ROWS)
    size = Counter()
    for _, t, _, s in ROWS:
        size[s] += len(words_of(t))
    names = sorted((s for s in size if s is not None), key=str.encode) + [None]
    goal = mixing.targets([size[s] for s in names], [(1.0, 2.0, 3.0)[i % 3] for i in range(len(names))])
    taken = Counter()
    for r in got:
        i = names.index(r["source"])
        assert r["source_size"] == size[r["source"]] and r["target"] == pytest.approx(goal[i])
        assert r["taken"] <= 3 * r["size"] and (not r["size"] or r["taken"] % r["size"] == 0)
        taken[r["source"]] += r["taken"]
    for s, g in zip(names, goal, strict=True):
        assert abs(taken[s] - g) <= max(1, 0.02 * g) or s is None
    again = {(r["doc_id"], r["size"], r["taken"]) for r in mixing.mix_documents(frame(spark)).collect()}
    assert again == {(r["doc_id"], r["size"], r["taken"]) for r in got}
    assert mixing.mix_documents(empty(spark)).count() == 0


def test_targets_stop_and_reshare():
    assert mixing.targets([10, 10, 80], [1, 1, 1]) == [30, 30, 40]
    assert sum(mixing.targets([5, 7, 0], [1, 2, 3])) == pytest.approx(12)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 30), st.integers(1, 6)), min_size=1, max_size=6, unique_by=lambda x: x[0]), st.integers(0, 400))
def test_budget_is_met_as_nearly_as_can_be(items, budget):
    lengths, counts = (np.array(x) for x in zip(*items, strict=True))
    n = mixing.fit_counts(lengths, counts, budget)
    assert ((n >= 0) & (n <= counts)).all()
    reach = {0}
    for length, count in items:
        reach = {r + length * c for r in reach for c in range(count + 1)}
    assert int((n * lengths).sum()) == max(r for r in reach if r <= budget)


def test_large_budgets_end_exactly():
    lengths, counts = np.arange(1, 400), np.full(399, 50)
    budget = 1_234_567
    assert int((mixing.fit_counts(lengths, counts, budget) * lengths).sum()) == budget


# --- token store


def test_store_round_trip(spark, tmp_path):
    from tokenizers import Tokenizer

    path = tokenizer_path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    folder = token_store.write_store(frame(spark), f"file://{tmp_path}/store", path)
    want, at = [], 0
    for d, t, _, _ in ROWS:
        want.append((d, tok.encode(t or "", add_special_tokens=False).ids + [2]))
    got = sorted(token_store.verify_store(spark, folder).collect(), key=lambda r: r["start"])
    assert all(r["verified"] for r in got)
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == Counter((d, len(i), zlib.crc32(np.array(i, "<u4"))) for d, i in want)
    ids = [r["doc_id"] for r in got]
    assert ids == sorted(ids, key=lambda d: (d is not None, d))
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]
    back = token_store.read_store(spark, folder).collect()
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in back) == Counter((d, tuple(i)) for d, i in want)
    digests = spark.read.parquet(f"{folder}/chunks").select("digest")
    assert digests.count() == digests.distinct().count()


def test_a_damaged_chunk_is_noticed(spark, tmp_path):
    folder = token_store.write_store(frame(spark, ROWS[:5]), f"file://{tmp_path}/one", tokenizer_path("word_bpe_49k.json"))
    chunks = spark.read.parquet(f"{folder}/chunks").collect()
    spoiled = [(bytes(r["digest"]), (b"\x07\x00" + bytes(r["ids"])[2:]) if i == 0 else bytes(r["ids"])) for i, r in enumerate(chunks)]
    spark.createDataFrame(spoiled, "digest binary, ids binary").write.mode("overwrite").parquet(f"{folder}/chunks")
    assert {r["verified"] for r in token_store.verify_store(spark, folder).collect()} == {True, False} or len(ROWS[:5]) == 1


def test_store_of_nothing(spark, tmp_path):
    folder = token_store.write_store(empty(spark), f"file://{tmp_path}/none", tokenizer_path("word_bpe_49k.json"))
    assert token_store.verify_store(spark, folder).count() == 0


def thue_morse(n, a="a", b="b"):
    return "".join(b if bin(i).count("1") % 2 else a for i in range(n))


#: words of equal polynomial hash, and what lower case would spoil
ODD_WORDS = [thue_morse(n, *x) for n in (64, 1024, 2048, 4096) for x in (("a", "b"), ("b", "a"))] + ["<|ENDOFTEXT|>", "x<|StartOfText|>y", "<|endoftext|>", "J\u030c", "T\u0308T", "DON'T"]


def test_words_of_equal_bytes_alone_are_one():
    raw = " ".join(ODD_WORDS * 2).encode()
    text = pa.array([raw.decode()])
    (w,) = _text.scan(text, hashes=False)
    first, which = _text.distinct(w.raw, w.start, w.end)
    assert len(first) == len(ODD_WORDS) and which.tolist() == list(range(len(ODD_WORDS))) * 2


def test_colliding_hashes_are_told_apart(monkeypatch):
    monkeypatch.setattr(_text, "word_hashes", lambda raw, start, end, lower: np.zeros(len(start), np.uint64))
    words = ["ab", "ab", "abc", "x" * 70, "x" * 69 + "y", "x" * 70, "123456789", "123456780", "ab"]
    (w,) = _text.scan(pa.array([" ".join(words)]), hashes=False)
    first, which = _text.distinct(w.raw, w.start, w.end)
    assert [words[first_at] for first_at in first[which]] == words and len(first) == 6


def test_odd_words_are_stored_and_linked_by_their_bytes(spark, tmp_path, pieces):
    from tokenizers import Tokenizer

    path = tokenizer_path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    rows = [(1, " ".join(ODD_WORDS), "en", "s"), *[(i + 2, f"one two {w}", "en", "s") for i, w in enumerate(ODD_WORDS)]]
    folder = token_store.write_store(frame(spark, rows), f"file://{tmp_path}/odd", path)
    assert {r["doc_id"]: list(r["ids"]) for r in token_store.read_store(spark, folder).collect()} == {d: [*tok.encode(t, add_special_tokens=False).ids, 2] for d, t, _, _ in rows}
    got = {r["doc_id"]: list(r["ids"]) for r in piece_fst.encode_documents(frame(spark, rows), tokenizer_path("piece_bpe_32k.model")).collect()}
    assert got == {d: pieces[1].encode(t) for d, t, _, _ in rows}
    near = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(frame(spark, [(i, f"{thue_morse(1024, *x)} and then", "en", "s") for i, x in enumerate((("a", "b"), ("b", "a")))]), 3, 85).collect()}
    assert near == {0: 0, 1: 1}


def test_whether_words_stand_alone_is_probed():
    assert token_store.Words(open(tokenizer_path("word_bpe_49k.json")).read(), np.uint16).by_word
    assert not token_store.Words(open(tokenizer_path("byte_bpe_50k.json")).read(), np.uint16).by_word


@settings(max_examples=80, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "THE", "J", "\u030c", "T", "\u0308", "<|Endoftext|>", "é", "ß", "İ", "'s", "'", "don't", "<|endoftext|>", "<|", "x,y", "1", "12", "²", "—", "́", " ", "  ", "\n", ".", "!!", "中", "😀"]), max_size=14))
def test_units_encode_as_whole_texts(parts):
    from tokenizers import Tokenizer

    text = "".join(parts)
    path = tokenizer_path("word_bpe_49k.json")
    words = test_units_encode_as_whole_texts.__dict__.setdefault("words", None) or token_store.Words(open(path).read(), np.uint16)
    test_units_encode_as_whole_texts.words = words
    tok = test_units_encode_as_whole_texts.__dict__.setdefault("tok", None) or Tokenizer.from_file(path)
    test_units_encode_as_whole_texts.tok = tok
    ((_, ids, _),) = token_store._by_word(pa.RecordBatch.from_arrays([pa.array([text])], names=["text"]), words)
    assert ids.tolist() == tok.encode(text, add_special_tokens=False).ids


# --- pieces


@pytest.fixture(scope="module")
def pieces():
    import sentencepiece

    path = tokenizer_path("piece_bpe_32k.model")
    return piece_fst.compile_model(path), sentencepiece.SentencePieceProcessor(model_file=path)


def test_pieces_match_the_library(pieces):
    machine, library = pieces
    for _, text, _, _ in ROWS:
        if text is not None and len(text) < 5000:
            assert machine.encode(text) == library.encode(text)
            assert machine.decode(machine.encode(text)) == library.decode(library.encode(text))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "th", "e", " ", "  ", "\n", "\t", "\r", ";\r", "é", "▁", "中", "😀", "1", "The", "́", "     ", "<s>", "<0x41>", "ing", "{", "}"]), max_size=24))
def test_pieces_match_on_odd_texts(pieces, parts):
    machine, library = pieces
    text = "".join(parts)
    assert machine.encode(text) == library.encode(text)
    units = piece_fst.Units(machine)
    ((_, ids, edges),) = units.encode(pa.array([text]))
    assert ids[edges[0] : edges[1]].tolist() == library.encode(text)


def test_encoding_documents(spark, pieces):
    _, library = pieces
    path = tokenizer_path("piece_bpe_32k.model")
    got = piece_fst.encode_digests(frame(spark), path).collect()
    want = Counter((d, None if t is None else len(library.encode(t)), None if t is None else zlib.crc32(np.array(library.encode(t), "<u4"))) for d, t, _, _ in ROWS)
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == want
    assert all(r["round_trip"] for r in got if r["n_tokens"] is not None)
    back = piece_fst.decode_documents(piece_fst.encode_documents(frame(spark), path), path).collect()
    assert Counter((r["doc_id"], r["text"]) for r in back) == Counter((d, t) for d, t, _, _ in ROWS)
    assert piece_fst.encode_digests(empty(spark), path).count() == 0


def test_unigram_paths_have_the_least_weight():
    def field(n, raw):
        return bytes([n << 3 | 2, len(raw)]) + raw

    import itertools
    import struct

    scores = {"a": -1.0, "b": -2.0, "ab": -2.5, "ba": -1.5, "aba": -9.0, "▁": -0.5, "▁a": -1.2}
    raw = field(1, field(1, b"<unk>") + bytes([3 << 3, 2]))
    for p, s in scores.items():
        raw += field(1, field(1, p.encode()) + bytes([2 << 3 | 5]) + struct.pack("<f", s))
    machine = piece_fst.Machine(raw + field(2, bytes([3 << 3, 1])) + field(3, bytes([3 << 3, 1, 4 << 3, 0])))
    for text in ("abba", "ababa", "a b", "bab ab"):
        path = machine.encode(text)
        whole = machine.normalise(text)
        best = min(-sum(scores[p] for p in cut) for n in range(1, len(whole) + 1) for ends in itertools.combinations(range(1, len(whole)), n - 1) for cut in [[whole[i:j] for i, j in zip((0, *ends), (*ends, len(whole)), strict=True)]] if all(p in scores for p in cut))
        assert -sum(machine.score[i] for i in path) == pytest.approx(best, abs=1e-5)
        assert machine.paths([whole.replace("▁", " ").encode()])[0].tolist() == path


def test_machines_have_states_and_arcs(pieces):
    machine, _ = pieces
    states = {0} | set(machine.held.values())
    assert len(states) == len(machine.accepts) == len(machine.held) + 1
    assert {i for i in machine.accepts.tolist() if i >= 0} == set(machine.ids.values())
    assert machine.arcs.n == len(machine.held) and (machine.weight == 0).all()
    # arcs of a piece, read from its end, lead to the state that accepts it
    for piece in ("▁the", "ing", "e"):
        state = 0
        for c in reversed(piece):
            state = machine.held[state * machine.width + machine.number[c]]
        assert machine.accepts[state] == machine.ids[piece]
    the, t, he = (machine.ids[p] for p in ("▁the", "▁t", "he"))
    assert machine.beside.one(-1, the) and not machine.beside.one(t, he)


def test_every_state_kept_gives_the_same_path(pieces):
    machine, _ = pieces
    units = [w.encode() for _, t, _, _ in ROWS[:20] if t for w in t.split(" ") if w] + [b"", "x\u00e9\u4e2d\U0001f600".encode(), b"\xff\xfe"]
    ids, n = machine.paths(units)
    want = [machine.shortest(machine.normalise(u.decode("utf-8", "replace"), begins=False)) for u in units]
    assert n.tolist() == [len(w) for w in want] and ids.tolist() == sum(want, [])


def test_round_trip_is_of_the_text_as_it_was(spark):
    rows = [(1, "a ▁ b", "en", "s"), (2, "a  b ", "en", "s"), (3, " ", "en", "s"), (4, None, "en", "s")]
    got = {r["doc_id"]: r["round_trip"] for r in piece_fst.encode_digests(frame(spark, rows), tokenizer_path("piece_bpe_32k.model")).collect()}
    assert got == {1: False, 2: True, 3: True, 4: None}


# --- quality


def test_quality_on_held_out(spark):
    rng = np.random.default_rng(0)
    good = ["alpha", "beta", "gamma", "delta", "omega", "sigma", "kappa"]

    def text(grade):
        w = list(rng.choice(good, rng.integers(5, 40)))
        if grade == 0:
            w.insert(int(rng.integers(len(w))), "scoundrel")
        if grade == 1:
            w = [x + "$$" for x in w]
        return " ".join(w)

    grades = [int(g) for g in rng.integers(0, 3, 900)]
    rows = [(i, text(g), "en", "s") for i, g in enumerate(grades)]
    docs = frame(spark, rows)
    rated = spark.createDataFrame([(i, g) for i, g in enumerate(grades) if i < 600] + [(5, None), (99999, 1), (None, 2)], "doc_id long, grade int")
    got = {r["doc_id"]: r for r in quality.score(docs, quality.fit(docs, rated)).collect()}
    held = range(600, 900)
    assert np.mean([(got[i]["quality_tail"] >= 0.5) == (grades[i] == 2) for i in held]) > 0.99
    assert np.mean([round(float(got[i]["quality_grade"])) == grades[i] for i in held]) > 0.95


def brute_features(text):
    """Buckets by the definition, a word at a time."""
    words = [w for w in re.split(rb"[ \t\n\x0b\x0c\r]+", (text or "").encode().lower()) if w]
    raw = (text or "").encode()
    w = next(iter(_text.scan(pa.array([text or ""]))), None)
    hashes = w.hash.tolist() if w else []
    shift = 64 - quality.BITS
    out = {h >> shift for h in hashes}
    for x in words:
        code = 0
        for j in (3, 2, 1):
            code = code * 257 + (x[-j] if len(x) >= j else 0)
        out.add(int(_text.mix(np.array([code + 77], np.uint64))[0]) >> shift)
    share = sum(a == b for a, b in zip(words, words[1:], strict=False)) / max(len(words), 1)
    out |= {int(_text.mix(np.array([1000 + i], np.uint64))[0]) >> shift for i, r in enumerate(quality.REPEATS) if share >= r}
    assert len(raw) >= len(words)
    return out


def test_quality_scores_match_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(i, t, "en", "s") for i, (_, t, _, _) in enumerate(ROWS)]
    rows = [(d, (t or "") + " awful" * int(rng.integers(1, 4)) if d % 3 == 0 else t, x, y) for d, t, x, y in rows]
    rated = spark.createDataFrame([(d, int(d % 3 != 0) + int(d % 5 != 0 and d % 3 != 0)) for d, *_ in rows], "doc_id long, grade int")
    docs = frame(spark, rows)
    model = quality.fit(docs, rated)
    assert len(model.buckets) and list(model.thresholds) == sorted(model.thresholds)
    weight = dict(zip(model.buckets.tolist(), model.weights.tolist(), strict=True))
    got = {r["doc_id"]: r for r in quality.score(docs, model).collect()}
    for d, t, _, _ in rows:
        z = sum(weight.get(f, 0.0) for f in brute_features(t))
        tails = [1 / (1 + np.exp(c - z)) for c in model.thresholds]
        assert got[d]["quality_tail"] == pytest.approx(tails[-1], abs=2e-6)
        assert got[d]["quality_grade"] == pytest.approx(model.grades[0] + sum(x * (b - a) for x, a, b in zip(tails, model.grades, model.grades[1:], strict=False)), abs=2e-6)


def test_fitting_climbs_the_likelihood():
    rng = np.random.default_rng(5)
    buckets = np.arange(0, 60, 2, dtype=np.int32)
    bad = rng.normal(size=30) < 0
    sets, grade = [], []
    for _ in range(400):
        own = np.sort(rng.choice(buckets, 6, replace=False))
        sets.append(own.astype(np.int32))
        grade.append(int(np.clip(2 - sum(bad[np.searchsorted(buckets, own)]) / 2 + rng.normal() * 0.4, 0, 2)))
    grade = np.array(grade)
    model = quality.fit_features(sets, grade, buckets)
    best = quality.log_likelihood(model, sets, grade)
    for _ in range(40):  # no step in any allowed direction does better
        w = np.minimum(model.weights + rng.normal(size=len(model.weights)) * 0.05, 0.0)
        cut = np.sort(model.thresholds + rng.normal(size=2) * 0.05)
        assert quality.log_likelihood(model._replace(weights=w, thresholds=cut), sets, grade) <= best + 1e-4


def test_quality_without_ratings_keeps_all(spark):
    none = spark.createDataFrame([], "doc_id long, grade int")
    docs = frame(spark)
    scored = quality.score(docs, quality.fit(docs, none))
    assert scored.where("quality_tail >= 0.5").count() == len(ROWS)
    assert scored.columns.count("quality_grade") == 1
    assert quality.score(empty(spark), quality.fit(docs, none)).count() == 0
