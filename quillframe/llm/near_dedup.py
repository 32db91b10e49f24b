"""MinHash near-dedup by a chosen-path similarity join.

Documents with the same shingle set are one class; classes carry ``COORDS`` minwise tokens. In each
of ``trees`` trees a class descends from the root to ``BRANCH`` children, each named by
a coordinate that the node's seed selects and the class's token there. Similar sets agree on most
tokens and so share paths; unrelated ones part at once. Nodes that are small enough are compared
exhaustively; larger ones branch again. With two branches, the chance that a pair
shares no small node in a tree is at most the extinction probability q of q = (1 - s + s*q)^2,
where s is the share of tokens the pair agrees on. The trees draw from the same ``COORDS`` tokens, so
they aren't independent: averaged over Binomial(COORDS, similarity) agreeing tokens, the bound on the
chance that all 6 miss a link is 3.3e-7 at a similarity of 0.85 (1.1e-5 at 0.8).

Comparing is in two steps. Fingerprints of ``BINS`` bytes (the least shingle of each bin; for short
texts nearly the set itself) tell which members of a node have a partner within ``SLACK`` of the
threshold, five standard deviations. Only these meet again with their full shingle sets, and a node
hands on no pairs but a spanning forest of the links confirmed there. A pair that shares several
small nodes is looked at in the first of them alone.

Large groups of near copies would agree on every token and never part. So the first level serves
twice: each node's most typical member (the one whose tokens are most widely shared) is its hub, and
links with hubs are confirmed first. A node is then compared only across the components so formed,
which leaves nothing to do inside a group, while no link between components is lost. Nodes still
large at the last level are compared in blocks of candidates against chunks of those outside the
largest component, each pair of them a group of its own; nothing is capped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import Scratch, pick, small_batches, tidy
from ._components import components
from ._text import mix, scan, shingle_sets

COORDS = 64
BINS = 512
BRANCH = 2
LEVELS = 6
SLACK, HUB_SLACK = 0.08, 0.15
#: what one task compares: members, pairs across components, and shingles of the members
NODE, PAIRS, SHINGLES = 4096, 1 << 22, 1 << 22
SEED = 0x5EED


def _coefficients() -> tuple[np.ndarray, np.ndarray]:
    x = mix(np.arange(1, 2 * COORDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return x[:COORDS] | np.uint64(1), x[COORDS:]


def _tokens(sets: list[np.ndarray]) -> np.ndarray:
    """Minwise tokens (uint32) of sets that aren't empty: a row for each set."""
    a, b = _coefficients()
    flat, bounds = np.concatenate(sets), np.cumsum([0] + [len(s) for s in sets[:-1]])
    out = np.empty((len(sets), COORDS), dtype=np.uint32)
    for j in range(COORDS):
        out[:, j] = np.minimum.reduceat((flat * a[j] + b[j]) >> np.uint64(32), bounds)
    return out


def _print(shingles: np.ndarray) -> bytes:
    """A byte for each bin of hash values: 0 if empty, else from its least shingle."""
    top = (shingles >> np.uint64(64 - 9)).astype(np.int64)
    first = np.ones(len(top), dtype=bool)
    first[1:] = top[1:] != top[:-1]
    out = np.zeros(BINS, dtype=np.uint8)
    out[top[first]] = (mix(shingles[first]) % np.uint64(255)).astype(np.uint8) + 1
    return out.tobytes()


def sketcher(k: int):
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column("text")
            for w in scan(texts):
                sets = shingle_sets(w, k)
                n = np.array([len(s) for s in sets], dtype=np.int64)
                some = np.flatnonzero(n)
                hi, lo, packed, prints = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64), [None] * len(n), [None] * len(n)
                if len(some):
                    tokens = _tokens([sets[i] for i in some])
                    for row, i in enumerate(some):
                        m = mix(sets[i])
                        hi[i], lo[i] = m.sum(dtype=np.uint64).view(np.int64), np.bitwise_xor.reduce(mix(m + np.uint64(1))).view(np.int64)
                        packed[i] = tokens[row].tobytes()
                        prints[i] = _print(sets[i])
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(w.first, len(n)), batch.column("t").slice(w.first, len(n)), pa.array(n), pa.array(hi), pa.array(lo), pa.array(packed, pa.binary()), pa.array(prints, pa.binary())],
                    names=["doc_id", "t", "n_shingles", "hi", "lo", "tokens", "print"],
                )

    return sketch


def _matrix(column: pa.Array, dtype, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=dtype).reshape(-1, width)


def _paths(trees: int):
    """Each class's nodes of the first level, side by side: BRANCH for each tree."""

    def paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = _matrix(batch.column("tokens"), np.uint32, COORDS)
            seeds = mix(np.arange(trees, dtype=np.uint64) + np.uint64(SEED))
            out = np.column_stack([c for s in seeds for c in _children(np.broadcast_to(s, len(tokens)), tokens)])
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1, dtype=np.int32) * out.shape[1]), pa.array(out.view(np.int64).ravel()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc", "n", "tokens", "print")), lists], names=["doc", "n", "tokens", "print", "paths"])

    return paths


def _children(node: np.ndarray, tokens: np.ndarray) -> list[np.ndarray]:
    """The children of each node that each row goes to: BRANCH arrays of node names."""
    h = mix(node + np.uint64(0xA5))
    coord = (h % np.uint64(COORDS)).astype(np.int64)
    step = ((h >> np.uint64(32)) % np.uint64(COORDS - 1)).astype(np.int64) + 1
    rows, out = np.arange(len(node)), []
    for b in range(BRANCH):
        c = (coord + b * step) % COORDS
        out.append(mix(mix(node * np.uint64(31) + c.astype(np.uint64)) + tokens[rows, c].astype(np.uint64)))
    return out


def _next_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        tokens = _matrix(batch.column("tokens"), np.uint32, COORDS)
        node = batch.column("node").to_numpy(zero_copy_only=False).view(np.uint64)
        out = _children(node, tokens)
        ids, n = (np.tile(batch.column(c).to_numpy(zero_copy_only=False), len(out)) for c in ("doc", "n"))
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(n), pa.array(np.concatenate(out).view(np.int64)), pa.array(np.full(len(ids), 99, np.int32))], names=["doc", "n", "node", "at"])


def _similar(least: float):
    """Pairs (a, b) whose tokens agree enough, from rows with both sides' tokens."""

    def similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (_matrix(batch.column(c), np.uint32, COORDS) for c in ("ta", "tb"))
            keep = pa.array((x == y).mean(axis=1) >= least) if batch.num_rows else pa.array([], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], names=["a", "b"])

    return similar


KEY = ("node", "chunk", "block")


def _groups(batches: Iterator[pa.RecordBatch], extract) -> Iterator[dict[str, np.ndarray]]:
    """Rows of one (node, chunk, block) after another, from batches sorted by it."""
    held: dict[str, np.ndarray] | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in (*KEY, "at", "doc", "root", "query", "cand", "mask")}
        rows["print"] = _matrix(batch.column("print"), np.uint8, BINS)
        rows["paths"] = batch.column("paths").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
        rows |= extract(batch)
        if held is not None:
            rows = {c: np.concatenate([held[c], rows[c]]) for c in rows}
        new = np.zeros(len(rows["doc"]), dtype=bool)
        for c in KEY:
            new[1:] |= rows[c][1:] != rows[c][:-1]
        edges = [0, *np.flatnonzero(new).tolist()]
        for a, b in zip(edges, edges[1:], strict=False):
            yield {c: v[a:b] for c, v in rows.items()}
        held = {c: v[edges[-1] :] for c, v in rows.items()}
    if held is not None:
        yield held


def _near(g: dict[str, np.ndarray], q: int, cand: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Candidates near enough to row q by fingerprints, in other components, not met in an earlier small node; and how near."""
    c = cand[g["root"][cand] != g["root"][q]]
    met = (g["paths"][c] == g["paths"][q]) & ((g["mask"][q] >> np.arange(g["paths"].shape[1])) & 1).astype(bool)
    c = c[~met[:, : int(g["at"][q])].any(axis=1)]
    x, y = g["print"][q], g["print"][c]
    some = (y != 0) | (x != 0)
    share = ((y == x) & some).sum(axis=1) / np.maximum(some.sum(axis=1), 1)
    keep = share >= least
    return c[keep], share[keep]


def _flagged(least: float):
    """Members with a near partner: (node, chunk, block, doc)."""

    def flagged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[np.ndarray, ...]] = []
        size = 0
        for g in _groups(batches, lambda b: {}):
            cand = np.flatnonzero(g["cand"])
            hit = np.zeros(len(g["doc"]), dtype=bool)
            for q in np.flatnonzero(g["query"]):
                c, _ = _near(g, q, cand, least)
                if len(c):
                    hit[c] = hit[q] = True
            if hit.any():
                out.append(tuple(g[c][hit] for c in (*KEY, "doc")))
                size += int(hit.sum())
            if size > 50_000:
                yield _batch(out)
                out, size = [], 0
        yield _batch(out)

    return flagged


def _batch(out: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.int64)]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=[*KEY, "doc"])


def _spanning(least: float, percent: int):
    """Links (a, b) confirmed on full sets that join components of a node, no more than its members."""

    def spanning(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def shingles(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
            out = np.empty(batch.num_rows, dtype=object)
            out[:] = batch.column("shingles").to_pylist()
            return {"shingles": out}

        for g in _groups(batches, shingles):
            cand = np.flatnonzero(g["cand"])
            shares, asking, asked = [], [], []
            for q in np.flatnonzero(g["query"]):
                c, share = _near(g, q, cand, least)
                shares.append(share.astype(np.float32))
                asking.append(np.full(len(c), q, dtype=np.int32))
                asked.append(c.astype(np.int32))
            if not shares:
                continue
            # nearest first; twelve bytes a pair, PAIRS of them at most
            share, asking, asked = np.concatenate(shares), np.concatenate(asking), np.concatenate(asked)
            del shares
            order = np.argsort(-share, kind="stable").astype(np.int32)
            del share
            up: dict[int, int] = {}

            def top(x: int) -> int:
                while up.get(x, x) != x:
                    up[x] = x = up.get(up[x], up[x])
                return x

            root, a, b = g["root"].tolist(), [], []
            sets = [np.frombuffer(x, np.uint64) for x in g["shingles"]]
            for start in range(0, len(order), 65_536):
                part = order[start : start + 65_536]
                for q, c in zip(asking[part].tolist(), asked[part].tolist(), strict=True):
                    x, y = top(root[q]), top(root[c])
                    if x != y and linked(sets[q], sets[c], percent):
                        up[x] = y
                        a.append(int(g["doc"][q]))
                        b.append(int(g["doc"][c]))
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return spanning


def linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union of two sorted sets."""
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    both = np.concatenate([x, y])
    both.sort()
    shared = int((both[1:] == both[:-1]).sum())
    return 100 * shared >= percent * (len(x) + len(y) - shared)


def _sets(k: int):
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column("doc"), batch.column("text")
            for w in scan(texts):
                found = [s.tobytes() for s in shingle_sets(w, k)]
                yield pa.RecordBatch.from_arrays([ids.slice(w.first, len(found)), pa.array(found, pa.binary())], names=["doc", "shingles"])

    return sets


def _confirm(percent: int):
    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, dtype=bool)
            for i, (x, y) in enumerate(zip(batch.column("sa"), batch.column("sb"), strict=True)):
                keep[i] = linked(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), percent)
            mask = pa.array(keep)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(mask), batch.column("b").filter(mask)], names=["a", "b"])

    return confirm


def _full(wanted: DataFrame, texts: DataFrame, k: int, scratch: Scratch) -> DataFrame:
    """doc, shingles of the wanted documents, once each; merged at every size, so that the plan doesn't change as the corpus grows."""
    sets = texts.join(wanted.hint("merge"), "doc", "left_semi").mapInArrow(tidy(_sets(k)), "doc long, shingles binary")
    return scratch.table(sets, "sets").where(F.octet_length("shingles") > 0).dropDuplicates(["doc"])


def _confirmed(pairs: DataFrame, texts: DataFrame, k: int, percent: int, scratch: Scratch) -> DataFrame:
    """Those of ``pairs`` (a, b) whose full shingle sets are similar enough."""
    wanted = pairs.select(F.col("a").alias("doc")).union(pairs.select(F.col("b").alias("doc"))).distinct()
    full = _full(wanted, texts, k, scratch)
    left, right = (full.select(F.col("doc").alias(c), F.col("shingles").alias(f"s{c}")) for c in "ab")
    return scratch.table(pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb").mapInArrow(tidy(_confirm(percent)), "a long, b long"), "confirmed")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, trees: int = 6) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs`` (doc_id, text); and text_key, cluster.

    Linked: 100 * intersection >= percent * union of the distinct k-word shingle sets. Texts without
    words are linked with nothing. component_id is the smallest doc_id of a component, and ``kept`` marks
    its rows. Repeated rows give repeated results; rows of one doc_id with other texts each follow
    their own text. A row without doc_id takes no part: no component, kept. text_key is a hash of
    the text and cluster names the component, also where one doc_id stands in several; it is null for
    rows that take no part or have no words. Very long texts are read whole; other columns are
    ignored, whatever their names; an empty table gives an empty result.
    """
    with small_batches(docs.sparkSession):
        return _near_duplicates(docs, k, percent, trees)


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each group of near copies: that of the least (doc_id, text_key).

    Rows equal in doc_id and text are copies as well, and the one least in its other columns stays. Rows
    without words stay, once for each doc_id and text; rows without doc_id all stay.
    """
    found = near_duplicates(docs, k, percent)
    some = found.where("cluster IS NOT NULL").groupBy("cluster").agg(F.min(F.struct("doc_id", "text_key")).alias("one")).select("one.*")
    none = found.where("cluster IS NULL AND doc_id IS NOT NULL").select("doc_id", "text_key").distinct()
    chosen = some.unionByName(none).select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key"))
    # a map-side minimum leaves one row of any number of repeated ones; merged at every size: the list grows with the corpus
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    once = docs.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("__id"), _text_key(F.col("text")).alias("__key")).agg(F.min(row).alias("__row"))
    return once.join(chosen.hint("merge"), ["__id", "__key"], "left_semi").select("__row.*").unionByName(docs.where("doc_id IS NULL"))


def _text_key(text: Column) -> Column:
    return F.xxhash64(text.cast("string"), text.isNull())


def _near_duplicates(docs: DataFrame, k: int, percent: int, trees: int) -> DataFrame:
    scratch = Scratch(docs.sparkSession, "near")
    base = pick(docs, doc_id="long", text="string").withColumn("t", _text_key(F.col("text")))
    sketches = scratch.table(base.mapInArrow(tidy(sketcher(k)), "doc_id long, t long, n_shingles long, hi long, lo long, tokens binary, print binary"), "sketches")
    taking = sketches.where("n_shingles > 0 AND doc_id IS NOT NULL")
    # a class of equal sets is named by its least doc_id; by a hash, where that doc_id has several texts
    several = scratch.table(taking.groupBy("doc_id").agg(F.min("t").alias("t0"), F.max("t").alias("t1")).where("t0 <> t1").select("doc_id", "t0"), "several")
    key = ["n_shingles", "hi", "lo"]
    classes = taking.groupBy(*key).agg(F.min(F.struct("doc_id", "t")).alias("rep"), F.first("tokens").alias("tokens"), F.first("print").alias("print"))
    classes = classes.select(*key, "rep.doc_id", "rep.t", "tokens", "print")
    if several.isEmpty():  # the same names either way; without repeated ids nothing need be joined
        classes = classes.withColumn("doc", F.col("doc_id"))
    else:
        classes = classes.join(several.hint("merge"), "doc_id", "left").withColumn("doc", F.when(F.col("t") != F.col("t0"), F.xxhash64("doc_id", "t")).otherwise(F.col("doc_id"))).drop("t0")
    classes = scratch.table(classes, "classes")
    members = classes.select("doc", F.col("n_shingles").alias("n"), "tokens", "print")
    # texts by class; a row of another class under the same doc_id has another key
    named = classes.select("doc", "doc_id", "t").where("doc <> doc_id")
    texts = base.where("doc_id IS NOT NULL").select("doc_id", "t", "text")
    if several.isEmpty():
        texts = texts.select(F.col("doc_id").alias("doc"), "text")
    else:
        first = several.withColumnRenamed("t0", "own")
        texts = texts.join(named.hint("merge"), ["doc_id", "t"], "left").join(first.hint("merge"), "doc_id", "left")
        texts = texts.where("doc IS NOT NULL OR own IS NULL OR own = t").select(F.coalesce("doc", "doc_id").alias("doc"), "text")
    roots = _linked(members, texts, scratch, k, percent, trees)
    found = classes.select(*key, "doc", "doc_id").join(roots.withColumnRenamed("node", "doc"), "doc", "left").select(*key, "doc_id", F.coalesce("root", "doc").alias("cluster"))
    least = found.groupBy("cluster").agg(F.min("doc_id").alias("component_id"))
    found = scratch.table(found.join(least.hint("merge"), "cluster").select(*key, "cluster", "component_id"), "found")
    out = sketches.select("doc_id", "t", *key).join(found.hint("merge"), key, "left")
    known = F.col("doc_id").isNotNull()
    out = out.withColumns({"component_id": F.when(known, F.coalesce("component_id", "doc_id")), "cluster": F.when(known, F.col("cluster"))})
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"), F.col("t").alias("text_key"), "cluster")


def _linked(members: DataFrame, texts: DataFrame, scratch: Scratch, k: int, percent: int, trees: int) -> DataFrame:
    least = percent / 100
    members = scratch.table(members.mapInArrow(tidy(_paths(trees)), "doc long, n long, tokens binary, print binary, paths array<long>"), "members")
    nodes = members.select("doc", "n", F.posexplode("paths").alias("at", "node"))
    sizes = nodes.groupBy("node").agg(F.count("*").alias("size")).where("size > 1")
    nodes = scratch.table(nodes.join(sizes, "node").select("doc", "n", "node", "at", "size"), "nodes")
    # hubs: the member whose tokens are most widely shared
    typical = nodes.groupBy("doc").agg(F.sum(F.log("size")).alias("shared"))
    best = F.max(F.struct(F.round("shared", 9).alias("shared"), (-F.col("doc")).alias("minus"))).alias("best")
    hubs = nodes.join(typical, "doc").groupBy("node").agg(best).select("node", (-F.col("best.minus")).alias("hub"))
    spokes = nodes.join(hubs, "node").where("doc <> hub").select(F.least("doc", "hub").alias("a"), F.greatest("doc", "hub").alias("b")).distinct()
    sided = [members.select(F.col("doc").alias(c), F.col("tokens").alias(f"t{c}")) for c in "ab"]
    spokes = spokes.join(sided[0], "a").join(sided[1], "b").select("a", "b", "ta", "tb").mapInArrow(tidy(_similar(least - HUB_SLACK)), "a long, b long")
    found = _confirmed(scratch.table(spokes, "spokes"), texts, k, percent, scratch)
    roots = scratch.table(components(found, scratch).withColumnRenamed("node", "doc"), "hub-roots")
    # across components: small nodes at once, larger ones after branching
    placed, masks = None, None
    for level in range(LEVELS):
        own = scratch.table(nodes.join(roots, "doc", "left").select("node", "at", "doc", "n", F.coalesce("root", "doc").alias("root")), "own")
        shape = own.groupBy("node", "root").agg(F.count("*").alias("size"), F.sum("n").alias("n"))
        shape = shape.groupBy("node").agg(F.sum("size").alias("size"), F.sum("n").alias("n"), F.max(F.struct("size", "root")).alias("top"))
        shape = shape.select("node", "size", "n", F.col("top.root").alias("main"), (F.col("size") - F.col("top.size")).alias("odd")).where("odd > 0")
        last = level == LEVELS - 1
        small = F.lit(True) if last else (F.col("size") <= NODE) & (F.col("odd") * F.col("size") <= PAIRS) & (F.col("n") <= SHINGLES)
        shape = scratch.table(shape.withColumn("small", small), "shape")
        # members against those outside the largest component, in chunks and blocks where a node is large
        blocks = F.greatest(F.ceil(F.col("size") / NODE), F.ceil(F.col("n") / SHINGLES))
        chunks = F.least(F.ceil(F.col("odd") / F.lit(PAIRS / NODE)), F.col("odd"))
        laid = shape.where("small").select("node", "main", blocks.alias("blocks"), chunks.alias("chunks"))
        ready = own.join(laid, "node").withColumn("odd", F.col("root") != F.col("main"))
        if level == 0:
            masks = scratch.table(ready.groupBy("doc").agg(F.bit_or(F.expr("shiftleft(1L, at)")).alias("mask")), "masks")
        chunk, block = (F.pmod(F.xxhash64("doc", F.lit(s)), F.col(n)).cast("int") for s, n in ((1, "chunks"), (2, "blocks")))
        # a candidate meets every chunk of its block, a query every block: one row each where a node isn't cut
        spots = F.when(F.col("odd"), F.array_union(F.transform(F.sequence(F.lit(0), F.col("chunks").cast("int") - 1), lambda c: F.struct(c.alias("chunk"), block.alias("block"))), F.transform(F.sequence(F.lit(0), F.col("blocks").cast("int") - 1), lambda b: F.struct(chunk.alias("chunk"), b.alias("block")))))
        spots = F.coalesce(spots, F.transform(F.sequence(F.lit(0), F.col("chunks").cast("int") - 1), lambda c: F.struct(c.alias("chunk"), block.alias("block"))))
        laid_out = ready.select("node", "at", "doc", "root", "odd", chunk.alias("mine"), block.alias("home"), F.explode(spots).alias("s"))
        laid_out = laid_out.select("node", F.col("s.chunk").alias("chunk"), F.col("s.block").alias("block"), "at", "doc", "root", (F.col("odd") & (F.col("mine") == F.col("s.chunk"))).alias("query"), (F.col("home") == F.col("s.block")).alias("cand"))
        placed = laid_out if placed is None else placed.unionByName(laid_out)
        if last or shape.where("NOT small").isEmpty():
            break
        branching = own.join(shape.where("NOT small").select("node"), "node", "left_semi").join(members.select("doc", "tokens"), "doc")
        nodes = branching.select("doc", "n", "node", "tokens").mapInArrow(tidy(_next_nodes), "doc long, n long, node long, at int")
        nodes = scratch.table(nodes, "nodes")
    placed = scratch.table(placed, "placed")
    known = members.select("doc", "print", "paths").join(masks, "doc", "left").select("doc", "print", "paths", F.coalesce("mask", F.lit(0)).alias("mask"))
    met = placed.join(known, "doc").repartition(*KEY).sortWithinPartitions(*KEY, "doc")
    flagged = scratch.table(met.mapInArrow(tidy(_flagged(least - SLACK)), "node long, chunk int, block int, doc long"), "flagged")
    full = _full(flagged.select("doc").distinct(), texts, k, scratch)
    again = flagged.join(placed, [*KEY, "doc"]).join(known, "doc").join(full, "doc").repartition(*KEY).sortWithinPartitions(*KEY, "doc")
    links = scratch.table(again.mapInArrow(tidy(_spanning(least - SLACK, percent)), "a long, b long"), "spanning")
    return components(found.unionByName(links), scratch)
