"""Token ids in a content-addressed store.

``write_store`` encodes every text, appends the end id, and cuts each document's id stream into
chunks where a rolling hash of the last ``WINDOW`` ids says so. Layout below its folder, all Parquet:

    chunks/    digest (first 16 bytes of SHA-256), ids (little-endian unsigned, 2 or 4 bytes each);
               each distinct chunk once, whichever documents hold it
    recipes/   part, place, doc_id, n_tokens, local_start, chunk digests in order, root (SHA-256 over
               them); parts are ranges of ascending doc_id, rows ascend within a part
    manifest/  level, part, start, n_documents, n_tokens, digest: Merkle nodes; level 1 covers a
               part's roots in order, level 2 (part -1) all parts

``verify_store`` reads the files back: every chunk is hashed again, every root and Merkle node
recomputed, and each document's checksum put together from its chunks' (CRC-32 of a concatenation is
linear in those of its parts), so chunk payloads never cross the network a second time.
``read_store`` rebuilds the id arrays themselves.

Words are encoded once per distinct unit and slice and then gathered, which equals encoding whole
texts for tokenizers that cut at white space and drop it; whether one does is probed, and others encode whole texts.
Words that may hold an added token, or characters other than ASCII, go to the tokenizer as they are.

Defined cases: a null or empty text is the end id alone. Repeated rows are stored as rows of their
own, sharing chunks. Null ids come first. Nothing but doc_id and text is stored, so other columns may
have any name. Very long texts are encoded whole, in one slice each. An empty table gives an empty store.
"""

from __future__ import annotations

import hashlib
import json
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import Scratch, pick
from ._memo import Memo, gather, kept
from ._text import GROUP_BYTES, SPACE, buffers, groups, mix, scan

WINDOW, LEAST, MEAN, MOST = 16, 64, 256, 2048
STEP = 1 << 18
MOST_WRITTEN = 200_000
ROLL = np.uint64(0x9E3779B97F4A7C15)


def cut_points(ids: np.ndarray) -> np.ndarray:
    """Positions after which the rolling hash of the last WINDOW ids asks for a cut."""
    found = []
    for at in range(0, len(ids), STEP):
        lo = max(0, at - WINDOW + 1)
        h = mix(ids[lo : at + STEP].astype(np.uint64) + np.uint64(1))
        if len(h) < WINDOW:
            continue
        size, factor = 1, ROLL
        while size < WINDOW:  # each step hashes runs twice as long
            h = h[:-size] + h[size:] * factor
            size, factor = 2 * size, ROLL ** np.uint64(2 * size)
        found.append(np.flatnonzero((mix(h) & np.uint64(MEAN - 1)) == 0) + lo + WINDOW)
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)


def chunk_bounds(n: int, cuts: np.ndarray) -> list[int]:
    """Chunk borders of a document of n ids: a cut LEAST ids on at least, MOST at most."""
    out, at, cuts, i = [0], 0, cuts.tolist(), 0
    while n - at > LEAST:
        while i < len(cuts) and cuts[i] < at + LEAST:
            i += 1
        at = min(cuts[i] if i < len(cuts) else n, at + MOST, n)
        out.append(at)
    if out[-1] != n:
        out.append(n)
    return out


def _encoder(tokenizer: str, end_id: int, width: int):
    dtype = np.uint16 if width == 2 else np.uint32

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core a task
        words = kept(("tokenizer", hashlib.sha256(tokenizer.encode()).digest(), width), lambda: Words(tokenizer, dtype))
        run = words.run
        written: set[bytes] = set()  # of this task: a chunk's bytes leave it once
        for batch in batches:
            ids = batch.column("doc_id")
            for first, ids_of_all, edges in _by_word(batch, words) if words.by_word else _whole(batch, run, dtype):
                n, digests, payloads, roots = [], [], [], []
                # the end id goes behind each document
                flat = np.insert(ids_of_all, edges[1:], dtype(end_id))
                edges = edges + np.arange(len(edges))
                cuts = cut_points(flat)
                near = np.searchsorted(cuts, edges)
                data, wide = flat.tobytes(), flat.itemsize
                for i, (a, b) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)):
                    bounds = chunk_bounds(b - a, cuts[near[i] : near[i + 1]] - a)
                    parts = [data[(a + x) * wide : (a + y) * wide] for x, y in zip(bounds, bounds[1:], strict=False)]
                    own = [hashlib.sha256(p).digest()[:16] for p in parts]
                    n.append(b - a)
                    digests.append(own)
                    payloads.append([None if d in written else p for d, p in zip(own, parts, strict=True)])
                    written.update(own)
                    if len(written) > MOST_WRITTEN:
                        written.clear()
                    roots.append(hashlib.sha256(b"".join(own)).digest())
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(first, len(n)), pa.array(n, pa.int64()), pa.array(digests, pa.list_(pa.binary())), pa.array(payloads, pa.list_(pa.binary())), pa.array(roots, pa.binary())],
                    names=["doc_id", "n_tokens", "digests", "payloads", "root"],
                )

    return encode


class Words:
    """Encodes whole columns by distinct units of words.

    A word is a unit; it is further cut between ASCII letters and ASCII marks, where the tokenizer's
    own splitting cuts too, unless it holds an apostrophe (contractions) or a mark that an added
    token holds. Added tokens are told by their own spelling, and lower case may change how characters
    compose, so only words of ASCII characters that can't begin an added token are lowered here, and
    only for tokenizers that lower them.
    """

    def __init__(self, text: str, dtype):
        from tokenizers import Tokenizer

        tok = Tokenizer.from_str(text)
        told = json.loads(text)
        self.run = getattr(tok, "encode_batch_fast", tok.encode_batch)
        self.lower = '"Lowercase"' in json.dumps(told.get("normalizer"))
        self.suffix = told["model"].get("end_of_word_suffix") or None
        self.ends = np.zeros(tok.get_vocab_size(), dtype=bool)
        if self.suffix:
            self.ends[[i for t, i in tok.get_vocab().items() if t.endswith(self.suffix)]] = True
        codes = np.arange(256)
        self.letter = ((codes >= 65) & (codes <= 90)) | ((codes >= 97) & (codes <= 122))
        self.mark = (codes < 128) & ~self.letter & ~SPACE
        self.glue = np.zeros(256, dtype=bool)
        added = [t["content"] for t in told.get("added_tokens") or []]
        for c in {"'", *"".join(added)}:
            if ord(c) < 128 and not self.letter[ord(c)]:
                self.glue[ord(c)] = True
        #: bytes that keep a word as it is written
        self.asis = codes >= 128
        self.asis[[ord(t[0]) for t in added if ord(t[0]) < 128]] = True
        self.memo = Memo(self.encode, dtype)
        self.by_word = self.cuts_at_space(added)
        self.by_run = self.by_word and self.cuts_at_marks()

    def cuts_at_space(self, added: list[str]) -> bool:
        """Whether words encode alike apart and together, on probes with every white space; no added token may hold any."""
        if any(SPACE[b] for t in added for b in t.encode()) or any(self.letter[ord(t[0])] for t in added if ord(t[0]) < 128):
            return False
        words = ["Word", "!?", "12", "don't", "\u00e9t\u00e9", "\u0301x", "\u4e2d", "a_b", *added]
        spaces = [chr(c) for c in np.flatnonzero(SPACE)]
        probes = [t for s in spaces for t in (s + s.join(words) + s, s + s)]
        got = [e.ids for e in self.run(probes, add_special_tokens=False)]
        once = sum((e.ids for e in self.run(words, add_special_tokens=False)), [])
        return all(ids == (once if i % 2 == 0 else []) for i, ids in enumerate(got))

    def cuts_at_marks(self) -> bool:
        """Whether letters and marks encode alike apart and together, on probes of every ASCII mark."""
        marks = [chr(c) for c in np.flatnonzero(self.mark & ~self.glue) if c > 32 and c < 127]
        probes = [t for m in marks for t in (f"word{m}", f"{m}word", f"a{m}{m}b")]
        apart = [t for m in marks for t in ("word", m, m, "word", "a", m + m, "b")]
        ids = [e.ids for e in self.run(probes, add_special_tokens=False)]
        parts = [e.ids for e in self.run(apart, add_special_tokens=False)]
        return sum(ids, []) == sum(parts, [])

    def encode(self, keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all keys one after another, number of ids of each)."""
        texts = b" ".join(keys).decode("utf-8", "replace").split(" ")
        alike = np.fromiter(map(str.isalpha, texts), dtype=bool, count=len(texts)) & bool(self.suffix)
        size, flat = np.zeros(len(texts), dtype=np.int64), np.zeros(0, dtype=np.int64)
        if alike.any():  # a run of letters ends where a piece has the suffix, so runs can share a call
            (joined,) = self.run([" ".join([t for t, a in zip(texts, alike.tolist(), strict=True) if a])], add_special_tokens=False)
            flat = np.array(joined.ids, dtype=np.int64)
            ends = np.flatnonzero(self.ends[flat]) + 1
            if len(ends) == alike.sum():
                size[alike] = np.diff(ends, prepend=0)
            else:
                alike[:], flat = False, flat[:0]
        rest = [e.ids for e in self.run([t for t, a in zip(texts, alike.tolist(), strict=True) if not a], add_special_tokens=False)]
        size[~alike] = [len(ids) for ids in rest]
        flat = np.concatenate([flat, np.array(list(chain.from_iterable(rest)), dtype=np.int64)])
        order = np.argsort(~alike, kind="stable")  # as they stand in ``flat``
        start = np.empty(len(texts), dtype=np.int64)
        start[order] = np.cumsum(size[order]) - size[order]
        return gather(flat, start, size, np.arange(len(texts)))

    def units(self, w, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends in ``raw``, the slice's bytes."""
        start, end = w
        if not self.by_run or not len(start):
            return start, end
        letter, mark = self.letter[raw], self.mark[raw]
        cut = np.flatnonzero((letter[:-1] & mark[1:]) | (mark[:-1] & letter[1:])) + 1
        glued = np.concatenate([[0], np.cumsum(self.glue[raw], dtype=np.int32)])
        word = np.searchsorted(start, cut, side="right") - 1
        cut = cut[(glued[end[word]] == glued[start[word]]) & (cut < end[word])]
        return np.sort(np.concatenate([start, cut])), np.sort(np.concatenate([end, cut]))


def _by_word(batch: pa.RecordBatch, words: Words) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, ids of the slice's rows one after another, n + 1 borders)."""
    _, at = buffers(batch.column("text"))
    for w in scan(batch.column("text"), hashes=False, most=3 * GROUP_BYTES):
        own = at[w.first : w.first + len(w.count) + 1]
        raw, start, end = w.raw[own[0] : own[-1]], w.start - own[0], w.end - own[0]
        if words.lower and len(start):
            raw = lowered(raw, start, words.asis)
        start, end = words.units((start, end), raw)
        ids, n = words.memo(raw, start, end)
        yield w.first, ids, np.concatenate([[0], np.cumsum(n)])[np.searchsorted(start, own - own[0])]


def lowered(raw: np.ndarray, start: np.ndarray, asis: np.ndarray) -> np.ndarray:
    """``raw`` with ASCII capitals lowered, but in words with a byte that ``asis`` marks."""
    capital = np.flatnonzero((raw >= 65) & (raw <= 90))
    kept = np.zeros(len(start), dtype=bool)
    kept[np.searchsorted(start, np.flatnonzero(asis[raw]), side="right") - 1] = True
    capital = capital[~kept[np.searchsorted(start, capital, side="right") - 1]]
    out = raw.copy()
    out[capital] += 32
    return out


def _whole(batch: pa.RecordBatch, run, dtype) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    texts = batch.column("text")
    for i, j in groups(buffers(texts)[1]):
        got = [np.array(e.ids, dtype=dtype) for e in run([t or "" for t in texts.slice(i, j - i).to_pylist()], add_special_tokens=False)]
        yield i, np.concatenate([np.zeros(0, dtype), *got]), np.concatenate([[0], np.cumsum([len(g) for g in got])]).astype(np.int64)


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """local_start and place within the part: rows come sorted."""
    at = place = 0
    for batch in batches:
        n = batch.column("n_tokens").to_numpy(zero_copy_only=False)
        start = at + np.cumsum(n) - n
        arrays = [*batch.columns, pa.array(start.astype(np.int64)), pa.array(place + np.arange(len(n), dtype=np.int64))]
        yield pa.RecordBatch.from_arrays(arrays, names=[*batch.schema.names, "local_start", "place"])
        at += int(n.sum())
        place += len(n)


def _fold(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("place")
    return pd.DataFrame({"part": pdf["part"].iloc[:1], "node": pdf["node"].iloc[:1], "digest": [hashlib.sha256(b"".join(pdf["root"])).digest()], "n_documents": [len(pdf)], "n_tokens": [int(pdf["n_tokens"].sum())]})


FAN_OUT = 4096


def _merkle(recipes: DataFrame) -> pd.DataFrame:
    """Level-1 nodes: a part's roots folded FAN_OUT at a time, then those nodes; one row a part."""
    nodes = recipes.select("part", F.floor(F.col("place") / FAN_OUT).alias("node"), "place", "root", "n_tokens")
    folded = nodes.groupBy("part", "node").applyInPandas(_fold, "part int, node long, digest binary, n_documents long, n_tokens long")
    ordered = F.array_sort(F.collect_list(F.struct("node", "digest")))
    joined = F.aggregate(ordered, F.lit(b"").cast("binary"), lambda acc, x: F.concat(acc, x["digest"]))
    # a part is a range of about one shuffle partition, so it has few nodes
    return folded.groupBy("part").agg(F.unhex(F.sha2(joined, 256)).alias("digest"), F.sum("n_documents").alias("n_documents"), F.sum("n_tokens").alias("n_tokens")).toPandas().sort_values("part")


def _top(parts: pd.DataFrame) -> bytes:
    return hashlib.sha256(b"".join(bytes(x) for x in parts["digest"])).digest()


def write_store(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int = 2) -> str:
    """Encode ``docs`` (doc_id, text) into ``folder``; the tokenizer's file is read once, here."""
    from tokenizers import Tokenizer

    with open(tokenizer_path, encoding="utf-8") as f:
        tokenizer = f.read()
    width = 2 if max(Tokenizer.from_str(tokenizer).get_vocab_size(), end_id + 1) <= 1 << 16 else 4
    scratch = Scratch(docs.sparkSession, "encoded")
    encoded = pick(docs, doc_id="long", text="string").mapInArrow(
        _encoder(tokenizer, end_id, width), "doc_id long, n_tokens long, digests array<binary>, payloads array<binary>, root binary"
    )
    encoded = scratch.table(encoded, "encoded")
    pieces = encoded.select(F.explode(F.arrays_zip("digests", "payloads")).alias("c")).select(F.col("c.digests").alias("digest"), F.col("c.payloads").alias("ids"))
    # equal digests hold equal bytes, so any one of them may stand for all; each task sends a chunk once
    pieces.where("ids IS NOT NULL").repartition("digest").groupBy("digest").agg(F.first("ids").alias("ids")).write.option("compression", "zstd").parquet(f"{folder}/chunks")
    ranged = encoded.select("doc_id", "n_tokens", "digests", "root").repartitionByRange("doc_id", "root").sortWithinPartitions("doc_id", "root")
    numbered = ranged.mapInArrow(_number, "doc_id long, n_tokens long, digests array<binary>, root binary, local_start long, place long")
    numbered.withColumn("part", F.spark_partition_id()).write.parquet(f"{folder}/recipes")
    scratch.drop(encoded)
    _write_manifest(docs.sparkSession, folder, width)
    return folder


def _write_manifest(spark: SparkSession, folder: str, width: int) -> None:
    parts = _merkle(spark.read.parquet(f"{folder}/recipes"))
    rows, at = [], 0
    for r in parts.itertuples():
        rows.append((1, int(r.part), at, int(r.n_documents), int(r.n_tokens), bytes(r.digest), width))
        at += int(r.n_tokens)
    rows.append((2, -1, 0, int(parts["n_documents"].sum()), at, _top(parts), width))
    spark.createDataFrame(rows, "level int, part int, start long, n_documents long, n_tokens long, digest binary, width int").coalesce(1).write.parquet(f"{folder}/manifest")


def _crc_tables() -> np.ndarray:
    """tables[k, byte lane, value]: a CRC-32 moved on by 4 * 2**k zero bytes, as four look-ups."""
    def times(m: list[int], v: int) -> int:
        out, i = 0, 0
        while v:
            if v & 1:
                out ^= m[i]
            v >>= 1
            i += 1
        return out

    m = [0xEDB88320] + [1 << i for i in range(31)]  # one zero bit
    for _ in range(5):  # 32 bits: four bytes
        m = [times(m, x) for x in m]
    tables = np.zeros((40, 4, 256), dtype=np.uint32)
    for k in range(40):
        for lane in range(4):
            for v in range(256):
                tables[k, lane, v] = times(m, v << 8 * lane)
        m = [times(m, x) for x in m]
    return tables


_shift: list[np.ndarray] = []


def crc_shift(crc: np.ndarray, words: np.ndarray) -> np.ndarray:
    """CRC-32 values as they count with ``words`` 32-bit words after them."""
    if not _shift:
        _shift.append(_crc_tables())
    out, n, k = crc.astype(np.uint32), words.astype(np.int64).copy(), 0
    while n.any():
        on = (n & 1).astype(bool)
        c = out[on]
        t = _shift[0][k]
        out[on] = t[0][c & 255] ^ t[1][c >> 8 & 255] ^ t[2][c >> 16 & 255] ^ t[3][c >> 24]
        n >>= 1
        k += 1
    return out


def _digested(width: int):
    dtype = np.uint16 if width == 2 else np.uint32

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, crc, good = [], [], []
            for name, ids in zip(batch.column("digest"), batch.column("ids"), strict=True):
                raw = ids.as_buffer()
                good.append(hashlib.sha256(raw).digest()[:16] == name.as_py())
                got = np.frombuffer(raw, dtype=dtype)
                n.append(len(got))
                crc.append(zlib.crc32(got.astype("<u4")))
            yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array(n, pa.int64()), pa.array(crc, pa.int64()), pa.array(good, pa.bool_())], names=["digest", "n", "crc", "good"])

    return digested


def verify_store(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, verified for each stored row, all from the files."""
    manifest = spark.read.parquet(f"{folder}/manifest").toPandas()
    recipes = spark.read.parquet(f"{folder}/recipes")
    parts = _merkle(recipes)
    told = manifest[manifest["level"] == 1].sort_values("part")
    whole = _top(parts) == bytes(manifest[manifest["level"] == 2]["digest"].iloc[0])
    sound = [p for p, a, b in zip(told["part"], told["digest"], parts["digest"], strict=True) if bytes(a) == bytes(b)] if whole else []
    width = int(manifest["width"].iloc[0])
    chunks = spark.read.parquet(f"{folder}/chunks").mapInArrow(_digested(width), "digest binary, n long, crc long, good boolean")

    @F.pandas_udf("long")
    def shifted(crc: pd.Series, after: pd.Series) -> pd.Series:
        return pd.Series(crc_shift(crc.to_numpy(np.int64), after.to_numpy(np.int64)).astype(np.int64))

    named = recipes.withColumn("root_good", F.unhex(F.sha2(F.aggregate("digests", F.lit(b"").cast("binary"), lambda acc, x: F.concat(acc, x)), 256)) == F.col("root"))
    uses = named.select("part", "place", "root_good", F.posexplode("digests").alias("i", "digest"))
    found = uses.join(chunks, "digest", "left")
    row = Window.partitionBy("part", "place").orderBy(F.desc("i")).rowsBetween(Window.unboundedPreceding, -1)
    placed = found.withColumn("after", F.coalesce(F.sum("n").over(row), F.lit(0)))
    placed = placed.withColumn("share", shifted(F.coalesce("crc", F.lit(0)), "after"))
    sums = placed.groupBy("part", "place").agg(
        F.bit_xor("share").alias("ids_crc32"), F.sum("n").alias("n_tokens"), F.bool_and(F.coalesce("good", F.lit(False)) & F.col("root_good")).alias("good")
    )
    bases = F.broadcast(spark.createDataFrame([(int(r.part), int(r.start), r.part in sound) for r in told.itertuples()], "part int, base long, sound boolean")) if len(told) else spark.createDataFrame([], "part int, base long, sound boolean")
    out = recipes.select("part", "place", "doc_id", "local_start", F.col("n_tokens").alias("told")).join(sums, ["part", "place"]).join(bases, "part")
    return out.select("doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32", (F.col("good") & F.col("sound") & (F.col("told") == F.col("n_tokens"))).alias("verified"))


def read_store(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, ids (array<int>, end id included) of each stored row."""
    manifest = spark.read.parquet(f"{folder}/manifest")
    width = int(manifest.first()["width"])
    bases = F.broadcast(manifest.where("level = 1").select("part", F.col("start").alias("base")))
    recipes = spark.read.parquet(f"{folder}/recipes")
    uses = recipes.select("part", "place", F.posexplode("digests").alias("i", "digest"))
    parts = uses.join(spark.read.parquet(f"{folder}/chunks"), "digest").groupBy("part", "place").agg(F.array_sort(F.collect_list(F.struct("i", "ids"))).alias("chunks"))

    @F.pandas_udf("array<int>")
    def joined(chunks: pd.Series) -> pd.Series:
        return chunks.map(lambda rows: np.frombuffer(b"".join(bytes(r["ids"]) for r in rows), dtype=np.uint16 if width == 2 else np.uint32).astype(np.int32))

    return recipes.join(parts, ["part", "place"]).join(bases, "part").select("doc_id", (F.col("base") + F.col("local_start")).alias("start"), joined("chunks").alias("ids"))
