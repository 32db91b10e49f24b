"""SentencePiece encoding and decoding as a weighted finite-state transducer.

``compile_model`` reads a model file and builds three machines, held as arrays of states and arcs:

    N  the normaliser: an optional dummy prefix, then each space to U+2581, all else to itself
    P  the pieces: a trie over characters, read from the end of a match, whose accepting states
       return to the root, write a piece and cost its weight; a character that is no piece of its own
       takes the fallback arc, which writes its bytes' pieces (or the unknown piece)
    B  what may stand beside what: a state per piece, each arc of tropical weight 0 or infinity

An input is composed with N and P into a lattice, whose arcs are the pieces that match somewhere, and
the lattice with B; states of the composition are (position, last piece). The path of least tropical
weight is found by relaxing arcs in order of the position where they end.

For a BPE model an arc of B from t to u has weight 0 exactly if merging the characters of t followed
by those of u gives back t and u. A sequence of pieces is the one that merging gives for the whole
text if and only if all its neighbours pass that test, so the one path of finite weight is the BPE
segmentation itself. The same holds for every beginning of the text, so at most one state of each
position has finite weight, and weights need an entry per position alone. For a unigram model B is
one state with weight 0 and P's arcs weigh minus the piece's score, which makes the path the most
probable segmentation. ``shortest`` relaxes one text state by state with all states kept; ``paths``
does all distinct units of a slice side by side in arrays.

White space that no piece has behind another character (found when compiling) parts a text into
units, each such white space and what follows up to the next; no piece crosses their borders, so
each distinct unit is encoded once a slice. Without any, whole texts are the units.

Defined cases: a null text encodes to null ids; an empty one to none. Very long texts are read in
slices of units. Repeated rows give repeated results; other columns are ignored, whatever their names.
An empty table gives an empty result. Decoding undoes N, so U+2581 in a text comes back as a space, as
in the model's own convention; ``round_trip`` compares with the text as it was, so it is false there.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import tidy
from ._memo import gather, kept
from ._text import GROUP_BYTES, buffers, distinct, scan

MARK = "▁"
#: fixed values of the model file's format: field numbers, piece types, model types
PIECES, TRAINER, NORMALIZER = 1, 2, 3
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
UNKNOWN_PENALTY = 10.0


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a protocol-buffer message: varints as int, the rest as bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = raw[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(raw):
        tag = varint()
        if tag & 7 == 0:
            yield tag >> 3, varint()
        else:
            n = {1: 8, 5: 4}.get(tag & 7) or varint()
            yield tag >> 3, raw[at : at + n]
            at += n


#: the state of B before any piece, and after a fallback
START = -1
CHUNK, LONGEST_UNIT = 1 << 18, 4096


class Table:
    """Whole numbers by whole numbers from 0, in arrays: open addressing, looked up and filled many at a time."""

    def __init__(self, bits: int):
        self.bits = bits
        self.clear()

    def clear(self) -> None:
        self.keys, self.values, self.n = np.full(1 << self.bits, -1, dtype=np.int64), np.zeros(1 << self.bits, dtype=np.int32), 0

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Distinct keys that aren't there yet."""
        self.n += len(keys)
        slot = self._slot(keys)
        while len(keys):
            free = np.flatnonzero(self.keys[slot] == -1)
            self.keys[slot[free]] = keys[free]  # of several that want a slot, the last has it
            here = self.keys[slot] == keys
            self.values[slot[here]] = values[here]
            keys, values, slot = keys[~here], values[~here], (slot[~here] + 1) & ((1 << self.bits) - 1)

    def get(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(values, whether the key is there)."""
        slot = self._slot(keys)
        found = self.keys[slot]
        here = found == keys
        out = self.values[slot].astype(np.int64)
        todo = np.flatnonzero(~here & (found != -1))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)
            found = self.keys[slot[todo]]
            hit = todo[found == keys[todo]]
            here[hit] = True
            out[hit] = self.values[slot[hit]]
            todo = todo[(found != keys[todo]) & (found != -1)]
        return out, here


class Beside:
    """Arcs of B, worked out when first asked for. What is kept never changes a result."""

    def __init__(self, machine: Machine):
        self.m, self.table, self.most = machine, Table(20), 1 << 19

    def __call__(self, t: np.ndarray, u: np.ndarray) -> np.ndarray:
        """Whether each u may stand behind its t."""
        keys = (t + 1) * len(self.m.pieces) + u
        value, here = self.table.get(keys)
        if not here.all():
            new = np.unique(keys[~here])
            if self.table.n + len(new) > self.most:
                self.table.clear()
            known = {k: self.m.follows(k // len(self.m.pieces) - 1, k % len(self.m.pieces)) for k in new.tolist()}
            self.table.put(new, np.fromiter(known.values(), np.int64, len(known)))
            missing = np.flatnonzero(~here)
            value[missing] = [known[k] for k in keys[missing].tolist()]
        return value.astype(bool)

    def one(self, t: int, u: int) -> bool:
        return bool(self(np.array([t], dtype=np.int64), np.array([u], dtype=np.int64))[0])


def _joined(paths: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    size = np.array([len(p) for p in paths], dtype=np.int64)
    return np.array([i for p in paths for i in p], dtype=np.int64), size


class Machine:
    def __init__(self, raw: bytes):
        pieces, trainer, norm = [], {}, {}
        for number, value in _fields(raw):
            if number == PIECES:
                f = dict(_fields(value))
                pieces.append((f.get(1, b"").decode(), struct.unpack("<f", f[2])[0] if 2 in f else 0.0, f.get(3, NORMAL)))
            elif number == TRAINER:
                trainer = dict(_fields(value))
            elif number == NORMALIZER:
                norm = dict(_fields(value))
        self.kind = trainer.get(3, UNIGRAM)
        if self.kind not in (UNIGRAM, BPE) or norm.get(2) or norm.get(4, 1) or any(t in (USER_DEFINED, UNUSED) for _, _, t in pieces):
            raise ValueError("only unigram and BPE models with the identity normaliser and ordinary pieces are compiled")
        self.dummy, self.escape = bool(norm.get(3, 1)), bool(norm.get(5, 1))
        self.pieces = pieces
        self.ids = {p: i for i, (p, _, t) in enumerate(pieces) if t == NORMAL}
        self.score = {i: s for i, (_, s, _) in enumerate(pieces)}
        self.unknown = next(i for i, (_, _, t) in enumerate(pieces) if t == UNKNOWN)
        byte_ids = {int(p[3:5], 16): i for i, (p, _, t) in enumerate(pieces) if t == BYTE}
        self.fallback = [byte_ids[b] for b in range(256)] if len(byte_ids) == 256 else None
        self.worst = min((s for _, s, t in pieces if t == NORMAL), default=0.0) - UNKNOWN_PENALTY
        self.weight = np.array([-s if self.kind == UNIGRAM else 0.0 for _, s, _ in pieces])
        self._trie()
        self.beside = Beside(self)
        parting = {MARK if self.escape else " ", *"\t\n\x0b\x0c\r"}
        while crossed := {c for p in self.ids for b, c in zip(p, p[1:], strict=False) if c in parting and b not in parting}:
            parting -= crossed
        self.by_unit = (MARK if self.escape else " ") in parting
        self.parting = np.zeros(256, dtype=bool)
        self.parting[[32, *(ord(c) for c in parting if c < "\x80")]] = True

    # N
    def normalise(self, text: str, begins: bool = True) -> str:
        out = (" " if self.dummy and begins and text else "") + text
        return out.replace(" ", MARK) if self.escape else out

    # B
    def merged(self, text: str) -> list[str]:
        """Characters of ``text`` after merging neighbours, the best-scored piece first, then the leftmost."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                piece = self.ids.get(parts[i] + parts[i + 1])
                if piece is not None and (best is None or self.score[piece] > best):
                    best, at = self.score[piece], i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def follows(self, t: int, u: int) -> bool:
        """Whether u may stand behind t; behind START, whether merging u's own characters gives u."""
        if self.kind == UNIGRAM:
            return True
        b = self.pieces[u][0]
        if t == START:
            return self.merged(b) == [b]
        a = self.pieces[t][0]
        return self.merged(a + b) == [a, b]

    # P
    def _trie(self) -> None:
        """Arrays of P: an arc leads from a state with a symbol to a state; ``accepts`` has a state's piece or -1."""
        chars = sorted({c for p in self.ids for c in p})
        self.symbol = np.zeros(0x110000, dtype=np.int32)  # 0: a character of no piece
        self.symbol[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        number = {c: i + 1 for i, c in enumerate(chars)}
        width, arcs, accepts = len(chars) + 1, {}, [-1]
        for p, i in self.ids.items():
            state = 0
            for c in reversed(p):
                key = state * width + number[c]
                state = arcs.get(key, 0)
                if not state:
                    state = arcs[key] = len(accepts)
                    accepts.append(-1)
            accepts[state] = i
        self.width, self.accepts = width, np.array(accepts, dtype=np.int32)
        self.arcs, self.held = Table(20), arcs
        self.arcs.put(np.fromiter(arcs.keys(), np.int64, len(arcs)), np.fromiter(arcs.values(), np.int64, len(arcs)))
        self.number = number
        self.own = np.zeros(width, dtype=bool)  # symbols that are pieces
        self.own[[number[c] for c in chars if c in self.ids]] = True

    def shortest(self, text: str) -> list[int]:
        """Pieces of the least-weight path over normalised ``text``: states (position, last piece), all of them kept."""
        bpe, inf = self.kind == BPE, float("inf")
        live: list[dict[int, tuple[float, int, int]]] = [{START: (0.0, 0, START)}]  # weight, position and state before

        def relax(end: int, at: int, piece: int, cost: float) -> None:
            for t, (weight, _, _) in live[at].items():
                if bpe and piece >= 0 and not self.beside.one(t, piece):
                    continue
                state = piece if bpe and piece >= 0 else START
                if weight + cost < live[end].get(state, (inf,))[0]:
                    live[end][state] = (weight + cost, at, t)
                    taken[end, state] = piece

        taken: dict[tuple[int, int], int] = {}
        for end in range(1, len(text) + 1):
            live.append({})
            node, at = 0, end
            while at > 0:
                node = self.held.get(node * self.width + self.number.get(text[at - 1], 0), 0)
                if not node:
                    break
                at -= 1
                piece = int(self.accepts[node])
                if piece >= 0:
                    relax(end, at, piece, float(self.weight[piece]))
            if text[end - 1] not in self.ids:
                relax(end, end - 1, -1, -self.worst if not bpe else 0.0)
        out: list[int] = []
        end = len(text)
        state = min(live[end], key=lambda s: live[end][s][0])
        while end > 0:
            piece = taken[end, state]
            _, at, before = live[end][state]
            out.extend([piece] if piece >= 0 else self._unknown(text[at:end])[::-1])
            end, state = at, before
        return out[::-1]

    def paths(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the least-weight paths of all units one after another, number of ids of each); spaces are spaces still."""
        ids, sizes, i = [], [], 0
        while i < len(units):
            j, total = i, 0
            while j < len(units) and (j == i or total + len(units[j]) <= CHUNK):
                total += len(units[j])
                j += 1
            long = j == i + 1 and total > LONGEST_UNIT
            got = [np.array(self.shortest(self.normalise(units[i].decode("utf-8", "replace"), begins=False)), dtype=np.int64)] if long else None
            flat, size = (got[0], np.array([len(got[0])])) if long else self._side_by_side(units[i:j])
            ids.append(flat)
            sizes.append(size)
            i = j
        return (np.concatenate(ids), np.concatenate(sizes)) if ids else (np.zeros(0, np.int64), np.zeros(0, np.int64))

    def _side_by_side(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        raw = b"".join(units)
        codes = np.frombuffer(raw.decode("utf-8", "replace").encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
        # a character per byte that continues none
        heads = np.concatenate([[0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)])
        edge = heads[np.concatenate([[0], np.cumsum([len(u) for u in units])])]
        if edge[-1] != len(codes):  # bytes that are no UTF-8
            return _joined([self.shortest(self.normalise(u.decode("utf-8", "replace"), begins=False)) for u in units])
        if self.escape:
            codes[codes == 32] = ord(MARK)
        size = np.diff(edge)
        unit = np.repeat(np.arange(len(units)), size)
        begin = np.repeat(edge[:-1], size)
        start, end, piece = self._lattice(codes, begin)
        # a unit of n characters has n + 1 positions
        first = edge[:-1] + np.arange(len(units))
        last_unit = unit[end - 1]
        local = end - begin[end - 1]
        start, end = start + last_unit, end + last_unit
        order = np.argsort(local, kind="stable")
        start, end, piece, local = start[order], end[order], piece[order], local[order]
        bytes_of = 1 + (codes > 0x7F) + (codes > 0x7FF) + (codes > 0xFFFF)
        written = np.where(piece >= 0, 1, bytes_of[end - 1 - last_unit[order]] if self.fallback else 1)
        cost = np.where(piece >= 0, self.weight[piece], -self.worst if self.kind == UNIGRAM else 0.0)
        total = len(codes) + len(units)
        weight, state = np.full(total, np.inf), np.full(total, START, dtype=np.int64)
        weight[first] = 0.0
        back, taken, count = np.zeros(total, dtype=np.int64), np.zeros(total, dtype=np.int64), np.zeros(total, dtype=np.int64)
        # arcs that end at one local position come by their length, so an end stands once in each run
        edges = np.concatenate([[0], np.flatnonzero(np.diff(local * 64 + np.minimum(end - start, 63))) + 1, [len(local)]])
        bpe = self.kind == BPE
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            s, e, p = start[a:b], end[a:b], piece[a:b]
            new = weight[s] + cost[a:b]
            better = new < weight[e]
            if bpe and better.any():
                at = np.flatnonzero(better & (p >= 0))
                better[at] = self.beside(state[s[at]], p[at])
            at = np.flatnonzero(better)
            s, e, p = s[at], e[at], p[at]
            weight[e], back[e], taken[e], count[e] = new[at], s, p, count[s] + written[a:b][at]
            if bpe:
                state[e] = np.where(p >= 0, p, START)
        here = edge[1:] + np.arange(len(units))
        sizes = count[here]
        offset = np.cumsum(sizes) - sizes
        out = np.full(int(sizes.sum()), self.unknown, dtype=np.int64)
        todo = np.flatnonzero(here > first)
        here = here[todo]
        while len(todo):
            p, before = taken[here], back[here]
            spot = offset[todo] + count[before]
            plain = p >= 0
            out[spot[plain]] = p[plain]
            odd = np.flatnonzero(~plain)
            if len(odd) and self.fallback:
                for i in odd.tolist():
                    ids = self._unknown(chr(int(codes[here[i] - 1 - todo[i]])))
                    out[spot[i] : spot[i] + len(ids)] = ids
            on = before > first[todo]
            todo, here = todo[on], before[on]
        return out, sizes

    def _lattice(self, codes: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, piece) of each arc that N and P give over the characters of all units, shorter ones first."""
        symbol = self.symbol[codes]
        starts, ends, pieces = [], [], []
        last = np.flatnonzero(symbol)
        state, at = np.zeros(len(last), dtype=np.int64), last
        while len(last):
            state, there = self.arcs.get(state * self.width + symbol[at])
            last, at, state = last[there], at[there], state[there]
            piece = self.accepts[state]
            hit = piece >= 0
            starts.append(at[hit])
            ends.append(last[hit] + 1)
            pieces.append(piece[hit])
            on = at > begin[last]
            last, at, state = last[on], at[on] - 1, state[on]
        odd = np.flatnonzero(~self.own[symbol])
        starts.append(odd)
        ends.append(odd + 1)
        pieces.append(np.full(len(odd), -1, dtype=np.int32))
        return np.concatenate(starts), np.concatenate(ends), np.concatenate(pieces).astype(np.int64)

    def _unknown(self, char: str) -> list[int]:
        return [self.fallback[b] for b in char.encode()] if self.fallback else [self.unknown]

    def encode(self, text: str) -> list[int]:
        return self.shortest(self.normalise(text))

    def spelled(self) -> list[bytes]:
        """What each piece writes when decoded."""
        out = []
        for p, _, t in self.pieces:
            out.append(bytes([int(p[3:5], 16)]) if t == BYTE else b"" if t == CONTROL else " ⁇ ".encode() if t == UNKNOWN else p.replace(MARK, " ").encode())
        return out

    def decode(self, ids: list[int]) -> str:
        spelled = self.spelled()
        out = b"".join(spelled[i] for i in ids).decode("utf-8", "replace")
        return out[1:] if self.dummy and out.startswith(" ") else out


def compile_model(path: str) -> Machine:
    with open(path, "rb") as f:
        return Machine(f.read())


class Units:
    """Encodes whole Arrow columns unit by unit."""

    def __init__(self, machine: Machine):
        self.m = machine
        spelled = machine.spelled()
        self.size = np.array([len(s) for s in spelled], dtype=np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.bytes = np.frombuffer(b"".join(spelled), dtype=np.uint8)

    def encode(self, column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first row, ids, their bounds by row)."""
        if self.m.escape and pc.any(pc.match_substring(column, MARK)).as_py():
            column = pc.replace_substring(column, MARK, " ")  # N makes both the same
        raw, at = buffers(column)
        for w in scan(column, hashes=False, space=self.m.parting, most=2 * GROUP_BYTES):
            rows = len(w.count)
            own = at[w.first : w.first + rows + 1]
            # texts side by side, each with its dummy prefix, so that a unit is one run of bytes
            pad = (np.diff(own) > 0).astype(np.int64) if self.m.dummy else np.zeros(rows, np.int64)
            shift = np.cumsum(pad) - own[0]
            bounds = own + np.concatenate([[-own[0]], shift])
            text = np.full(int(bounds[-1]), 32, dtype=np.uint8)
            keep = np.ones(len(text), dtype=bool)
            keep[bounds[:-1][pad > 0]] = False
            text[keep] = raw[own[0] : own[-1]]
            if not self.m.by_unit:
                start, end, per = bounds[:-1], bounds[1:], np.ones(rows, dtype=np.int64)
            else:
                doc = w.doc()
                end_w = w.end + shift[doc]
                # a unit from the end of the word before (or the text's start) to the word's end, and one for what follows the last word
                last = np.flatnonzero(w.count > 0)
                tail_at = bounds[:-1].copy()
                tail_at[last] = end_w[np.cumsum(w.count)[last] - 1]
                start_w = np.empty(len(end_w), dtype=np.int64)
                start_w[1:] = end_w[:-1]
                firsts = (np.cumsum(w.count) - w.count)[last]
                start_w[firsts] = bounds[:-1][last]
                place = np.arange(len(end_w)) + doc
                tails = np.cumsum(w.count) + np.arange(rows)
                start, end = np.empty(len(end_w) + rows, np.int64), np.empty(len(end_w) + rows, np.int64)
                start[place], end[place], start[tails], end[tails] = start_w, end_w, tail_at, bounds[1:]
                per = w.count + 1
            some = end > start
            start_s, end_s = start[some], end[some]
            one, which = distinct(text, start_s, end_s)
            held = text.tobytes()
            flat, size = self.m.paths([held[a:b] for a, b in zip(start_s[one].tolist(), end_s[one].tolist(), strict=True)])
            ids, n = gather(flat, np.cumsum(size) - size, size, which)
            full = np.zeros(len(start), dtype=np.int64)
            full[some] = n
            edges = np.concatenate([[0], np.cumsum(full)])[np.concatenate([[0], np.cumsum(per)])]
            yield w.first, ids, edges

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """Bytes that ``ids`` spell, the dummy prefix included."""
        out = []
        for a in range(0, len(ids), 1 << 19):
            out.append(gather(self.bytes, self.start, self.size, ids[a : a + (1 << 19)].astype(np.int64))[0])
        return np.concatenate(out) if out else np.zeros(0, np.uint8)


def _mapper(model: bytes, keep: list[str], digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = kept(("pieces", hashlib.sha256(model).digest()), lambda: Units(Machine(model)))
        for batch in batches:
            texts, null = batch.column("text"), batch.column("text").is_null().to_numpy(zero_copy_only=False)
            raw, at = buffers(texts)
            for first, ids, edges in units.encode(texts):
                rows = len(edges) - 1
                own = [batch.column(c).slice(first, rows) for c in keep]
                n = pa.array(np.diff(edges), mask=null[first : first + rows])
                if not digest:
                    lists = pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(ids.astype(np.int32)), mask=pa.array(null[first : first + rows]))
                    yield pa.RecordBatch.from_arrays([*own, n, lists], names=[*keep, "n_tokens", "ids"])
                    continue
                wide = ids.astype("<u4")
                crc = [zlib.crc32(wide[a:b]) for a, b in zip(edges, edges[1:], strict=False)]
                back = units.decode(ids)
                spelled = np.concatenate([[0], np.cumsum(units.size[ids])])[edges]
                same = np.empty(rows, dtype=bool)
                for i in range(rows):
                    was, now = raw[at[first + i] : at[first + i + 1]], back[spelled[i] : spelled[i + 1]]
                    now = now[1:] if units.m.dummy and len(now) else now
                    same[i] = len(was) == len(now) and np.array_equal(was, now)
                out = [n, pa.array(crc, pa.int64(), mask=null[first : first + rows]), pa.array(same, mask=null[first : first + rows])]
                yield pa.RecordBatch.from_arrays([*own, *out], names=[*keep, "n_tokens", "ids_crc32", "round_trip"])

    return run


def _prepared(docs: DataFrame, model_path: str) -> tuple[DataFrame, bytes]:
    with open(model_path, "rb") as f:
        return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), f.read()


def encode_documents(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_tokens, ids (array<int>) for every row of ``docs``."""
    base, model = _prepared(docs, model_path)
    return base.mapInArrow(tidy(_mapper(model, ["doc_id"], False)), "doc_id long, n_tokens long, ids array<int>")


def encode_digests(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_tokens, ids_crc32, round_trip (whether decoding the ids gives the text) for every row."""
    base, model = _prepared(docs, model_path)
    return base.mapInArrow(tidy(_mapper(model, ["doc_id"], True)), "doc_id long, n_tokens long, ids_crc32 long, round_trip boolean")


def decode_documents(encoded: DataFrame, model_path: str) -> DataFrame:
    """doc_id and text of rows with doc_id and ids; null ids give a null text."""
    with open(model_path, "rb") as f:
        model = f.read()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = kept(("pieces", hashlib.sha256(model).digest()), lambda: Units(Machine(model)))
        for batch in batches:
            out = []
            for ids in batch.column("ids"):
                if ids.as_py() is None:
                    out.append(None)
                    continue
                text = units.decode(ids.values.to_numpy(zero_copy_only=False)).tobytes().decode("utf-8", "replace")
                out.append(text[1:] if units.m.dummy and text.startswith(" ") else text)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(tidy(run), "doc_id long, text string")
