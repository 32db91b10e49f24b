"""Vectorised scanning of Arrow text columns: word bounds and word hashes without a Python loop per word.

Words are ``[^\x20\x09-\x0D]+`` over UTF-8 bytes, which is the same as over characters, since every
byte of a multi-byte character is above 0x7F. Whole texts are scanned, in slices that hold memory
to a few dozen MB; a slice ends between documents, and hashing steps through long documents. Word hashes have
64 bits: two given sets of 1,000 shingles each are told apart but with a chance of 5e-14.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash

SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

GROUP_BYTES = 2 << 20
STEP_BYTES = 1 << 19

_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_ROLL = np.uint64(0xD6E8FEB86659FD93)
_S33 = np.uint64(33)
#: what is left of eight bytes when 0 to 8 of them count
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)
LONG = 64


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every input bit."""
    h = h ^ (h >> _S33)
    h = h * _M1
    h ^= h >> _S33
    h *= _M2
    return h ^ (h >> _S33)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n + 1 offsets of a string column; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw, at.astype(np.int64)


class Words(NamedTuple):
    first: int  # position of the slice's first document in the batch
    count: np.ndarray  # words of each document in the slice
    bounds: np.ndarray  # n + 1 positions: where each document's words begin
    start: np.ndarray  # byte positions in ``raw``
    end: np.ndarray
    raw: np.ndarray
    hash: np.ndarray  # uint64 of the word's bytes

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.count)), self.count)


def groups(at: np.ndarray, most: int = GROUP_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of whole documents of up to ``most`` bytes, one document at least."""
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, side="right")) - 1)
        yield i, j
        i = j


class Lanes:
    """Eight bytes from any place of a run of bytes, as one number."""

    def __init__(self, part: np.ndarray):
        room = np.zeros(len(part) + 8, dtype=np.uint8)
        room[: len(part)] = part
        self.at = np.ndarray(shape=(len(part) + 1,), dtype="<u8", buffer=room, strides=(1,))

    def __call__(self, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The first ``size`` bytes (8 at most) from each start."""
        return self.at[start] & _MASK[np.minimum(size, 8)]


def word_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool) -> np.ndarray:
    """uint64 of each run of bytes. Eight bytes at a time go through a mixing step of all the bits before, so that
    no arrangement of equal letters cancels out; runs above LONG bytes get their XXH3."""
    out = np.empty(len(start), dtype=np.uint64)
    i = 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(end, start[i] + STEP_BYTES, side="right")))
        a, b = int(start[i]), int(end[j - 1])
        part = LOWER[raw[a:b]] if lower else raw[a:b]
        lanes, s, n = Lanes(part), start[i:j] - a, end[i:j] - start[i:j]
        h = mix(n.astype(np.uint64) * _ROLL + lanes(s, n))
        more, at = np.flatnonzero(n > 8), 8
        while len(more) and at < LONG:
            h[more] = mix(h[more] * _ROLL + lanes(s[more] + at, n[more] - at))
            at += 8
            more = more[n[more] > at]
        for w in more.tolist():
            h[w] = xxhash.xxh3_64_intdigest(part[s[w] : s[w] + n[w]].tobytes())
        out[i:j] = h
        i = j
    return out


def differing(raw: np.ndarray, start: np.ndarray, end: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Which runs of bytes aren't equal to run ``other`` of the same list."""
    base = int(start[0]) if len(start) else 0
    lanes = Lanes(raw[base : int(end[-1])] if len(start) else raw[:0])
    s, n = start - base, end - start
    wrong = n != n[other]
    at, todo = 0, np.flatnonzero(~wrong & (other != np.arange(len(other))))
    while len(todo) and at < LONG:
        o = other[todo]
        wrong[todo] |= lanes(s[todo] + at, n[todo] - at) != lanes(s[o] + at, n[todo] - at)
        at += 8
        todo = todo[(n[todo] > at) & ~wrong[todo]]
    for i in todo.tolist():
        o = other[i]
        wrong[i] = not np.array_equal(raw[start[i] : end[i]], raw[start[o] : end[o]])
    return np.flatnonzero(wrong)


def distinct(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(where each distinct run of bytes first stands, which of these each run is). Equal hashes are checked byte by byte."""
    inverse, found = pd.factorize(word_hashes(raw, start, end, lower=False))
    first = np.empty(len(found), dtype=np.int64)
    first[inverse[::-1]] = np.arange(len(inverse) - 1, -1, -1)
    odd = differing(raw, start, end, first[inverse])
    if len(odd):
        extra: dict[bytes, int] = {}
        more = []
        for i in odd.tolist():
            key = raw[start[i] : end[i]].tobytes()
            if key not in extra:
                extra[key] = len(first) + len(more)
                more.append(i)
            inverse[i] = extra[key]
        first = np.concatenate([first, np.array(more, dtype=np.int64)])
    return first, inverse


def scan(column: pa.Array, lower: bool = True, hashes: bool = True, most: int = GROUP_BYTES, space: np.ndarray = SPACE) -> Iterator[Words]:
    raw, at = buffers(column)
    for i, j in groups(at, most):
        lo, hi = int(at[i]), int(at[j])
        ink = ~space[raw[lo:hi]]
        first, last = ink.copy(), ink.copy()
        first[1:] &= ~ink[:-1]
        last[:-1] &= ~ink[1:]
        edge = at[i:j] - lo
        edge = edge[edge < hi - lo]
        first[edge] = ink[edge]
        edge = edge[edge > 0] - 1
        last[edge] = ink[edge]
        start = np.flatnonzero(first) + lo
        end = np.flatnonzero(last) + lo + 1
        bounds = np.searchsorted(start, at[i : j + 1])
        h = word_hashes(raw, start, end, lower) if hashes else np.zeros(0, np.uint64)
        yield Words(i, np.diff(bounds), bounds, start, end, raw, h)


def rolled(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k consecutive words from each position; len(h) - k + 1 of them."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = h[:n].copy()
    for j in range(1, k):
        out *= _ROLL
        out += h[j : j + n]
    return mix(out)


def shingle_sets(words: Words, k: int) -> list[np.ndarray]:
    """Each document's sorted distinct shingle hashes; a text of 1 to k-1 words is one shingle."""
    rolls, sets = rolled(words.hash, k), []
    bounds = words.bounds
    for d in range(len(words.count)):
        a, b = int(bounds[d]), int(bounds[d + 1])
        if b - a >= k:
            s = np.sort(rolls[a : b - k + 1])
            keep = np.ones(len(s), dtype=bool)
            keep[1:] = s[1:] != s[:-1]
            sets.append(s[keep])
        elif b > a:
            sets.append(mix(rolled(words.hash[a:b], b - a) + np.uint64(b - a)))
        else:
            sets.append(np.zeros(0, dtype=np.uint64))
    return sets
