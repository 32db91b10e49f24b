"""Encoding by distinct unit: each distinct byte string of a slice is encoded once, then gathered.

A worker keeps what it has encoded, over its tasks, in two dictionaries of limited size, so
memory stays bounded whatever the corpus holds. Results never depend on what is kept.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from ._text import distinct

KEEP_BYTES = 40 << 20
ENTRY_BYTES = 180
LONGEST = 64


class Memo:
    """``encode`` gives (ids of byte strings one after another, how many each has). Two generations are kept: when the younger is full it
    becomes the elder, and what is met again moves back."""

    def __init__(self, encode: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], dtype=np.uint16, keep: int = KEEP_BYTES):
        self.keep, self.encode, self.dtype, self.young, self.old, self.held = keep, encode, np.dtype(dtype), {}, {}, 0

    def __call__(self, raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all units one after another, number of ids of each unit)."""
        if not len(start):
            return np.zeros(0, self.dtype), np.zeros(0, np.int64)
        first, inverse = distinct(raw, start, end)
        text = raw.tobytes()
        keys = [text[a:b] for a, b in zip(start[first].tolist(), end[first].tolist(), strict=True)]
        found = list(map(self.young.get, keys))
        missing = [i for i, f in enumerate(found) if f is None]
        if missing:
            new = []
            for i in missing:
                f = found[i] = self.old.get(keys[i])
                if f is None:
                    new.append(i)
            if new:
                flat, size = self.encode([keys[i] for i in new])
                held, edge = flat.astype(self.dtype, copy=False).tobytes(), (np.cumsum(size) * self.dtype.itemsize).tolist()
                for i, a, b in zip(new, [0, *edge], edge, strict=False):
                    found[i] = held[a:b]
            for i in missing:
                if len(keys[i]) <= LONGEST:
                    self.young[keys[i]] = found[i]
            self.held += sum(ENTRY_BYTES + len(keys[i]) + len(found[i]) for i in missing if len(keys[i]) <= LONGEST)
            if self.held > self.keep:
                self.young, self.old, self.held = {}, self.young, 0
        flat = np.frombuffer(b"".join(found), dtype=self.dtype)
        size = np.fromiter(map(len, found), dtype=np.int64, count=len(found)) // self.dtype.itemsize
        return gather(flat, np.cumsum(size) - size, size, inverse)


_kept: dict[object, object] = {}


def kept(key: object, make: Callable[[], object]) -> object:
    """What ``make`` gave before under this key in this worker; the latest key is held."""
    if key not in _kept:
        while _kept:
            _kept.pop(next(iter(_kept)))
        _kept[key] = make()
    return _kept[key]


def gather(flat: np.ndarray, start: np.ndarray, size: np.ndarray, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """flat[start[p] : start[p] + size[p]] for each p of ``pick``, one after another, and their sizes."""
    n = size[pick]
    at = np.cumsum(n) - n
    where = np.repeat(start[pick] - at, n)
    where += np.arange(len(where))
    return flat[where], n
