"""Undo history: commits, undo and redo replayed in order.

``step`` is the rule; ``replayed`` folds a table with it, a key after another over rows sorted by key and
order, so a history of any length is read as a stream and only its stack is held. ``streaming.history`` folds a
stream with the same rule.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def step(stack: list[str], cursor: int, kind: str, snapshot: str) -> int:
    """The cursor after one event; ``stack`` is changed in place.

    A commit equal to the current snapshot is none; another cuts what was undone and is appended. Undo
    stops at the baseline, redo at the end.
    """
    if kind == "undo":
        return max(cursor - 1, 0)
    if kind == "redo":
        return min(cursor + 1, len(stack) - 1)
    if stack[cursor] != snapshot:
        del stack[cursor + 1 :]
        stack.append(snapshot)
        return len(stack) - 1
    return cursor


def replayed(events: DataFrame, key: str, order: list[str], baseline: str = "0") -> DataFrame:
    """key, n_events, stack_size, cursor, current snapshot. A key's events are one user's edits of one page."""

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: tuple | None = None
        done: list[tuple] = []
        stack, cursor, n = [baseline], 0, 0
        for pdf in batches:
            for k, kind, snapshot in zip(pdf[key], pdf["kind"], pdf["snapshot"], strict=True):
                if held != (k,):
                    if held is not None:
                        done.append((*held, n, len(stack), cursor, stack[cursor]))
                    held, stack, cursor, n = (k,), [baseline], 0, 0
                cursor, n = step(stack, cursor, kind, snapshot), n + 1
            yield pd.DataFrame(done, columns=[key, "n_events", "stack_size", "cursor", "current"])
            done = []
        if held is not None:
            yield pd.DataFrame([(*held, n, len(stack), cursor, stack[cursor])], columns=[key, "n_events", "stack_size", "cursor", "current"])

    kind = dict(events.dtypes)[key]
    rows = events.where(F.col(key).isNotNull()).repartition(key).sortWithinPartitions(key, *order)
    return rows.select(key, "kind", "snapshot").mapInPandas(fold, f"{key} {kind}, n_events long, stack_size long, cursor long, current string")
