"""Undo history as a stateful stream: one state (stack, cursor) for each key, kept by the state store.

Events of a key must come in order of (ts, event_id) across batches; within a batch they are sorted.
A state holds the key's whole stack, as the batch fold does, so both always agree.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.history import step

OUT = "user_id long, n_events long, stack_size long, cursor long, current string"
STATE = "n long, cursor long, stack array<string>"


def folder(baseline: str):
    def fold(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n, cursor, stack = state.get if state.exists else (0, 0, [baseline])
        stack = list(stack)
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        for kind, snapshot in zip(rows["kind"], rows["snapshot"], strict=True):
            cursor = step(stack, cursor, kind, snapshot)
        n += len(rows)
        state.update((n, cursor, stack))
        yield pd.DataFrame({"user_id": [key[0]], "n_events": [n], "stack_size": [len(stack)], "cursor": [cursor], "current": [stack[cursor]]})

    return fold


def replay(events: DataFrame, baseline: str = "0") -> DataFrame:
    """The state of each key after each batch of a stream of (user_id, ts, event_id, kind, snapshot)."""
    return events.groupBy("user_id").applyInPandasWithState(folder(baseline), OUT, STATE, "update", "NoTimeout")


def replay_table(spark: SparkSession, path: str) -> DataFrame:
    """A finite event table run through the stream; the last state of each key, read from the tables its batches wrote."""
    schema = spark.read.parquet(path).schema
    # as a pattern, since a stream takes a folder or a pattern, not a single file
    raw = spark.readStream.schema(schema).parquet(f"{path[:-1]}[{path[-1]}]")
    kind = F.when(F.col("event_type") == "error", "undo").when(F.col("event_type") == "view", "redo").otherwise("commit")
    events = raw.select("user_id", "ts", "event_id", kind.alias("kind"), F.floor(F.col("value") / 20).cast("string").alias("snapshot"))
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:  # unset in tests alone, where all run on one machine
        shared = f"file://{tempfile.mkdtemp(prefix='quillframe-history-')}"
    place = f"{shared.rstrip('/')}/history-{uuid.uuid4().hex}"

    def keep(batch: DataFrame, number: int) -> None:
        # a batch that is run again after a failure replaces what it wrote before
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{place}/states/{number}")

    run = replay(events).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{place}/checkpoint").trigger(availableNow=True).start()
    run.awaitTermination()
    seen = spark.read.schema(f"{OUT}, batch int").parquet(f"{place}/states/*")
    last = seen.groupBy("user_id").agg(F.max_by(F.struct("n_events", "stack_size", "cursor", "current"), "n_events").alias("s"))
    return last.select("user_id", "s.n_events", "s.stack_size", "s.cursor", "s.current")
