"""Shared plumbing: scratch tables in the cluster's shared folder, input coercion."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, nullcontext, suppress
from functools import wraps

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or a local one in local mode only."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    found = spark.sparkContext._jsc.sc().getCheckpointDir()
    if found.isDefined():
        return found.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    base = f"file://{tempfile.gettempdir()}/quillframe-{uuid.uuid4().hex[:12]}"
    spark.conf.set("spark.checkpoint.dir", base)
    return base


class Scratch:
    """Intermediate tables written as Parquet below the shared folder.

    A written table cuts lineage like a reliable checkpoint does, is compressed, and outlives lost
    executors. Tables that a lazy result still reads stay until the interpreter ends; ``drop``
    removes one earlier. With ``lean`` the shuffle files of a table go as soon as it is written.
    """

    def __init__(self, spark: SparkSession, label: str, lean: bool = False):
        self.spark, self.lean = spark, lean
        self.root = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
        self._n = 0
        atexit.register(self.close)

    def _delete(self, path: str) -> None:
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(p, True)

    def path(self, name: str) -> str:
        self._n += 1
        return f"{self.root}/{self._n:03d}-{name}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        path = self.path(name)
        with setting(self.spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true") if self.lean else nullcontext():
            df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        for df in frames:
            path = getattr(df, "_scratch_path", None)
            if path:
                self._delete(path)

    def close(self) -> None:
        try:
            self._delete(self.root)
        except Exception:  # the session has ended; the folder goes with the cluster's clean-up
            pass


@contextmanager
def setting(spark: SparkSession, name: str, value: str):
    """A setting of the session that holds for what runs inside."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def small_batches(spark: SparkSession, rows: int = 1024):
    """Arrow batches of at most ``rows`` rows for what runs inside; long texts and wide keys then take little memory in a worker."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = int(spark.conf.get(name))
    return setting(spark, name, str(min(rows, before) if before > 0 else rows))


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` over the batches of a task; afterwards the worker, which waits for further tasks, gives back the memory it has freed."""

    @wraps(run)
    def tidied(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            release()

    return tidied


def release() -> None:
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # other C libraries than glibc have no such function
        ctypes.CDLL(None).malloc_trim(0)


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, cast; whatever else the input has (clashing names too) is left out."""
    return df.select(*[F.col(f"`{name}`").cast(kind).alias(name) for name, kind in columns.items()])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def schema_of(text: str) -> T.StructType:
    return T._parse_datatype_string(text)
