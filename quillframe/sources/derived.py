"""Layout tables derived from the corpus tables: each is a narrow view of its source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..coerce import let

SIZE, PER_LINE, LINES = 12.0, 12, 40
ADVANCE = 0.52 * SIZE


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """``rows`` over all cores, where their files come in fewer parts than there are cores; else as they are.

    A file of one row group is one task however many rows are made of it. Files of a corpus have more parts than
    the cluster has cores, so nothing is shuffled there.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows._jdf.rdd().getNumPartitions() < cores else rows


#: bytes of a file that one part of ``dealt`` holds; some 200,000 words where texts are packed four to one
PART = 1 << 19


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """``rows`` of files dealt out by ``keys``, in parts whose number grows with the files.

    What is made of a row and grouped by ``keys`` (and by more, if it likes) stays in its part, so the source is
    shuffled and not the many rows made of it. A part is small enough to be sorted in memory, however large the
    files are; adaptive execution doesn't merge parts of a given number.
    """
    held = int(str(rows._jdf.queryExecution().analyzed().collectLeaves().apply(0).stats().sizeInBytes()))
    return rows.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, -(-held // PART)), *keys)


def text_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each word of ``documents``: twelve to a line, forty lines to a page.

    doc_id, page_index, seq, run_id, str, len, left, top, width, height. (doc_id, seq) tells runs apart; run_id
    is only a number to vary by. Documents are dealt out by doc_id, so what is grouped by it stays where it is.
    """
    docs = dealt(table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", "text"), "doc_id")
    words = {"ws": F.filter(F.split("text", "[\n ]"), lambda w: w != "")}
    # texts are parted into lines, then lines into words whose places are sums over a fixed number of columns: no
    # window, and no row that carries its text along
    lines = let(words, lambda v: F.transform(F.sequence(F.lit(0), F.ceil(F.size(v["ws"]) / PER_LINE).cast("int")), lambda i: F.slice(v["ws"], i * PER_LINE + 1, PER_LINE)))
    rows = docs.select("doc_id", F.posexplode(lines).alias("line", "ws"))
    rows = rows.select("doc_id", F.col("line").cast("long").alias("line"), *[F.get("ws", i).alias(f"w{i}") for i in range(PER_LINE)])
    rows = rows.select("doc_id", "line", *[f"w{i}" for i in range(PER_LINE)], *[F.coalesce(F.length(f"w{i}"), F.lit(0)).cast("long").alias(f"n{i}") for i in range(PER_LINE)])
    before = [sum((F.col(f"n{j}") for j in range(i)), F.lit(0).cast("long")) for i in range(PER_LINE)]
    placed = F.array(*[F.struct(F.lit(i).cast("long").alias("i"), F.col(f"w{i}").alias("str"), F.col(f"n{i}").alias("len"), before[i].alias("before")) for i in range(PER_LINE)])
    runs = rows.select("doc_id", "line", F.inline(placed)).where("str IS NOT NULL")
    seq = F.col("line") * PER_LINE + F.col("i")
    return runs.select(
        "doc_id",
        F.floor(F.col("line") / LINES).alias("page_index"),
        seq.alias("seq"),
        (F.col("doc_id") * 100000 + seq).alias("run_id"),
        "str",
        "len",
        (F.col("before") * ADVANCE).alias("left"),
        (F.col("line") % LINES * (1.25 * SIZE)).alias("top"),
        (F.col("len") * ADVANCE).alias("width"),
        F.lit(SIZE).alias("height"),
    )


#: the same view for the oracle
TEXT_RUN_SQL = """
word AS (SELECT doc_id, list_filter(string_split_regex(text, '[\\n ]'), lambda w: w <> '') AS ws FROM documents WHERE text IS NOT NULL),
wordrow AS (SELECT doc_id, unnest(ws) AS str, unnest(range(len(ws))) AS seq FROM word),
text_run AS MATERIALIZED (
  SELECT doc_id, seq // 12 // 40 AS page_index, seq, doc_id * 100000 + seq AS run_id, str, length(str) AS len,
    coalesce(sum(length(str)) OVER (PARTITION BY doc_id, seq // 12 ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * 6.24::DOUBLE AS "left",
    (seq // 12 % 40) * 15.0::DOUBLE AS top, length(str) * 6.24::DOUBLE AS width, 12.0::DOUBLE AS height
  FROM wordrow)"""
