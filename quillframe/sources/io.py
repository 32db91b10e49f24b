"""Readers and writers of the engine's files: binary documents, requests, tables, paint commands, archives.

Rendering, recognition and document encoding need libraries outside Spark; ``decoded`` takes one as a
function and runs it where the bytes are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import one_line_base64, stem

#: The first bytes of the formats.
MAGIC = {"pdf": b"%PDF-", "png": b"\x89PNG\r\n\x1a\n", "jpg": b"\xff\xd8\xff"}


def files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, name, content, format (by first bytes) of each file."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    form = F.lit(None).cast("string")
    for name, start in MAGIC.items():
        form = F.when(F.substring("content", 1, len(start)) == F.lit(bytearray(start)), name).otherwise(form)
    return raw.select("path", F.regexp_extract("path", "([^/]*)$", 1).alias("name"), "content", form.alias("format"))


#: JPEG markers that start a frame.
FRAMES = tuple(m for m in range(0xC0, 0xD0) if m not in (0xC4, 0xC8, 0xCC))


def _jpeg_size(content: bytes) -> tuple[int, int] | None:
    """(width, height) of the first frame, found by walking the segments."""
    at = 2
    while at + 9 <= len(content):
        if content[at] != 0xFF:
            return None
        mark = content[at + 1]
        if mark == 0xFF or mark == 0x01 or 0xD0 <= mark <= 0xD8:  # filling, or marks without a length
            at += 1 if mark == 0xFF else 2
            continue
        if mark in FRAMES:
            return int.from_bytes(content[at + 7 : at + 9], "big"), int.from_bytes(content[at + 5 : at + 7], "big")
        at += 2 + int.from_bytes(content[at + 2 : at + 4], "big")
    return None


def image_sizes(images: DataFrame) -> DataFrame:
    """Width and height of PNG and JPEG files, from their headers; null for others."""

    @F.pandas_udf("struct<width long, height long>")
    def jpeg(content: pd.Series) -> pd.DataFrame:
        found = [_jpeg_size(bytes(c)) if c is not None else None for c in content]
        return pd.DataFrame({k: pd.array([f and f[i] for f in found], dtype="Int64") for i, k in enumerate(("width", "height"))})

    word = lambda at: F.conv(F.hex(F.substring("content", at, 4)), 16, 10).cast("long")
    read = images.withColumn("__jpeg", jpeg(F.when(F.col("format") == "jpg", F.col("content"))))
    size = {k: F.when(F.col("format") == "png", word(at)).when(F.col("format") == "jpg", F.col(f"__jpeg.{k}")) for k, at in (("width", 17), ("height", 21))}
    return read.withColumns(size).drop("__jpeg")


def language(spark: SparkSession, default: str = "en") -> str:
    """The session's language preference."""
    return spark.conf.get("quillframe.language", default)


def decoded(documents: DataFrame, decode: Callable[[bytes], pd.DataFrame], schema: str) -> DataFrame:
    """Rows that ``decode`` gives for each document's content, beside its path."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                yield decode(bytes(content)).assign(path=path)

    return documents.select("path", "content").mapInPandas(run, f"{schema}, path string")


def json_requests(spark: SparkSession, path: str) -> DataFrame:
    """One request body a file, unparsed."""
    return spark.read.text(path, wholetext=True).withColumnRenamed("value", "body")


def tables(spark: SparkSession, path: str, kind: str, schema: str | None = None, **options: str) -> DataFrame:
    """Parquet, ORC, CSV or JSON; CSV and JSON need a schema."""
    if kind in ("csv", "json") and schema is None:
        raise ValueError("csv and json need a schema")
    reader = spark.read.format(kind).options(**options)
    return (reader.schema(schema) if schema else reader).load(path)


def data_urls(images: DataFrame) -> DataFrame:
    return images.withColumn("data_url", F.concat(F.lit("data:image/"), F.when(F.col("format") == "jpg", "jpeg").otherwise(F.col("format")), F.lit(";base64,"), one_line_base64(F.col("content"))))


def write_pages(pages: DataFrame, path: str, by: str | None = None) -> None:
    """Split output: one folder for all pages, or one for each range."""
    writer = pages.write.mode("errorifexists")
    (writer.partitionBy(by) if by else writer).parquet(path)


def write_texts(texts: DataFrame, path: str, column: str) -> None:
    texts.select(F.col(column).alias("value")).write.mode("errorifexists").text(path)


def named_outputs(pages: DataFrame, source: str, kind: str) -> DataFrame:
    """File names of a document's pages, and of its archive."""
    return pages.withColumns({"file": F.format_string(f"page-%03d.{kind}", F.col("page")), "archive": F.concat(stem(F.col(source), "converted"), F.lit(".zip"))})


def edited_name(source: str) -> F.col:
    return F.concat(stem(F.col(source), "edited-document", r"(?i)\.pdf$"), F.lit("-edited.pdf"))


def archives(outputs: DataFrame, key: str) -> DataFrame:
    """A deflated archive of the outputs (file, content) of each key: as large as what it holds, so a key is one document."""
    import io
    import zipfile

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        held = io.BytesIO()
        with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
            for row in pdf.sort_values("file").itertuples():
                z.writestr(row.file, bytes(row.content))
        return pd.DataFrame({key: pdf[key].iloc[:1], "archive": [held.getvalue()]})

    kind = dict(outputs.dtypes)[key]
    return outputs.select(key, "file", "content").groupBy(key).applyInPandas(pack, f"{key} {kind}, archive binary")
