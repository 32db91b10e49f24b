"""The queries of this subpackage, and the SQL that expresses some of them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import hilbert_search, lines, mixing, near_dedup, passages, piece_fst, pivot_search, quality, sharding, token_store
from ._common import Scratch, table


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_pivot_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivot_search.top_k(table(spark, sf_dir, "embeddings"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.remove_boilerplate(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.col("n_lines").cast("long").alias("n_lines"), F.col("n_removed").cast("long").alias("n_removed"), F.md5("text").alias("text_md5"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, quality.grades_of(table(spark, sf_dir, "labels")))
    return quality.score(docs, model).select("doc_id", "quality_grade", "quality_tail", (F.col("quality_tail") >= 0.5).alias("kept"))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), k=3, percent=85)


def op5_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated_passages(table(spark, sf_dir, "documents"))


def op6_hilbert_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert_search.nearest(table(spark, sf_dir, "embeddings"))


def op7_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op8_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = Scratch(spark, "store").root
    token_store.write_store(table(spark, sf_dir, "documents"), folder, tokenizer_path("word_bpe_49k.json"))
    return token_store.verify_store(spark, folder)


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_fst.encode_digests(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op10_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


SQL = {
    "op1_pivot_search": r"""
WITH usable AS (SELECT DISTINCT vec_id, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score FROM usable q JOIN usable c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id),
ranked AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10""",
    "op2_line_dedup": r"""
WITH parted AS (SELECT text, list_filter(string_split_regex(text, '[ \t\n\x0b\x0c\r]+'), lambda w: w <> '') AS ws FROM documents WHERE text IS NOT NULL GROUP BY text),
marked AS (SELECT text, CASE WHEN len(ws) >= 3 THEN list_min(list_transform(range(1, len(ws) - 1), lambda i: md5(ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]))) ELSE md5(text) END AS mark FROM parted),
line AS (
  SELECT doc_id, source, mark, text, UNNEST(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents JOIN marked USING (text)),
inked AS (
  SELECT doc_id, source, mark, text, raw, pos, trim(raw, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS k FROM line),
homes AS (SELECT k, mark, min(coalesce('s' || source, '')) AS home, count(DISTINCT text) AS texts FROM inked WHERE k <> '' GROUP BY k, mark),
bad AS (SELECT k FROM homes GROUP BY k HAVING count(DISTINCT home) >= 8 AND count(*) >= 0.15 * sum(texts)),
kept AS (
  SELECT i.doc_id, count(*) AS n_lines, count(b.k) AS n_removed, coalesce(string_agg(i.raw, chr(10) ORDER BY i.pos) FILTER (WHERE b.k IS NULL), '') AS text
  FROM inked i LEFT JOIN bad b USING (k) GROUP BY i.doc_id)
SELECT d.doc_id, CAST(coalesce(k.n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(k.n_removed, 0) AS BIGINT) AS n_removed, CASE WHEN d.text IS NOT NULL THEN md5(k.text) END AS text_md5
FROM documents d LEFT JOIN kept k USING (doc_id)""",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_pivot_search": op1_pivot_search,
        "op2_line_dedup": op2_line_dedup,
        "op3_quality": op3_quality,
        "op4_near_dedup": op4_near_dedup,
        "op5_passages": op5_passages,
        "op6_hilbert_search": op6_hilbert_search,
        "op7_shards": op7_shards,
        "op8_token_store": op8_token_store,
        "op9_sentencepiece": op9_sentencepiece,
        "op10_mix": op10_mix,
    }


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
