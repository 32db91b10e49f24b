"""The corpus pipeline: five stages from raw documents to encoded training text.

quality classifier -> line dedup -> MinHash near-dedup -> mixing to target weights -> SentencePiece

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last keep the columns of
``documents`` (doc_id, text, lang, source, n_chars). ``run`` writes each stage's result to the
shared folder as Parquet and reads it again as the next one's docs, which also cuts lineage.

Defined cases, for every stage: rows are told apart by all their columns, never by doc_id alone, so rows
without doc_id, repeated rows and rows of one doc_id with other texts are each treated by their own text. A
null or empty text is kept by the classifier, has no lines to lose and no near copies, counts no words in the mix
(it comes as often as its source's whole passes say) and encodes to null or no ids. Further columns, and columns
with clashing names, don't reach the next stage. An empty table gives an empty result. Ties go as the operators say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillframe.llm import lines, mixing, near_dedup, piece_fst, quality
from quillframe.llm._common import Scratch, table
from quillframe.llm.queries import tokenizer_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
KEEP_TAIL = 0.5


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose chance of the top grade is KEEP_TAIL or more; the model is fitted to the rated ones among ``docs``."""
    model = quality.fit(docs, quality.grades_of(table(spark, sf_dir, "labels")))
    return quality.score(docs, model).where(F.col("quality_tail") >= KEEP_TAIL).select(*COLUMNS)


def strip_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without cross-site boilerplate lines; a document that was nothing else goes."""
    out = lines.remove_boilerplate(docs.select(*COLUMNS))
    whole = F.col("n_removed") == 0
    kept = out.where(whole | (F.trim(F.regexp_replace("text", r"[\x09-\x0D]", " ")) != ""))
    return kept.withColumn("n_chars", F.when(whole, F.col("n_chars")).otherwise(F.length("text").cast("long"))).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least doc_id, of each group of near copies: five-word shingles, similarity 0.8 or more.

    Rows equal in doc_id and text are copies too; rows without doc_id take no part and stay, each.
    """
    return near_dedup.keep_one(docs.select(*COLUMNS), k=5, percent=80)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as many times as the mix takes it."""
    return mixing.repeated(docs.select(*COLUMNS))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_crc32 and whether decoding gives the text back, for each row of the mix."""
    return piece_fst.encode_digests(docs, tokenizer_path("piece_bpe_32k.model"))


STAGES = [
    ("quality classifier", classify),
    ("line dedup", strip_lines),
    ("MinHash near-dedup", drop_near_copies),
    ("mixing sources to target weights", mix),
    ("SentencePiece encoding and decoding", encode),
]

#: SQL can express neither the fitted classifier nor the transducer; tests hold both against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark, "pipeline")
    for name, stage in STAGES:
        docs = scratch.table(stage(spark, docs, sf_dir), name.split()[0])
    return docs
