"""Line dedup by distinct-site spread: boilerplate that many sites share is cut from every text.

A line (text between line feeds, trimmed of ``[\\x20\\x09-\\x0D]``; blank lines never count) is
boilerplate when it stands on at least ``min_sites`` distinct sites. Copies of a document on many sites
spread all their lines, though none is boilerplate; they belong to document dedup and keep their
text. So each text has a mark, the least MD5 of its three-word shingles, which exact copies share always and
near copies mostly; texts of one mark count as one document on one site, the least of theirs. What
edits of near copies leave of that is far below ``min_share``: a line's texts must have that many distinct
marks each.

Spread is sketched: one HyperLogLog per line hash, merged by aggregation, so that a line on every
page of a third of the corpus still shuffles one sketch per task. Only lines that may have ``min_sites``
sites are looked at again; of these, the sites of distinct marks are sketched likewise, and lines whose
estimate is within four standard errors of the threshold get an exact distinct count; further ones
are settled by the sketch.

Defined cases: a null site counts as one site of its own; null texts stay null and have no lines;
rows with null or repeated doc_id are treated row by row; every other column passes through, but for
columns of the input named n_lines or n_removed, which give way to the counts. Very long texts are read
whole. An empty table gives an empty result.
A text that loses all its lines becomes empty, and stays as a row.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import Scratch

BLANK = " \t\n\x0b\x0c\r"
SPACES = "[ \\t\\n\\x0b\\x0c\\r]+"
LG_K = 11
MIN_SITES, MIN_SHARE = 8, 0.15


def _keys(lines: Column) -> Column:
    """For each line (hash, length), null where blank."""
    trimmed = F.transform(lines, lambda x: F.btrim(x, F.lit(BLANK)))
    return F.transform(trimmed, lambda x: F.when(x != "", F.struct(F.xxhash64(x).alias("h"), F.length(x).alias("n"))))


def _mark(text: Column) -> Column:
    """The least MD5 of the three-word shingles; that of the text itself where it has fewer words."""
    words = F.filter(F.split(text, SPACES), lambda w: w != "")

    def least(ws: Column) -> Column:
        shingles = F.transform(F.sequence(F.lit(0), F.size(ws) - 3), lambda i: F.md5(F.concat_ws(" ", F.get(ws, i), F.get(ws, i + 1), F.get(ws, i + 2))))
        return F.when(F.size(ws) >= 3, F.array_min(shingles)).otherwise(F.md5(text))

    # bound once, so that the words are parted once
    return F.transform(F.array(words), least)[0]


def _site(site: str) -> Column:
    return F.coalesce(F.concat(F.lit("s"), F.col(site).cast("string")), F.lit(""))


def _read(docs: DataFrame, text: str, site: str) -> DataFrame:
    """row, site, mark and lines (key, at) of each text: what all counts need, without the text."""
    return docs.where(F.col(text).isNotNull()).select(
        F.struct(F.col("doc_id").alias("id"), F.xxhash64(text).alias("t")).alias("row"),
        _site(site).alias("site"),
        _mark(F.col(text)).alias("mark"),
        F.filter(F.transform(_keys(F.split(text, "\n")), lambda k, i: F.struct(k.alias("key"), i.alias("at"))), lambda x: x["key"].isNotNull()).alias("lines"),
    )


def _sketched(rows: DataFrame, site: str) -> DataFrame:
    return rows.groupBy("key").agg(F.hll_sketch_agg(site, F.lit(LG_K)).alias("sketch")).select("key", F.hll_sketch_estimate("sketch").alias("estimate"))


def boilerplate(docs: DataFrame, scratch: Scratch, text: str = "text", site: str = "source", min_sites: int = MIN_SITES, min_share: float = MIN_SHARE) -> tuple[DataFrame, DataFrame]:
    """(lines, places): key, sites, texts, marks of each boilerplate line; where spread lines stand (key, row, at)."""
    margin = 4 * 1.04 / math.sqrt(1 << LG_K)
    least = math.floor(min_sites * (1 - margin))
    read = scratch.table(_read(docs, text, site), "lines")
    spread = _sketched(read.select("site", F.explode("lines.key").alias("key")), "site").where(F.col("estimate") >= least)
    spread = scratch.table(spread.select("key"), "spread")
    places = read.select("row", "site", "mark", F.explode("lines").alias("l")).select("row", "site", "mark", "l.key", "l.at")
    places = scratch.table(places.join(spread.hint("merge"), "key"), "places")
    texts = places.groupBy("key", "mark", F.col("row.t").alias("t")).agg(F.min("site").alias("site"))
    marks = scratch.table(texts.groupBy("key", "mark").agg(F.min("site").alias("home"), F.count("*").alias("texts")), "marks")
    counts = marks.groupBy("key").agg(F.count("*").alias("marks"), F.sum("texts").alias("texts"))
    found = _sketched(marks, "home").join(counts, "key").where((F.col("estimate") >= least) & (F.col("marks") >= F.col("texts") * min_share))
    found = scratch.table(found, "found")
    near = found.where(F.col("estimate") <= math.ceil(min_sites * (1 + margin))).select("key")
    exact = marks.join(near, "key", "left_semi").groupBy("key").agg(F.countDistinct("home").alias("exact"))
    lines = found.join(exact, "key", "left").select("key", F.coalesce("exact", "estimate").alias("sites"), "texts", "marks").where(F.col("sites") >= min_sites)
    lines = scratch.table(lines, "boilerplate")
    scratch.drop(read, spread, marks, found)
    return lines, places


def remove_boilerplate(docs: DataFrame, text: str = "text", site: str = "source", min_sites: int = MIN_SITES, min_share: float = MIN_SHARE) -> DataFrame:
    """``docs`` with ``text`` cleaned, and n_lines and n_removed besides."""
    scratch = Scratch(docs.sparkSession, "lines")
    lines, places = boilerplate(docs, scratch, text, site, min_sites, min_share)
    gone = scratch.table(places.join(lines.select("key").hint("merge"), "key", "left_semi").groupBy("row").agg(F.collect_set("at").alias("gone")), "gone")
    scratch.drop(lines, places)
    keyed = docs.withColumn("__row", F.struct(F.col("doc_id").alias("id"), F.xxhash64(text).alias("t")))
    split = F.split(text, "\n")
    kept = F.when(F.col("__gone").isNull(), F.col(text)).otherwise(
        F.array_join(F.filter(split, lambda _, i: ~F.array_contains("__gone", i)), "\n")
    )
    # merged at every size: a plan that broadcasts while ``gone`` is small would change as the corpus grows
    joined = keyed.join(gone.select(F.col("row").alias("__row"), F.col("gone").alias("__gone")).hint("merge"), "__row", "left")
    return joined.select(
        *[kept.alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("n_lines", "n_removed")],
        F.when(F.col(text).isNull(), 0).otherwise(F.size(split)).alias("n_lines"),
        F.coalesce(F.size("__gone"), F.lit(0)).alias("n_removed"),
    )
