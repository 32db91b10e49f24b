"""Queries on scans, nodes, snapshots and calibration."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import one_line_base64, stem
from ..operators import edits, masks, nodes, scans, shapes
from ..sources.derived import table
from .edits import _W, boxes
from .text import NAMED_SQL, named_fonts, r6


def node_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and scaled sizes, the mask in pixels, where the text stands, its scale worked out anew."""
    k = F.col("p_partkey")
    p = table(spark, sf_dir, "part").select(
        k.alias("k"), F.col("p_name").alias("original_text"), F.lit("").alias("edited_text"), F.when(k % 5 == 0, F.lit(None)).otherwise(k % 7 * 10.0 - 10).alias("base"), (k % 90).cast("double").alias("mask_width"), F.when(k % 3 == 0, F.lit(0.0)).otherwise(k % 4 * 0.5).alias("mask_scale"),
        F.when(k % 2 == 0, F.lit(None)).otherwise(1.5).cast("double").alias("pad_x"), (k % 30 + 6.0).alias("font_size"), F.when(k % 4 == 0, F.lit(float("nan"))).when(k % 4 == 1, F.lit(None)).otherwise(k % 6 * 0.6).alias("original_scale_x"), F.lit(1.0).alias("scale_x"),
    )
    c = F.col
    p = p.withColumn("rect", nodes.mask_rect(c("k") % 11 + 0.5, c("k") % 13 - 0.5, c("mask_width"), c("font_size"), c("mask_scale"), F.lit(1.0)))
    p = p.withColumns({"width": nodes.base_dimension(c("base"), c("mask_width"), c("mask_scale"), 6.0), "place": nodes.text_place(c("rect.left"), c("rect.top"), c("pad_x"), F.lit(None).cast("double"), F.lit(0.25), F.lit(None).cast("double"), c("rect.width"))})
    out = nodes.recalibrated(p)
    return out.select("k", r6(c("width")).alias("width"), *[r6(c(f"rect.{x}")).alias(f"mask_{x}") for x in ("left", "top", "width", "height")], *[r6(c(f"place.{x}")).alias(f"text_{x}") for x in ("left", "top", "width")], r6(c("scale_x")).alias("scale"), nodes.comparable(c("original_text")).alias("comparable"))


def _page_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A decoded page for each turn: a text block with a line for each sentence, then a picture."""
    span = lambda w, i: F.struct(F.when(i % 7 == 3, F.array(F.lit(0.0), F.lit(1.0), F.lit(2.0))).otherwise(F.array(i * 10.0, F.lit(5.0), i * 10.0 + F.length(w), F.lit(17.0))).alias("bbox"), F.when(i % 5 == 0, F.lit(None)).otherwise(w).alias("font"), F.length(w).cast("double").alias("size"), (i * 7).alias("color"), F.lit(None).cast("int").alias("flags"))
    lines = F.transform(F.split("text", "[.]"), lambda s: F.struct(F.transform(F.filter(F.split(s, " "), lambda w: w != ""), span).alias("spans")))
    block = lambda kind, own: F.struct(F.lit(kind).alias("type"), own.alias("lines"))
    return table(spark, sf_dir, "conversations").where("text IS NOT NULL").select("conv_id", "turn", F.array(block(0, lines), block(1, lines)).alias("blocks"))


def span_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scans.spans(_page_blocks(spark, sf_dir), ["conv_id", "turn"])
    return s.groupBy("conv_id", "turn").agg(F.count("*").alias("spans"), F.sum(F.col("line") * 1000 + F.col("span")).alias("places"), r6(F.sum("rect.width")).alias("widths"), F.sum(F.length("font")).alias("chars"), F.sum("color").alias("colours"), F.max("block").alias("block"))


STYLES = (("serif", "Times New Roman", 0.9, -0.3), ("Caveat", None, None, 0.25), ("tt12", "x", 0.7, None))


def item_style(spark: SparkSession, sf_dir: str) -> DataFrame:
    styles = spark.createDataFrame(STYLES, "font_name string, font_family string, ascent double, descent double")
    f = scans.styled(named_fonts(spark, sf_dir).select("k", F.col("name").alias("font_name")), styles)
    return f.select("k", "font_family", "ascent", "descent")


def snapshot_restore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes written as JSON and read again."""
    b = edits.refreshed(boxes(spark, sf_dir))
    held = b.select("doc_id", "box_seq", nodes.snapshot(b).alias("snapshot"))
    r = nodes.restored(held, "snapshot", b)
    return r.groupBy("doc_id").agg(F.count("*").alias("boxes"), F.count_if("has_edit").alias("edited"), F.count_if("is_deleted").alias("deleted"), F.sum(F.length("edited_text")).alias("chars"), r6(F.sum("left")).alias("lefts"), F.count_if(edits.is_moved()).alias("moved"))


def page_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = edits.refreshed(boxes(spark, sf_dir))
    pages = b.select("doc_id", "page_index").distinct()
    own = b.where((F.col("k") % 3 == 0) & (F.col("page_index") % 2 == 0)).withColumn("has_edit", F.col("has_edit") & (F.col("doc_id") % 5 != 0))
    return scans.entries(pages, own, ["doc_id", "page_index"]).select("doc_id", "page_index", "objects")


def page_download(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one page asked for of each page's outputs, with its name; and its bytes as a data URL."""
    k = F.col("page_id")
    p = table(spark, sf_dir, "pages").withColumn("page", F.explode(F.sequence(F.lit(1), F.lit(4))))
    one = scans.one_page(p.withColumn("asked", k % 6), F.col("asked"))
    return one.select("page_id", "page", F.concat(stem(F.regexp_extract("url", "([^/]*)/?$", 1), "converted", r"(?i)\.pdf$"), F.format_string("-%03d.png", "page")).alias("file"), F.md5(F.concat(F.lit("data:image/png;base64,"), one_line_base64(F.col("html").cast("binary")))).alias("data_url"))


def font_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    faces = table(spark, sf_dir, "pages").select("page_id", "url")
    files = table(spark, sf_dir, "pages").where("html IS NOT NULL").groupBy("url").agg(F.min(F.encode("html", "UTF-8")).alias("content")).where(F.length("url") % 3 != 0)
    return scans.with_font_bytes(faces, files).select("page_id", F.length("font_bytes").cast("long").alias("bytes"))


KINDS = ("text_box", "rect", "ellipse", "triangle", "polygon", "line", "path", "i-text", "textbox", "image")


def property_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    p = table(spark, sf_dir, "part").select(k.alias("k"), F.element_at(F.array(*[F.lit(x) for x in KINDS]), (k % len(KINDS) + 1).cast("int")).alias("kind"), F.lit("old").alias("stroke"), F.lit(1.0).alias("stroke_width"), F.lit("none").alias("fill"), F.lit(8.0).alias("font_size"), F.lit("f").alias("font_family"))
    return shapes.painted(p, F.col("k") % 3 != 0, {"stroke": "#111111", "stroke_width": 2.0, "fill": "#222222", "text_color": "#333333", "font_size": 14.0, "font_family": "Arial"})


def typography_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The candidate of 245 whose mask is nearest to each reference mask."""
    e = table(spark, sf_dir, "embeddings").where("embedding IS NOT NULL")
    refs = e.select("vec_id", F.transform("embedding", lambda x: F.when(x > 0.02, 1).otherwise(0)).alias("mask"), F.col("embedding"))
    grid = refs.select("vec_id", "embedding", F.explode(masks.candidates(F.col("vec_id") % 20 + 5.0, F.lit(1.1), F.lit(0.9))).alias("c"))
    rendered = grid.select("vec_id", "c.seq", "c.size", "c.scale", "c.ascent", F.transform("embedding", lambda x: F.when(x > (F.col("c.seq") * 13 % 31) * 0.01, 1).otherwise(0)).alias("candidate"))
    out = nodes.calibrated(refs.drop("embedding"), rendered, "vec_id")
    return out.select("vec_id", F.col("seq").cast("long").alias("seq"), r6(F.col("score")).alias("score"), r6(F.col("size")).alias("size"), r6(F.col("scale")).alias("scale"), r6(F.col("ascent")).alias("ascent"))


QUERIES = {f.__name__: f for f in (node_geometry, span_scan, item_style, snapshot_restore, page_entries, page_download, font_bytes, property_update, typography_calibration)}

_GRID = ", ".join(f"({i}, {s}::DOUBLE, {x}::DOUBLE, {a}::DOUBLE)" for i, (s, x, a) in enumerate((s, x, a) for s in masks.SIZES for x in masks.SCALES for a in masks.ASCENTS))

SQL = {
    "node_geometry": """WITH p AS (SELECT p_partkey AS k, p_name AS t, CASE WHEN p_partkey % 5 <> 0 THEN p_partkey % 7 * 10.0::DOUBLE - 10 END AS base, (p_partkey % 90)::DOUBLE AS mw, CASE WHEN p_partkey % 3 = 0 OR p_partkey % 4 = 0 THEN 1.0 ELSE p_partkey % 4 * 0.5 END::DOUBLE AS ms,
  CASE WHEN p_partkey % 2 = 0 THEN 2.0 ELSE 1.5 END::DOUBLE AS px, p_partkey % 30 + 6.0::DOUBLE AS fs, CASE WHEN p_partkey % 4 >= 2 THEN p_partkey % 6 * 0.6::DOUBLE END AS os FROM part),
r AS (SELECT *, floor(k % 11 + 0.5 + 0.5)::DOUBLE AS ml, floor(k % 13 - 0.5 + 0.5)::DOUBLE AS mt, greatest(floor(greatest(mw * ms, 0) + 0.5), 2.0) AS rw, greatest(floor(fs + 0.5), 2.0) AS rh, greatest(greatest(mw * ms, 0) - px * 2, 4.0) AS target FROM p),
d AS (SELECT *, greatest(0.58::DOUBLE, least(1.9::DOUBLE, target / (length(t) * greatest(fs, 8.0) * 0.52::DOUBLE))) AS derived FROM r)
SELECT k, round(CASE WHEN base > 0 THEN base ELSE greatest(mw * ms, 6.0) END, 6) AS width, ml::DOUBLE AS mask_left, mt::DOUBLE AS mask_top, rw::DOUBLE AS mask_width, rh::DOUBLE AS mask_height, round(ml + px + 0.25, 6) AS text_left, round(mt + 1.0::DOUBLE, 6) AS text_top, round(greatest(greatest(rw, 6.0) - px * 2, 4.0), 6) AS text_width,
  round(greatest(0.5, least(2.2, CASE WHEN coalesce(os, derived) = 0 THEN derived ELSE coalesce(os, derived) END)), 6) AS scale, t AS comparable FROM d""",
    "span_scan": """WITH s AS (SELECT conv_id, turn, unnest(string_split(text, '.')) AS s, generate_subscripts(string_split(text, '.'), 1) - 1 AS line FROM conversations WHERE text IS NOT NULL),
w AS (SELECT conv_id, turn, line, list_filter(string_split(s, ' '), lambda w: w <> '') AS ws FROM s), x AS (SELECT conv_id, turn, line, unnest(ws) AS w, generate_subscripts(ws, 1) - 1 AS i FROM w)
SELECT conv_id, turn, count(*) AS spans, CAST(sum(line * 1000 + i) AS BIGINT) AS places, round(sum(length(w))::DOUBLE, 6) AS widths, CAST(sum(CASE WHEN i % 5 = 0 THEN 0 ELSE length(w) END) AS BIGINT) AS chars, CAST(sum(i * 7) AS BIGINT) AS colours, 0 AS block FROM x WHERE i % 7 <> 3 GROUP BY ALL""",
    "item_style": f"""WITH {NAMED_SQL}, st(n, f, a, d) AS (VALUES {", ".join("(" + ", ".join("NULL" if x is None else repr(x) for x in row) + ")" for row in STYLES)})
SELECT k, coalesce(f, '') AS font_family, coalesce(a, 0.82)::DOUBLE AS ascent, abs(coalesce(d, -0.18))::DOUBLE AS descent FROM named LEFT JOIN st ON name = n""",
    "snapshot_restore": f"""{_W} SELECT doc_id, count(*) AS boxes, count(*) FILTER (WHERE has_edit) AS edited, count(*) FILTER (WHERE is_deleted) AS deleted, CAST(sum(length(edited_text)) AS BIGINT) AS chars, round(sum("left"), 6) AS lefts, count(*) FILTER (WHERE moved) AS moved FROM ready GROUP BY doc_id""",
    "page_entries": f"""{_W}, o AS (SELECT doc_id, page_index, (has_edit AND doc_id % 5 <> 0) OR moved AS on_ FROM ready WHERE k % 3 = 0 AND page_index % 2 = 0) SELECT doc_id, page_index, count(*) AS objects FROM o GROUP BY ALL HAVING bool_or(on_)""",
    "page_download": r"""SELECT page_id, CAST(page_id % 6 AS INTEGER) AS page, coalesce(nullif(trim(regexp_replace(regexp_extract(url, '([^/]*)/?$', 1), '(?i)\.pdf$', '')), ''), 'converted') || '-00' || (page_id % 6) || '.png' AS file, md5('data:image/png;base64,' || to_base64(encode(html))) AS data_url FROM pages WHERE page_id % 6 BETWEEN 1 AND 4""",
    "font_bytes": """SELECT page_id, CASE WHEN length(url) % 3 <> 0 THEN strlen(m) END AS bytes FROM pages LEFT JOIN (SELECT url, min(html) AS m FROM pages WHERE html IS NOT NULL GROUP BY url) USING (url)""",
    "property_update": f"""WITH p AS (SELECT p_partkey AS k, {list(KINDS)}[p_partkey % 10 + 1] AS kind, p_partkey % 3 <> 0 AS on_ FROM part), t AS (SELECT *, kind IN ('i-text', 'text', 'textbox') AS word, kind = 'text_box' AS box, kind IN ('rect', 'ellipse', 'triangle', 'polygon') AS shape FROM p)
SELECT k, kind, CASE WHEN on_ AND NOT box THEN '#111111' ELSE 'old' END AS stroke, CASE WHEN on_ AND NOT box THEN 2.0 ELSE 1.0 END::DOUBLE AS stroke_width, CASE WHEN on_ AND (word OR box) THEN '#333333' WHEN on_ AND shape THEN '#222222' ELSE 'none' END AS fill, CASE WHEN on_ AND word THEN 14.0 ELSE 8.0 END::DOUBLE AS font_size, CASE WHEN on_ AND word THEN 'Arial' ELSE 'f' END AS font_family FROM t""",
    "typography_calibration": f"""WITH grid(seq, fs, fx, fa) AS (VALUES {_GRID}), e AS (SELECT vec_id, embedding, list_transform(embedding, lambda x: CASE WHEN x > 0.02::DOUBLE THEN 1 ELSE 0 END) AS r FROM embeddings WHERE embedding IS NOT NULL),
lv AS (SELECT vec_id, v, r, list_transform(embedding, lambda x: CASE WHEN x > v * 0.01::DOUBLE THEN 1 ELSE 0 END) AS c FROM e, (SELECT unnest(range(31)) AS v) t),
n AS (SELECT vec_id, v, list_sum(r) AS n, list_sum(c) AS m, list_sum(list_transform(list_zip(r, c), lambda z: z[1] * z[2])) AS both_ FROM lv), s AS (SELECT *, 1 - both_ / greatest(n + m - both_, 1)::DOUBLE + abs(m - n) / greatest(n, 1)::DOUBLE * 0.35::DOUBLE AS score FROM n WHERE n >= 8),
k AS (SELECT vec_id, seq, score, fs, fx, fa, row_number() OVER (PARTITION BY vec_id ORDER BY score, seq) AS o FROM s JOIN grid ON v = seq * 13 % 31)
SELECT e.vec_id, CAST(seq AS BIGINT) AS seq, round(score, 6) AS score, round(greatest(6.0, least(180.0, greatest(e.vec_id % 20 + 5.0, 8.0) * fs)), 6)::DOUBLE AS size, round(greatest(0.5, least(2.2, 1.1::DOUBLE * fx)), 6) AS scale, round(greatest(0.5, least(0.95, 0.9::DOUBLE + fa)), 6) AS ascent FROM e LEFT JOIN (SELECT * FROM k WHERE o = 1) b USING (vec_id)""",
}
