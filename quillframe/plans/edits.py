"""Queries on edits: detection, typography, matching, resolution, painting."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..coerce import layer
from ..functions import geom
from ..operators import edits, match, paint
from ..sources.derived import TEXT_RUN_SQL, text_runs
from .text import PAGE_FONTS, _export_token, _standard, r6


def r4(c) -> F.col:
    """Four places; shifted a little, since bisected sizes are dyadic and often stand right between two."""
    return F.round(c + 0.00000123, 4)


FAMILIES = ("Arial, sans-serif", "Times New Roman", " arial,  Sans-Serif ", "Courier New")


def _type(family, size, weight, style, spacing):
    return F.struct(family.alias("family"), size.alias("size"), weight.alias("weight"), style.alias("style"), spacing.alias("char_spacing"))


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text boxes with edits of every kind, one for each run."""
    r = text_runs(spark, sf_dir)
    k = F.col("run_id")
    fam = F.array(*[F.lit(f) for f in FAMILIES])
    one = F.element_at(fam, F.lit(1))
    original = _type(one, F.lit(12.0), F.lit("400"), F.lit("normal"), F.when(k % 17 == 0, F.lit(None)).otherwise(F.lit(0.0)))
    edit = _type(F.element_at(fam, F.when(k % 9 == 1, 2).when(k % 9 == 2, 3).otherwise(1)), F.when(k % 8 == 1, 12.04).when(k % 8 == 2, 14.0).when(k % 8 == 3, 0.0).otherwise(12.0), F.when(k % 11 == 1, F.lit("bold")).when(k % 11 == 2, F.lit("")).otherwise(F.lit("400")), F.when(k % 13 == 1, F.lit("italic")).otherwise(F.lit(" Normal")), F.when(k % 7 == 1, 25.0).otherwise(0.0))
    return r.select(
        "doc_id", "page_index", F.col("seq").alias("box_seq"), k.alias("k"), F.lit("text_box").alias("kind"), F.lit(False).alias("is_helper"), F.col("str").alias("original_text"),
        F.when(k % 5 == 1, F.concat("str", F.lit("x"))).when(k % 5 == 2, F.col("str")).when(k % 5 == 3, F.lit(None)).otherwise(F.lit("")).alias("edited_text"),
        (k % 19 == 1).alias("is_deleted"), F.lit(False).alias("has_edit"), original.alias("original"), edit.alias("edit"),
        F.col("left").alias("base_left"), F.col("top").alias("base_top"), F.col("width").alias("base_width"), F.col("height").alias("base_height"),
        (F.col("left") + F.when(k % 6 == 1, 0.5).when(k % 6 == 2, 0.51).when(k % 6 == 3, -7.0).otherwise(0.0)).alias("left"), (F.col("top") + F.when(k % 4 == 1, 3.0).otherwise(0.0)).alias("top"),
        F.lit(1.0).alias("scale_x"), F.lit(2.0).alias("pad_x"), F.lit(1.0).alias("pad_y"), (k % 5 - 2.0).alias("ink_x"), F.lit(0.0).alias("ink_y"), F.lit("#ffffff").alias("mask_color"),
    )


BOX_SQL = f"""{TEXT_RUN_SQL},
box AS (SELECT doc_id, page_index, seq AS box_seq, run_id AS k, str AS original_text, width AS base_width, height AS base_height, "left" AS base_left, top AS base_top,
  CASE run_id % 5 WHEN 1 THEN str || 'x' WHEN 2 THEN str WHEN 3 THEN NULL ELSE '' END AS edited_text, run_id % 19 = 1 AS is_deleted,
  CASE run_id % 9 WHEN 1 THEN 'Times New Roman' WHEN 2 THEN ' arial,  Sans-Serif ' ELSE 'Arial, sans-serif' END AS e_family, CASE run_id % 8 WHEN 1 THEN 12.04 WHEN 2 THEN 14.0 WHEN 3 THEN 0.0 ELSE 12.0 END::DOUBLE AS e_size,
  CASE run_id % 11 WHEN 1 THEN 'bold' WHEN 2 THEN '' ELSE '400' END AS e_weight, CASE run_id % 13 WHEN 1 THEN 'italic' ELSE ' Normal' END AS e_style, CASE run_id % 7 WHEN 1 THEN 25.0 ELSE 0.0 END::DOUBLE AS e_spacing,
  "left" + CASE run_id % 6 WHEN 1 THEN 0.5 WHEN 2 THEN 0.51 WHEN 3 THEN -7.0 ELSE 0.0 END::DOUBLE AS "left", top + CASE run_id % 4 WHEN 1 THEN 3.0 ELSE 0.0 END::DOUBLE AS top FROM text_run),
judged AS (SELECT *, abs("left" - base_left) > 0.5 OR abs(top - base_top) > 0.5 AS moved, k % 9 = 1 OR k % 8 = 2 OR k % 11 = 1 OR k % 13 = 1 OR k % 7 = 1 AS styled, k % 5 = 1 AS retexted FROM box),
done AS (SELECT *, is_deleted OR retexted OR styled AS has_edit FROM judged),
ready AS (SELECT * REPLACE (CASE WHEN NOT has_edit THEN '' WHEN is_deleted THEN edited_text WHEN k % 5 = 1 THEN original_text || 'x' ELSE original_text END AS edited_text, has_edit AND is_deleted AS is_deleted,
  CASE WHEN has_edit THEN e_family ELSE 'Arial, sans-serif' END AS e_family, CASE WHEN has_edit THEN e_size ELSE 12.0 END AS e_size, CASE WHEN has_edit THEN e_weight ELSE '400' END AS e_weight, CASE WHEN has_edit THEN e_style ELSE 'normal' END AS e_style, CASE WHEN has_edit THEN e_spacing ELSE 0.0 END AS e_spacing) FROM done)"""


def edit_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = edits.refreshed(boxes(spark, sf_dir))
    return b.groupBy("doc_id").agg(F.count("*").alias("boxes"), F.count_if("has_edit").alias("edited"), F.count_if(edits.is_moved()).alias("moved"), F.count_if("is_deleted").alias("deleted"), F.count_if(F.coalesce("edited_text", F.lit("")) != "").alias("filled"), F.count_if(F.col("has_edit") | edits.is_moved()).alias("changed"))


def edit_compat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rule by which an untouched box counts as edited."""
    b = edits.refreshed(boxes(spark, sf_dir), compat=True)
    return b.groupBy("doc_id").agg(F.count_if("has_edit").alias("edited"), F.count_if(F.col("edited_text") == F.col("original_text")).alias("restored"))


def style_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = edits.with_style_changed(boxes(spark, sf_dir), "changed")
    return b.groupBy("doc_id", "page_index").agg(F.count_if("changed").alias("changed"), F.coalesce(F.sum(F.when(F.col("changed"), F.col("box_seq"))), F.lit(0)).alias("which"))


def effective_typography(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = edits.refreshed(boxes(spark, sf_dir))
    t = b.select("doc_id", edits.effective_type().alias("t"), edits.effective_text().alias("s"))
    return t.groupBy("doc_id", "t.family", "t.weight", "t.style").agg(F.count("*").alias("n"), r6(F.sum("t.size")).alias("sizes"), r6(F.sum("t.char_spacing")).alias("spacing"), F.sum(F.length("s")).alias("chars"))


def edit_commit(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = F.when(F.col("k") % 3 == 0, F.lit(" \n ")).when(F.col("k") % 3 == 1, F.concat("original_text", F.lit("\r\n b"))).otherwise(F.col("original_text"))
    b = edits.committed(boxes(spark, sf_dir), new)
    return b.groupBy("doc_id").agg(F.count_if("has_edit").alias("edited"), F.count_if("is_deleted").alias("tombstones"), F.sum(F.length("edited_text")).alias("chars"))


def page_exportable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edits.exportable_pages(edits.refreshed(boxes(spark, sf_dir)), ["doc_id", "page_index"])


def nudge_tombstone(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = edits.refreshed(boxes(spark, sf_dir))
    b = edits.removed(edits.nudged(b, F.col("k") % 3 == 0, 10.0, -1.0), F.col("k") % 4 == 3)
    return b.groupBy("doc_id", "page_index").agg(F.count_if("is_deleted").alias("deleted"), F.count_if(edits.is_moved()).alias("moved"), r6(F.sum("left")).alias("lefts"), r6(F.sum("top")).alias("tops"))


def visual_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = edits.refreshed(boxes(spark, sf_dir))
    v = edits.visual_state(F.col("k") % 23 == 0, F.col("page_index") == 0)
    s = b.select("doc_id", v["state"].alias("state"), v["text_shown"].alias("text_shown"), edits.export_state().alias("export"))
    return s.groupBy("doc_id", "state", "text_shown", "export").agg(F.count("*").alias("n"))


def origin_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = edits.origin_masks(boxes(spark, sf_dir))
    return m.groupBy("doc_id", "page_index", "fill").agg(F.count("*").alias("n"), r6(F.sum("left")).alias("lefts"), r6(F.sum("width")).alias("widths"))


def mask_resize(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = edits.refreshed(boxes(spark, sf_dir))
    m = b.select("doc_id", edits.mask_size(F.length(edits.effective_text()), edits.effective_type()["size"], F.lit(600.0)).alias("m"))
    return m.groupBy("doc_id").agg(r6(F.sum("m.width")).alias("widths"), r6(F.sum("m.height")).alias("heights"))


def letter_spacing(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = edits.spaced(boxes(spark, sf_dir), F.col("k") % 2 == 0, (F.col("k") % 7 * 100 - 200).cast("double"))
    return b.groupBy("doc_id").agg(F.count_if("has_edit").alias("edited"), r6(F.sum("edit.char_spacing")).alias("spacing"))


def ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Export operations: each run moved a little, its text replaced."""
    r = text_runs(spark, sf_dir)
    k = F.col("run_id")
    rect = geom.rect(F.col("left"), F.col("top"), F.col("width"), F.col("height"))
    cur = geom.rect(F.col("left") + (k % 7 - 3), F.col("top"), F.col("width"), F.col("height"))
    value = F.when(k % 29 == 0, F.lit(" ")).otherwise(F.concat(F.lit(">"), "str", F.lit("-"), (k % 97).cast("string")))
    return r.select(
        "doc_id", "page_index", F.col("seq").alias("op_seq"), k.alias("k"), F.lit(600.0).alias("source_width"), F.lit(640.0).alias("source_height"), rect.alias("base_rect"), cur.alias("current_rect"), value.alias("text"), value.alias("value"),
        F.lit("Arial, sans-serif").alias("font_family"), F.when(k % 2 == 0, F.lit("bold")).otherwise(F.lit("400")).alias("font_weight"), F.lit("normal").alias("font_style"), F.lit(12.0).alias("font_size"), (k % 5 * 20 - 40.0).alias("char_spacing"), (k % 4 * 0.1 + 0.85).alias("font_scale_x"), F.lit(0.8).alias("ascent"),
        F.lit(1.0).alias("pad_x"), F.lit(0.5).alias("pad_y"), F.lit(0.25).alias("ink_x"), F.lit(0.0).alias("ink_y"), F.lit("#102030").alias("text_color"), F.lit("#fff").alias("fill"), (k % 3 != 0).alias("strict_fit"), (k % 4 != 0).alias("micro_calibration"),
    )


SPAN_FONTS = ("ABCDEF+Times-New_Roman", "JetBrains Mono", "Unknown", "Caveat")


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of a page: its runs, a little off; every eleventh has no width."""
    r = text_runs(spark, sf_dir)
    k = F.col("run_id")
    box = geom.rect(F.col("left") + k % 5, F.col("top") + (k % 3) * 0.5, F.when(k % 11 == 0, 0.0).otherwise(F.col("width")), F.col("height"))
    font = F.element_at(F.array(*[F.lit(f) for f in SPAN_FONTS]), (k % 4 + 1).cast("int"))
    return r.select("doc_id", "page_index", F.col("seq").alias("span_seq"), box.alias("rect"), F.struct(box.alias("rect"), font.alias("font"), (k % 4 * 4.0).alias("size"), F.when(k % 6 == 0, F.lit(None)).otherwise((k * 7919) % 16777216).alias("color"), F.struct((F.col("left") + k % 5).alias("x"), (F.col("top") + 9.6).alias("y")).alias("origin")).alias("span"))


KEYS = ["doc_id", "page_index"]
PW, PH = 300.0, 320.0


def op_page_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = ops(spark, sf_dir)
    pages = every.select(*KEYS).distinct()
    o = every.withColumn("page_index", F.when(F.col("k") % 31 == 0, -1).otherwise(F.col("page_index")))
    # pages are fewer than ops, so ops are grouped before pages are told apart
    g = match.on_pages(match.grouped(o, KEYS), pages, KEYS)
    return g.select(*KEYS, "n_ops", F.array_join(F.transform("op_seqs", lambda x: x.cast("string")), ",").alias("ops"))


def span_match_iou(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = ops(spark, sf_dir).select(*KEYS, "op_seq", F.col("base_rect").alias("rect"))
    m = match.best_spans(o, spans(spark, sf_dir).select(*KEYS, "span_seq", "rect"), KEYS)
    return m.select(*KEYS, "op_seq", "span_seq", r6(F.col("score")).alias("score"))


def resolved_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = ops(spark, sf_dir).withColumn("rect", F.col("base_rect"))
    withspan = match.best_spans(o, spans(spark, sf_dir), KEYS, carried=["span"])
    # the page's spans are in page points at half the source's size here, so they scale with it
    half = F.when(F.col("span").isNotNull(), F.struct(geom.rect(*[F.col("span.rect")[x] / 2 for x in ("left", "top", "width", "height")]).alias("rect"), F.col("span.font").alias("font"), F.col("span.size").alias("size"), F.col("span.color").alias("color"), F.struct((F.col("span.origin.x") / 2).alias("x"), (F.col("span.origin.y") / 2).alias("y")).alias("origin")))
    fonts = match.font_table(spark.createDataFrame(PAGE_FONTS, "page_index int, font_seq int, xref int, basefont string, resource_name string")).select(F.col("token"), "xref")
    from ..functions.font import export_token

    keyed = withspan.withColumn("span", half).withColumn("token", export_token(F.col("span.font")))
    return match.resolved(keyed.join(F.broadcast(fonts), "token", "left"), F.lit(PW), F.lit(PH))  # five fonts


def op_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = resolved_ops(spark, sf_dir)
    return r.select("doc_id", "op_seq", "font", r4(F.col("size")).alias("size"), r4(F.col("tracking")).alias("tracking"), r4(F.col("stretch")).alias("stretch"), r4(F.col("x")).alias("x"), r4(F.col("y")).alias("y"), "own_glyphs", r4(F.col("color.r")).alias("red"), r4(F.col("color.g")).alias("green"), r4(F.col("color.b")).alias("blue"))


def fit_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("run_id")
    r = text_runs(spark, sf_dir).select("doc_id", F.col("len"), (k % 5 * 0.02 - 0.04).alias("tracking"), (k % 4 * 0.2 + 0.8).alias("stretch"), (F.col("width") * (k % 9 * 0.1 + 0.3)).alias("most"))
    chars, tracking, stretch, most = (F.col(c) for c in ("len", "tracking", "stretch", "most"))
    out = geom.with_fit_size(r, "size", chars, F.lit(12.0), most, tracking, stretch)
    out = layer(out, fitted=geom.fit_tracking(chars, F.col("size"), tracking, stretch, most))
    out = layer(out, wide=geom.run_width(chars, F.col("size"), F.col("fitted"), stretch), drawn=geom.stretch_to(chars, F.col("size"), most))
    return out.groupBy("doc_id").agg(r4(F.sum("size")).alias("sizes"), r4(F.sum("fitted")).alias("trackings"), r4(F.sum("wide")).alias("widths"), r4(F.sum("drawn")).alias("stretches"), F.count_if(geom.own_glyphs(F.col("fitted"), stretch)).alias("by_glyph"))


def glyph_advance(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = ops(spark, sf_dir).select(*KEYS, "op_seq", "value", F.col("current_rect.left").alias("x"), F.lit(10.0).alias("size"), (F.col("char_spacing") / 1000).alias("tracking"), F.col("font_scale_x").alias("stretch"))
    g = paint.glyphs(o, [*KEYS, "op_seq"])
    code = F.col("pos") * F.ascii("glyph") + F.col("op_seq")
    return g.groupBy(*KEYS).agg(F.count("*").alias("glyphs"), r4(F.sum("x")).alias("places"), r4(F.max("x")).alias("last"), F.sum(code).alias("spelled"))


def erase_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = paint.erase_rects(ops(spark, sf_dir), KEYS, F.lit(640.0))
    return e.groupBy(*KEYS, "fill").agg(F.count("*").alias("rects"), F.sum(F.col("op_seq") * 2 + F.col("part")).alias("which"), *[r4(F.sum(c)).alias(f"{c}s") for c in "xywh"])


def paint_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = ops(spark, sf_dir)
    both = [paint.commands(o, KEYS, m).withColumn("mode", F.lit(m)) for m in ("vector", "exact")]
    every = both[0].unionByName(both[1])
    # an order by what stands where
    return every.groupBy(*KEYS, "mode", "kind").agg(F.count("*").alias("commands"), F.min("paint_seq").cast("long").alias("first"), F.sum(F.col("paint_seq").cast("long") * (F.col("op_seq") * 3 + F.col("part"))).alias("order"))


def z_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = boxes(spark, sf_dir).select(*KEYS, "box_seq", "k", F.col("k").alias("z"))
    f = paint.restacked(b, KEYS, F.col("k") % 5 == 0, True).withColumnRenamed("new_z", "front")
    z = paint.restacked(f, KEYS, F.col("k") % 7 == 0, False)
    return z.groupBy(*KEYS).agg(F.sum(F.col("front").cast("long") * F.col("box_seq")).alias("front"), F.sum(F.col("new_z").cast("long") * F.col("box_seq")).alias("back"))


def baseline_snap(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = boxes(spark, sf_dir).select(*KEYS, "box_seq", "k", (F.col("top") + F.col("k") % 13 * 0.37).alias("top"), (F.col("k") % 3 * 2 + 10.0).alias("size"), F.lit(0.8).alias("ascent"), (F.col("k") % 5 == 0).alias("is_deleted"))
    out = match.nearest_baseline(b, KEYS, F.col("k") % 12 == 0)
    return out.select("doc_id", "box_seq", r6(F.col("new_top")).alias("new_top"))


def objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes, drawings and helpers of a page."""
    b = edits.refreshed(boxes(spark, sf_dir))
    return b.withColumns({"kind": F.when(F.col("k") % 11 == 0, "rect").otherwise(F.col("kind")), "is_helper": F.col("k") % 33 == 0})


def clear_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = edits.cleared(objects(spark, sf_dir))
    return o.groupBy("doc_id", "page_index").agg(F.count("*").alias("objects"), F.count_if("has_edit").alias("edited"), r6(F.sum("left")).alias("lefts"), r6(F.sum("top")).alias("tops"))


def duplicate_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = edits.duplicated(objects(spark, sf_dir), F.col("k") % 2 == 0)
    return o.groupBy("doc_id").agg(F.count("*").alias("objects"), F.sum("copy").alias("copies"), r6(F.sum("left")).alias("lefts"))


def selected_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of a selection, by its ids."""
    o = objects(spark, sf_dir)
    chosen = o.where("k % 21 = 4").select("doc_id", "box_seq")
    return edits.selected(o, chosen, ["doc_id", "box_seq"]).groupBy("doc_id").agg(F.count("*").alias("boxes"))


def auto_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every box back to its original type; by the plain rule and by the one that makes each an edit."""
    b = edits.auto_matched(boxes(spark, sf_dir)).select("doc_id", "box_seq", F.col("has_edit").alias("plain"))
    c = edits.auto_matched(boxes(spark, sf_dir), compat=True).select("doc_id", "box_seq", F.col("has_edit").alias("compat"))
    return b.join(c, ["doc_id", "box_seq"]).groupBy("doc_id").agg(F.count_if("plain").alias("plain"), F.count_if("compat").alias("compat"))


def vector_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as drawn over the page itself: baseline from the bottom of the page."""
    o = ops(spark, sf_dir)
    d = match.vector_places(o, F.lit(PW), F.lit(PH))
    return d.groupBy(*KEYS).agg(F.count("*").alias("texts"), r4(F.sum("x")).alias("xs"), r4(F.sum("y")).alias("ys"), r4(F.sum("size")).alias("sizes"), F.count_if("own_glyphs").alias("by_glyph"))


QUERIES = {f.__name__: f for f in (edit_changed, edit_compat, style_changed, effective_typography, edit_commit, page_exportable, nudge_tombstone, visual_state, origin_masks, mask_resize, letter_spacing, op_page_group, span_match_iou, op_resolve, fit_size, glyph_advance, erase_dedup, paint_order, z_order, baseline_snap, clear_page, duplicate_objects, selected_boxes, auto_match, vector_ops)}

_W = "WITH " + BOX_SQL
CELL = int(match.CELL)
OP_SQL = f"""{TEXT_RUN_SQL}, op AS MATERIALIZED (SELECT doc_id, page_index, seq AS op_seq, run_id AS k, "left" AS bl, top AS bt, width AS bw, height AS bh, "left" + (run_id % 7 - 3) AS cl, top AS ct, CASE WHEN run_id % 29 = 0 THEN ' ' ELSE '>' || str || '-' || run_id % 97 END AS value FROM text_run),
span AS MATERIALIZED (SELECT doc_id, page_index, seq AS span_seq, "left" + run_id % 5 AS sl, top + (run_id % 3) * 0.5::DOUBLE AS st, CASE WHEN run_id % 11 = 0 THEN 0.0::DOUBLE ELSE width END AS sw, height AS sh, run_id % 4 * 4.0::DOUBLE AS ssize, CASE WHEN run_id % 6 <> 0 THEN (run_id * 7919) % 16777216 END AS color, top + 9.6::DOUBLE AS oy, ['ABCDEF+Times-New_Roman', 'JetBrains Mono', 'Unknown', 'Caveat'][run_id % 4 + 1] AS sfont FROM text_run),
opx AS (SELECT *, unnest(range(floor(bl / {CELL})::BIGINT, floor((bl + bw) / {CELL})::BIGINT + 1)) AS cx FROM op), opc AS (SELECT *, unnest(range(floor(bt / {CELL})::BIGINT, floor((bt + bh) / {CELL})::BIGINT + 1)) AS cy FROM opx),
spx AS (SELECT *, unnest(range(floor(sl / {CELL})::BIGINT, floor((sl + sw) / {CELL})::BIGINT + 1)) AS cx FROM span), spc AS (SELECT *, unnest(range(floor(st / {CELL})::BIGINT, floor((st + sh) / {CELL})::BIGINT + 1)) AS cy FROM spx),
met AS (SELECT DISTINCT o.doc_id, o.page_index, o.op_seq, s.span_seq, (least(bl + bw, sl + sw) - greatest(bl, sl)) * (least(bt + bh, st + sh) - greatest(bt, st)) AS both_, bw * bh AS a, sw * sh AS b FROM opc o JOIN spc s USING (doc_id, page_index, cx, cy) WHERE bl < sl + sw AND sl < bl + bw AND bt < st + sh AND st < bt + bh),
ranked AS (SELECT *, both_ / (a + b - both_) AS score, row_number() OVER (PARTITION BY doc_id, op_seq ORDER BY both_ / (a + b - both_) DESC, span_seq) AS n FROM met WHERE both_ > 0),
best AS MATERIALIZED (SELECT doc_id, op_seq, span_seq, score FROM ranked WHERE n = 1 AND score >= 0.03)"""


def _run_width(chars: str, size: str, tracking: str, stretch: str) -> str:
    s = f"greatest({size}, 1.0)"
    return f"(CASE WHEN {chars} = 0 THEN 0.0 ELSE greatest((greatest({chars} * {s} * 0.52::DOUBLE, {s} * 0.4::DOUBLE) + greatest({chars} - 1, 0) * {tracking} * {size}) * {stretch}, 0.0) END)"


def _bisected(source: str, size: str, name: str) -> str:
    """CTEs name0..name14 over ``source`` (chars, tracking, stretch, most)."""
    out = [f"{name}0 AS (SELECT *, greatest({size} * 0.68::DOUBLE, 1.0) AS low, {size} AS high FROM {source})"]
    for i in range(14):
        wide = f"{_run_width('chars', '((low + high) / 2.0)', 'tracking', 'stretch')} > most"
        out.append(f"{name}{i + 1} AS (SELECT * REPLACE (CASE WHEN {wide} THEN low ELSE (low + high) / 2.0 END AS low, CASE WHEN {wide} THEN (low + high) / 2.0 ELSE high END AS high) FROM {name}{i})")
    return ", ".join(out)


def _fitted_tracking(size: str) -> str:
    w = _run_width("chars", size, "tracking", "stretch")
    return f"CASE WHEN chars < 2 OR {w} <= most OR most <= 1.0 THEN tracking ELSE greatest(-0.08::DOUBLE, least(tracking, tracking - ({w} - most) / (greatest(chars - 1, 1) * greatest({size}, 1.0) * greatest(stretch, 0.1::DOUBLE)))) END"


_FONTS = f"""fonts(seq, xref, base, res) AS (VALUES {", ".join(f"({s}, {x}, '{b}', '{r}')" for _, s, x, b, r in PAGE_FONTS)}),
tok AS (SELECT seq * 2 AS o, xref, {_export_token("base")} AS token FROM fonts UNION ALL SELECT seq * 2 + 1, xref, {_export_token("res")} FROM fonts), known AS (SELECT token, arg_min(xref, o) AS xref FROM tok WHERE token <> '' GROUP BY token)"""

_FIT = """fit AS (SELECT doc_id, len AS chars, run_id % 5 * 0.02::DOUBLE - 0.04::DOUBLE AS tracking, run_id % 4 * 0.2::DOUBLE + 0.8::DOUBLE AS stretch, width * (run_id % 9 * 0.1::DOUBLE + 0.3::DOUBLE) AS most FROM text_run)"""

SQL = {
    "edit_changed": f"{_W} SELECT doc_id, count(*) AS boxes, count(*) FILTER (WHERE has_edit) AS edited, count(*) FILTER (WHERE moved) AS moved, count(*) FILTER (WHERE is_deleted) AS deleted, count(*) FILTER (WHERE coalesce(edited_text, '') <> '') AS filled, count(*) FILTER (WHERE has_edit OR moved) AS changed FROM ready GROUP BY doc_id",
    "edit_compat": f"{_W}, c AS (SELECT *, is_deleted OR styled OR coalesce(edited_text, '') <> original_text AS on_ FROM judged) SELECT doc_id, count(*) FILTER (WHERE on_) AS edited, count(*) FILTER (WHERE CASE WHEN NOT on_ THEN false WHEN is_deleted THEN edited_text = original_text WHEN coalesce(edited_text, '') = '' THEN true ELSE edited_text = original_text END) AS restored FROM c GROUP BY doc_id",
    "style_changed": f"{_W} SELECT doc_id, page_index, count(*) FILTER (WHERE styled) AS changed, CAST(coalesce(sum(box_seq) FILTER (WHERE styled), 0) AS BIGINT) AS which FROM judged GROUP BY ALL",
    "effective_typography": f"""{_W}, t AS (SELECT doc_id, CASE WHEN has_edit THEN e_family ELSE 'Arial, sans-serif' END AS family, CASE WHEN e_size = 0 THEN 12.0 ELSE e_size END AS size, CASE WHEN e_weight = '' THEN '400' ELSE e_weight END AS weight, CASE WHEN has_edit THEN e_style ELSE 'normal' END AS style, e_spacing AS spacing, CASE WHEN is_deleted THEN '' WHEN has_edit AND edited_text <> '' THEN edited_text ELSE original_text END AS s FROM ready)
SELECT doc_id, family, weight, style, count(*) AS n, round(sum(size), 6) AS sizes, round(sum(spacing), 6) AS spacing, CAST(sum(length(s)) AS BIGINT) AS chars FROM t GROUP BY ALL""",
    "edit_commit": f"{_W} SELECT doc_id, count(*) FILTER (WHERE k % 3 <> 2) AS edited, count(*) FILTER (WHERE k % 3 = 0) AS tombstones, CAST(sum(CASE k % 3 WHEN 0 THEN 0 WHEN 1 THEN length(original_text) + 2 ELSE length(original_text) END) AS BIGINT) AS chars FROM box GROUP BY doc_id",
    "page_exportable": f"{_W} SELECT doc_id, page_index, bool_or(has_edit OR moved) AS exportable, count(*) AS objects FROM ready GROUP BY ALL",
    "nudge_tombstone": f"""{_W}, n AS (SELECT *, "left" + CASE WHEN k % 3 = 0 THEN 10.0 ELSE 0.0 END AS l2, top + CASE WHEN k % 3 = 0 THEN -1.0 ELSE 0.0 END AS t2 FROM ready)
SELECT doc_id, page_index, count(*) FILTER (WHERE is_deleted OR k % 4 = 3) AS deleted, count(*) FILTER (WHERE abs(l2 - base_left) > 0.5 OR abs(t2 - base_top) > 0.5) AS moved, round(sum(l2), 6) AS lefts, round(sum(t2), 6) AS tops FROM n GROUP BY ALL""",
    "visual_state": f"""{_W}, v AS (SELECT *, CASE WHEN k % 23 = 0 THEN 'editing' WHEN page_index = 0 THEN 'outlined' WHEN has_edit OR moved THEN 'changed' ELSE 'hidden' END AS state FROM ready)
SELECT doc_id, state, CASE WHEN state = 'hidden' THEN false ELSE NOT is_deleted AND (has_edit OR moved OR k % 23 = 0) END AS text_shown, CASE WHEN has_edit AND is_deleted THEN 'mask' WHEN has_edit THEN 'mask+text' WHEN moved THEN 'snapshot' ELSE 'hidden' END AS export, count(*) AS n FROM v GROUP BY ALL""",
    "origin_masks": f"{_W} SELECT doc_id, page_index, '#ffffff' AS fill, count(*) AS n, round(sum(base_left), 6) AS lefts, round(sum(base_width), 6) AS widths FROM judged WHERE moved GROUP BY ALL",
    "mask_resize": f"""{_W}, t AS (SELECT *, length(CASE WHEN is_deleted THEN '' WHEN has_edit AND edited_text <> '' THEN edited_text ELSE original_text END) AS c, greatest(CASE WHEN e_size = 0 THEN 12.0 ELSE e_size END, 8.0) AS s FROM ready),
w AS (SELECT *, greatest(base_width, c * s * 0.52::DOUBLE * 1.0 + 2.0 * 2 + 4 + greatest(k % 5 - 2.0::DOUBLE, 0.0)) AS wide, greatest(600.0 - "left" - 2, 6.0) AS room FROM t)
SELECT doc_id, round(sum(CASE WHEN c > 0 THEN greatest(6.0, least(room, wide)) ELSE base_width END), 6) AS widths, round(sum(CASE WHEN c > 0 THEN greatest(base_height, s * 1.2::DOUBLE + 1.0 * 2, 10.0) ELSE base_height END), 6) AS heights FROM w GROUP BY doc_id""",
    "letter_spacing": f"""{_W}, s AS (SELECT *, greatest(-120.0, least(320.0, (k % 7 * 100 - 200)::DOUBLE)) AS sp FROM judged), c AS (SELECT *, k % 2 = 0 AND (is_deleted OR k % 5 = 1 OR k % 9 = 1 OR k % 8 = 2 OR k % 11 = 1 OR k % 13 = 1 OR abs(sp) > 0.01) AS on_ FROM s)
SELECT doc_id, count(*) FILTER (WHERE on_) AS edited, round(sum(CASE WHEN on_ THEN sp WHEN k % 2 = 0 THEN 0.0 ELSE e_spacing END), 6) AS spacing FROM c GROUP BY doc_id""",
    "clear_page": f"""{_W}, o AS (SELECT *, k % 11 <> 0 AS is_box FROM ready WHERE k % 11 <> 0 OR k % 33 = 0), b AS (SELECT *, is_box AND (has_edit OR is_deleted OR moved) AS back FROM o)
SELECT doc_id, page_index, count(*) AS objects, count(*) FILTER (WHERE has_edit AND NOT back) AS edited, round(sum(CASE WHEN back THEN base_left ELSE "left" END), 6) AS lefts, round(sum(CASE WHEN back THEN base_top ELSE top END), 6) AS tops FROM b GROUP BY ALL""",
    "duplicate_objects": f"""{_W}, d AS (SELECT doc_id, "left" AS l, 0 AS copy FROM ready UNION ALL SELECT doc_id, "left" + 24.0, 1 FROM ready WHERE k % 2 = 0 AND k % 11 = 0 AND k % 33 <> 0) SELECT doc_id, count(*) AS objects, CAST(sum(copy) AS BIGINT) AS copies, round(sum(l), 6) AS lefts FROM d GROUP BY doc_id""",
    "selected_boxes": f"{_W} SELECT doc_id, count(*) AS boxes FROM ready WHERE k % 21 = 4 AND k % 11 <> 0 GROUP BY doc_id",
    "auto_match": f"{_W} SELECT doc_id, count(*) FILTER (WHERE is_deleted OR k % 5 = 1) AS plain, count(*) FILTER (WHERE is_deleted OR coalesce(edited_text, '') <> original_text) AS compat FROM box GROUP BY doc_id",
    "vector_ops": f"""WITH {OP_SQL} SELECT doc_id, page_index, count(*) AS texts, round(sum((cl + 1.0 + 0.25) * 0.5::DOUBLE) + 0.00000123::DOUBLE, 4) AS xs, round(sum(320.0 - (ct + 0.5 + 0.0 + 12.0 * 0.8::DOUBLE) * 0.5::DOUBLE) + 0.00000123::DOUBLE, 4) AS ys, round(sum(6.0::DOUBLE) + 0.00000123::DOUBLE, 4) AS sizes, count(*) FILTER (WHERE abs((k % 5 * 20 - 40.0::DOUBLE) / 1000) > 0.001 OR abs(greatest(0.5, least(2.2, k % 4 * 0.1::DOUBLE + 0.85::DOUBLE)) - 1) > 0.015) AS by_glyph FROM op WHERE trim(value) <> '' GROUP BY ALL""",
    "op_page_group": f"""WITH {OP_SQL}, p AS (SELECT doc_id, CASE WHEN k % 31 = 0 THEN -1 ELSE page_index END AS page_index, op_seq FROM op) SELECT doc_id, page_index, count(*) AS n_ops, string_agg(CAST(op_seq AS VARCHAR), ',' ORDER BY op_seq) AS ops FROM p WHERE page_index >= 0 GROUP BY ALL""",
    "span_match_iou": f"WITH {OP_SQL} SELECT doc_id, page_index, op_seq, span_seq, round(score, 6) AS score FROM op LEFT JOIN best USING (doc_id, op_seq)",
    "op_resolve": f"""WITH {OP_SQL}, {_FONTS}, j AS (SELECT o.*, s.span_seq IS NOT NULL AS has, ssize, color, sl / 2 AS sl, st / 2 AS st, sl / 2 AS ox, oy / 2 AS oy, {_export_token("coalesce(sfont, '')")} AS token FROM op o LEFT JOIN best USING (doc_id, op_seq) LEFT JOIN span s ON s.doc_id = o.doc_id AND s.span_seq = best.span_seq WHERE trim(o.value) <> ''),
base AS (SELECT j.*, xref, k % 3 <> 0 AS strict, k % 4 <> 0 AS micro, CASE WHEN has AND coalesce(xref, 0) <> 0 THEN 'xf' || xref ELSE CASE WHEN k % 2 = 0 THEN 'Helvetica-Bold' ELSE 'Helvetica' END END AS font,
  greatest(CASE WHEN coalesce(ssize, 0) > 0 THEN ssize ELSE 12.0 * (320.0 / 640.0) END, 1.0)::DOUBLE AS size0, greatest(0.5, least(2.2, k % 4 * 0.1::DOUBLE + 0.85::DOUBLE)) AS stretch, (k % 5 * 20 - 40.0::DOUBLE) / 1000.0 AS tracking, length(value) AS chars, cl * 0.5::DOUBLE AS x0_, ct * 0.5::DOUBLE AS y0_, greatest(bw * 0.5::DOUBLE, 0.2::DOUBLE) AS cw FROM j LEFT JOIN known USING (token)),
most AS (SELECT *, greatest(cw - 0.5::DOUBLE * 2.0 - 0.6::DOUBLE, 1.0) AS most, x0_ + (ox - sl) AS ex, y0_ + (oy - st) AS ey FROM base), {_bisected("most", "size0", "fit_")},
sized AS (SELECT *, CASE WHEN NOT strict OR {_run_width("chars", "size0", "tracking", "stretch")} <= most OR most <= 1.0 THEN size0 ELSE greatest(low, 1.0) END AS size, CASE WHEN has THEN ex + 0.125 ELSE x0_ + 0.5 + 0.125 END AS px, CASE WHEN has THEN ey ELSE y0_ + 0.25 + 0.0 + size0 * 0.8::DOUBLE END AS py FROM fit_14),
tracked AS (SELECT *, CASE WHEN strict THEN {_fitted_tracking("size")} ELSE tracking END AS tr FROM sized)
SELECT doc_id, op_seq, font, round(size + 0.00000123::DOUBLE, 4) AS size, round(tr + 0.00000123::DOUBLE, 4) AS tracking, round(stretch + 0.00000123::DOUBLE, 4) AS stretch, round(CASE WHEN micro AND has THEN px + greatest(-1.25, least(1.25, ex - px)) ELSE px END + 0.00000123::DOUBLE, 4) AS x, round(CASE WHEN micro AND has THEN py + greatest(-1.0, least(1.0, ey - py)) ELSE py END + 0.00000123::DOUBLE, 4) AS y,
  abs(tr) > 0.001 OR abs(stretch - 1.0) > 0.015 AS own_glyphs, round(CASE WHEN color IS NOT NULL THEN (color >> 16 & 255) / 255.0::DOUBLE ELSE 16 / 255.0::DOUBLE END + 0.00000123::DOUBLE, 4) AS red, round(CASE WHEN color IS NOT NULL THEN (color >> 8 & 255) / 255.0::DOUBLE ELSE 32 / 255.0::DOUBLE END + 0.00000123::DOUBLE, 4) AS green, round(CASE WHEN color IS NOT NULL THEN (color & 255) / 255.0::DOUBLE ELSE 48 / 255.0::DOUBLE END + 0.00000123::DOUBLE, 4) AS blue FROM tracked""",
    "fit_size": f"""WITH {TEXT_RUN_SQL}, {_FIT}, {_bisected("fit", "12.0::DOUBLE", "fit_")},
sized AS (SELECT *, CASE WHEN {_run_width("chars", "12.0::DOUBLE", "tracking", "stretch")} <= most OR most <= 1.0 THEN 12.0::DOUBLE ELSE greatest(low, 1.0) END AS size FROM fit_14), tracked AS (SELECT *, {_fitted_tracking("size")} AS tr FROM sized)
SELECT doc_id, round(sum(size) + 0.00000123::DOUBLE, 4) AS sizes, round(sum(tr) + 0.00000123::DOUBLE, 4) AS trackings, round(sum({_run_width("chars", "size", "tr", "stretch")}) + 0.00000123::DOUBLE, 4) AS widths, round(sum(greatest(0.58::DOUBLE, least(1.9::DOUBLE, greatest(most, 2.0) / (chars * greatest(size, 8.0) * 0.52::DOUBLE)))) + 0.00000123::DOUBLE, 4) AS stretches, count(*) FILTER (WHERE abs(tr) > 0.001 OR abs(stretch - 1.0) > 0.015) AS by_glyph FROM tracked GROUP BY doc_id""",
    "glyph_advance": f"""WITH {OP_SQL}, g AS (SELECT *, unnest(range(length(value))) AS pos FROM op),
x AS (SELECT *, cl + pos * ((10.0::DOUBLE * 0.52::DOUBLE + (k % 5 * 20 - 40.0::DOUBLE) / 1000 * 10.0::DOUBLE) * (k % 4 * 0.1::DOUBLE + 0.85::DOUBLE)) AS x FROM g)
SELECT doc_id, page_index, count(*) AS glyphs, round(sum(x) + 0.00000123::DOUBLE, 4) AS places, round(max(x) + 0.00000123::DOUBLE, 4) AS "last", CAST(sum(pos * ascii(substr(value, CAST(pos + 1 AS BIGINT), 1)) + op_seq) AS BIGINT) AS spelled FROM x GROUP BY ALL""",
    "erase_dedup": f"""WITH {OP_SQL}, r AS (SELECT doc_id, page_index, op_seq, 0 AS part, bl AS x, 640.0 - (bt + bh) AS y, greatest(bw, 0.2) AS w, greatest(bh, 0.2) AS h FROM op UNION ALL SELECT doc_id, page_index, op_seq, 1, cl, 640.0 - (ct + bh), greatest(bw, 0.2), greatest(bh, 0.2) FROM op),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page_index, floor(x * 10 + 0.5), floor(y * 10 + 0.5), floor(w * 10 + 0.5), floor(h * 10 + 0.5) ORDER BY op_seq, part) AS n FROM r)
SELECT doc_id, page_index, '#fff' AS fill, count(*) AS rects, CAST(sum(op_seq * 2 + part) AS BIGINT) AS which, {", ".join(f"round(sum({c}) + 0.00000123::DOUBLE, 4) AS {c}s" for c in "xywh")} FROM n WHERE n = 1 GROUP BY doc_id, page_index""",
    "paint_order": f"""WITH {OP_SQL}, c AS (SELECT doc_id, page_index, op_seq, unnest([0, 1, 2]) AS part, value FROM op), v AS (SELECT *, CASE part WHEN 2 THEN 'text' ELSE 'mask' END AS kind FROM c WHERE part < 2 OR trim(value) <> ''),
e AS (SELECT doc_id, page_index, 'vector' AS mode, op_seq, kind, part, row_number() OVER (PARTITION BY doc_id, page_index ORDER BY part = 2, op_seq, part) AS paint_seq FROM v UNION ALL SELECT doc_id, page_index, 'exact', op_seq, kind, part, row_number() OVER (PARTITION BY doc_id, page_index ORDER BY op_seq, part) FROM v)
SELECT doc_id, page_index, mode, kind, count(*) AS commands, min(paint_seq) AS "first", CAST(sum(paint_seq * (op_seq * 3 + part)) AS BIGINT) AS "order" FROM e GROUP BY doc_id, page_index, mode, kind""",
    "z_order": f"""{_W}, p AS (SELECT doc_id, page_index, box_seq, row_number() OVER (PARTITION BY doc_id, page_index ORDER BY CASE WHEN k % 5 = 0 THEN 1 ELSE 0 END, k) - 1 AS front, row_number() OVER (PARTITION BY doc_id, page_index ORDER BY CASE WHEN k % 7 = 0 THEN -1 ELSE 0 END, k) - 1 AS back FROM box)
SELECT doc_id, page_index, CAST(sum(front * box_seq) AS BIGINT) AS front, CAST(sum(back * box_seq) AS BIGINT) AS back FROM p GROUP BY ALL""",
    "baseline_snap": f"""{_W}, p AS (SELECT doc_id, page_index, box_seq, k, top + k % 13 * 0.37::DOUBLE AS top, k % 3 * 2 + 10.0::DOUBLE AS size, k % 5 = 0 AS del FROM box), l AS MATERIALIZED (SELECT *, top + size * 0.8::DOUBLE AS bl FROM p),
j AS (SELECT a.doc_id, a.box_seq, a.top, a.bl, b.bl AS rb, row_number() OVER (PARTITION BY a.doc_id, a.box_seq ORDER BY abs(b.bl - a.bl) + abs(b.top - a.top) * 0.1::DOUBLE, b.box_seq) AS n FROM l a LEFT JOIN l b ON a.doc_id = b.doc_id AND a.page_index = b.page_index AND a.box_seq <> b.box_seq AND NOT b.del WHERE a.k % 12 = 0)
SELECT doc_id, box_seq, round(CASE WHEN abs(coalesce(rb, bl) - (bl - top) - top) > 0.3 THEN coalesce(rb, bl) - (bl - top) ELSE top END, 6) AS new_top FROM j WHERE n = 1""",
}
