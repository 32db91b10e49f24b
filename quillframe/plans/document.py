"""Queries on documents: requests, splitting, history, messages, page settings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..coerce import clamp, half_up, leading_int, number_or
from ..functions import text
from ..operators import history, messages, requests, shapes, split
from ..sources.derived import TEXT_RUN_SQL, table, text_runs
from .text import r6

RAW = ("7", "3", "0", "99", "x", "", "3.7", "4", " 12zz", "-5")


def ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three ranges for each document with pages, as typed."""
    d = table(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") % 12).alias("pages"))
    raw = F.array(*[F.lit(x) for x in RAW])
    at = lambda i, m: F.element_at(raw, ((F.col("doc_id") * m + i) % len(RAW) + 1).cast("int"))
    return d.select("doc_id", "pages", F.explode(F.array(*[F.struct(F.lit(i).alias("range_idx"), at(i // 2, 3).alias("from_raw"), at(i // 2, 7).alias("to_raw")) for i in range(3)])).alias("r")).select("doc_id", "pages", "r.*")


def split_sanitize(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = split.sanitised(ranges(spark, sf_dir), F.col("pages"))
    return s.select("doc_id", F.col("range_idx").cast("long").alias("range_idx"), "from_page", "to_page", clamp(F.coalesce(leading_int(F.col("from_raw")), F.lit(1)).cast("double"), 1.0, F.greatest(F.col("pages"), F.lit(1)).cast("double")).cast("long").alias("clamped"))


def split_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = split.sanitised(ranges(spark, sf_dir), F.col("pages"))
    p = split.pages_of(split.once(s, ["doc_id"]))
    return p.select("doc_id", F.col("range_idx").cast("long").alias("range_idx"), "page")


def split_remove(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = split.sanitised(split.without(ranges(spark, sf_dir), F.lit(0)), F.col("pages"))
    return s.groupBy("doc_id").agg(F.sum(F.col("to_page") - F.col("from_page") + 1).alias("pages"))


def history_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "error", "undo").when(F.col("event_type") == "view", "redo").otherwise("commit")
    return e.select("user_id", "ts", "event_id", kind.alias("kind"), F.floor(F.col("value") / 20).cast("string").alias("snapshot"))


def history_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.replayed(history_events(spark, sf_dir), "user_id", ["ts", "event_id"])


def history_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same states from a stateful stream over the event table."""
    from ..streaming.history import replay_table

    return replay_table(spark, f"{sf_dir}/events.parquet")


def request_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    k = F.col("conv_id")
    op = F.concat(F.lit('{"pageIndex": '), (k % 4 - 1).cast("string"), F.lit(', "text": "a\\nb", "fontSize": '), (k % 9).cast("string"), F.lit(', "baseRect": {"left": 1, "top": 2, "width": '), F.col("turn").cast("string"), F.lit(', "height": 4}}'))
    body = F.when(k % 7 == 0, F.lit("not json")).when(k % 7 == 1, F.concat(F.lit('{"operations": ['), op, F.lit("]}"))).when(k % 7 == 2, F.lit('{"pdfBase64": "JVBERg==", "operations": 5}')).otherwise(F.concat(F.lit('{"fileName": "x.pdf", "pdfBase64": "JVBERg==", "operations": ['), op, F.lit(", "), op, F.lit("]}")))
    r = requests.parsed(c.select("conv_id", "turn", body.alias("body")), "body")
    ops = r.withColumn("kept", F.size(F.filter(F.coalesce("operations", F.array()), lambda o: (o["pageIndex"] >= 0) & (o["pageIndex"] < 2))))
    return ops.select("conv_id", "turn", "status", "error", F.coalesce(F.size("operations"), F.lit(-1)).cast("long").alias("operation_count"), F.greatest("kept", F.lit(0)).cast("long").alias("kept"), F.length("content").cast("long").alias("bytes"), text.one_line_base64(F.col("content")).alias("back"))


def i18n_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = messages.templates(spark)
    c = table(spark, sf_dir, "conversations")
    k = F.col("conv_id")
    asked = c.select("conv_id", "turn", F.when(k % 3 == 0, F.lit("fr")).when(k % 3 == 1, F.lit("en")).otherwise(F.lit("de")).alias("lang"), F.when(k % 5 == 0, F.lit("missing")).when(k % 5 == 1, F.lit("loaded")).otherwise(F.lit("range")).alias("key"), F.create_map(F.lit("from"), F.col("turn").cast("string"), F.lit("to"), k.cast("string")).alias("values"))
    out = messages.rendered(asked, t, "en")
    return out.select("conv_id", "turn", "lang", "key", "message", text.fill_template(F.col("template"), F.col("values"), keep_unknown=False).alias("bare"))


def status_translate(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    k = F.col("conv_id")
    s = F.when(k % 4 == 0, F.lit("Ready.")).when(k % 4 == 1, F.concat(F.lit("Page "), F.col("turn").cast("string"), F.lit(" of "), k.cast("string"))).when(k % 4 == 2, F.concat(F.lit("Zoom "), k.cast("string"), F.lit("%"))).otherwise(F.lit("Zoom x%"))
    return messages.translated(c.select("conv_id", "turn", s.alias("status")), spark).select("conv_id", "turn", "status", "shown")


def page_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    zoom = F.when(k % 11 == 0, F.lit(float("nan"))).otherwise(k % 300 + 0.5)
    out = p.select(k.alias("k"), zoom.alias("zoom"), (k % 1500).cast("double").alias("stage"), (k % 900 + 1.0).alias("width"))
    z = shapes.zoom_percent(F.col("zoom"))
    return out.select("k", r6(z).alias("zoom"), r6(shapes.zoomed(F.col("width"), z)).alias("page_px"), r6(shapes.fit_percent(F.col("stage"), F.col("width"))).alias("fit"), r6(shapes.render_scale(F.col("stage"), F.col("width"))).alias("scale"), r6(half_up(clamp(number_or(F.col("zoom"), 0.0), -120.0, 320.0))).alias("spacing"))


def drawing_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    d = p.select(k.alias("k"), F.element_at(F.array(*[F.lit(x) for x in ("line", "rect", "ellipse")]), (k % 3 + 1).cast("int")).alias("kind"), (k % 37).cast("double").alias("x0"), (k % 41).cast("double").alias("y0"), (k % 29).cast("double").alias("x1"), (k % 31).cast("double").alias("y1"))
    b = shapes.drawn(d)
    return b.select("k", "kind", *[r6(F.col(f"shape.{c}")).alias(c) for c in ("left", "top", "width", "height", "rx", "ry")])


def export_strategy(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id")
    return d.select("doc_id", shapes.strategy(F.col("doc_id") % 3 == 0, F.col("doc_id") % 5 != 1).alias("strategy"))


def page_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages, their runs counted, as the split works on them."""
    return text_runs(spark, sf_dir).groupBy("doc_id").agg(F.countDistinct("page_index").alias("pages"), F.count("*").alias("runs"))


def file_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    k = F.col("page_id")
    files = p.select(F.floor(k / 5).alias("drop_id"), k.alias("seq"), F.when(k % 7 == 3, F.lit("application/pdf")).otherwise(F.lit("text/plain")).alias("mime"), F.concat(F.lit("f"), k.cast("string"), F.when(k % 4 == 1, F.lit(".PDF")).otherwise(F.lit(".txt"))).alias("name"))
    return requests.picked(files, "drop_id")


QUERIES = {f.__name__: f for f in (split_sanitize, split_expand, split_remove, history_state, history_stream, request_ops, i18n_render, status_translate, page_settings, drawing_bounds, export_strategy, page_runs, file_pick)}

_RANGES = f"""r AS (SELECT doc_id, n_chars % 12 AS pages, i AS range_idx, {list(RAW)}[(doc_id * 3 + i // 2) % 10 + 1] AS f, {list(RAW)}[(doc_id * 7 + i // 2) % 10 + 1] AS t FROM documents, range(3) x(i)),
n AS (SELECT *, TRY_CAST(nullif(regexp_extract(f, '^\\s*([+-]?[0-9]+)', 1), '') AS BIGINT) AS fi, TRY_CAST(nullif(regexp_extract(t, '^\\s*([+-]?[0-9]+)', 1), '') AS BIGINT) AS ti FROM r WHERE pages > 0),
c AS (SELECT *, greatest(1, least(pages, coalesce(fi, 1))) AS a, greatest(1, least(pages, coalesce(ti, pages))) AS b FROM n), s AS (SELECT doc_id, pages, fi, range_idx, least(a, b) AS from_page, greatest(a, b) AS to_page FROM c)"""
_HISTORY = """e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, CASE event_type WHEN 'error' THEN 'undo' WHEN 'view' THEN 'redo' ELSE 'commit' END AS kind, CAST(CAST(floor(value / 20) AS BIGINT) AS VARCHAR) AS snap FROM events),
st AS (SELECT DISTINCT user_id, 0::BIGINT AS n, ['0'] AS stack, 1::BIGINT AS cur FROM e UNION ALL
  SELECT s.user_id, e.n, CASE WHEN e.kind <> 'commit' OR s.stack[s.cur] = e.snap THEN s.stack ELSE list_append(s.stack[1:s.cur], e.snap) END, CASE WHEN e.kind = 'undo' THEN greatest(s.cur - 1, 1) WHEN e.kind = 'redo' THEN least(s.cur + 1, len(s.stack)) WHEN s.stack[s.cur] = e.snap THEN s.cur ELSE s.cur + 1 END FROM st s JOIN e ON e.user_id = s.user_id AND e.n = s.n + 1)"""

_HISTORY_SQL = f"WITH RECURSIVE {_HISTORY} SELECT user_id, n AS n_events, CAST(len(stack) AS BIGINT) AS stack_size, cur - 1 AS cursor, stack[cur] AS current FROM st QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC) = 1"

SQL = {
    "split_sanitize": f"WITH {_RANGES} SELECT doc_id, range_idx, from_page, to_page, greatest(1, least(greatest(pages, 1), coalesce(fi, 1))) AS clamped FROM s",
    "split_expand": f"WITH {_RANGES}, o AS (SELECT doc_id, from_page, to_page, min(range_idx) AS range_idx FROM s GROUP BY ALL) SELECT doc_id, range_idx, unnest(range(from_page, to_page + 1)) AS page FROM o",
    "split_remove": f"WITH {_RANGES} SELECT doc_id, CAST(sum(to_page - from_page + 1) AS BIGINT) AS pages FROM s WHERE range_idx <> 0 GROUP BY doc_id",
    "history_state": _HISTORY_SQL,
    "history_stream": _HISTORY_SQL,
    "request_ops": """SELECT conv_id, turn, CASE WHEN conv_id % 7 <= 2 THEN 400 ELSE 200 END AS status, CASE WHEN conv_id % 7 <= 1 THEN 'no content' WHEN conv_id % 7 = 2 THEN 'operations is no list' END AS error, CAST(CASE conv_id % 7 WHEN 0 THEN -1 WHEN 1 THEN 1 WHEN 2 THEN -1 ELSE 2 END AS BIGINT) AS operation_count,
  CAST(CASE WHEN conv_id % 4 - 1 BETWEEN 0 AND 1 THEN CASE conv_id % 7 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 0 ELSE 2 END ELSE 0 END AS BIGINT) AS kept, CAST(CASE WHEN conv_id % 7 <= 1 THEN NULL ELSE 4 END AS BIGINT) AS bytes, CASE WHEN conv_id % 7 <= 1 THEN NULL ELSE 'JVBERg==' END AS back FROM conversations""",
    "i18n_render": """WITH a AS (SELECT conv_id, turn, CASE conv_id % 3 WHEN 0 THEN 'fr' WHEN 1 THEN 'en' ELSE 'de' END AS lang, CASE conv_id % 5 WHEN 0 THEN 'missing' WHEN 1 THEN 'loaded' ELSE 'range' END AS key FROM conversations),
t AS (SELECT *, CASE WHEN key = 'missing' THEN 'missing' WHEN key = 'loaded' THEN CASE WHEN lang = 'fr' THEN 'Charge {n} pages' ELSE 'Loaded {n} pages' END WHEN lang = 'fr' THEN 'Pages {from} a {to}' ELSE 'Pages {from} to {to}' END AS tpl FROM a)
SELECT conv_id, turn, lang, key, replace(replace(tpl, '{from}', turn::VARCHAR), '{to}', conv_id::VARCHAR) AS message, regexp_replace(replace(replace(tpl, '{from}', turn::VARCHAR), '{to}', conv_id::VARCHAR), '\\{[^}]+\\}', '', 'g') AS bare FROM t""",
    "status_translate": """WITH s AS (SELECT conv_id, turn, CASE conv_id % 4 WHEN 0 THEN 'Ready.' WHEN 1 THEN 'Page ' || turn || ' of ' || conv_id WHEN 2 THEN 'Zoom ' || conv_id || '%' ELSE 'Zoom x%' END AS status FROM conversations)
SELECT *, CASE conv_id % 4 WHEN 0 THEN 'Pret.' WHEN 1 THEN 'Page ' || turn || ' sur ' || conv_id WHEN 2 THEN 'Zoom a ' || conv_id || ' %' ELSE status END AS shown FROM s""",
    "page_settings": """WITH p AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE p_partkey % 300 + 0.5 END AS z, (p_partkey % 1500)::DOUBLE AS stage, (p_partkey % 900 + 1)::DOUBLE AS w FROM part),
q AS (SELECT *, CASE WHEN z IS NULL THEN 100 ELSE floor(greatest(50, least(200, z)) + 0.5) END::DOUBLE AS zz FROM p)
SELECT k, zz AS zoom, greatest(1.0, floor(w * (zz / 100.0) + 0.5)) AS page_px, greatest(50.0, least(200.0, floor(greatest(stage - 40.0, 320.0) / greatest(w, 1.0) * 100.0 / 5 + 0.5) * 5)) AS fit, round(CASE WHEN stage = 0 THEN 1.0 ELSE greatest(0.6, least(1.6, greatest(stage - 40.0, 320.0) / greatest(w, 1.0))) END::DOUBLE, 6) AS scale, floor(greatest(-120.0, least(320.0, coalesce(z, 0.0)))::DOUBLE + 0.5) AS spacing FROM q""",
    "drawing_bounds": """WITH d AS (SELECT p_partkey AS k, ['line', 'rect', 'ellipse'][p_partkey % 3 + 1] AS kind, (p_partkey % 37)::DOUBLE AS x0, (p_partkey % 41)::DOUBLE AS y0, (p_partkey % 29)::DOUBLE AS x1, (p_partkey % 31)::DOUBLE AS y1 FROM part)
SELECT k, kind, least(x0, x1) AS "left", least(y0, y1) AS top, abs(x1 - x0) AS width, abs(y1 - y0) AS height, CASE WHEN kind = 'ellipse' THEN abs(x1 - x0) / 2 END AS rx, CASE WHEN kind = 'ellipse' THEN abs(y1 - y0) / 2 END AS ry FROM d""",
    "export_strategy": "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'exact' WHEN doc_id % 5 <> 1 THEN 'vector' ELSE 'raster' END AS strategy FROM documents",
    "page_runs": f"WITH {TEXT_RUN_SQL} SELECT doc_id, count(DISTINCT page_index) AS pages, count(*) AS runs FROM text_run GROUP BY doc_id",
    "file_pick": """WITH f AS (SELECT page_id // 5 AS drop_id, page_id AS seq, page_id % 7 = 3 AS by_type, page_id % 4 = 1 AS by_name, 'f' || page_id || CASE WHEN page_id % 4 = 1 THEN '.PDF' ELSE '.txt' END AS name FROM pages)
SELECT drop_id, arg_min(seq, (CASE WHEN by_type THEN 0 ELSE 1 END) * 1000000000 + seq) AS seq, arg_min(name, (CASE WHEN by_type THEN 0 ELSE 1 END) * 1000000000 + seq) AS name FROM f WHERE by_type OR by_name GROUP BY drop_id""",
}
