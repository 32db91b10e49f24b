"""Queries on texts, fonts and layout."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..coerce import trimmed
from ..functions import font, text
from ..operators import layout
from ..operators.match import font_table
from ..sources.derived import TEXT_RUN_SQL, table, text_runs

WS = r"[\t\n\x0b\x0c\r \x{a0}\x{feff}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
PAGE = (600.0, 640.0)


def r6(c) -> F.col:
    return F.round(c, 6)


def text_run_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = text_runs(spark, sf_dir)
    return runs.groupBy("doc_id", "page_index").agg(F.count("*").alias("runs"), r6(F.sum("width")).alias("ink"), r6(F.max(F.col("left") + F.col("width"))).alias("right"), F.max("top").alias("bottom"), F.min("run_id").alias("first_run"))


def text_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    raw = F.concat(F.lit("  "), F.replace("text", F.lit(" "), F.lit(" \r\n ")), F.lit("  "))
    return c.select("conv_id", "turn", text.commit(raw).alias("committed"), text.one_line(raw).alias("drawn"), text.item(raw).alias("scanned"), trimmed(raw).alias("trimmed"), text.visible(F.lit(" ")).alias("visible"), font.comparable(raw).alias("comparable"))


def box_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = text_runs(spark, sf_dir)
    k = F.col("run_id") % 7
    items = runs.select(
        "doc_id", "page_index", "run_id", F.when(F.col("run_id") % 50 == 1, F.lit(" ")).otherwise(F.concat("str", F.lit(" "))).alias("str"),
        F.array(F.lit(12.0), F.lit(0.0), F.lit(0.0), 9.0 + k, F.col("left"), PAGE[1] - F.col("top")).alias("transform"),
        F.when(k == 3, F.col("width") * 2.5).when(k == 5, F.lit(0.0)).otherwise(F.col("width")).alias("width"), F.when(k == 2, F.lit(40.0)).otherwise(F.lit(11.0)).alias("height"),
        F.when(k == 4, F.lit(None)).otherwise(F.lit(0.8)).alias("ascent"), F.lit(-0.2).alias("descent"),
    )
    b = layout.placed(items, *PAGE)
    return b.groupBy("doc_id", "page_index").agg(F.count("*").alias("boxes"), r6(F.sum("left")).alias("lefts"), r6(F.sum("top")).alias("tops"), r6(F.sum("w")).alias("widths"), r6(F.sum("h")).alias("heights"), r6(F.sum("font_size")).alias("sizes"))


def ocr_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = text_runs(spark, sf_dir)
    bbox = F.struct(F.col("left").alias("x0"), F.col("top").alias("y0"), (F.col("left") + F.col("width")).alias("x1"), (F.col("top") + F.col("run_id") % 13).cast("double").alias("y1"))
    return runs.select("doc_id", "page_index", "run_id", F.col("str").alias("text"), (F.col("run_id") % 100).cast("double").alias("confidence"), bbox.alias("bbox"))


def ocr_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = layout.recognised(ocr_words(spark, sf_dir), *PAGE)
    return b.groupBy("doc_id").agg(F.count("*").alias("boxes"), r6(F.sum("w")).alias("widths"), r6(F.sum("h")).alias("heights"), r6(F.sum("font_size")).alias("sizes"), F.min("confidence").alias("least"))


def box_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = text_runs(spark, sf_dir)
    pdf = runs.select("doc_id", "page_index", "run_id", F.col("width").alias("w"))
    ocr = layout.recognised(ocr_words(spark, sf_dir), *PAGE).select("doc_id", "page_index", "run_id", "w")
    return layout.readiness(layout.boxes_of(pdf, ocr), ["doc_id", "page_index"])


def scan_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = text_runs(spark, sf_dir).select("doc_id", "page_index").distinct()
    done = pages.where("(doc_id + page_index) % 3 = 0")
    return layout.not_scanned(pages, done, ["doc_id", "page_index"])


def box_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    c = p.select(
        k.alias("box_seq"), (k % 9 - 2.0).alias("left"), F.when(k % 4 == 0, F.lit(None)).otherwise(k % 11 - 3.0).alias("top"), (k % 23).cast("double").alias("width"), (k % 17).cast("double").alias("height"), F.col("p_name").alias("text"),
        F.when(k % 5 == 0, F.lit(0.0)).otherwise(k % 20 + 0.5).alias("font_size"), F.when(k % 6 == 0, F.lit("")).otherwise(F.col("p_brand")).alias("font_family"), F.lit(None).cast("string").alias("font_weight"), F.lit("").alias("font_style"),
        (k % 3 - 1.0).alias("char_spacing"), (k % 4 * 0.4).alias("scale_x"), (k % 12 * 0.1).alias("ascent"), (k % 15 - 7.0).alias("ink_x"), (k % 11 - 5.0).alias("ink_y"), F.lit(None).cast("double").alias("pad_x"), (k % 3 - 1.0).alias("pad_y"), F.when(k % 2 == 0, F.lit("ocr")).alias("source"),
    )
    out = layout.built(c)
    return out.select("box_seq", "text", "font_family", "font_weight", "font_style", "source", *[r6(F.col(x)).alias(x) for x in ("left", "top", "width", "height", "font_size", "char_spacing", "scale_x", "ascent", "ink_x", "ink_y", "pad_x", "pad_y")])


#: names made of a part's words, in the forms fonts come in
NAMES = ("ABCDEF+Times-New_Roman", "'Segoe UI'", "g_d0_f1", "Garamond Premier", "Courier_New  Bold", "sans-serif", '"Foo, Bar"', "XYZ+IBM Plex Sans-Italic", "", "JetBrains Mono", "tt12", "serif", "Qrst", "Arial, 'Helvetica Neue', sans-serif", "Trebuchet MS", "Caveat")
WEIGHTS = ("400", "bold", "700", "", "950", "semibold", "12", "600")
STYLES = ("normal", "italic", "oblique 10deg", "")


def _pick(values, k) -> F.col:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (k % len(values) + 1).cast("int"))


def named_fonts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    return p.select(k.alias("k"), F.when(k % 5 == 0, F.col("p_brand")).otherwise(_pick(NAMES, k)).alias("family"), _pick(NAMES, F.floor(k / 16)).alias("name"), _pick(WEIGHTS, k).alias("weight"), _pick(STYLES, F.floor(k / 3)).alias("style"))


def font_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    f, c = named_fonts(spark, sf_dir), F.col("family")
    return f.select("k", font.token(c).alias("token"), font.export_token(c).alias("export_token"), font.unquoted(c).alias("raw"), font.lookup_token(c).alias("lookup"), font.is_generic(c).alias("generic"), font.quoted(c).alias("quoted"), font.is_alias(c).alias("alias"), font.renderable(c).alias("renderable"))


def font_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = named_fonts(spark, sf_dir)
    return f.select("k", font.canonical_stack(F.col("family")).alias("stack"), font.mapped_family(F.col("family"), F.col("name")).alias("mapped"))


def font_standard(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = named_fonts(spark, sf_dir)
    args = F.col("family"), F.col("weight"), F.col("style")
    page, compat = font.standard_font(*args), font.standard_font(*args, compat=True)
    t = font.traits(F.col("family"), F.col("name"), F.col("weight"))
    return f.select("k", font.weight(F.col("weight")).alias("weight"), page["name"].alias("name"), page["label"].alias("label"), page["fallback"].alias("fallback"), compat["name"].alias("compat_name"), font.export_font(*args).alias("export"), font.export_font(*args, compat=True).alias("export_compat"), t["weight"].alias("trait_weight"), t["style"].alias("trait_style"))


def font_family_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = named_fonts(spark, sf_dir)
    both = F.concat_ws(", ", "family", "name", F.lit("serif"))
    src = F.concat(F.lit("local(x), url( '"), F.when(F.col("k") % 3 == 0, F.lit("font.woff")).when(F.col("k") % 3 == 1, F.lit("https://e.x/f.woff2")).otherwise(F.lit("data:font/woff2;base64,AA")), F.lit("' ) format('woff2'), url(blob:z)"))
    return f.select("k", F.array_join(font.families(both), "|").alias("families"), font.primary_family(both).alias("first_family"), font.embeddable_url(src).alias("url"))


PAGE_FONTS = ((0, 0, 7, "ABCDEF+Times-New_Roman", "F1"), (0, 1, 9, "JetBrains Mono", "F2"), (0, 2, 11, "times new roman", "F3"), (0, 3, 0, "Arial", "Caveat"), (0, 4, 13, "", "TT12"))


def font_xref_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    fonts = spark.createDataFrame(PAGE_FONTS, "page_index int, font_seq int, xref int, basefont string, resource_name string")
    f = named_fonts(spark, sf_dir).withColumn("token", font.export_token(F.col("family")))
    known = font_table(fonts).select("token", "xref")
    # a page's fonts: the driver made them above, so their number is known
    out = f.join(F.broadcast(known), "token", "left")
    fallback = font.export_font(F.col("family"), F.col("weight"), F.col("style"))
    return out.select("k", F.when(F.coalesce("xref", F.lit(0)) == 0, fallback).otherwise(F.concat(F.lit("xf"), F.col("xref").cast("string"))).alias("font"))


def font_inspect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an edit is exported with: its own font if its file is known, else the standard one."""
    f = named_fonts(spark, sf_dir)
    faces = spark.createDataFrame([("jetbrains mono", "https://e.x/j.woff2"), ("caveat", "data:font/woff2;base64,AA")], "token string, url string")
    out = font.with_face(f, F.col("family"), faces)
    standard = font.standard_font(F.col("family"), F.col("weight"), F.col("style"))
    return out.select("k", F.coalesce(F.when(F.col("url").isNotNull(), F.col("primary")), standard["label"]).alias("label"), (F.col("url").isNull() & standard["fallback"]).alias("fallback"))


def file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    k = F.col("page_id")
    name = F.concat(F.when(k % 7 == 0, F.lit("")).otherwise(F.regexp_extract("url", "([^/]*)/?$", 1)), F.when(k % 3 == 0, F.lit(".PDF")).when(k % 3 == 1, F.lit(".png")).otherwise(F.lit(" .jpeg")))
    mime = F.when(k % 5 == 0, F.lit("image/PNG")).otherwise(F.lit("application/octet-stream"))
    return p.select("page_id", text.stem(name, "converted-image").alias("image_stem"), text.stem(name, "edited-document", r"(?i)\.pdf$").alias("pdf_stem"), F.format_string("page-%03d.png", k).alias("page_name"), (mime.rlike("(?i)^image/(png|jpeg|jpg)$") | name.rlike(r"(?i)\.(png|jpe?g)$")).alias("is_image"), (name.rlike(r"(?i)\.pdf$")).alias("is_pdf"), text.escape_xml(F.col("url")).alias("escaped"))


def icon_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    x = text.icon_label(F.col("text"))
    return c.select("conv_id", "turn", x["icon"].alias("icon"), x["label"].alias("label"))


QUERIES = {f.__name__: f for f in (text_run_layout, text_normalize, box_normalize, ocr_filter, box_union, scan_once, box_build, font_tokens, font_canonical, font_standard, font_family_split, font_xref_resolve, font_inspect, file_names, icon_labels)}


def _trim(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def _names(values, k: str) -> str:
    listed = ", ".join("'" + v.replace("'", "''") + "'" for v in values)
    return f"[{listed}][({k}) % {len(values)} + 1]"


NAMED_SQL = f"""named AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 5 = 0 THEN p_brand ELSE {_names(NAMES, "p_partkey")} END AS family,
  {_names(NAMES, "p_partkey // 16")} AS name, {_names(WEIGHTS, "p_partkey")} AS weight, {_names(STYLES, "p_partkey // 3")} AS style FROM part)"""


def _unquoted(x: str) -> str:
    return f"""regexp_replace({_trim(x)}, '^[''"]|[''"]$', '', 'g')"""


def _token(x: str) -> str:
    return _trim(f"regexp_replace(regexp_replace(regexp_replace({_unquoted(x)}, '^[^+]*\\+', ''), '_+', ' ', 'g'), '{WS}+', ' ', 'g')")


def _export_token(x: str) -> str:
    return f"regexp_replace(lower(regexp_replace({_trim(x)}, '^[^+]*\\+', '')), '[^a-z0-9]+', '', 'g')"


GENERIC = "('serif', 'sans-serif', 'monospace', 'cursive', 'fantasy', 'system-ui')"


def _quoted(x: str) -> str:
    return f"CASE WHEN {_trim(x)} = '' THEN '' WHEN regexp_matches({_trim(x)}, '(?i)^[a-z0-9-]+$') THEN {_trim(x)} ELSE '''' || replace({_trim(x)}, '''', '\\''') || '''' END"


def _stack(x: str) -> str:
    cases = " ".join("WHEN " + " OR ".join(f"contains({x}, '{m}')" for m in marks) + " THEN '" + stack.replace("'", "''") + "'" for marks, stack in font.STACKS)
    return f"CASE WHEN {x} = '' THEN '' {cases} ELSE '' END"


def _alias(x: str) -> str:
    return f"regexp_matches({_trim(x)}, '(?i)^(g_[a-z0-9_]+|f[0-9]+|tt[0-9]+)$')"


SANS = font.SANS.replace("'", "''")


def _weight(x: str) -> str:
    return f"CASE WHEN regexp_matches({x}, '^[0-9]+') THEN greatest(100, least(900, CAST(regexp_extract({x}, '^[0-9]+') AS INTEGER))) WHEN contains({x}, 'bold') THEN 700 ELSE 400 END"


def _standard(family: str, weight: str, style: str, compat: bool, export: bool) -> str:
    serif = f"contains({family}, 'serif')" if compat else f"regexp_matches(replace({family}, 'sans-serif', ''), '\\bserif\\b')"
    times = " OR ".join(f"contains({family}, '{m}')" for m in (font.EXPORT_TIMES if export else font.TIMES)) + " OR " + serif
    courier = " OR ".join(f"contains({family}, '{m}')" for m in (font.EXPORT_COURIER if export else font.COURIER))
    bold = f"(contains({weight}, 'bold') OR (regexp_matches({weight}, '^[0-9]+$') AND TRY_CAST({weight} AS BIGINT) >= 600))" if export else f"({_weight(weight)} >= 600)"
    slant = f"(contains({style}, 'italic') OR contains({style}, 'oblique'))"

    def faces(key: str, lean: str, plain: str) -> str:
        sep = "-" if export else ""
        return f"CASE WHEN {bold} AND {slant} THEN '{key}{sep}Bold{lean}' WHEN {bold} THEN '{key}{sep}Bold' WHEN {slant} THEN '{key}{sep}{lean}' ELSE '{key}{sep + plain if plain else ''}' END"

    return f"CASE WHEN {times} THEN {faces('Times', 'Italic', 'Roman')} WHEN {courier} THEN {faces('Courier', 'Oblique', '')} ELSE {faces('Helvetica', 'Oblique', '')} END"


_RAW = "'  ' || replace(text, ' ', ' ' || chr(13) || chr(10) || ' ') || chr(160) || ' '"
_OCR = """ocr AS (SELECT *, (run_id % 100)::DOUBLE AS confidence, least("left" + width - "left", 600.0 - greatest(least("left", 598.0), 0.0)) AS w, least((top + run_id % 13) - top, 640.0 - greatest(least(top, 638.0), 0.0)) AS h
  FROM text_run WHERE ("left" + width) - "left" >= 4 AND (top + run_id % 13) - top >= 4 AND run_id % 100 >= 35)"""

SQL = {
    "text_run_layout": f"""WITH {TEXT_RUN_SQL} SELECT doc_id, page_index, count(*) AS runs, round(sum(width), 6) AS ink, round(max("left" + width), 6) AS "right", max(top) AS bottom, min(run_id) AS first_run FROM text_run GROUP BY ALL""",
    "text_normalize": f"""WITH r AS (SELECT *, {_RAW} AS raw FROM conversations) SELECT conv_id, turn, regexp_replace(replace(raw, chr(13), ''), '{WS}*\\n{WS}*', ' ', 'g') AS committed, replace(replace(raw, chr(13), ''), chr(10), ' ') AS drawn,
  regexp_replace(replace(raw, chr(160), ' '), '{WS}+$', '') AS scanned, {_trim("raw")} AS trimmed, false AS visible, regexp_replace(lower({_trim("raw")}), '{WS}+', ' ', 'g') AS comparable FROM r""",
    "box_normalize": f"""WITH {TEXT_RUN_SQL},
item AS (SELECT *, run_id % 7 AS k FROM text_run WHERE run_id % 50 <> 1),
g AS (SELECT *, greatest(9.0 + k, CASE WHEN k = 2 THEN 40.0 ELSE 11.0 END, 8.0)::DOUBLE AS fh, CASE WHEN k = 4 THEN 0.82::DOUBLE ELSE 0.8::DOUBLE END AS asc_, CASE WHEN k = 3 THEN width * 2.5 WHEN k = 5 THEN 0.0 ELSE width END AS w0 FROM item),
b AS (SELECT *, greatest(least("left", 598.0::DOUBLE), 0.0::DOUBLE) AS x, greatest(least((640.0 - (640.0 - top)) - fh * asc_, 638.0::DOUBLE), 0.0::DOUBLE) AS y, CASE WHEN w0 < 2 THEN greatest(len * fh * 0.45::DOUBLE, 8.0::DOUBLE) ELSE w0 END AS w1, greatest(fh * (asc_ + 0.2::DOUBLE), fh * 1.05::DOUBLE, 9.0::DOUBLE) AS h1 FROM g),
c AS (SELECT *, least(w1, 600.0 - x) AS w2, least(h1, 640.0 - y) AS h2 FROM b), d AS (SELECT *, greatest(least(fh, h2 * 0.96::DOUBLE), 8.0::DOUBLE) AS fs FROM c WHERE w2 >= 2 AND h2 >= 2),
e AS (SELECT *, greatest(len * greatest(fs, 8.0::DOUBLE) * 0.52::DOUBLE * 1.03::DOUBLE + 2, 8.0::DOUBLE) AS roomy, greatest(fs * 1.25::DOUBLE + 2, 9.0::DOUBLE) AS line FROM d),
f AS (SELECT *, greatest(2.0::DOUBLE, least(600.0 - x, CASE WHEN w2 > roomy * 1.12::DOUBLE THEN roomy ELSE w2 END)) AS w, greatest(2.0::DOUBLE, least(640.0 - y, CASE WHEN h2 > line * 1.45::DOUBLE THEN line ELSE h2 END)) AS h FROM e)
SELECT doc_id, page_index, count(*) AS boxes, round(sum(x), 6) AS lefts, round(sum(y), 6) AS tops, round(sum(w), 6) AS widths, round(sum(h), 6) AS heights, round(sum(fs), 6) AS sizes FROM f WHERE w >= 2 AND h >= 2 GROUP BY ALL""",
    "ocr_filter": f"""WITH {TEXT_RUN_SQL}, {_OCR} SELECT doc_id, count(*) AS boxes, round(sum(w), 6) AS widths, round(sum(h), 6) AS heights, round(sum(greatest(h * 0.78::DOUBLE, 8.0::DOUBLE)), 6) AS sizes, min(confidence) AS least FROM ocr WHERE w >= 2 AND h >= 2 GROUP BY doc_id""",
    "box_union": f"""WITH {TEXT_RUN_SQL}, {_OCR}, every AS (SELECT doc_id, page_index, 'pdf' AS source FROM text_run UNION ALL SELECT doc_id, page_index, 'ocr' FROM ocr WHERE w >= 2 AND h >= 2)
SELECT doc_id, page_index, bool_or(source = 'pdf') AS pdf_ready, bool_or(source = 'ocr') AS ocr_ready, count(*) AS boxes FROM every GROUP BY ALL""",
    "scan_once": f"""WITH {TEXT_RUN_SQL} SELECT DISTINCT doc_id, page_index FROM text_run WHERE (doc_id + page_index) % 3 <> 0""",
    "box_build": """WITH c AS (SELECT p_partkey AS k, * FROM part) SELECT k AS box_seq, p_name AS text, CASE WHEN k % 6 = 0 THEN 'Arial, sans-serif' ELSE p_brand END AS font_family, '400' AS font_weight, 'normal' AS font_style, CASE WHEN k % 2 = 0 THEN 'ocr' ELSE 'pdf' END AS source,
  greatest(k % 9 - 2.0, 0)::DOUBLE AS "left", CASE WHEN k % 4 = 0 THEN 0 ELSE greatest(k % 11 - 3.0, 0) END::DOUBLE AS top, greatest(k % 23, 6)::DOUBLE AS width, greatest(k % 17, 10)::DOUBLE AS height, CASE WHEN k % 5 = 0 THEN 12 ELSE greatest(k % 20 + 0.5, 8) END::DOUBLE AS font_size, (k % 3 - 1)::DOUBLE AS char_spacing,
  CASE WHEN k % 4 = 0 THEN 1.0 ELSE greatest(k % 4 * 0.4, 0.5) END::DOUBLE AS scale_x, greatest(0.5, least(0.95, k % 12 * 0.1))::DOUBLE AS ascent, greatest(-4, least(4, k % 15 - 7))::DOUBLE AS ink_x, greatest(-3, least(3, k % 11 - 5))::DOUBLE AS ink_y, 0.0::DOUBLE AS pad_x, greatest(k % 3 - 1, 0)::DOUBLE AS pad_y FROM c""",
    "font_tokens": f"""WITH {NAMED_SQL}, t AS (SELECT *, {_trim("family")} AS clean FROM named), n AS (SELECT *, length(regexp_replace(clean, '(?i)[^a-z]', '', 'g')) AS letters, length(regexp_replace(clean, '[^0-9]', '', 'g')) AS digits FROM t)
SELECT k, {_token("family")} AS token, {_export_token("family")} AS export_token, {_unquoted("family")} AS raw, lower({_trim("regexp_replace(family, '^[''" + chr(34) + "]|[''" + chr(34) + "]$', '', 'g')")}) AS lookup, lower(family) IN {GENERIC} AS generic, {_quoted("family")} AS quoted, {_alias("family")} AS alias,
  clean <> '' AND lower(clean) NOT IN {GENERIC} AND letters >= 4 AND digits <= letters AND NOT (regexp_matches(clean, '(?i)^[a-z0-9_-]+$') AND NOT regexp_matches(clean, '(?i)[aeiou]') AND letters < 8) AS renderable FROM n""",
    "font_canonical": f"""WITH {NAMED_SQL}, t AS (SELECT *, {_token("family")} AS tf, {_token("name")} AS tn, {_unquoted("family")} AS rf, {_unquoted("name")} AS rn, lower({_trim("family")}) AS gen FROM named),
a AS (SELECT *, lower(tf || ' ' || tn || ' ' || rf || ' ' || rn) AS every FROM t)
SELECT k, {_stack("lower(family)")} AS stack, CASE WHEN {_alias("rf")} THEN {_quoted("rf")} || ', {SANS}' WHEN {_alias("rn")} THEN {_quoted("rn")} || ', {SANS}' WHEN {_alias("tf")} THEN {_quoted("tf")} || ', {SANS}' WHEN {_alias("tn")} THEN {_quoted("tn")} || ', {SANS}'
  WHEN {_stack("every")} <> '' THEN {_stack("every")} WHEN gen = 'serif' THEN '''Times New Roman'', Georgia, serif' WHEN gen = 'sans-serif' THEN '{SANS}' WHEN gen = 'monospace' THEN '''Courier New'', Consolas, monospace'
  WHEN tf <> '' AND lower(tf) NOT IN {GENERIC} THEN {_quoted("tf")} || ', Arial, sans-serif' WHEN rf <> '' AND lower(rf) NOT IN {GENERIC} THEN {_quoted("rf")} || ', Arial, sans-serif' WHEN tn <> '' AND lower(tn) NOT IN {GENERIC} THEN {_quoted("tn")} || ', Arial, sans-serif' WHEN rn <> '' AND lower(rn) NOT IN {GENERIC} THEN {_quoted("rn")} || ', Arial, sans-serif' ELSE '{SANS}' END AS mapped FROM a""",
    "font_standard": f"""WITH {NAMED_SQL}, t AS (SELECT k, lower(family) AS f, lower(weight) AS w, lower(style) AS s, lower(family || ' ' || name) AS fn FROM named),
n AS (SELECT *, {_standard("f", "w", "s", False, False)} AS name FROM t)
SELECT k, {_weight("w")} AS weight, name, trim(replace(replace(replace(replace(replace(name, 'Times', 'Times '), 'Courier', 'Courier '), 'Helvetica', 'Helvetica '), 'Bold', 'Bold '), '  ', ' ')) AS label,
  NOT ({" OR ".join(f"contains(f, '{m}')" for m in (*font.TIMES, *font.COURIER, *font.HELVETICA))} OR regexp_matches(replace(f, 'sans-serif', ''), '\\bserif\\b')) AS fallback,
  {_standard("f", "w", "s", True, False)} AS compat_name, {_standard("f", "w", "s", False, True)} AS export, {_standard("f", "w", "s", True, True)} AS export_compat,
  CASE WHEN contains(fn, 'bold') OR w = 'bold' OR coalesce(TRY_CAST(nullif(regexp_extract(w, '^[0-9]+'), '') AS BIGINT) >= 600, false) THEN CASE WHEN regexp_matches(w, '^[0-9]+') THEN CAST(greatest(100, least(900, CAST(regexp_extract(w, '^[0-9]+') AS BIGINT))) AS VARCHAR) ELSE '700' END
    WHEN regexp_matches(w, '^[0-9]+') AND TRY_CAST(nullif(regexp_extract(w, '^[0-9]+'), '') AS BIGINT) BETWEEN 100 AND 900 THEN regexp_extract(w, '^[0-9]+') ELSE '400' END AS trait_weight,
  CASE WHEN contains(fn, 'italic') OR contains(fn, 'oblique') THEN 'italic' ELSE 'normal' END AS trait_style FROM n""",
    "font_family_split": f"""WITH {NAMED_SQL}, t AS (SELECT k, family || ', ' || name || ', serif' AS bothf FROM named),
p AS (SELECT k, list_filter(list_transform(regexp_extract_all(bothf, '((?:''[^'']*''|"[^"]*"|[^,''"])+)', 1), lambda x: {_unquoted("x")}), lambda x: x <> '') AS l FROM t)
SELECT k, array_to_string(l, '|') AS families, coalesce(list_filter(l, lambda x: lower(x) NOT IN {GENERIC})[1], '') AS first_family, CASE k % 3 WHEN 0 THEN 'blob:z' WHEN 1 THEN 'https://e.x/f.woff2' ELSE 'data:font/woff2;base64,AA' END AS url FROM p""",
    "font_xref_resolve": f"""WITH {NAMED_SQL}, fonts(seq, xref, base, res) AS (VALUES {", ".join(f"({s}, {x}, '{b}', '{r}')" for _, s, x, b, r in PAGE_FONTS)}),
tok AS (SELECT seq * 2 AS o, xref, {_export_token("base")} AS token FROM fonts UNION ALL SELECT seq * 2 + 1, xref, {_export_token("res")} FROM fonts), known AS (SELECT token, arg_min(xref, o) AS xref FROM tok WHERE token <> '' GROUP BY token),
t AS (SELECT k, lower(family) AS f, lower(weight) AS w, lower(style) AS s, {_export_token("family")} AS token FROM named)
SELECT k, CASE WHEN coalesce(xref, 0) = 0 THEN {_standard("f", "w", "s", False, True)} ELSE 'xf' || xref END AS font FROM t LEFT JOIN known USING (token)""",
    "font_inspect": f"""WITH {NAMED_SQL}, l AS (SELECT *, list_filter(list_transform(regexp_extract_all(family, '((?:''[^'']*''|"[^"]*"|[^,''"])+)', 1), lambda x: {_unquoted("x")}), lambda x: x <> '' AND lower(x) NOT IN {GENERIC})[1] AS head, lower(family) AS f, lower(weight) AS w, lower(style) AS s FROM named),
n AS (SELECT * EXCLUDE (name), lower(coalesce(head, '')) IN ('jetbrains mono', 'caveat') AS own, {_standard("f", "w", "s", False, False)} AS name FROM l)
SELECT k, CASE WHEN own THEN head ELSE trim(replace(replace(replace(replace(replace(name, 'Times', 'Times '), 'Courier', 'Courier '), 'Helvetica', 'Helvetica '), 'Bold', 'Bold '), '  ', ' ')) END AS label,
  NOT own AND NOT ({" OR ".join(f"contains(f, '{m}')" for m in (*font.TIMES, *font.COURIER, *font.HELVETICA))} OR regexp_matches(replace(f, 'sans-serif', ''), '\\bserif\\b')) AS fallback FROM n""",
    "file_names": f"""WITH n AS (SELECT *, CASE WHEN page_id % 7 = 0 THEN '' ELSE regexp_extract(url, '([^/]*)/?$', 1) END || CASE page_id % 3 WHEN 0 THEN '.PDF' WHEN 1 THEN '.png' ELSE ' .jpeg' END AS name FROM pages)
SELECT page_id, coalesce(nullif({_trim("regexp_replace(name, '\\.[^.]+$', '')")}, ''), 'converted-image') AS image_stem, coalesce(nullif({_trim("regexp_replace(name, '(?i)\\.pdf$', '')")}, ''), 'edited-document') AS pdf_stem, 'page-' || lpad(CAST(page_id AS VARCHAR), greatest(3, length(CAST(page_id AS VARCHAR)))::INTEGER, '0') || '.png' AS page_name,
  page_id % 5 = 0 OR regexp_matches(name, '(?i)\\.(png|jpe?g)$') AS is_image, regexp_matches(name, '(?i)\\.pdf$') AS is_pdf, replace(replace(replace(replace(replace(url, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&apos;') AS escaped FROM n""",
    "icon_labels": f"""WITH t AS (SELECT conv_id, turn, {_trim("text")} AS x FROM conversations) SELECT conv_id, turn, regexp_extract(x, '^([^{WS[1:-1]}]+){WS}*(.*)$', 1) AS icon, {_trim(f"regexp_extract(x, '^([^{WS[1:-1]}]+){WS}*(.*)$', 2)")} AS label FROM t""",
}
