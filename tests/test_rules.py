"""Rules against hand-worked values."""

import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillframe import coerce, schemas
from quillframe.functions import color, font, geom, text
from quillframe.operators import edits, history, masks, match, paint, palette, split, svg


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_coercion(spark):
    nan, d = F.lit(float("nan")), F.lit
    assert value(spark, coerce.clamp(d(5.0), 1.0, 3.0)) == 3.0
    assert value(spark, coerce.clamp(d(5.0), 4.0, 3.0)) == 4.0
    assert math.isnan(value(spark, coerce.clamp(nan, 1.0, 3.0)))
    assert value(spark, coerce.clamp_finite(nan, 1.0, 3.0)) == 1.0
    assert value(spark, coerce.clamp_finite(d(5.0), 4.0, 3.0)) == 3.0
    assert value(spark, coerce.half_up(d(-2.5))) == -2.0
    assert value(spark, coerce.number_or(d(0.0), 7.0)) == 7.0
    assert value(spark, coerce.leading_int(d("3.7"))) == 3
    assert value(spark, coerce.leading_int(d("x"))) is None
    assert value(spark, coerce.trimmed(d("   a　"))) == "a"
    assert value(spark, coerce.text_or(d(""), d(None).cast("string"), "z")) == "z"


def test_schemas_parse(spark):
    for name in ("PAGE", "RAW_ITEM", "STYLE", "OCR_WORD", "TEXT_BOX", "EDIT_OP", "SPAN", "PAGE_FONT", "PALETTE", "COLOUR", "MASK", "SPLIT_RANGE", "HISTORY_EVENT", "I18N", "REQUEST"):
        assert spark.createDataFrame([], getattr(schemas, name)).columns


def rect(*x):
    return geom.rect(*map(float, x))


@pytest.mark.parametrize(("other", "expected"), [((5, 5, 10, 10), 0.142857), ((10, 0, 10, 10), 0.0), ((9, 9, 10, 10), 0.005025), ((8, 5, 10, 10), 0.052632)])
def test_iou(spark, other, expected):
    assert value(spark, F.round(geom.iou(rect(0, 0, 10, 10), rect(*other)), 6)) == expected


def test_lab_and_nearest(spark):
    for text_, want in (("#ff0000", (53.232882, 80.109310, 67.220068)), ("#808080", (53.585013, 0.003156, -0.006244)), ("#0000ff", (32.302587, 79.196662, -107.863681)), ("#000000", (0, 0, 0))):
        got = value(spark, color.lab(color.css(F.lit(text_))))
        assert tuple(round(x, 6) + 0.0 for x in got) == pytest.approx(want, abs=2e-6)
    base = spark.createDataFrame([(i, h, h) for i, h in enumerate(("#ff0000", "#00ff00", "#0000ff", "#ffffff", "#000000", "#808080"))], "seq int, name string, hex string")
    entries = base.withColumn("lab", color.lab(color.hex_strict(F.col("hex"))))
    nodes = spark.createDataFrame([(i, c) for i, c in enumerate(("#fe1010", "#777777", "#102030", "#c0ffc0", "none", "zzz"))], "node int, raw string")
    got = {r["raw"]: r["best"] and (r["best"]["hex"], round(r["best"]["distance"], 6)) for r in palette.mapped(nodes, entries).collect()}
    assert got == {"#fe1010": ("#ff0000", 4.246741), "#777777": ("#808080", 3.550575), "#102030": ("#000000", 17.226579), "#c0ffc0": ("#ffffff", 39.880174), "none": None, "zzz": None}


def test_percent_ranges():
    assert palette.percents(100, 20, 5)[-1] == 20
    assert palette.percents(98, 51, 5)[-2:] == [53, 51]


def test_paint_colours(spark):
    def got(f, t):
        return tuple(round(x, 6) for x in value(spark, f(F.lit(t))))

    assert got(color.paint_strict, "#0f0") == (0, 1, 0)
    assert got(color.paint_strict, "rgb(300, -5, 10)") == (1, 0, 0.039216)
    assert got(color.paint_strict, "#12345") == (0, 0, 0)
    assert got(color.paint_strict, "red") == (0, 0, 0)
    assert got(color.paint_lenient, "#12345") == (round(0x01 / 255, 6), round(0x23 / 255, 6), round(0x45 / 255, 6))
    assert value(spark, color.to_hex(color.rgb(254.5, 300.0, -1.0))) == "#ffff00"


@pytest.mark.parametrize(("chars", "most", "size", "tracking"), [(10, 70.0, 12.0, 0.0), (10, 50.0, 9.615234, 0.0), (10, 30.0, 8.16, -0.08), (1, 3.0, 8.16, 0.0)])
def test_fits(spark, chars, most, size, tracking):
    args = F.lit(chars), F.lit(12.0), F.lit(most), F.lit(0.0), F.lit(1.0)
    found = geom.fit_size(*args)
    assert value(spark, F.round(found, 6)) == size
    assert value(spark, F.round(geom.fit_tracking(F.lit(chars), F.lit(size), F.lit(0.0), F.lit(1.0), F.lit(most)), 6)) == tracking


def test_texts(spark):
    assert value(spark, text.commit(F.lit("a \n\n b"))) == "a b"
    assert value(spark, text.commit(F.lit("a\r\nb"))) == "a b"
    assert value(spark, font.export_token(F.lit("ABCDEF+Times-New Roman"))) == "timesnewroman"
    assert value(spark, font.export_font(F.lit("Arial, sans-serif"), F.lit("400"), F.lit(""))) == "Helvetica"
    assert value(spark, font.export_font(F.lit("Arial, sans-serif"), F.lit("400"), F.lit(""), compat=True)) == "Times-Roman"
    assert value(spark, text.fill_template(F.lit("{a} {b}"), F.create_map(F.lit("a"), F.lit("1")))) == "1 {b}"
    assert value(spark, text.fill_template(F.lit("{a} {b}"), F.create_map(F.lit("a"), F.lit("1")), keep_unknown=False)) == "1 "
    assert value(spark, geom.moved(F.lit(0.0), F.lit(0.0), F.lit(0.5), F.lit(0.0))) is False
    assert value(spark, geom.moved(F.lit(0.0), F.lit(0.0), F.lit(0.51), F.lit(0.0))) is True


def test_split(spark):
    rows = [(i, a, b) for i, (a, b) in enumerate((("7", "3"), ("0", "99"), ("x", ""), ("3.7", "4"), ("3", "7")))]
    s = split.sanitised(spark.createDataFrame(rows, "range_idx int, from_raw string, to_raw string"), F.lit(10)).withColumn("d", F.lit(1))
    got = {r["range_idx"]: (r["from_page"], r["to_page"]) for r in s.collect()}
    assert got == {0: (3, 7), 1: (1, 10), 2: (1, 10), 3: (3, 4), 4: (3, 7)}
    assert sorted(r["range_idx"] for r in split.once(s, ["d"]).collect()) == [0, 1, 3]
    assert split.pages_of(s).count() == sum(b - a + 1 for a, b in got.values())


@settings(max_examples=15, deadline=None)
@given(st.lists(st.one_of(st.just("undo"), st.just("redo"), st.sampled_from("abc")), max_size=12))
def test_history_against_a_loop(spark, kinds):
    stack, at = ["0"], 0
    for k in kinds:
        if k == "undo":
            at = max(at - 1, 0)
        elif k == "redo":
            at = min(at + 1, len(stack) - 1)
        elif stack[at] != k:
            stack = [*stack[: at + 1], k]
            at = len(stack) - 1
    events = spark.createDataFrame([(1, -1, "commit", "0"), *((1, i, k if len(k) > 1 else "commit", k) for i, k in enumerate(kinds))], "page long, n int, kind string, snapshot string")
    r = history.replayed(events, "page", ["n"]).first()
    assert (r["stack_size"], r["cursor"], r["current"]) == (len(stack), at, stack[at])


def test_streaming_history_keeps_state():
    import pandas as pd

    from quillframe.streaming.history import folder

    class State:
        exists, get = False, None

        def update(self, x):
            self.exists, self.get = True, x

    fold, state = folder("0"), State()
    one = pd.DataFrame({"ts": [1, 2], "event_id": [1, 2], "kind": ["commit", "commit"], "snapshot": ["a", "b"]})
    two = pd.DataFrame({"ts": [3, 4], "event_id": [3, 4], "kind": ["undo", "commit"], "snapshot": ["", "c"]})
    list(fold((1,), iter([one]), state))
    (last,) = fold((1,), iter([two]), state)
    assert last.iloc[0].tolist() == [1, 4, 3, 2, "c"]


def test_masks(spark):
    bits = F.array(*[F.lit(int(i in (9, 10, 18))) for i in range(64)])
    b = value(spark, masks.bounds(bits, F.lit(8)))
    assert (b["min_x"], b["min_y"], b["max_x"], b["max_y"]) == (1, 1, 2, 2)
    assert value(spark, masks.bounds(F.array(*[F.lit(0)] * 4), F.lit(2))) is None
    assert value(spark, masks.score(bits, bits)) == float("inf")  # under eight points
    full = F.array(*[F.lit(1)] * 16)
    assert value(spark, masks.score(full, full)) == 0
    assert value(spark, F.size(masks.candidates(F.lit(12.0), F.lit(1.0), F.lit(0.8)))) == 245


def test_best_span_takes_the_first_of_equals(spark):
    ops = spark.createDataFrame([(1, 0, 1)], "doc_id int, page_index int, op_seq int").withColumn("rect", rect(90, 90, 20, 20))
    spans = spark.createDataFrame([(1, 0, i) for i in (3, 2)], "doc_id int, page_index int, span_seq int").withColumn("rect", rect(95, 95, 20, 20))
    m = match.best_spans(ops, spans, ["doc_id", "page_index"]).collect()
    assert [(r["op_seq"], r["span_seq"]) for r in m] == [(1, 2)]


def test_restacking(spark):
    rows = spark.createDataFrame([(1, i) for i in range(4)], "page int, z int")
    got = {r["z"]: r["new_z"] for r in paint.restacked(rows, ["page"], F.col("z") == 1, True).collect()}
    assert got == {0: 0, 2: 1, 3: 2, 1: 3}


def test_svg_size_is_added_once(spark):
    assert value(spark, svg.sized(F.lit("<svg width='3'><svg/></svg>"), F.lit(5), F.lit(6))) == """<svg width='3' height="6" viewBox="0 0 5 6"><svg/></svg>"""


def test_core_plans_stay_in_the_engine(spark):
    from quillframe.plans import edits as plans

    for name in ("span_match_iou", "edit_changed", "erase_dedup", "fit_size"):
        plan = plans.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
        assert "Python" not in plan and "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_reset_forgets_edits(spark):
    o = F.struct(F.lit("A").alias("family"), F.lit(12.0).alias("size"), F.lit("400").alias("weight"), F.lit("normal").alias("style"), F.lit(0.0).alias("char_spacing"))
    b = spark.range(1).select(F.lit("a").alias("original_text"), F.lit("b").alias("edited_text"), F.lit(True).alias("has_edit"), F.lit(False).alias("is_deleted"), o.alias("original"), o.alias("edit"))
    assert edits.refreshed(edits.reset(b)).first()["has_edit"] is False
    assert edits.refreshed(b).first()["has_edit"] is True


def test_histories_of_any_length_agree():
    import pandas as pd

    from quillframe.operators.history import step
    from quillframe.streaming.history import folder

    class State:
        exists, get = False, None

        def update(self, x):
            self.exists, self.get = True, x

    n = 120_000
    rows = pd.DataFrame({"ts": range(n), "event_id": range(n), "kind": ["commit"] * n, "snapshot": [str(i) for i in range(n)]})
    (last,) = folder("0")((1,), iter([rows]), State())
    stack, cursor = ["0"], 0
    for s in rows["snapshot"]:
        cursor = step(stack, cursor, "commit", s)
    assert last.iloc[0].tolist() == [1, n, len(stack), cursor, stack[cursor]] and len(stack) == n


def test_colour_functions(spark):
    want = {"rgb(1, 2, 3)": (1, 2, 3), "rgb(1 2 3)": (1, 2, 3), "RGBA(1,2,3,.5)": (1, 2, 3), "rgba(1 2 3 / 0.5)": (1, 2, 3), "rgb(300, 0, 10)": (255, 0, 10), "rgb(1,2)": None, "rgb(-5, 1, 2)": None, "rgb(1,,2,3)": None, "rgb(1, 2, 3, 4, 5)": None, "rgb(a, b, c)": None}
    rows = spark.createDataFrame([(k,) for k in want], "t string").select("t", color.rgb_function(F.col("t")).alias("c")).collect()
    assert {r["t"]: r["c"] and tuple(r["c"]) for r in rows} == want


def test_odd_rectangles_dont_spread_over_cells(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(1, 0, (0.0, 0.0, 10.0, 10.0)), (1, 1, (0.0, 0.0, inf, 10.0)), (1, 2, (nan, 0.0, 10.0, 10.0)), (1, 3, (-1e300, 0.0, 5.0, 5.0)), (1, 4, (5.0, 5.0, -3.0, 2.0))]
    t = spark.createDataFrame([(p, s, (float(a), float(b), float(c), float(d))) for p, s, (a, b, c, d) in rows], "page int, op_seq int, rect struct<left:double,top:double,width:double,height:double>")
    spans = t.where("op_seq = 0").withColumnRenamed("op_seq", "span_seq")
    got = {r["op_seq"]: r["span_seq"] for r in match.best_spans(t, spans, ["page"]).collect()}
    assert got[0] == 0 and got[2] is None and got[4] is None


def test_files_in_and_out(spark, tmp_path):
    import base64
    import io as bytes_io
    import zipfile

    from quillframe.sources import io

    png = b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + (640).to_bytes(4, "big") + (480).to_bytes(4, "big") + b"\x08\x02\0\0\0"
    jpg = b"\xff\xd8\xff\xe0\x00\x10JFIF\x00\x01\x01\0\0\x01\0\x01\0\0" + b"\xff\xc2\x00\x11\x08" + (300).to_bytes(2, "big") + (200).to_bytes(2, "big") + b"\x03" + b"\0" * 9
    for name, content in (("a.png", png), ("b.jpg", jpg), ("c.jpg", b"\xff\xd8\xff\xe0\x00\x10"), ("d.pdf", b"%PDF-1.4")):
        (tmp_path / name).write_bytes(content)
    found = io.image_sizes(io.files(spark, f"file://{tmp_path}"))
    got = {r["name"]: (r["format"], r["width"], r["height"]) for r in found.collect()}
    assert got == {"a.png": ("png", 640, 480), "b.jpg": ("jpg", 200, 300), "c.jpg": ("jpg", None, None), "d.pdf": ("pdf", None, None)}
    urls = {r["name"]: r["data_url"] for r in io.data_urls(found.where("format IN ('png', 'jpg')")).collect()}
    assert urls["b.jpg"] == "data:image/jpeg;base64," + base64.b64encode(jpg).decode()
    pages = spark.createDataFrame([("x", 1, bytearray(b"one")), ("x", 2, bytearray(b"two")), ("y", 1, bytearray(b"three"))], "part string, page int, content binary")
    named = io.named_outputs(pages.withColumn("name", F.lit("my file.pdf")), "name", "png")
    packed = {r["part"]: bytes(r["archive"]) for r in io.archives(named.select("part", "file", "content"), "part").collect()}
    with zipfile.ZipFile(bytes_io.BytesIO(packed["x"])) as z:
        assert {n: z.read(n) for n in z.namelist()} == {"page-001.png": b"one", "page-002.png": b"two"}
    io.write_pages(pages, f"file://{tmp_path}/split", by="part")
    assert spark.read.parquet(f"file://{tmp_path}/split").where("part = 'x'").count() == 2
    io.write_texts(spark.createDataFrame([("<svg/>",)], "svg string"), f"file://{tmp_path}/svgs", "svg")
    assert [r[0] for r in spark.read.text(f"file://{tmp_path}/svgs").collect()] == ["<svg/>"]
    assert io.language(spark) == "en"


def test_fits_as_columns_and_as_layers_agree(spark):
    rows = spark.range(400).select((F.col("id") % 9).cast("int").alias("n"), (F.col("id") * 1.7 + 0.5).alias("most"), (F.col("id") % 5 * 0.02 - 0.04).alias("t"), (F.col("id") % 4 * 0.2 + 0.8).alias("s"))
    args = F.col("n"), F.lit(12.0), F.col("most"), F.col("t"), F.col("s")
    both = geom.with_fit_size(rows.withColumn("a", geom.fit_size(*args)), "b", *args)
    assert both.where("a <> b").count() == 0


def test_white_space(spark):
    d = F.lit
    every = "\t\n\x0b\x0c\r " + "".join(map(chr, (0xA0, 0xFEFF, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
    assert value(spark, coerce.trimmed(d(f"{every}a b\u0085{every}"))) == "a b\u0085"
    assert value(spark, coerce.trimmed(d(every))) == ""
    assert value(spark, coerce.trimmed(d(None).cast("string"))) is None
    assert value(spark, text.commit(d("a \r\n　b\rc"))) == "a bc"
    assert value(spark, text.commit(d(None).cast("string"))) == ""
    assert value(spark, text.one_line(d("a\r\nb\n"))) == "a b "
    assert value(spark, text.item(d("a b  \n"))) == "a b"
    assert value(spark, font.comparable(d(f" A{every}B "))) == "a b"


def test_spread(spark):
    from quillframe.sources.derived import spread

    cores = spark.sparkContext.defaultParallelism
    assert spread(spark.range(100, numPartitions=1)).rdd.getNumPartitions() == cores
    many = spark.range(100, numPartitions=cores + 3)
    assert spread(many) is many
    assert sorted(r.id for r in spread(spark.range(9, numPartitions=1)).collect()) == list(range(9))


#: queries whose rows stay where their documents were dealt out to
STAY = ("span_match_iou", "op_resolve", "baseline_snap", "erase_dedup", "paint_order", "op_page_group", "selected_boxes")


@pytest.mark.parametrize("name", STAY)
def test_rows_made_of_documents_are_not_shuffled(spark, name):
    import re

    from quillframe import plans

    plan = plans.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"Exchange hashpartitioning\(doc_id#\w+, \d+\), REPARTITION_BY_NUM", plan)
    assert not re.search(r"Exchange hashpartitioning\(doc_id[^)]*\), ENSURE_REQUIREMENTS", plan)


def test_parts_dealt_out_grow_with_the_files(spark, tmp_path, monkeypatch):
    from quillframe.sources import derived

    spark.range(4000).selectExpr("id AS doc_id", "sha2(cast(id AS string), 512) AS text").write.parquet(f"{tmp_path}/documents.parquet")
    parts = lambda: derived.text_runs(spark, str(tmp_path)).rdd.getNumPartitions()
    few = parts()
    monkeypatch.setattr(derived, "PART", 1 << 12)
    assert few == spark.sparkContext.defaultParallelism and parts() > 8 * few


def test_a_span_is_matched_once_across_cells_and_equal_ops_stay(spark):
    from quillframe.operators import match

    rect = "struct<left:double,top:double,width:double,height:double>"
    ops = spark.createDataFrame([(1, 1, (0.0, 0.0, 100.0, 100.0), "a"), (1, 1, (0.0, 0.0, 100.0, 100.0), "b"), (1, 2, (300.0, 0.0, 10.0, 10.0), "c"), (1, 3, (float("nan"), 0.0, 1.0, 1.0), "d"), (1, 4, None, "e")], f"page int, op_seq int, rect {rect}, note string")
    spans = spark.createDataFrame([(1, 7, (0.0, 0.0, 100.0, 90.0), "x"), (1, 6, (0.0, 10.0, 100.0, 90.0), "y"), (1, 8, (309.0, 9.0, 99.0, 99.0), "z"), (2, 9, (0.0, 0.0, 100.0, 100.0), "q")], f"page int, span_seq int, rect {rect}, name string")
    m = match.best_spans(ops, spans, ["page"], carried=["name"])
    got = sorted((r["op_seq"], r["note"], r["span_seq"], r["name"], r["score"] and round(r["score"], 6)) for r in m.collect())
    assert got == [(1, "a", 6, "y", 0.9), (1, "b", 6, "y", 0.9), (2, "c", None, None, None), (3, "d", None, None, None), (4, "e", None, None, None)]


def test_nearest_baselines_are_those_of_all_pairs(spark):
    from quillframe.operators import match

    # near and far boxes, equal baselines, deleted ones, and a page of one box
    made = [(p, i, float((i * i * 37 + p * 11) % 400 // (p % 3 + 1)), 10.0 + i % 3, 0.8, (i + p) % 5 == 0) for p in range(6) for i in range((p * 17) % 60 + 1)]
    rows = spark.createDataFrame(made, "page int, box_seq int, top double, size double, ascent double, is_deleted boolean")
    got = {(r["page"], r["box_seq"]): r["ref_seq"] for r in match.nearest_baseline(rows, ["page"], F.col("box_seq") % 2 == 0).collect()}
    line = {(p, i): t + s * a for p, i, t, s, a, _ in made}

    def ref(p, i, top):
        others = [(abs(line[p, j] - line[p, i]) + abs(t - top) * 0.1, j) for q, j, t, _, _, gone in made if q == p and j != i and not gone]
        return min(others)[1] if others else None

    assert got == {(p, i): ref(p, i, top) for p, i, top, *_ in made if i % 2 == 0}


def test_rows_among_named_keys(spark):
    from quillframe.operators.first_best import among

    rows = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "d"), (3, None)], "k int, v string")
    named = spark.createDataFrame([(1,), (1,), (3,), (9,), (None,)], "k int")
    assert sorted(map(repr, among(rows, named, ["k"]).collect())) == sorted(map(repr, rows.join(named, "k", "left_semi").collect()))


def test_the_calibration_grid_of_a_small_file_is_searched_on_all_cores(spark):
    from quillframe.plans import colours

    rows = colours.calibration_grid(spark, "/root/testdata/sf0.001")
    assert rows.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
