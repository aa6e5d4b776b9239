"""Review plans and the checks that need pictures, spans and bands."""

import numpy as np
from pyspark.sql import functions as F

from quirework import schemas
from quirework.functions import ink
from quirework.functions.lines import header_key
from quirework.functions.rects import RECT
from quirework.operators import review, verify

LINE = f"book_id string, page int, line_idx int, text string, rect {RECT}"


def line(page, i, text, top, left=0.1, right=0.9):
    return ("b", page, i, text, (left, top, right, top + 0.02))


def found(d):
    return sorted((r.code, r.ref) for r in d.collect())


def test_sheets_rows_and_snapping(spark):
    d = spark.createDataFrame([("b", 0, i, 0.1 * (i // 2), 0.1 + 0.5 * (i % 2), 0.1 * (i // 2) + 0.08) for i in range(5)], "book_id string, page int, id int, top double, left double, bottom double")
    assert [(r.sheet, r.row, r.column) for r in review.sheet_plan(d, ["book_id"], ["id"], 2, 2).orderBy("id").collect()] == [(0, 0, 0), (0, 0, 1), (0, 1, 0), (0, 1, 1), (1, 0, 0)]
    assert [(r.row, r.row_size) for r in review.item_rows(d).orderBy("id").collect()] == [(0, 2), (0, 2), (1, 2), (1, 2), (2, 1)]
    assert review.snap(0.11, [(0.1, 0.14)]) == 0.098 and review.snap(0.3, [(0.1, 0.14)]) == 0.3
    merged = review.merge_fractions([{"text": "1", "left": 0.1, "right": 0.2, "top": 0.1, "bottom": 0.12, "font_size": 10, "column": 0}, {"text": "2", "left": 0.1, "right": 0.2, "top": 0.115, "bottom": 0.135, "font_size": 10, "column": 0}, {"text": "x", "left": 0.1, "right": 0.2, "top": 0.3, "bottom": 0.32, "font_size": 10, "column": 0}])
    assert [m["text"] for m in merged] == ["1 2", "x"] and len(merged[0]["parts"]) == 2


def test_running_lines_of_a_book(spark):
    rows = []
    for p in range(6):
        rows += [line(p, 0, f"Chapter of many things {p}", 0.05, 0.1, 0.5), line(p, 1, str(p), 0.05, 0.8, 0.85), line(p, 2, f"Body text number {p} " + "abcdef"[p] * 5, 0.5)]
    d = spark.createDataFrame(rows, LINE)
    pages = spark.createDataFrame([("b", 6)], "book_id string, page_count int")
    got = review.header_footer(d, pages, header_key(F.col("text")))
    assert {r.line_idx for r in got.filter("header_footer").collect()} == {0, 1}
    heads = review.running_heads(d, header_key(F.col("text")))
    assert {r.line_idx for r in heads.filter("running").collect()} == {0, 1} and heads.count() == 18


def test_reports_and_lookups(spark):
    books = spark.createDataFrame([("a", "A|B"), ("c", "C")], "book_id string, title string")
    gates = spark.createDataFrame([("a", 0, 0, True)], "book_id string, open long, unconfirmed long, perfect boolean")
    sums = spark.createDataFrame([("a", 5, 5)], "book_id string, items long, answered long")
    got = {r.book_id: (r.status, r.line) for r in review.batch_index(books, gates, sums).collect()}
    assert got["a"] == ("PERFECT", r"| A\|B | 5 | 5 | 0 | 0 | PERFECT |") and got["c"][0] == "ZERO EXERCISES"
    o = lambda rows: spark.createDataFrame(rows, "book_id string, label string, title string, page int, depth int")
    diff = review.outline_diff(o([("b", "1", "One", 0, 0), ("b", "2", "Two", 5, 0), ("b", None, "End", 9, 0)]), o([("b", "1", "one", 0, 0), ("b", "2", "Two", 6, 0), ("b", "3", "New", 7, 0)]))
    assert sorted((r.key, r.state) for r in diff.collect()) == [("1", "same"), ("2", "changed"), ("3", "new"), ("end", "gone")]
    items = spark.createDataFrame([("b", 0, "x", 10.0, 0.0), ("b", 0, "y", 0.0, 0.0), ("b", 0, "z", 9.0, 1.5)], "book_id string, page int, text string, font_size double, angle double")
    assert sorted((r.text, r.font_size) for r in review.upright(items).collect()) == [("x", 10.0), ("y", 10.0)]
    frames = spark.createDataFrame([("b", "f1", "exercise", 0, (0.1, 0.1, 0.5, 0.2), None, None, [(0, (0.1, 0.1, 0.2, 0.2)), (0, (0.1, 0.1, 0.2, 0.2000001))], None, "book", "7", "s1")], schemas.FRAMES)
    wanted = spark.createDataFrame([("b", "f1", None, None), ("b", None, "s1", "7"), ("b", None, "s1", "8")], "book_id string, id string, section string, label string")
    assert sorted(str(r.found) for r in review.frame_of(wanted, frames).collect()) == ["None", "f1", "f1"]
    assert len(review.union_regions(frames, ["book_id", "unit"], "context").first().context) == 1


def test_spans_ends_bands_and_edges(spark):
    lines = spark.createDataFrame([line(0, 0, "1. first", 0.10), line(0, 1, "between", 0.20), line(0, 2, "more of first", 0.30), line(0, 3, "goes on", 0.325), line(0, 4, "9. alone", 0.6)], LINE).withColumn("header_footer", F.lit(False))
    R = f"book_id string, page int, id string, unit string, role string, ord int, rect {RECT}"
    regions = spark.createDataFrame([("b", 0, "f1", None, "item", 0, (0.08, 0.09, 0.92, 0.125)), ("b", 0, "f1", None, "item", 1, (0.08, 0.295, 0.92, 0.3225)), ("b", 0, "a1", None, "solution", 0, (0.08, 0.61, 0.92, 0.7))], R)
    assert found(verify.check_spans(lines, regions)) == [("span-gap", "f1")]
    assert found(verify.check_open_ends(lines, regions)) == [("region-open-end", "f1")]
    assert found(verify.check_limits(regions, 1)) == [("continuation-limit", "f1")]
    bands = spark.createDataFrame([("b", 0, "s1", 0.55, 0.9)], "book_id string, page int, section string, top double, bottom double")
    assert ("answer-clipped", "a1") in found(verify.check_answers(lines, regions, bands))
    assert found(verify.check_inline(lines, regions, spark.createDataFrame([("b", 0, "s1", 0.05, 0.5)], "book_id string, page int, section string, top double, bottom double"))) == [("inline-section", "s1")]
    contexts = spark.createDataFrame([("b", "s1", "f1", 0, 0.01, True), ("b", "s1", None, 0, 0.05, False)], "book_id string, section string, item_id string, page int, top double, attached boolean")
    items = spark.createDataFrame([("b", "s1", "f1", "1", 0, 0.1)], "book_id string, section string, id string, label string, page int, top double")
    assert found(verify.check_nearest_context(contexts, items)) == [("context-not-nearest", "s1:1")]
    page = np.full((200, 100), 255, np.uint8)
    page[98:104, 20:60] = 0
    pictures = spark.createDataFrame([("b", 0, bytearray(ink.bit_map(page)), 100, 200)], "book_id string, page int, bits binary, width int, height int")
    cut = spark.createDataFrame([("b", 0, "x", (0.1, 0.2, 0.9, 0.5)), ("b", 0, "y", (0.1, 0.6, 0.9, 0.9))], f"book_id string, page int, id string, rect {RECT}")
    assert found(verify.check_edges(cut, pictures)) == [("edge-on-ink", "x:bottom")]
