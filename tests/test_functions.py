"""Functions of text, labels, rectangles and ink on small inputs with known results."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quirework.functions import ink, labels, lines, rects


def column(spark, values, f, kind="string"):
    d = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.x for r in d.select("i", f(F.col("v")).alias("x")).orderBy("i").collect()]


def test_label_forms(spark):
    assert column(spark, ["5.", " 12  a. ", "(a)", "3)", "1.2...", None], labels.normalized) == ["5", "12 a", "(a)", "3", "1.2...", None]
    assert column(spark, ["5.", "7", "", "x" * 30, "--"], labels.problem) == ["label-style", None, "label-missing", "bad-label", "bad-label"]
    assert column(spark, ["ﬁve – 2", None, " a　b "], labels.folded) == ["five - 2", None, "a b"]
    assert column(spark, ["Élan & Über 2", "!!"], labels.slugged) == ["elan-uber-2", None]
    assert column(spark, ["1.10.2b", "7", "x"], labels.numbers) == [[1, 10, 2], [7], None]
    assert column(spark, ["5. Find", "5) x", "(12a) y", "(a) z", "1.2.3 Foo", "1.5 apples", "word", "3.14"], labels.item_start) == ["5", "5", "12a", "a", "1.2.3", None, None, None]
    assert column(spark, ["In Exercises 5-8, 12 and 14, find", "no numbers", "3 and 4"], labels.named_numbers) == [[5, 6, 7, 8, 12, 14], [], [3, 4]]
    assert column(spark, ["xiv", "12", "iix", "", "MCMXC"], labels.numeral) == [14, 12, None, None, 1990]
    order = spark.createDataFrame([("10",), ("2b",), ("2",), ("2a",), ("x",), ("1.10",), ("1.9",)], "v string")
    assert [r.v for r in order.orderBy(labels.order(F.col("v"))).collect()] == ["1.9", "1.10", "2", "2a", "2b", "10", "x"]
    assert [labels.successor(x) for x in ("5", "5a", "1.9", "z", "b")] == ["6", "5b", "1.10", "aa", "c"]


@given(st.integers(1, 3999))
@settings(max_examples=60, deadline=None)
def test_roman_round_trip(n):
    assert labels.roman_value(labels.roman(n)) == n


def test_line_classes(spark):
    rows = ["CHAPTER ONE 12", "17", "(3.1)", "Chapter 4 Things", "7. What is it?", "Figure 3 A tree", "Find the sum of both.", "Plain words here", "---"]
    assert column(spark, rows, lines.line_class) == ["furniture", "furniture", "symbol", "heading", "item", "caption", "instruction", "text", "symbol"]
    assert column(spark, ["Page 12 of  300", "Page 9 of 1"], lines.header_key) == ["page # of #", "page # of #"]
    got = column(spark, ["Exercise 12 x", "5. Foo", "5. foo", "5) x", "(5) x", "§ 7 x", "1.2 Title", "none"], lines.start_style)
    assert [(g.style, g.label, g.confidence) if g else None for g in got] == [("keyword", "12", 0.9), ("number-dot", "5", 0.55), ("number-dot", "5", 0.5), ("number-paren", "5", 0.5), ("paren-number", "5", 0.4), ("section", "7", 0.3), ("heading-number", "1.2", 0.25), None]
    got = column(spark, ["3. x", "4) x", "(5) x", "[6] x", "7 apples", "3.14 x", "x"], lines.census_label)
    assert [(g.family, g.n) if g else None for g in got] == [("dot", 3), ("paren", 4), ("both", 5), ("bracket", 6), ("bare", 7), None, None]
    assert column(spark, ["Title . . . . 12", "A\x01 b"], lines.clean_title) == ["Title", "A b"]
    assert column(spark, ["Chapter 2: Cats & Dogs!"], lines.title_key) == ["cats and dogs"]
    assert column(spark, ["/a/My_book-2.pdf"], lines.title_from_file) == ["My book 2"]
    assert column(spark, ["https://a.b/c", "ftp://x", "http:// "], lines.is_web_address) == [True, False, False]
    credit = column(spark, ["Copyright 2020 by Ann Lee", "Under CC BY-SA 4.0, all rights reserved"], lines.credits)
    assert [[tuple(x) for x in c] for c in credit] == [[("author", "Ann Lee")], [("license", "CC BY-SA 4.0"), ("rights", "all rights reserved")]]


def test_rectangles(spark):
    d = spark.createDataFrame([((0.1, 0.1, 0.5, 0.5), (0.3, 0.3, 0.9, 0.4))], f"a {rects.RECT}, b {rects.RECT}")
    a, b = F.col("a"), F.col("b")
    r = d.select(rects.area(a).alias("area"), rects.intersection(a, b).alias("x"), rects.bounds(a, b).alias("u"), rects.shared(a, b).alias("s"), rects.contains(rects.bounds(a, b), a).alias("c"), rects.equal(a, a).alias("e"), rects.shifted(b, F.lit(0.5), F.lit(-0.9)).alias("m"), rects.formatted(a).alias("f")).first()
    assert r.area == pytest.approx(0.16) and tuple(r.x) == (0.3, 0.3, 0.5, 0.4) and tuple(r.u) == (0.1, 0.1, 0.9, 0.5)
    assert r.s == pytest.approx(0.02 / 0.06) and r.c and r.e and tuple(r.m) == pytest.approx((0.4, 0.0, 1.0, 0.1)) and r.f == "0.1,0.1,0.5,0.5"
    assert column(spark, [0.000005, -0.000005, 0.123454999, None], rects.round_half_up, "double") == [1e-05, 0.0, 0.12345, None]
    rows = [(0.1, 0.1, 0.5, 0.5), (0.5, 0.1, 0.1, 0.5), (-0.1, 0.0, 0.5, 0.5), (-0.001, 0.0, 0.5, 0.5), (0.1, 0.1, 0.11, 0.5), None]
    d = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, r {rects.RECT}")
    assert [x.p for x in d.select("i", rects.problem(F.col("r")).alias("p")).orderBy("i").collect()] == [None, "rect-inverted", "rect-off-page", "rect-clamped", "rect-too-small", "bad-rect"]
    parsed = column(spark, ["0.1,0.2,0.3,0.4", "[0, 0.2, 0.3, 1]", '{"left":0.1,"top":0.2,"right":0.3,"bottom":0.4}', "x", "1,2,3"], rects.parsed)
    assert [tuple(p) if p else None for p in parsed] == [(0.1, 0.2, 0.3, 0.4), (0, 0.2, 0.3, 1), (0.1, 0.2, 0.3, 0.4), None, None]
    grown = spark.createDataFrame([((0.0, 0.5, 0.001, 0.501),)], f"r {rects.RECT}").select(rects.enlarged(F.col("r")).alias("g")).first().g
    assert tuple(grown) == pytest.approx((0.0, 0.4955, 0.02, 0.5055), abs=1e-3) and grown.left >= 0


def test_ink(spark):
    page = np.full((100, 80), 255, np.uint8)
    page[40:60, 10:70] = 0
    p = ink.profile(page, 10)
    assert p[0] == 0 and p[4] == pytest.approx(0.75) and len(p) == 10
    dark = ink.unpacked(ink.bit_map(page), 80, 100)
    assert (dark == (page < 170)).all()
    cut = (0.1, 0.5, 0.9, 0.9)
    found = ink.edge(dark, cut, "top")
    assert found["crossing"] == 60 and found["longest"] == 60 and ink.is_cut(found)
    assert ink.clean_edge(dark, (0.1, 0.59, 0.9, 0.9), "top") == pytest.approx(0.60)
    assert ink.clean_edge(dark, cut, "top") is None and ink.clean_edge(dark, (0.1, 0.7, 0.9, 0.9), "top") == 0.7
    assert ink.poke_depth(dark, 42) == 2 and ink.poke_depth(dark, 50) == 4
    d = spark.createDataFrame([(bytearray(page.tobytes()), 80, 100), (None, None, None)], "pixels binary, width int, height int")
    got = [r.x for r in d.select(ink.profiles("pixels", "width", "height").alias("x")).collect()]
    assert len(got[0]) == 400 and got[1] is None
