"""Operators over books on small fixtures with known results, and their indifference to the order of rows."""

import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from quirework import schemas
from quirework.functions.rects import RECT
from quirework.operators import census, contents, gate, geometry, layout, operations, propose, reconcile, sequences, statistics, trees, validation, verify


def rows(d, *cols):
    return sorted((tuple(r) for r in (d.select(*cols) if cols else d).collect()), key=lambda t: [(x is None, x) for x in t])


# -- sequences


def test_longest_rising_equals_brute_force():
    rnd = random.Random(1)
    for _ in range(200):
        v = [rnd.randint(0, 6) for _ in range(rnd.randint(0, 9))]
        got = sequences.longest_rising(v)
        best = max((c for n in range(len(v) + 1) for c in itertools.combinations(range(len(v)), n) if all(v[a] <= v[b] for a, b in zip(c, c[1:], strict=False))), key=lambda c: (len(c), [-x for x in c]))
        assert got == list(best)


def test_sequence_checks(spark):
    d = spark.createDataFrame([("s", n) for n in (1, 2, 2, 5, 40)] + [("t", 3), ("t", None)], "s string, n int")
    assert rows(sequences.duplicates(d, "s", "n")) == [("s", 2, 2)]
    g = sequences.gaps(d, "s", "n")
    assert rows(g) == [("s", 3, 4, 2), ("s", 6, 39, 34)]
    assert rows(sequences.missing_numbers(g, "s", 10), "missing") == [(3,), (4,), (None,)]
    assert rows(sequences.outliers(d, "s", "n"), "n") == [(40,)]
    assert rows(sequences.compact_ranges(d, ["s"], "n")) == [("s", "1, 2, 5, 40"), ("t", "3")]
    c = spark.createDataFrame([("k", x) for x in (0.0, 0.03, 0.05, 0.06, 0.2)], "k string, x double")
    assert rows(sequences.anchored_clusters(c, ["k"], "x", 0.05), "cluster", "anchor", "n") == [(0, 0.0, 3), (1, 0.06, 1), (2, 0.2, 1)]
    assert [r.island for r in sequences.lag_islands(c, ["k"], "x", 0.05).orderBy("x").collect()] == [0, 0, 0, 0, 1]
    o = spark.createDataFrame([("b", i, x) for i, x in enumerate([2, 5, 1, 9, 2])], "b string, i int, d int")
    assert [r.clamped for r in sequences.clamp_depths(o, ["b"], "i", "d").orderBy("i").collect()] == [0, 1, 1, 2, 2]
    e = spark.createDataFrame([("k", i) for i in range(10)], "k string, i int")
    assert [r.i for r in sequences.even_stride(e, ["k"], ["i"], 4).orderBy("i").collect()] == [0, 2, 5, 9]


# -- trees


def test_trees(spark):
    o = spark.createDataFrame([("b", i, d) for i, d in enumerate([0, 1, 2, 1, 0, 1])], "b string, idx long, depth int")
    e = trees.extents(o, ["b"], "idx", "depth", 4)
    with pytest.raises(Exception, match="deeper than 1 levels"):
        trees.extents(o, ["b"], "idx", "depth", 1).collect()
    assert rows(e, "idx", "subtree_end", "parent") == [(0, 4, None), (1, 3, 0), (2, 3, 1), (3, 4, 0), (4, None, None), (5, None, 4)]
    counts = spark.createDataFrame([(2, 5), (5, 1), (0, 2)], "idx long, n long")
    assert rows(trees.rollup(counts, e, "idx", "parent", "n", 3)) == [(0, 2, 7), (1, 0, 5), (2, 5, 5), (3, 0, 0), (4, 0, 1), (5, 1, 1)]
    items = spark.createDataFrame([("b", 1, 0.5, "x"), ("b", 0, 0.1, "y"), ("b", 3, 0.0, "z")], "b string, page int, top double, id string")
    marks = spark.createDataFrame([("b", 0, 0.2, "s1"), ("b", 3, 0.0, "s2")], "b string, page int, top double, m string")
    assert {(r.id, r.located) for r in trees.locate(items, marks, ["b"], ["page", "top"], "m").collect()} == {("x", "s1"), ("y", None), ("z", "s2")}


# -- comparisons


def test_compare_and_plan(spark):
    f = spark.createDataFrame([("1", 3, "a"), ("1", 0, "z"), ("2", 2, "b"), ("4", 1, "d")], "label string, count int, title string")
    e = spark.createDataFrame([("1", 3, "a"), ("2", 5, "b"), ("3", 1, "c"), ("4", 1, "D")], "label string, count int, title string")
    assert rows(reconcile.compare(f, e, "label", "count", "title"), "label", "status") == [("1", "equal"), ("2", "count"), ("3", "missing"), ("4", "title")]
    p = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 3.0)], "k string, v double")
    s = spark.createDataFrame([("a", 1.0004), ("b", 9.0), ("d", 1.0)], "k string, v double")
    assert rows(reconcile.plan(p, s, ["k"], ["v"], 0.001)) == [("a", "unchanged"), ("b", "changed"), ("c", "added"), ("d", "not-proposed")]
    assert {r.action for r in reconcile.plan(p, p, ["k"], ["v"], 0.001).collect()} == {"unchanged"}


# -- geometry

R = f"book_id string, page int, id string, unit string, rect {RECT}"


def region(i, left, top, right, bottom, unit=None, page=0):
    return ("b", page, i, unit, (left, top, right, bottom))


def test_rectangle_joins(spark):
    d = spark.createDataFrame([region("a", 0.1, 0.1, 0.5, 0.5), region("b", 0.1, 0.4, 0.5, 0.9), region("c", 0.1, 0.1, 0.5, 0.5), region("e", 0.2, 0.2, 0.3, 0.3), region("f", 0.1, 0.1, 0.5, 0.5, page=1), region("g", 0.6, 0.1, 0.9, 0.9, "u"), region("h", 0.6, 0.5, 0.9, 0.9, "u")], R)
    got = rows(geometry.overlapping_regions(d, ["book_id", "page"], "id", "unit", "rect"), "a", "b", "code")
    assert got == [("a", "b", "overlap"), ("a", "c", "duplicate-region"), ("a", "e", "overlap"), ("b", "c", "overlap"), ("c", "e", "overlap")]
    assert ("e", "a") in rows(geometry.contained(d, ["book_id", "page"], "id", "rect"), "inner", "outer")
    assert rows(geometry.overlapping_regions(d.repartition(5), ["book_id", "page"], "id", "unit", "rect"), "a", "b", "code") == got


def test_covered_share_equals_a_grid(spark):
    rnd = random.Random(2)
    boxes, regions = [], []
    cell = lambda: sorted(rnd.sample(range(11), 2))
    for i in range(12):
        (l, r), (t, b) = cell(), cell()  # noqa: E741
        (boxes if i < 4 else regions).append((l, t, r, b))
    f = lambda x: tuple(v / 10 for v in x)
    bd = spark.createDataFrame([("b", 0, str(i), f(x)) for i, x in enumerate(boxes)], f"book_id string, page int, id string, rect {RECT}")
    rd = spark.createDataFrame([("b", 0, f(x)) for x in regions], f"book_id string, page int, rect {RECT}")
    got = {r.id: r.share for r in geometry.covered_share(bd, rd, ["book_id", "page"], "id").collect()}
    for i, (l, t, r, b) in enumerate(boxes):  # noqa: E741
        n = sum(any(x0 <= x < x1 and y0 <= y < y1 for x0, y0, x1, y1 in regions) for x in range(l, r) for y in range(t, b))
        assert got[str(i)] == pytest.approx(n / ((r - l) * (b - t)))


def test_same_place_and_cut_lines(spark):
    a = spark.createDataFrame([("b", 0, "x", (0.1, 0.1, 0.5, 0.2))], f"book_id string, page int, id string, rect {RECT}")
    b = spark.createDataFrame([("b", 0, "y", (0.102, 0.1049, 0.5, 0.2)), ("b", 0, "z", (0.2, 0.1, 0.5, 0.2))], f"book_id string, page int, id string, rect {RECT}")
    assert rows(geometry.same_place(a, b, ["book_id", "page"]), "b_id") == [("y",)]
    lines = spark.createDataFrame([("b", 0, 1, (0.1, 0.30, 0.9, 0.32)), ("b", 0, 2, (0.1, 0.5, 0.9, 0.52))], f"book_id string, page int, line_idx int, rect {RECT}")
    regions = spark.createDataFrame([("b", 0, "r", (0.1, 0.1, 0.9, 0.312))], f"book_id string, page int, id string, rect {RECT}")
    assert rows(geometry.cut_lines(lines, regions, ["book_id", "page"]), "a_line_idx", "b_side", "suggested") == [(1, "bottom", 0.32)]


# -- layout


def item(i, text, left, baseline, width=None, size=10.0, page=0):
    return ("b", page, i, text, left, left + (width if width is not None else 5.0 * len(text)), baseline, size, None, None, None)


def test_lines_of_a_page_of_two_columns(spark):
    items, i = [item(0, "A title over both of the columns here", 100.0, 40.0, 400.0, 14.0)], 1
    for k in range(8):
        for x, name in ((50.0, "left"), (330.0, "right")):
            items += [item(i, f"{k}.", x, 100.0 + 20 * k, 10.0), item(i + 1, f"{name} line {k}", x + 16, 100.0 + 20 * k, 180.0)]
            i += 2
    pages = spark.createDataFrame([("b", 0, 600.0, 800.0)], "book_id string, page int, width double, height double")
    random.Random(3).shuffle(items)
    got = layout.lines_of(spark.createDataFrame(items, schemas.TEXT_ITEMS), pages).orderBy("line_idx").collect()
    assert [r.text for r in got] == ["A title over both of the columns here"] + [f"{k}. left line {k}" for k in range(8)] + [f"{k}. right line {k}" for k in range(8)]
    assert [r.column for r in got] == [0] * 9 + [1] * 8
    assert layout.item_cells("1. a 2. b 3. c") == [(1, "1. a"), (2, "2. b"), (3, "3. c")] and layout.item_cells("none") == []


def book_lines(spark):
    """Two sections of ten numbered items over two pages, a running head, a heading for each section."""
    out = []
    for page in range(2):
        texts = [f"{page + 1}.1 Section title", "Find the sum in Exercises 1-10."] + [f"{n}. What is {n} and what is it for?" for n in range(1, 11)]
        out.append(("b", page, 0, f"A RUNNING HEAD {page}", 0.1, 0.02, 0.9, 0.04, 10.0, 0, 16, False))
        out += [("b", page, i + 1, t, 0.1, 0.1 + 0.05 * i, 0.8, 0.12 + 0.05 * i, 14.0 if i == 0 else 10.0, 0, len(t), i == 0) for i, t in enumerate(texts)]
    return spark.createDataFrame(out, layout.LINES)


def test_headings_starts_and_frames(spark):
    lines = book_lines(spark)
    heads = layout.headings(lines)
    assert rows(heads, "text") == [("1.1 Section title",), ("2.1 Section title",)]
    starts = propose.start_candidates(lines)
    dots = starts.filter("style = 'number-dot'")
    assert dots.count() == 20 and dots.filter("accepted").count() == 20
    frames = propose.item_frames(lines, dots)
    assert frames.count() == 20 and {r.label for r in frames.collect()} == {str(n) for n in range(1, 11)}
    body = statistics.weighted_mode(lines, ["book_id"], F.floor(F.col("font_size") * 2 + 0.5) / 2, F.col("chars"), F.struct("page", "line_idx")).withColumnRenamed("mode", "body")
    found = contents.scan_headings(lines, body)
    assert rows(found, "kind", "label") == [("lesson", "1.1"), ("lesson", "2.1")]
    listed = spark.createDataFrame([("b", 9, 0, "section", "1.1", "Section title", 1, True, 0)], contents.ENTRIES + ", index int")
    assert rows(contents.sections(listed, found), "label", "page", "confidence") == [("1.1", 0, 0.8), ("2.1", 1, 0.65)]


def test_contents(spark):
    texts = ["Contents", "Chapter 1 Numbers . . . . . 3", "1.1 Counting .......... 4", "1.2 Adding ............ 9", "Index ............... 80", "plain words"]
    d = spark.createDataFrame([("b", 0, i, t) for i, t in enumerate(texts)] + [("b", 7, 0, "only one ..... 3")], "book_id string, page int, line_idx int, text string")
    got = rows(contents.contents(d), "line_idx", "kind", "title", "printed_page")
    assert got == [(1, "chapter", "Numbers", 3), (2, "section", "Counting", 4), (3, "section", "Adding", 9), (4, "unnumbered", "Index", 80)]
    n = spark.createDataFrame([("b", 2)], "book_id string, offset int")
    assert rows(contents.page_index(contents.contents(d), n), "index") == [(1,), (2,), (7,), (78,)]
    o = spark.createDataFrame([("b", i, t, dp) for i, (t, dp) in enumerate([("Part", 0), ("1 One", 1), ("1.1 A", 2), ("1.2 B", 2), ("2 Two", 1), ("2.1 C", 2)])], "book_id string, idx int, title string, depth int")
    assert {r.title: r.label for r in contents.number_bookmarks(o).collect()} == {"Part": None, "1 One": "1", "1.1 A": "1.1", "1.2 B": "1.2", "2 Two": "2", "2.1 C": "2.1"}


# -- census


def test_census(spark):
    good = [("b", "dot", n, n // 8, n, 0.1, False) for n in range(1, 21) if n != 9]
    years = [("b", "bare", 1990 + n, n, 50, 0.1, False) for n in range(8)]
    d = spark.createDataFrame(good + years + [("b", "paren", 3, 0, 1, 0.1, False)], "book_id string, family string, n int, page int, ord int, left double, covered boolean")
    got = rows(census.verdicts(census.census(d)), "family", "first_n", "last_n", "n_items", "missing", "verdict")
    assert got == [("bare", 1990, 1997, 8, 0, "years"), ("dot", 1, 20, 19, 1, "run")]
    assert {r.code for r in census.uncovered(census.census(d)).collect()} == {"numbered-run-uncovered"}
    assert rows(census.census(d)) == rows(census.census(d.orderBy(F.rand(1))))
    c = [{"n": n, "suffix": "", "page": 0, "top": n / 50, "left": 0.1} for n in (1, 2, 3, 4, 20)] + [{"n": 2, "suffix": "", "page": 5, "top": 0.5, "left": 0.15}]
    assert [r["n"] for r in census.select_sequence(c)] == [1, 2, 3, 4]
    assert census.kept_dividers([0.5, 0.1, 0.105, 0.2]) == [0.1, 0.2, 0.5]


# -- validation and verification


def frame(i, page=0, rect=(0.1, 0.1, 0.5, 0.2), kind="exercise", unit=None, context=None, solution=None, authority=None, label=None, section=None):
    return ("b", i, kind, page, rect, unit, None, context, solution, authority, label, section)


def test_validation(spark):
    frames = spark.createDataFrame(
        [
            frame("ok", authority="book", label="1", section="s1", rect=(0.1, 0.7, 0.5, 0.8)), frame("bad id"), frame("far", page=9), frame("flat", rect=(0.1, 0.1, 0.5, 0.105)), frame("upside", rect=(0.5, 0.1, 0.1, 0.2)), frame("q", kind="question", context=[(0, (0.1, 0.3, 0.5, 0.4))], rect=(0.1, 0.9, 0.5, 0.95)),
            frame("nolabel", authority="book", section="s1"), frame("twin", authority="book", label="1.", section="s1", rect=(0.6, 0.1, 0.9, 0.2)), frame("lost", authority="book", label="7", section="s9", rect=(0.6, 0.3, 0.9, 0.4)), frame("part", unit="u1", rect=(0.6, 0.5, 0.9, 0.6)),
        ],
        schemas.FRAMES,
    )
    outline = spark.createDataFrame([("b", 0, "One", 0, 0, "s1", None, None), ("b", 1, " ", 7, 3, "s1", None, None)], schemas.OUTLINE)
    books = spark.createDataFrame([("b", 2)], "book_id string, page_count int")
    got = set(rows(validation.validate(frames, outline, books), "ref", "code"))
    for want in [("bad id", "bad-id"), ("far", "page-out-of-range"), ("flat", "rect-too-small"), ("upside", "rect-inverted"), ("q", "context-not-exercise"), ("nolabel", "label-missing"), ("twin", "label-style"), ("ok", "duplicate-exercise"), ("twin", "duplicate-exercise"), ("lost", "section-unknown"), ("u1", "unit-single"), ("1", "bad-title"), ("1", "bad-page"), ("1", "depth-clamped"), ("0", "duplicate-id")]:
        assert want in got, want
    assert not {c for r, c in got if r == "ok"} - {"duplicate-exercise"}


def verified(spark, lines, frames, zones):
    regions = spark.createDataFrame([("b", p, i, None, "item", 0, r) for i, p, r, _ in frames], f"book_id string, page int, id string, unit string, role string, ord int, rect {RECT}")
    items = spark.createDataFrame([("b", i, "s1", label, p, r[0], r[1], True) for i, p, r, label in frames], "book_id string, id string, section string, label string, page int, left double, top double, has_answer boolean")
    texts = verify.region_texts(lines, regions)
    parts = [verify.check_text(texts, items), verify.check_places(regions), verify.check_coverage(lines, regions, zones), verify.check_inside(texts, items), verify.check_sequences(items, spark.createDataFrame([("b", "s1", 0, 5)], "book_id string, label string, page int, end_page int"))]
    return {(r.code, r.ref) for p in parts for r in p.collect()}


def test_seeded_defects_are_named(spark):
    flat = book_lines(spark).filter("page = 0")
    lines = flat.withColumn("rect", F.struct("left", "top", "right", "bottom")).withColumn("header_footer", F.col("line_idx") == 0)
    clean = [(f"f{n}", 0, (0.08, 0.098 + 0.05 * (n + 1), 0.82, 0.122 + 0.05 * (n + 1)), str(n)) for n in range(1, 11)]
    zones = spark.createDataFrame([("b", "s1", 0, 0.19, 0.72)], "book_id string, section string, page int, top double, bottom double")
    assert verified(spark, lines, clean, zones) == set()
    gone = [f for f in clean if f[0] != "f4"]
    assert verified(spark, lines, gone, zones) >= {("gap", "s1:4"), ("numbered-text-left-behind", "s1:4. What is 4 and what i…")}
    wrong = [f if f[0] != "f4" else (*f[:3], "14") for f in clean]
    assert ("label-not-first", "s1:14") in verified(spark, lines, wrong, zones)
    twice = [*clean, ("f99", 0, clean[2][2], "3")]
    assert verified(spark, lines, twice, zones) >= {("duplicate", "s1:3"), ("duplicate-region", "f3")}
    tall = [f if f[0] != "f4" else (f[0], 0, (0.08, f[2][1], 0.82, f[2][3] + 0.05), "4") for f in clean]
    assert verified(spark, lines, tall, zones) >= {("region-holds-item", "s1:4"), ("overlap", "f4")}


def test_context_key_and_strays(spark):
    items = spark.createDataFrame([("b", f"f{n}", "s1", str(n), 0, 0.1 * n) for n in range(1, 5)], "book_id string, id string, section string, label string, page int, top double")
    text = "In Exercises 2-3, find x."
    contexts = spark.createDataFrame([("b", "s1", "f1", text, True), ("b", "s1", "f2", text, True)], "book_id string, section string, item_id string, text string, attached boolean")
    assert rows(verify.check_context(contexts, items), "code", "ref") == [("context-missing", "s1:3"), ("context-range", "s1:1")]
    keyed = items.withColumn("context_key", F.when(F.col("id") != "f2", "c"))
    assert rows(verify.check_neighbour_contexts(keyed), "code", "ref") == [("context-inconsistent", "s1:2")]
    answers = spark.createDataFrame([("b", "s1", "1", 9, 0.1), ("b", "s2", "1", 9, 0.2), ("b", "s1", "3", 9, 0.3), ("b", "s1", "2", 9, 0.4)], "book_id string, section string, label string, page int, top double")
    markers = spark.createDataFrame([("b", 9, 0.0, "s1")], "book_id string, page int, top double, section string")
    assert rows(verify.check_key(answers, markers), "code", "ref") == [("solution-order", "s1:2"), ("solution-section-mismatch", "s2:1")]
    f = spark.createDataFrame([frame("a", authority="book", label="1", section="s"), frame("z")], schemas.FRAMES)
    assert rows(verify.check_strays(f), "ref") == [("z",)]
    lines = spark.createDataFrame([("b", "s1", "1-3. see there", 9, 0.1), ("b", "s1", "2. forty", 9, 0.2)], "book_id string, section string, text string, page int, top double")
    assert rows(propose.answer_ranges(lines), "n", "by_range") == [(1, True), (2, False), (3, True)]


# -- gate


def test_judge(spark):
    found = spark.createDataFrame([("b", "s", "gap", "warning", "s1:3", 4, "m"), ("b", "s", "gap", "warning", "s1:7", 5, "m"), ("b", "s", "overlap", "error", "f1", 2, "m"), ("c", "s", "gap", "warning", "x", 1, "m")], "book_id string, source string, code string, severity string, ref string, page int, message string")
    notes = [("b", 0, "gap", "s1:3", None, "printed so", None, True), ("b", 1, "gap", None, None, "both", 2, False), ("b", 2, "gap", "s1", None, "rest", 1, False), ("b", 3, "overlap", None, None, " ", None, True)]
    n = spark.createDataFrame(notes, "book_id string, note_idx int, code string, ref string, page int, reason string, count int, confirmed boolean")
    got = {(r.book_id, r.kind, r.code, r.ref, r.ord if r.kind == "note" else None): r.state for r in gate.judge(found, n).collect()}
    assert got[("b", "finding", "gap", "s1:3", None)] == "acknowledged" and got[("b", "finding", "gap", "s1:7", None)] == "unconfirmed"
    assert got[("b", "finding", "overlap", "f1", None)] == "open" and got[("c", "finding", "gap", "x", None)] == "open"
    assert [got[("b", "note", notes[i][2], notes[i][3], i)] for i in range(4)] == ["used", "stale", "used", "refused"]
    proofs = spark.createDataFrame([("b", True, True, True), ("d", True, True, True), ("e", True, False, True)], "book_id string, visual boolean, survey boolean, ink boolean")
    assert rows(gate.gate(gate.judge(found, n), proofs)) == [("b", 1, 1, 1, False), ("d", 0, 0, 0, True), ("e", 0, 0, 0, False)]


def test_survey_and_visual(spark):
    ranges = spark.createDataFrame([("b", 0, 1, "exercises"), ("b", 1, 2, "text"), ("b", 4, 9, "answers")], "book_id string, from int, to int, kind string")
    frames = spark.createDataFrame([("b", 0, "item"), ("b", 2, "item")], "book_id string, page int, role string")
    books = spark.createDataFrame([("b", 5)], "book_id string, page_count int")
    assert rows(gate.survey(ranges, frames, books), "page", "code") == [(1, "survey-overlap"), (2, "survey-unmarked"), (3, "survey-missing"), (4, "survey-missing"), (4, "survey-range")]
    entries = spark.createDataFrame([("b", 0, "1", "What is it", True, None, True, None), ("b", 1, "2", "Wrong words", False, None, True, None), ("b", 2, "9", "x", False, None, True, None)], schemas.VISUAL)
    items = spark.createDataFrame([("b", "1", "1. What is it for?", True, None), ("b", "2", "2. Why?", True, None), ("b", "3", "3.", False, None)], "book_id string, ref string, text string, has_context boolean, answer_text string")
    assert rows(gate.visual(entries, items), "ref", "code") == [("2", "visual-instruction"), ("2", "visual-words"), ("3", "visual-missing"), ("9", "visual-unknown")]


def test_review_sample():
    items = [{"id": i, "layout": i % 3, "chapter": i // 50, "section": i // 10} for i in range(100)]
    got = gate.review_sample(items, 20)
    assert len(got) == 20 and [i for i, _ in got[:3]] == [0, 1, 2] and "chapter 0: first" in dict(got)[0] and 49 in dict(got)
    assert gate.review_sample(items, 20) == got and len(gate.review_sample(items[:5], 20)) == 5
    answers = [x | {"answer_at": (9, i) if i % 2 == 0 else None, "answer_lines": 0 if i == 8 else 7 if i == 42 else 1} for i, x in enumerate(items)]
    why = dict(gate.answer_sample(answers, got, 12))
    assert len(why) == 12 and "most lines" in why[42] and "a picture alone" in why[8] and "first of a chapter's key" in why[50] and not any(i % 2 for i in why)


def test_parts(spark):
    texts = ["Solve:", "(a) one", "(b) two", "(i) inner", "(c) three"]
    d = spark.createDataFrame([("b", "x", 0, i, t) for i, t in enumerate(texts)] + [("b", "y", 0, 0, "(a) alone")], "book_id string, item string, page int, line_idx int, text string")
    assert rows(propose.parts(d), "item", "style", "first_ordinal", "length") == [("x", "letter", 1, 2)]


# -- operations


def test_operations():
    add = {"op": "add", "page": 0, "rect": {"left": 0.1, "top": 0.1, "right": 0.9, "bottom": 0.4}}
    book, n, error = operations.replay([], [{"title": "S", "page": 0, "depth": 0, "id": "s1"}], [add | {"as": "x"}, {"op": "split", "id": "@x", "at": 0.2}, {"op": "dividers", "id": "@x", "at": [0.2, 0.3]}, {"op": "move", "id": "@x", "dy": 0.9}])
    assert error is None and n == 4
    parts = sorted((f["rect"]["top"], f["rect"]["bottom"]) for f in book.frames.values())
    assert [x for p in parts for x in p] == pytest.approx([0.7, 0.8, 0.8, 0.9, 0.9, 1.0]) and len({f["unit"] for f in book.frames.values()}) == 1
    mark = [add | {"id": "a"}, {"op": "authority.mark", "id": "a", "label": "1", "section": "s1"}, {"op": "solution.add", "section": "s1", "label": "1", "page": 1, "rect": add["rect"]}]
    book, _, error = operations.replay([], [{"title": "S", "page": 0, "depth": 0, "id": "s1"}], mark + [{"op": "outline.update", "section": "s1", "id": "s2"}])
    assert error is None and book.frames["a"]["section"] == "s2" and len(book.frames["a"]["solution"]) == 1
    same = add | {"authority": "book", "label": "1", "section": "s1"}
    assert operations.replay([], [], [same, same])[2] and operations.replay([], [], [same, same | {"replace": True}])[2] is None
    for bad in ({"op": "nothing"}, {"op": "delete", "id": "zz"}, {"op": "split", "id": "a", "at": 0.1001}, {"op": "outline.delete", "section": "s1"}, add | {"rect": {"left": -0.2, "top": 0, "right": 1, "bottom": 1}}):
        state, _, error = operations.replay([], [{"title": "S", "page": 0, "depth": 0, "id": "s1"}], mark + [bad])
        assert state is None and error, bad


def test_operations_by_book(spark):
    state = spark.createDataFrame([(b, "[]", "[]", 0, "{}") for b in "ab"], "book_id string, frames string, outline string, seq long, meta string")
    add = {"op": "add", "page": 0, "rect": {"left": 0.1, "top": 0.1, "right": 0.9, "bottom": 0.4}}
    ops = spark.createDataFrame([("a", 1, json.dumps(add)), ("a", 2, json.dumps({"op": "delete", "id": "f1"})), ("a", 3, json.dumps(add)), ("b", 1, json.dumps(add)), ("b", 2, json.dumps({"op": "delete", "id": "f9"}))], schemas.OPERATIONS)
    got = {r.book_id: r for r in operations.replay_all(state, ops).collect()}
    assert got["a"].ok and [f["id"] for f in json.loads(got["a"].frames)] == ["f2"] and got["a"].seq == 2
    assert not got["b"].ok and got["b"].applied == 1 and json.loads(got["b"].frames) == []


def test_runs_with_scattered_gaps_are_cut_and_kept():
    cut = lambda ns, least: [[x["n"] for x in p] for p, _ in census.segments([{"n": n} for n in ns], least)]
    assert cut([1, 2, 4, 5, 7], 3) == [[1, 2, 4, 5]] and cut([1, 2, 4, 5, 7, 8, 9], 3) == [[1, 2, 4, 5], [7, 8, 9]]
    assert cut([1, 2, 2, 3], 3) == [[1, 2, 3]]


def test_partly_covered_runs_are_uncovered(spark):
    rows = [("b", "dot", i, 1, 10, 10, 1, 0, 1, 2, c) for i, c in enumerate((0.0, 0.5, 0.79, 0.8, 1.0))]
    assert sorted(r.run_id for r in census.uncovered(spark.createDataFrame(rows, census.RUNS)).collect()) == [0, 1, 2]
