"""Lines of a section to their items."""

from quirework.operators import assign

SCHEMA = "book_id string, section string, page int, line_idx int, left double, top double, right double, bottom double, text string, start string, role string"


def make(rows):
    return [("b", "s", page, i, left, top, left + width, top + 0.015, text, start, role) for i, (page, left, top, width, text, start, role) in enumerate(rows)]


ROWS = [
    (0, 0.1, 0.05, 0.7, "In Exercises 1-2, find x.", None, "instruction"),
    (0, 0.1, 0.10, 0.02, "1.", "1", "text"),
    (0, 0.13, 0.10, 0.3, "words of the first one that go on", None, "text"),
    (0, 0.13, 0.12, 0.3, "second line of the first", None, "text"),
    (0, 0.1, 0.16, 0.3, "2. words of the second item", "2", "text"),
    (0, 0.5, 0.10, 0.3, "3. right column item here", "3", "text"),
    (0, 0.52, 0.12, 0.3, "more of the third, going on", None, "text"),
    (1, 0.1, 0.05, 0.3, "the third goes on here on its page", None, "text"),
    (1, 0.1, 0.10, 0.3, "4. the fourth", "4", "text"),
    (1, 0.1, 0.60, 0.3, "far below, an orphan", None, "text"),
    (1, 0.1, 0.70, 0.3, "Summary", None, "heading"),
    (1, 0.1, 0.72, 0.3, "not an item's", None, "text"),
]


def test_owners(spark):
    d = spark.createDataFrame(make(ROWS), SCHEMA)
    got = {r.line_idx: (r.label, r.how) for r in assign.assign(d.repartition(3)).collect()}
    assert got == {0: (None, "instruction"), 1: ("1", "start"), 2: ("1", "row"), 3: ("1", "above"), 4: ("2", "start"), 5: ("3", "start"), 6: ("3", "above"), 7: ("3", "page"), 8: ("4", "start"), 9: (None, "orphan"), 10: (None, "heading"), 11: (None, "orphan")}


def test_regions_and_instructions(spark):
    d = spark.createDataFrame(make(ROWS), SCHEMA)
    got = {(r.label, r.ord): r for r in assign.regions(d, assign.assign(d)).collect()}
    assert set(got) == {("1", 0), ("2", 0), ("3", 0), ("3", 1), ("4", 0)}
    assert got["3", 1].page == 1 and got["1", 0].n_lines == 3 and abs(got["1", 0].top - 0.094) < 1e-9 and got["1", 0].bottom <= got["2", 0].top
    assert sorted((r.label, r.line_idx) for r in assign.instructions(d).collect()) == [("1", 0), ("2", 0)]
