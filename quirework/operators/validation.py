"""Rules that frames, outlines and book records have to keep. Every rule is a filter that emits issues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirework import constants as C
from quirework.functions import labels, lines, rects

KINDS = ("exercise", "question", "bookmark")
ID = r"^[A-Za-z0-9_-]{1,40}$"
SECTION = r"^[A-Za-z0-9][A-Za-z0-9._-]{0,59}$"


def _issues(d: DataFrame, codes: list[Column], ident: str) -> DataFrame:
    return d.select("book_id", F.col(ident).cast("string").alias("ref"), F.explode(F.array_compact(F.array(*codes))).alias("code"))


def severity(code: Column) -> Column:
    return F.when(code.isin("rect-clamped", "depth-clamped", "unit-snapped", "label-style"), "repair").when(code.isin("thin-frame", "contained", "overlap", "clips-line", "unit-single", "info-cut", "context-overlaps-frame", "unit-context-differs"), "warning").otherwise("error")


def check_frames(frames: DataFrame, books: DataFrame) -> DataFrame:
    """(book_id, ref, code, severity) of frames(book_id, id, kind, page, rect, unit, continues, context, solution, authority, label, section)."""
    pages = books.select(F.col("book_id").alias("_b"), F.col("page_count").alias("_pages"))
    w = Window.partitionBy("book_id", "id")
    d = frames.withColumn("_same", F.count(F.lit(1)).over(w)).join(pages, F.col("book_id") == F.col("_b"), "left")
    is_ex = F.col("kind") == "exercise"
    authority = F.col("authority").isNotNull()
    n_regions = lambda c: F.when(F.col(c).isNull(), 0).otherwise(F.size(c))
    regions = F.flatten(F.array_compact(F.array(F.col("continues"), F.col("context"), F.col("solution"))))
    bad_page = lambda p: (p < 0) | (p >= F.col("_pages"))
    codes = [
        F.when(~F.coalesce(F.col("id").rlike(ID), F.lit(False)), "bad-id"),
        F.when((F.col("_same") > 1) & F.col("id").isNotNull(), "duplicate-id"),
        F.when(~F.coalesce(F.col("kind").isin(*KINDS), F.lit(False)), "bad-kind"),
        F.when(authority & ~F.col("authority").isin("book", "author"), "bad-authority"),
        F.when(F.col("unit").isNotNull() & ~F.col("unit").rlike(ID), "bad-unit"),
        F.when(F.col("unit").isNotNull() & ~is_ex, "unit-not-exercise"),
        F.when((n_regions("context") > 0) & ~is_ex, "context-not-exercise"),
        F.when(authority & ~is_ex, "authority-not-exercise"),
        F.when((n_regions("solution") > 0) & ~is_ex, "solution-not-exercise"),
        F.when(authority & F.col("unit").isNotNull(), "authority-unit"),
        F.when(authority, labels.problem(F.col("label"))),
        F.when(authority & F.col("section").isNull(), "section-missing"),
        F.when(F.col("section").isNotNull() & ~F.col("section").rlike(SECTION), "bad-section"),
        F.when(~authority & F.col("label").isNotNull(), "label-without-authority"),
        F.when(~authority & F.col("section").isNotNull(), "section-without-authority"),
        F.when(F.col("unit").isNotNull() & (n_regions("continues") > 0), "unit-continues"),
        F.when((n_regions("continues") > C.MAX_REGIONS) | (n_regions("context") > C.MAX_REGIONS) | (n_regions("solution") > C.MAX_ANSWERS), "too-many-regions"),
        F.when(F.col("page").isNull() | F.exists(regions, lambda r: r["page"].isNull()), "bad-page"),
        F.when(F.coalesce(bad_page(F.col("page")), F.lit(False)) | F.exists(regions, lambda r: F.coalesce(bad_page(r["page"]), F.lit(False))), "page-out-of-range"),
        rects.problem(F.col("rect")),
        F.when(F.exists(regions, lambda r: F.coalesce(rects.problem(r["rect"]) != "rect-clamped", F.lit(False))), "bad-region"),
    ]
    return _issues(d, codes, "id").withColumn("severity", severity(F.col("code")))


def check_units(frames: DataFrame, tolerance: float = C.UNIT_TOLERANCE) -> DataFrame:
    """unit-single, unit-edges, unit-gap, unit-overlap and unit-snapped of the parts of a unit on a page."""
    d = frames.filter("unit IS NOT NULL").select("book_id", "unit", "page", "id", "rect")
    single = d.groupBy("book_id", F.col("unit").alias("ref")).agg(F.count(F.lit(1)).alias("_n")).filter("_n = 1").select("book_id", "ref", F.lit("unit-single").alias("code"))
    w = Window.partitionBy("book_id", "unit", "page").orderBy(F.col("rect.top"), "id")
    p = d.withColumn("_prev", F.lag("rect").over(w)).filter("_prev IS NOT NULL")
    edges = (F.abs(F.col("rect.left") - F.col("_prev.left")) > tolerance) | (F.abs(F.col("rect.right") - F.col("_prev.right")) > tolerance)
    gap = F.col("rect.top") - F.col("_prev.bottom")
    tiles = F.when(gap > tolerance, "unit-gap").when(gap < -tolerance, "unit-overlap").when(gap != 0, "unit-snapped")
    return single.unionByName(_issues(p, [F.when(edges, "unit-edges"), tiles], "id")).withColumn("severity", severity(F.col("code")))


def check_book(frames: DataFrame, outline: DataFrame) -> DataFrame:
    """duplicate-exercise and section-unknown of the items that a book's authority names."""
    a = frames.filter("authority IS NOT NULL AND section IS NOT NULL AND label IS NOT NULL").withColumn("_label", labels.normalized(F.col("label")))
    again = a.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("book_id", "section", "_label"))).filter("_n > 1").select("book_id", F.col("id").alias("ref"), F.lit("duplicate-exercise").alias("code"))
    known = outline.filter("id IS NOT NULL").select("book_id", F.col("id").alias("section")).distinct()
    unknown = a.join(known, ["book_id", "section"], "left_anti").select("book_id", F.col("id").alias("ref"), F.lit("section-unknown").alias("code"))
    return again.unionByName(unknown).withColumn("severity", F.lit("error"))


def check_outline(outline: DataFrame, books: DataFrame) -> DataFrame:
    """(book_id, ref, code, severity) of outline(book_id, idx, title, page, depth, id, label, top)."""
    pages = books.select(F.col("book_id").alias("_b"), F.col("page_count").alias("_pages"))
    before = Window.partitionBy("book_id").orderBy("idx")
    d = outline.withColumn("_prev", F.lag("depth").over(before)).withColumn("_same", F.count("id").over(Window.partitionBy("book_id", "id"))).join(pages, F.col("book_id") == F.col("_b"), "left")
    codes = [
        F.when(F.coalesce(lines.clean_title(F.col("title")), F.lit("")) == "", "bad-title"),
        F.when(F.col("page").isNull() | (F.col("page") < 0) | (F.col("page") >= F.col("_pages")), "bad-page"),
        F.when(F.col("depth").isNull() | (F.col("depth") < 0), "bad-depth"),
        F.when(F.col("id").isNotNull() & ~F.col("id").rlike(SECTION), "bad-id"),
        F.when(F.col("id").isNotNull() & (F.col("_same") > 1), "duplicate-id"),
        F.when(F.col("label").isNotNull() & (F.length("label") > C.MAX_LABEL), "bad-label"),
        F.when(F.col("top").isNotNull() & ((F.col("top") < 0) | (F.col("top") > 1)), "bad-top"),
        F.when(F.col("depth") > F.coalesce("_prev", F.lit(-1)) + 1, "depth-clamped"),
    ]
    return _issues(d, codes, "idx").withColumn("severity", severity(F.col("code")))


def check_info(books: DataFrame, limits: dict[str, int]) -> DataFrame:
    """info-too-long and bad-url of books' text fields, and title-missing."""
    codes = [F.when(F.length(k) > n, F.lit(f"info-too-long:{k}")) for k, n in limits.items()]
    codes += [F.when(F.coalesce(F.trim("title"), F.lit("")) == "", "title-missing"), F.when(F.col("source_url").isNotNull() & ~lines.is_web_address(F.col("source_url")), "bad-url")]
    return _issues(books, codes, "book_id").withColumn("severity", severity(F.col("code")))


def lint(frames: DataFrame) -> DataFrame:
    """thin-frame, contained, overlap and context-overlaps-frame of the regions of a page."""
    from quirework.operators import geometry

    regions = frames.select("book_id", "page", "id", F.coalesce("unit", "id").alias("unit"), "rect")
    thin = regions.filter(rects.height(F.col("rect")) < 2 * C.LEAST_HEIGHT).select("book_id", F.col("id").alias("ref"), F.lit("thin-frame").alias("code"))
    over = geometry.overlapping_regions(regions, ["book_id", "page"], "id", "unit", "rect", C.LINT_SHARE).select("book_id", F.col("a").alias("ref"), F.lit("overlap").alias("code"))
    inside = geometry.contained(regions, ["book_id", "page"], "id", "rect").select("book_id", F.col("inner").alias("ref"), F.lit("contained").alias("code"))
    context = frames.filter("context IS NOT NULL").select("book_id", "id", F.explode("context").alias("c")).select("book_id", "id", "c.page", "c.rect")
    a = context.withColumn("lo", F.col("rect.top")).withColumn("hi", F.col("rect.bottom"))
    b = regions.select("book_id", "id", "page", "rect").withColumn("lo", F.col("rect.top")).withColumn("hi", F.col("rect.bottom"))
    hits = geometry.overlaps(a, b, ["book_id", "page"], "lo", "hi", 0.125).filter(rects.shared(F.col("a_rect"), F.col("b_rect")) >= C.LINT_SHARE)
    crossing = hits.select(F.col("a_book_id").alias("book_id"), F.col("a_id").alias("ref"), F.lit("context-overlaps-frame").alias("code")).distinct()
    return thin.unionByName(over).unionByName(inside).unionByName(crossing).withColumn("severity", F.lit("warning"))


def solution_is_exercise(frames: DataFrame) -> DataFrame:
    """(book_id, ref, code): answers that stand at the place of an item, by buckets of the top edge."""
    from quirework.operators import geometry

    answers = frames.filter("solution IS NOT NULL").select("book_id", "id", F.explode("solution").alias("s")).select("book_id", "id", "s.page", "s.rect")
    items = frames.select("book_id", "id", "page", "rect")
    return geometry.same_place(answers, items, ["book_id", "page"]).select(F.col("a_book_id").alias("book_id"), F.col("a_id").alias("ref"), F.lit("solution-is-exercise").alias("code")).distinct()


def validate(frames: DataFrame, outline: DataFrame, books: DataFrame) -> DataFrame:
    """All issues of frames, units, book, outline and places. Frames with an error stay out of the later checks."""
    first = check_frames(frames, books)
    broken = first.filter("severity = 'error'").select("book_id", F.col("ref").alias("id")).distinct()
    sound = frames.join(broken, ["book_id", "id"], "left_anti")
    parts = [first, check_units(sound), check_book(sound, outline), check_outline(outline, books), lint(sound), solution_is_exercise(sound).withColumn("severity", F.lit("warning"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p.select(*out.columns))
    return out
