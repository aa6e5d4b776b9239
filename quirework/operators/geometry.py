"""Joins of intervals and rectangles. Every join has an equality: a page, and a band of the page where pages are dense."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirework import constants as C
from quirework.functions import rects


def banded(rows: DataFrame, low: Column, high: Column, height: float, name: str = "_band") -> DataFrame:
    """rows once for each band of that height that they reach into."""
    return rows.withColumn(name, F.explode(F.sequence(F.floor(low / height), F.floor(high / height))))


def overlaps(a: DataFrame, b: DataFrame, key: Sequence[str], low: str, high: str, band: float) -> DataFrame:
    """Pairs of rows of a and b (columns a_* and b_*) whose intervals [low, high] overlap by more than nothing, each once.

    Rows meet in a band they both reach into; a pair is told in the band where its overlap begins, so nothing is sorted out later.
    """
    x = banded(a, F.col(low), F.col(high), band).select(*[F.col(c).alias(f"a_{c}") for c in a.columns], F.col("_band").alias("_a"))
    y = banded(b, F.col(low), F.col(high), band).select(*[F.col(c).alias(f"b_{c}") for c in b.columns], F.col("_band").alias("_b"))
    on = F.col("_a") == F.col("_b")
    for k in key:
        on = on & (F.col(f"a_{k}") == F.col(f"b_{k}"))
    start = F.greatest(F.col(f"a_{low}"), F.col(f"b_{low}"))
    j = x.join(y, on & (start < F.least(F.col(f"a_{high}"), F.col(f"b_{high}"))))
    return j.filter(F.floor(start / band) == F.col("_a")).drop("_a", "_b")


def overlapping_regions(regions: DataFrame, key: Sequence[str], ident: str, unit: str, rect: str, share: float = C.SHARED_SHARE, least_height: float = C.SHARED_HEIGHT, band: float = 0.125) -> DataFrame:
    """(key, a, b, share, code): pairs of regions of a page that share a place: duplicate-region or overlap; parts of one unit don't.

    Of several hits of a pair the strongest is told.
    """
    flat = regions.select(*key, F.col(ident).alias("id"), F.col(unit).alias("unit"), F.col(rect).alias("r"), F.col(rect)["top"].alias("lo"), F.col(rect)["bottom"].alias("hi"))
    j = overlaps(flat, flat, [*key], "lo", "hi", band).filter((F.col("a_id") < F.col("b_id")) & ~(F.coalesce(F.col("a_unit") == F.col("b_unit"), F.lit(False))))
    common = rects.intersection(F.col("a_r"), F.col("b_r"))
    j = j.withColumn("share", rects.shared(F.col("a_r"), F.col("b_r"))).withColumn("_h", F.coalesce(common["bottom"] - common["top"], F.lit(0.0)))
    same = rects.equal(F.col("a_r"), F.col("b_r"), C.SAME_PLACE)
    code = F.when(same, "duplicate-region").when((F.col("share") > share) & (F.col("_h") >= least_height), "overlap")
    d = j.withColumn("code", code).filter("code IS NOT NULL")
    w = Window.partitionBy(*[f"a_{k}" for k in key], "a_id", "b_id").orderBy(F.col("share").desc())
    return d.withColumn("_r", F.row_number().over(w)).filter("_r = 1").select(*[F.col(f"a_{k}").alias(k) for k in key], F.col("a_id").alias("a"), F.col("b_id").alias("b"), "share", "code")


def contained(regions: DataFrame, key: Sequence[str], ident: str, rect: str, tolerance: float = C.TOUCH, band: float = 0.125) -> DataFrame:
    """(key, inner, outer): regions that lie in another of their page."""
    flat = regions.select(*key, F.col(ident).alias("id"), F.col(rect).alias("r"), F.col(rect)["top"].alias("lo"), F.col(rect)["bottom"].alias("hi"))
    j = overlaps(flat, flat, key, "lo", "hi", band).filter(F.col("a_id") != F.col("b_id")).filter(rects.contains(F.col("b_r"), F.col("a_r"), tolerance))
    return j.select(*[F.col(f"a_{k}").alias(k) for k in key], F.col("a_id").alias("inner"), F.col("b_id").alias("outer")).distinct()


def lines_in_regions(lines: DataFrame, regions: DataFrame, key: Sequence[str], rect: str = "rect", band: float = 0.125) -> DataFrame:
    """Lines and the regions of their page that hold their middle and half of their height (columns l_*, r_*)."""
    l = lines.withColumn("lo", F.col(rect)["top"]).withColumn("hi", F.col(rect)["bottom"])  # noqa: E741
    r = regions.withColumn("lo", F.col(rect)["top"]).withColumn("hi", F.col(rect)["bottom"])
    j = overlaps(l, r, key, "lo", "hi", band)
    a, b = F.col(f"a_{rect}"), F.col(f"b_{rect}")
    x, inside = (a["left"] + a["right"]) / 2, F.least(a["bottom"], b["bottom"]) - F.greatest(a["top"], b["top"])
    hit = (x >= b["left"]) & (x <= b["right"]) & (inside * 2 >= rects.height(a))
    names = [c for c in j.columns if c not in ("a_lo", "a_hi", "b_lo", "b_hi")]
    return j.filter(hit).select(*[F.col(c).alias(("l_" if c[0] == "a" else "r_") + c[2:]) for c in names])


def cut_lines(lines: DataFrame, regions: DataFrame, key: Sequence[str], rect: str = "rect", band: float = 0.125) -> DataFrame:
    """Edges of regions that run through a line, between a fifth and four fifths of its height, with the nearer line edge."""
    l = lines.withColumn("lo", F.col(rect)["top"]).withColumn("hi", F.col(rect)["bottom"])  # noqa: E741
    edges = regions.select(*regions.columns, F.explode(F.array(F.struct(F.lit("top").alias("side"), F.col(rect)["top"].alias("at")), F.struct(F.lit("bottom").alias("side"), F.col(rect)["bottom"].alias("at")))).alias("_e"))
    e = edges.select(*regions.columns, F.col("_e.side").alias("side"), F.col("_e.at").alias("at"), (F.col("_e.at") - 1e-9).alias("lo"), (F.col("_e.at") + 1e-9).alias("hi"))
    j = overlaps(l, e, key, "lo", "hi", band)
    a, b = F.col(f"a_{rect}"), F.col(f"b_{rect}")
    part = (F.col("b_at") - a["top"]) / rects.height(a)
    across = (a["left"] < b["right"]) & (a["right"] > b["left"])
    return j.filter(across & (part > 0.2) & (part < 0.8)).withColumn("suggested", F.when(part < 0.5, a["top"]).otherwise(a["bottom"])).drop("a_lo", "a_hi", "b_lo", "b_hi")


def covered_length(intervals: DataFrame, key: Sequence[str], low: str, high: str) -> DataFrame:
    """(key, covered, span): length of the union of a key's intervals, and from its least to its greatest end. Islands by a running maximum."""
    w = Window.partitionBy(*key).orderBy(low, high)
    d = intervals.filter(F.col(high) >= F.col(low)).withColumn("_reach", F.max(high).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    new = F.when(F.col("_reach").isNull() | (F.col(low) > F.col("_reach")), F.col(high) - F.col(low)).otherwise(F.greatest(F.col(high) - F.col("_reach"), F.lit(0)))
    return d.withColumn("_new", new).groupBy(*key).agg(F.sum("_new").alias("covered"), (F.max(high) - F.min(low)).alias("span"))


def covered_share(boxes: DataFrame, regions: DataFrame, key: Sequence[str], ident: str, rect: str = "rect", band: float = 0.125) -> DataFrame:
    """(key, id, share): the part of each box inside the union of its page's regions.

    The sides of the regions that meet a box cut it into cells; a cell counts if a region holds its middle. A box meets few
    regions, whose cut points are gathered with it alone.
    """
    x = boxes.select(*key, F.col(ident).alias("id"), F.col(rect).alias("r"), F.col(rect)["top"].alias("lo"), F.col(rect)["bottom"].alias("hi"))
    y = regions.select(*key, F.col(rect).alias("r"), F.col(rect)["top"].alias("lo"), F.col(rect)["bottom"].alias("hi"))
    part = rects.intersection(F.col("a_r"), F.col("b_r"))
    j = overlaps(x, y, key, "lo", "hi", band).withColumn("_p", part).filter("_p IS NOT NULL")
    g = j.groupBy(*[F.col(f"a_{k}").alias(k) for k in key], F.col("a_id").alias("id")).agg(F.first("a_r").alias("r"), F.collect_set("_p").alias("ps"))
    cuts = lambda a, b: F.array_sort(F.array_distinct(F.flatten(F.transform(F.col("ps"), lambda p: F.array(p[a], p[b])))))
    steps = lambda c: F.transform(F.sequence(F.lit(1), F.size(c) - 1), lambda i: F.struct(F.get(c, i - 1).alias("a"), F.get(c, i).alias("b")))
    xs, ys = steps(cuts("left", "right")), steps(cuts("top", "bottom"))
    cells = F.flatten(F.transform(xs, lambda h: F.transform(ys, lambda v: F.when(F.exists(F.col("ps"), lambda p: (p["left"] <= h["a"]) & (p["right"] >= h["b"]) & (p["top"] <= v["a"]) & (p["bottom"] >= v["b"])), (h["b"] - h["a"]) * (v["b"] - v["a"])).otherwise(F.lit(0.0)))))
    share = F.aggregate(cells, F.lit(0.0), lambda s, c: s + c) / rects.area(F.col("r"))
    hit = g.select(*key, "id", share.alias("share"))
    return boxes.select(*key, F.col(ident).alias("id")).join(hit, [*key, "id"], "left").withColumn("share", F.coalesce("share", F.lit(0.0)))


def same_place(a: DataFrame, b: DataFrame, key: Sequence[str], rect: str = "rect", tolerance: float = C.TOUCH) -> DataFrame:
    """Pairs of rows of a and b (a_*, b_*) at one place within tolerance: equal buckets of the top edge or neighbouring ones."""
    x = a.select(*[F.col(c).alias(f"a_{c}") for c in a.columns], F.floor(F.col(rect)["top"] / tolerance).alias("_a"))
    y = b.select(*[F.col(c).alias(f"b_{c}") for c in b.columns], F.explode(F.transform(F.array(*[F.lit(d) for d in (-1, 0, 1)]), lambda d: F.floor(F.col(rect)["top"] / tolerance) + d)).alias("_b"))
    on = (F.col("_a") == F.col("_b")) & rects.equal(F.col(f"a_{rect}"), F.col(f"b_{rect}"), tolerance)
    for k in key:
        on = on & (F.col(f"a_{k}") == F.col(f"b_{k}"))
    return x.join(y, on).drop("_a", "_b")


def range_check(ranges: DataFrame, present: DataFrame, low: str, high: str, position: str) -> DataFrame:
    """(position, n_ranges, n_present, code): positions that no range names, that several do, or that have nothing though named."""
    named = ranges.select(F.explode(F.sequence(F.col(low), F.col(high))).alias("position")).groupBy("position").agg(F.count(F.lit(1)).alias("n_ranges"))
    there = present.groupBy(F.col(position).alias("_p")).agg(F.count(F.lit(1)).alias("n_present"))
    j = named.join(there, F.col("position") == F.col("_p"), "full_outer").select(F.coalesce("position", "_p").alias("position"), F.coalesce("n_ranges", F.lit(0)).alias("n_ranges"), F.coalesce("n_present", F.lit(0)).alias("n_present"))
    code = F.when(F.col("n_ranges") == 0, "survey-missing").when(F.col("n_ranges") > 1, "survey-overlap").when(F.col("n_present") == 0, "survey-uncovered")
    return j.withColumn("code", code).filter("code IS NOT NULL")


def region_order(regions: DataFrame, key: Sequence[str], ord_: str) -> DataFrame:
    """continuation-order: regions that don't come after the one before them, by page, column and top."""
    w = Window.partitionBy(*key).orderBy(ord_)
    at = F.struct("page", F.floor(F.col("rect")["left"] * 2).alias("column"), F.col("rect")["top"].alias("top"))
    d = regions.withColumn("_at", at).withColumn("_prev", F.lag("_at").over(w))
    return d.filter(F.col("_prev").isNotNull() & (F.col("_at") <= F.col("_prev"))).drop("_at", "_prev").withColumn("code", F.lit("continuation-order"))


def size_faults(regions: DataFrame) -> DataFrame:
    """region-size of regions(book_id, page, id, unit, ord, rect): those that are no single item's by their measure.

    An item's first region may be C.TALLEST of the page high unless the item is alone on it, any region has to be as wide as
    C.NARROWEST and as large as C.SMALLEST; parts of a unit aren't measured.
    """
    r = F.col("rect")
    first = F.col("ord") == F.min("ord").over(Window.partitionBy("book_id", "id"))
    pages = regions.groupBy(F.col("book_id").alias("_b"), F.col("page").alias("_p")).agg((F.min("id") != F.max("id")).alias("_shared"))
    d = regions.withColumn("_first", first).join(pages, F.col("book_id").eqNullSafe(F.col("_b")) & F.col("page").eqNullSafe(F.col("_p"))).filter("unit IS NULL")
    high = F.col("_first") & F.col("_shared") & (rects.height(r) > C.TALLEST)
    return d.filter(high | (rects.width(r) < C.NARROWEST) | (rects.area(r) < C.SMALLEST)).withColumn("code", F.lit("region-size")).drop("_first", "_shared", "_b", "_p")
