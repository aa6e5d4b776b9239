"""Audits of numbered sequences: duplicates, gaps, outliers, order, coverage, islands and compact ranges."""

from __future__ import annotations

import itertools
from bisect import bisect_right
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quirework import constants as C
from quirework.functions.grouped import append_by_runs
from quirework.session import cut


def duplicates(rows: DataFrame, section: str, n: str) -> DataFrame:
    """(section, n, n_rows): numbers that a section has more than once."""
    return rows.filter(F.col(n).isNotNull()).groupBy(section, n).agg(F.count(F.lit(1)).alias("n_rows")).filter("n_rows > 1")


def gaps(rows: DataFrame, section: str, n: str) -> DataFrame:
    """(section, gap_from, gap_to, n_missing): each run of whole numbers missing between a section's least and greatest."""
    w = Window.partitionBy(section).orderBy(n)
    d = rows.filter(F.col(n).isNotNull()).select(section, n).distinct().withColumn("_next", F.lead(n).over(w))
    return d.filter(F.col("_next") - F.col(n) > 1).select(section, (F.col(n) + 1).cast("long").alias("gap_from"), (F.col("_next") - 1).cast("long").alias("gap_to"), (F.col("_next") - F.col(n) - 1).cast("long").alias("n_missing"))


def missing_numbers(gap_rows: DataFrame, section: str, most: int = C.LONG_GAP) -> DataFrame:
    """A row for each missing number; a gap longer than `most` stays a summary of one row without number."""
    each = F.when(F.col("n_missing") <= most, F.sequence("gap_from", "gap_to")).otherwise(F.array(F.lit(None).cast("long")))
    return gap_rows.select(section, "gap_from", "gap_to", "n_missing", F.explode(each).alias("missing"))


def outliers(rows: DataFrame, section: str, n: str, factor: float = C.OUTLIER_FACTOR) -> DataFrame:
    """Rows whose number is greater than factor times the median of their section, with the median."""
    mid = rows.groupBy(F.col(section).alias("_s")).agg(F.median(n).alias("section_median"))
    return rows.join(mid, F.col(section).eqNullSafe(F.col("_s"))).drop("_s").filter(F.col(n) > F.col("section_median") * factor)


def coverage(rows: DataFrame, section: str, answered: Column, percent: int = C.COVERAGE_PERCENT) -> DataFrame:
    """(section, n_items, n_answered, severity): info where no item has an answer, warning below percent, none otherwise."""
    got = F.count_if(answered)
    d = rows.groupBy(section).agg(F.count(F.lit(1)).alias("n_items"), got.alias("n_answered"))
    sev = F.when(F.col("n_answered") == 0, "info").when(F.col("n_answered") * 100 < F.col("n_items") * percent, "warning").otherwise("none")
    return d.withColumn("severity", sev)


def placement(rows: DataFrame, sections: DataFrame, section: str, page: str) -> DataFrame:
    """Rows whose page lies outside [start_page, end_page] of their section, or whose section is unknown (code)."""
    s = sections.select(F.col("section").alias("_s"), "start_page", "end_page")
    j = rows.join(s, F.col(section) == F.col("_s"), "left")
    code = F.when(F.col("_s").isNull(), "section-unknown").when((F.col(page) < F.col("start_page")) | (F.col(page) > F.col("end_page")), "section-page")
    return j.withColumn("code", code).filter("code IS NOT NULL").drop("_s")


def lag_islands(rows: DataFrame, key: Sequence[str], by: str, gap: float, tie: Sequence[str] = ()) -> DataFrame:
    """rows with island, from 0: a new one where `by` is more than gap above the one before (columns of a page, blocks of text)."""
    w = Window.partitionBy(*key).orderBy(by, *tie)
    opens = F.coalesce((F.col(by) - F.lag(by).over(w) > gap).cast("int"), F.lit(0))
    return rows.withColumn("_o", opens).withColumn("island", F.sum("_o").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("_o")


def anchored_clusters(rows: DataFrame, key: Sequence[str], by: str, tolerance: float) -> DataFrame:
    """(key, cluster, anchor, n): sorted values within tolerance of their cluster's first value, which a lag can't tell.

    A fold over the sorted distinct values of a key with their counts; equal values are counted before they are gathered.
    """
    counted = rows.filter(F.col(by).isNotNull()).groupBy(*key, F.col(by).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    listed = counted.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct(F.col("_v").alias("v"), F.col("_n").alias("n")))).alias("_l"))
    kind = "struct<done:array<struct<anchor:double,n:bigint>>,anchor:double,n:bigint>"
    none = F.array().cast("array<struct<anchor:double,n:bigint>>")

    def step(acc: Column, x: Column) -> Column:
        closed = F.concat(acc["done"], F.array(F.struct(acc["anchor"].alias("anchor"), acc["n"].alias("n"))))
        opened = F.struct(F.when(acc["n"] > 0, closed).otherwise(acc["done"]).alias("done"), x["v"].alias("anchor"), x["n"].alias("n"))
        # only a new cluster moves the list
        return F.when((acc["n"] == 0) | (x["v"] - acc["anchor"] > tolerance), opened).otherwise(F.struct(acc["done"].alias("done"), acc["anchor"].alias("anchor"), (acc["n"] + x["n"]).alias("n"))).cast(kind)

    start = F.struct(none.alias("done"), F.lit(None).cast("double").alias("anchor"), F.lit(0).cast("long").alias("n")).cast(kind)
    folded = listed.withColumn("_c", F.aggregate("_l", start, step, lambda acc: F.concat(acc["done"], F.array(F.struct(acc["anchor"].alias("anchor"), acc["n"].alias("n"))))))
    return folded.select(*key, F.posexplode("_c").alias("cluster", "_x")).select(*key, "cluster", F.col("_x.anchor").alias("anchor"), F.col("_x.n").alias("n"))


def compact_ranges(rows: DataFrame, key: Sequence[str], n: str) -> DataFrame:
    """(key, ranges): the different numbers of a key as '7, 12-14, 20'; a run of two is printed as two numbers."""
    d = rows.filter(F.col(n).isNotNull()).select(*key, F.col(n).cast("long").alias("_n")).distinct()
    d = d.withColumn("_g", F.col("_n") - F.row_number().over(Window.partitionBy(*key).orderBy("_n")))
    runs = d.groupBy(*key, "_g").agg(F.min("_n").alias("_a"), F.max("_n").alias("_b"))
    text = F.when(F.col("_a") == F.col("_b"), F.col("_a").cast("string")).when(F.col("_b") == F.col("_a") + 1, F.concat_ws(", ", "_a", "_b")).otherwise(F.concat_ws("-", "_a", "_b"))
    return runs.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(F.col("_a").alias("a"), text.alias("t")))).alias("_l")).select(*key, F.array_join("_l.t", ", ").alias("ranges"))


def longest_rising(values: Sequence[float]) -> list[int]:
    """Places of the longest non-decreasing subsequence; of equals the one whose places come first, read from its start."""
    n = len(values)
    best = [0] * n  # longest that starts here
    starts: list[float] = []  # of a rise of k + 1 the greatest start so far, negated, so that the list rises
    for i in range(n - 1, -1, -1):
        k = bisect_right(starts, -values[i])
        starts[k : k + 1] = [-values[i]]
        best[i] = k + 1
    out: list[int] = []
    need, low = len(starts), None
    for i in range(n):
        if need and best[i] == need and (low is None or values[i] >= low):
            out.append(i)
            low, need = values[i], need - 1
    return out


def out_of_order(rows: DataFrame, key: Sequence[str], order: Sequence[str], n: str) -> DataFrame:
    """rows with in_order: whether a row is on its group's longest non-decreasing subsequence of n. A group is a column of a section."""

    def run(b: pa.RecordBatch, at: list[int]) -> list[pa.Array]:
        values = b.column(n).to_numpy(zero_copy_only=False).tolist()
        out = np.zeros(len(values), bool)
        for i, j in itertools.pairwise(at):
            if j - i == 1:
                out[i] = True
            else:
                out[[i + k for k in longest_rising(values[i:j])]] = True
        return [pa.array(out)]

    return append_by_runs(rows, key, order, [T.StructField("in_order", T.BooleanType())], run)


def section_report(rows: DataFrame, section: str, n: str, answered: Column) -> DataFrame:
    """One row for each section: size, span, duplicates, missing numbers, outliers, answers and the worst severity. One shuffle."""
    d = rows.filter(F.col(n).isNotNull())
    g = d.groupBy(section).agg(
        F.count(F.lit(1)).alias("n_items"), F.count_distinct(F.col(n)).alias("n_numbers"), F.min(n).cast("long").alias("first_n"), F.max(n).cast("long").alias("last_n"), F.median(n).alias("median_n"), F.count_if(answered).alias("n_answered")
    )
    g = g.withColumn("n_duplicates", F.col("n_items") - F.col("n_numbers")).withColumn("n_missing", F.col("last_n") - F.col("first_n") + 1 - F.col("n_numbers"))
    g = g.withColumn("has_outlier", F.col("last_n") > F.col("median_n") * C.OUTLIER_FACTOR)
    sev = F.when(F.col("n_duplicates") > 0, "error").when((F.col("n_missing") > 0) | F.col("has_outlier") | ((F.col("n_answered") > 0) & (F.col("n_answered") * 100 < F.col("n_items") * C.COVERAGE_PERCENT)), "warning").otherwise("info")
    return g.withColumn("severity", sev)


def ranked(rows: DataFrame, key: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """rows with name, from 1: a row's place in order among those of its key, which have to differ in order.

    The rows are sorted by ranges and their places counted on from the ranges before, so that no task meets a key as a whole.
    The sort is written to the shared folder; what is counted is a row for each key of a range.
    """
    at = cut(rows.orderBy(*key, *order).withColumn("_at", F.monotonically_increasing_id())).withColumn("_part", F.shiftright("_at", 33))
    parts = at.groupBy(*key, "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_c"))
    before = F.coalesce(F.sum("_c").over(Window.partitionBy(*key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = parts.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(key)], F.col("_part").alias("_p"), "_first", before.alias("_before"))
    on = F.col("_part") == F.col("_p")
    for i, k in enumerate(key):
        on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    found = at.join(offsets, on).withColumn(name, F.col("_before") + F.col("_at") - F.col("_first") + 1)
    return found.select(*[F.col(f"`{c}`") for c in rows.columns], name)


def numbering(rows: DataFrame, kind: str, unit: Column, order: Sequence[str], letter: dict[str, str] | None = None) -> DataFrame:
    """rows with display, part, part_count: units of a kind are numbered by their first member, parts within a unit by order."""
    w = Window.partitionBy(kind, "_unit").orderBy(*order)
    d = rows.withColumn("_unit", unit).withColumn("part", F.row_number().over(w)).withColumn("part_count", F.count(F.lit(1)).over(Window.partitionBy(kind, "_unit")).cast("int"))
    firsts = ranked(d.filter("part = 1"), [kind], order, "number").withColumn("number", F.col("number").cast("int")).select(F.col(kind).alias("_k"), F.col("_unit").alias("_u"), "number")
    out = d.join(firsts, F.col(kind).eqNullSafe(F.col("_k")) & F.col("_unit").eqNullSafe(F.col("_u"))).drop("_k", "_u")
    head = F.upper(F.substring(F.col(kind), 1, 1)) if letter is None else F.create_map(*[F.lit(x) for kv in letter.items() for x in kv])[F.col(kind)]
    base = F.concat(head, F.col("number").cast("string"))
    return out.withColumn("display", F.when(F.col("part_count") > 1, F.concat(base, F.lit("."), F.col("part").cast("string"))).otherwise(base)).drop("_unit")


def tiling(parts: DataFrame, key: Sequence[str], top: str, bottom: str, tolerance: float = C.UNIT_TOLERANCE, tie: Sequence[str] = ()) -> DataFrame:
    """Faults between neighbours of a unit: unit-gap, unit-overlap beyond tolerance, unit-snapped within, with the snapped edge.

    A gap is given to the upper part; an overlap is split in the middle.
    """
    w = Window.partitionBy(*key).orderBy(top, bottom, *tie)
    d = parts.withColumn("_prev", F.lag(bottom).over(w)).filter(F.col("_prev").isNotNull()).withColumn("distance", F.col(top) - F.col("_prev"))
    code = F.when(F.col("distance") > tolerance, "unit-gap").when(F.col("distance") < -tolerance, "unit-overlap").when(F.col("distance") != 0, "unit-snapped")
    edge = F.when(F.col("distance") > 0, F.col(top)).otherwise((F.col(top) + F.col("_prev")) / 2)
    return d.withColumn("code", code).withColumn("edge", edge).filter("code IS NOT NULL").drop("_prev")


def clamp_depths(outline: DataFrame, key: Sequence[str], idx: str, depth: str) -> DataFrame:
    """(key, idx, depth, clamped): a depth is at most one more than the clamped depth before it; the first is 0 at most.

    Clamped one after another, the i-th of them (from 0) is i at most, and the least of depth + i - j over the rows j up to it.
    """
    w = Window.partitionBy(*key).orderBy(idx, depth)
    d = outline.select(*key, idx, F.col(depth).cast("int").alias(depth)).withColumn("_i", F.row_number().over(w) - 1)
    least = F.min(F.when(F.col(depth).isNotNull(), F.greatest(F.col(depth), F.lit(0)) - F.col("_i"))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return d.withColumn("clamped", F.least(F.col("_i"), F.col("_i") + least).cast("int")).drop("_i")


def even_stride(rows: DataFrame, key: Sequence[str], order: Sequence[str], count: int) -> DataFrame:
    """The rows at floor(k * m / count) of their group's m rows, k from 0, and the last; all where there are no more than count."""
    sizes = rows.groupBy(*[F.col(k).alias(f"_g{i}") for i, k in enumerate(key)]).agg(F.count(F.lit(1)).alias("_m"))
    same = F.lit(True)
    for i, k in enumerate(key):
        same = same & F.col(k).eqNullSafe(F.col(f"_g{i}"))
    d = ranked(rows, key, order, "_i").withColumn("_i", F.col("_i") - 1).join(sizes, same).drop(*[f"_g{i}" for i in range(len(key))])
    # i is taken if a whole k below count - 1 has floor(k * m / count) = i
    k = F.ceil(F.col("_i") * count / F.col("_m"))
    taken = (F.col("_m") <= count) | ((k < count - 1) & (F.floor(k * F.col("_m") / count) == F.col("_i"))) | (F.col("_i") == F.col("_m") - 1)
    return d.filter(taken).withColumn("place", F.col("_i").cast("long")).drop("_i", "_m")
