"""Counts, modes, medians and repeated lines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirework import constants as C


def repeated_keys(lines: DataFrame, key: Column, page: str, least: int, group: Sequence[str] = ()) -> DataFrame:
    """(group, key, n_pages): keys on `least` different pages at least."""
    d = lines.select(*group, key.alias("key"), F.col(page).alias("_p")).filter("key <> ''").distinct()
    return d.groupBy(*group, "key").agg(F.count(F.lit(1)).alias("n_pages")).filter(F.col("n_pages") >= least)


def header_threshold(n_pages: Column) -> Column:
    """Pages of a sample of n that a key must be on: three tenths, two at least, three at most."""
    return F.least(F.lit(3), F.greatest(F.lit(2), F.ceil(n_pages * 0.3))).cast("int")


def sampled_pages(n_pages: Column, most: int = C.HEADER_SAMPLE) -> Column:
    """The pages, from 0, that header keys are computed from: evenly spread, the first and last among them."""
    k = F.least(n_pages, F.lit(most))
    return F.when(k <= 1, F.sequence(F.lit(0), n_pages - 1)).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(0), k - 1), lambda i: F.floor(i * (n_pages - 1) / (k - 1) + 0.5).cast("int"))))


def mark_running_lines(lines: DataFrame, keys: DataFrame, key: Column, group: Sequence[str]) -> DataFrame:
    """lines with header_footer: whether a line's key is among its group's repeated keys."""
    k = keys.select(*[F.col(g).alias(f"_{g}") for g in group], F.col("key").alias("_key")).distinct().withColumn("_hit", F.lit(True))
    on = key == F.col("_key")
    for g in group:
        on = on & F.col(g).eqNullSafe(F.col(f"_{g}"))
    return lines.join(k, on, "left").withColumn("header_footer", F.coalesce("_hit", F.lit(False))).drop("_hit", "_key", *[f"_{g}" for g in group])


def neighbour_repeats(lines: DataFrame, key: Sequence[str], text: Column, page: str, line: str, top: str, tolerance: float = 0.01, reach: int = 2) -> DataFrame:
    """lines with repeats: how many lines of equal blurred text stand at the same height on pages up to `reach` away.

    A line is known by its key, page and line. Pages within reach meet by equality: a line is listed under each page it may be seen from.
    """
    base = lines.withColumn("_t", text)
    own = base.select(*key, page, line, "_t", F.col(top).alias("_y"))
    near = base.select(*[F.col(k).alias(f"_{k}") for k in key], F.col("_t").alias("_t2"), F.col(page).alias("_p2"), F.col(top).alias("_y2"), F.explode(F.sequence(F.col(page) - reach, F.col(page) + reach)).alias("_seen"))
    on = (F.col("_t") == F.col("_t2")) & (F.col(page) == F.col("_seen")) & (F.col(page) != F.col("_p2")) & (F.abs(F.col("_y") - F.col("_y2")) <= tolerance)
    for k in key:
        on = on & (F.col(k) == F.col(f"_{k}"))
    hits = own.join(near, on).groupBy(*key, page, line).agg(F.count(F.lit(1)).alias("repeats"))
    return lines.join(hits, [*key, page, line], "left").withColumn("repeats", F.coalesce("repeats", F.lit(0)))


def weighted_mode(rows: DataFrame, key: Sequence[str], value: Column, weight: Column, order: Column) -> DataFrame:
    """(key, mode, weight): the value of most weight, of equals the one seen first by order."""
    g = rows.groupBy(*key, value.alias("mode")).agg(F.sum(weight).alias("weight"), F.min(order).alias("_first"))
    w = Window.partitionBy(*key).orderBy(F.col("weight").desc(), "_first")
    return g.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r", "_first")


def weighted_median(rows: DataFrame, key: Sequence[str], value: str, weight: Column) -> DataFrame:
    """(key, weighted_median): the least value at which the running weight reaches half of all."""
    g = rows.groupBy(*key, value).agg(F.sum(weight).alias("_w"))
    run = F.sum("_w").over(Window.partitionBy(*key).orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    d = g.withColumn("_run", run).withColumn("_all", F.sum("_w").over(Window.partitionBy(*key)))
    return d.filter(F.col("_run") * 2 >= F.col("_all")).groupBy(*key).agg(F.min(value).alias("weighted_median"))


def medians(rows: DataFrame, key: Sequence[str], value: str) -> DataFrame:
    """(key, median, upper_median): the mean of the middle two, and the upper one."""
    counted = rows.groupBy(*key, value).agg(F.count(value).alias("_c"))
    run = F.sum("_c").over(Window.partitionBy(*key).orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    d = counted.withColumn("_run", run).withColumn("_n", F.sum("_c").over(Window.partitionBy(*key)))
    at = lambda place: F.min(F.when(F.col("_run") >= place, F.col(value)))
    g = d.groupBy(*key).agg(at(F.ceil(F.col("_n") / 2)).alias("_lower"), at(F.floor(F.col("_n") / 2) + 1).alias("upper_median"))
    return g.select(*key, ((F.col("_lower") + F.col("upper_median")) / 2).cast("double").alias("median"), "upper_median")


def offset_mode(rows: DataFrame, key: Sequence[str], printed: Column, index: Column, least: int = 3, percent: int = 40) -> DataFrame:
    """(key, offset, n_votes, n_rows): the commonest difference of printed and counted numbers, ties to the smaller size, then to
    the lesser. Needs `least` votes and `percent` of all."""
    v = rows.select(*key, (printed - index).alias("offset")).filter("offset IS NOT NULL").groupBy(*key, "offset").agg(F.count(F.lit(1)).alias("n_votes"))
    w = Window.partitionBy(*key).orderBy(F.col("n_votes").desc(), F.abs("offset"), "offset")
    d = v.withColumn("_r", F.row_number().over(w)).withColumn("n_rows", F.sum("n_votes").over(Window.partitionBy(*key)))
    return d.filter((F.col("_r") == 1) & (F.col("n_votes") >= least) & (F.col("n_votes") * 100 >= F.col("n_rows") * percent)).drop("_r")


def grouped_messages(findings: DataFrame, message: str, section: str, least: int = 4, show: int = 12) -> DataFrame:
    """(message, n_sections, sections): messages that `least` sections share, with the first names."""
    g = findings.select(message, section).distinct().groupBy(message).agg(F.count(F.lit(1)).alias("n_sections"), F.slice(F.sort_array(F.collect_list(F.col(section).cast("string"))), 1, show).alias("_s"))
    return g.filter(F.col("n_sections") >= least).select(message, "n_sections", F.array_join("_s", ", ").alias("sections"))


def value_ranges(rows: DataFrame, key: Sequence[str], position: str, value: str) -> DataFrame:
    """(key, value, first, last): runs of neighbouring positions with one value, such as pages of one size."""
    w = Window.partitionBy(*key).orderBy(position)
    d = rows.withColumn("_new", (~F.col(value).eqNullSafe(F.lag(value).over(w))).cast("int")).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return d.groupBy(*key, value, "_run").agg(F.min(position).alias("first"), F.max(position).alias("last")).drop("_run")


def rising_runs(markers: DataFrame, key: Sequence[str], style: str, order: Sequence[str], ordinal: str, priority: dict[str, int]) -> DataFrame:
    """(key, style, first_ordinal, length): each key's best run of rising markers, by length, then priority, then place.

    A run rises by one from each marker of its style to the next.
    """
    w = Window.partitionBy(*key, style).orderBy(*order)
    d = markers.withColumn("_g", F.col(ordinal) - F.row_number().over(w)).withColumn("_at", F.row_number().over(Window.partitionBy(*key).orderBy(*order)))
    d = d.withColumn("_new", (F.col(ordinal) != F.lag(ordinal, 1, -(10**9)).over(w) + 1).cast("int")).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    r = d.groupBy(*key, style, "_run").agg(F.count(F.lit(1)).alias("length"), F.min(ordinal).alias("first_ordinal"), F.min("_at").alias("_at"))
    rank = F.create_map(*[F.lit(x) for kv in priority.items() for x in kv])
    best = Window.partitionBy(*key).orderBy(F.col("length").desc(), F.coalesce(F.element_at(rank, F.col(style)), F.lit(99)), "_at")
    return r.withColumn("_b", F.row_number().over(best)).filter("_b = 1").select(*key, style, "first_ordinal", "length")


def choose_title(candidates: DataFrame, key: Sequence[str], title: str, source: str) -> DataFrame:
    """(key, title): the contents' title wins unless it is a near misspelling of what most others say; then support, then text."""
    votes = candidates.groupBy(*key, title).agg(F.count(F.lit(1)).alias("n"), F.max((F.col(source) == "contents").cast("int")).alias("listed"))
    others = votes.groupBy(*key).agg(F.max_by(title, F.struct("n", title)).alias("_most"), F.max("n").alias("_n"))
    j = votes.join(others, list(key))
    near = (F.levenshtein(F.col(title), F.col("_most")) > 0) & (F.levenshtein(F.col(title), F.col("_most")) <= 2) & (F.col("_n") > F.col("n"))
    w = Window.partitionBy(*key).orderBy(((F.col("listed") == 1) & ~near).desc(), F.col("n").desc(), title)
    return j.withColumn("_r", F.row_number().over(w)).filter("_r = 1").select(*key, title)
