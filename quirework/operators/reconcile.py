"""Comparisons of two tables: reference lists, merge plans, answers, snapshots and logs."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def compare(found: DataFrame, expected: DataFrame, label: str, count: str, title: str | None = None) -> DataFrame:
    """(label, found_count, expected_count, status): equal, count, missing or extra, and title where only that differs.

    Of rows that repeat a label on the left the one with more items stands for it.
    """
    top = Window.partitionBy(label).orderBy(F.col(count).desc(), *([F.col(title)] if title else []))
    f = found.withColumn("_r", F.row_number().over(top)).filter("_r = 1").select(F.col(label).alias("_fl"), F.col(count).alias("found_count"), (F.col(title) if title else F.lit(None).cast("string")).alias("_ft"))
    e = expected.select(F.col(label).alias("_el"), F.col(count).alias("expected_count"), (F.col(title) if title else F.lit(None).cast("string")).alias("_et"))
    j = f.join(e, F.col("_fl") == F.col("_el"), "full_outer")
    status = F.when(F.col("_fl").isNull(), "missing").when(F.col("_el").isNull(), "extra").when(F.col("found_count") != F.col("expected_count"), "count").when(~F.col("_ft").eqNullSafe(F.col("_et")), "title").otherwise("equal")
    return j.select(F.coalesce("_fl", "_el").alias(label), "found_count", "expected_count", status.alias("status"))


def plan(proposed: DataFrame, stored: DataFrame, key: Sequence[str], values: Sequence[str], tolerance: float) -> DataFrame:
    """(key, action): added, unchanged, changed or not-proposed; numbers within tolerance are the same. Applied twice it changes nothing."""
    p = proposed.select(*[F.col(k).alias(f"_p{k}") for k in key], *[F.col(v).alias(f"_p_{v}") for v in values])
    s = stored.select(*[F.col(k).alias(f"_s{k}") for k in key], *[F.col(v).alias(f"_s_{v}") for v in values])
    on = F.lit(True)
    same = F.lit(True)
    for k in key:
        on = on & (F.col(f"_p{k}") == F.col(f"_s{k}"))
    kinds = dict(proposed.dtypes)
    for v in values:
        a, b = F.col(f"_p_{v}"), F.col(f"_s_{v}")
        same = same & (F.coalesce(F.abs(a - b) <= tolerance, a.isNull() & b.isNull()) if kinds[v] in ("double", "float") else a.eqNullSafe(b))
    action = F.when(F.col(f"_s{key[0]}").isNull(), "added").when(F.col(f"_p{key[0]}").isNull(), "not-proposed").when(same, "unchanged").otherwise("changed")
    return p.join(s, on, "full_outer").select(*[F.coalesce(f"_p{k}", f"_s{k}").alias(k) for k in key], action.alias("action"))


def unmatched(left: DataFrame, right: DataFrame, key: Sequence[str], left_code: str, right_code: str) -> DataFrame:
    """(key, code): keys of the left without a partner, and of the right."""
    a, b = left.select(*key).distinct(), right.select(*key).distinct()
    return a.join(b, list(key), "left_anti").withColumn("code", F.lit(left_code)).unionByName(b.join(a, list(key), "left_anti").withColumn("code", F.lit(right_code)))


def introduced(before: DataFrame, after: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows of after whose key before lacks."""
    return after.join(before.select(*key).distinct(), list(key), "left_anti")


def differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows that one side has more often than the other, with side."""
    return left.exceptAll(right).withColumn("side", F.lit("left")).unionByName(right.exceptAll(left).withColumn("side", F.lit("right")))


def compare_logs(left: DataFrame, right: DataFrame, key: Sequence[str], order: Sequence[str], what: Column) -> DataFrame:
    """(key, step, left_call, right_call) where two logs of a key differ step by step."""
    w = Window.partitionBy(*key).orderBy(*order)
    side = lambda d, n: d.select(*[F.col(k).alias(f"_{n}{k}") for k in key], F.row_number().over(w).alias(f"_{n}step"), what.alias(f"{n}_call"))
    a, b = side(left, "left"), side(right, "right")
    on = F.col("_leftstep") == F.col("_rightstep")
    for k in key:
        on = on & (F.col(f"_left{k}") == F.col(f"_right{k}"))
    j = a.join(b, on, "full_outer").filter(~F.col("left_call").eqNullSafe(F.col("right_call")))
    return j.select(*[F.coalesce(f"_left{k}", f"_right{k}").alias(k) for k in key], F.coalesce("_leftstep", "_rightstep").alias("step"), "left_call", "right_call")


def title_score(a: Column, b: Column) -> Column:
    """1 for equal titles, 0.85 where one contains the other, else the Jaccard similarity of their words."""
    x, y = F.split(a, " "), F.split(b, " ")
    return F.when(a == b, F.lit(1.0)).when(a.contains(b) | b.contains(a), F.lit(0.85)).otherwise(F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y)))


def close_spelling(a: Column, b: Column) -> Column:
    """Edit distance of at most 2 or 12 per cent of the longer, whichever is more."""
    return F.levenshtein(a, b) <= F.greatest(F.lit(2), F.floor(F.greatest(F.length(a), F.length(b)) * 0.12).cast("int"))


def title_pairs(rows: DataFrame, key: Sequence[str], ident: str, title: str, block: int = 512) -> DataFrame:
    """(a, b, close, score): every two rows of a key, a before b by ident, with close_spelling() and title_score() of their titles.

    Two titles are compared once, however many rows have them; the rows of a title meet those of another in blocks.
    """
    same = lambda d, names: reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_c{i}")) for i, k in enumerate(names)])
    names = [*key, title]
    counted = rows.groupBy(*[F.col(k).alias(f"_c{i}") for i, k in enumerate(names)]).agg(F.ceil(F.count(F.lit(1)) / block).alias("_n"))
    dealt = rows.join(counted, same(rows, names)).withColumn("_block", F.pmod(F.xxhash64(ident), F.col("_n")))
    g = dealt.groupBy(*names, "_block").agg(F.collect_list(ident).alias("_ids"))
    side = lambda n: g.select(*[F.col(k).alias(f"{n}{i}") for i, k in enumerate(key)], F.col(title).alias(f"{n}_t"), F.col("_block").alias(f"{n}_block"), F.col("_ids").alias(f"{n}_ids"))
    place = lambda n: F.struct(F.col(f"{n}_t").alias("t"), F.col(f"{n}_block").alias("block"))
    on = reduce(lambda x, y: x & y, [F.col(f"x{i}") == F.col(f"y{i}") for i in range(len(key))], place("x") <= place("y"))
    pairs = side("x").join(side("y"), on).select("x_ids", "y_ids", (place("x") == place("y")).alias("_own"), close_spelling(F.col("x_t"), F.col("y_t")).alias("close"), title_score(F.col("x_t"), F.col("y_t")).alias("score"), (F.col("x_t").isNull() & F.col("y_t").isNotNull()).alias("_missing"))
    # few bytes become many rows: AQE would leave them in few tasks
    spread = pairs.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    met = spread.withColumn("_i", F.explode("x_ids")).withColumn("_j", F.explode("y_ids")).filter((F.col("_i") < F.col("_j")) | (~F.col("_own") & (F.col("_i") > F.col("_j"))))
    # as in SQL a title shares no word with a missing one behind it, and a missing title has no score; missing ones stand left
    score = F.when(F.col("_missing") & (F.col("_j") < F.col("_i")), 0.0).otherwise(F.col("score"))
    return met.select(F.least("_i", "_j").alias("a"), F.greatest("_i", "_j").alias("b"), "close", score.alias("score"))
