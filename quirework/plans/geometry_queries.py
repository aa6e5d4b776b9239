"""Intervals over order lines: quantities as heights, line numbers as lengths."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirework.functions import rects
from quirework.operators import geometry as G
from quirework.plans.catalog import query
from quirework.session import table


def _intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.col("l_quantity").alias("lo"), (F.col("l_quantity") + F.col("l_linenumber") * 2).alias("hi"))


_I = "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity AS lo, l_quantity + l_linenumber * 2 AS hi FROM lineitem"


@query(f"""
WITH i AS ({_I})
SELECT a.l_orderkey, a.l_partkey AS a_part, a.l_suppkey AS a_supp, b.l_partkey AS b_part, b.l_suppkey AS b_supp, (least(a.hi, b.hi) - greatest(a.lo, b.lo)) / least(a.hi - a.lo, b.hi - b.lo) AS share
FROM i a JOIN i b ON a.l_orderkey = b.l_orderkey AND (a.l_partkey, a.l_suppkey) < (b.l_partkey, b.l_suppkey) AND greatest(a.lo, b.lo) < least(a.hi, b.hi)
""")
def interval_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of an order's intervals that overlap, and by how much of the shorter."""
    i = _intervals(spark, sf_dir)
    j = G.overlaps(i, i, ["l_orderkey"], "lo", "hi", 16.0).filter(F.struct("a_l_partkey", "a_l_suppkey") < F.struct(F.col("b_l_partkey").alias("a_l_partkey"), F.col("b_l_suppkey").alias("a_l_suppkey")))
    share = (F.least("a_hi", "b_hi") - F.greatest("a_lo", "b_lo")) / F.least(F.col("a_hi") - F.col("a_lo"), F.col("b_hi") - F.col("b_lo"))
    return j.select(F.col("a_l_orderkey").alias("l_orderkey"), F.col("a_l_partkey").alias("a_part"), F.col("a_l_suppkey").alias("a_supp"), F.col("b_l_partkey").alias("b_part"), F.col("b_l_suppkey").alias("b_supp"), share.alias("share"))


@query(f"""
WITH i AS ({_I}), r AS (SELECT *, max(hi) OVER (PARTITION BY l_orderkey ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM i)
SELECT l_orderkey, sum(CASE WHEN reach IS NULL OR lo > reach THEN hi - lo ELSE greatest(hi - reach, 0) END) AS covered, max(hi) - min(lo) AS span FROM r GROUP BY 1
""")
def covered_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.covered_length(_intervals(spark, sf_dir), ["l_orderkey"], "lo", "hi")


@query("""
WITH r AS (SELECT c_custkey * 40 AS lo, c_custkey * 40 + 25 + c_custkey % 20 AS hi FROM customer),
n AS (SELECT unnest(range(lo, hi + 1)) AS position FROM r), c AS (SELECT position, count(*) AS n_ranges FROM n GROUP BY 1),
p AS (SELECT o_orderkey AS position, count(*) AS n_present FROM orders GROUP BY 1),
j AS (SELECT coalesce(c.position, p.position) AS position, coalesce(n_ranges, 0) AS n_ranges, coalesce(n_present, 0) AS n_present FROM c FULL JOIN p ON c.position = p.position)
SELECT *, CASE WHEN n_ranges = 0 THEN 'survey-missing' WHEN n_ranges > 1 THEN 'survey-overlap' ELSE 'survey-uncovered' END AS code FROM j WHERE n_ranges <> 1 OR n_present = 0
""")
def survey_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges that customers claim against the orders that are there."""
    r = table(spark, sf_dir, "customer").select((F.col("c_custkey") * 40).alias("lo"), (F.col("c_custkey") * 40 + 25 + F.col("c_custkey") % 20).alias("hi"))
    return G.range_check(r, table(spark, sf_dir, "orders"), "lo", "hi", "o_orderkey")


@query("""
WITH b AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_discount * 5 AS l, l_quantity / 60 AS t, least(1.0, l_discount * 5 + 0.3) AS r, least(1.0, l_quantity / 60 + 0.05 * l_linenumber) AS b FROM lineitem)
SELECT x.l_orderkey, x.l_partkey AS a_part, y.l_partkey AS b_part, x.l_suppkey AS a_supp, y.l_suppkey AS b_supp, round((least(x.r, y.r) - greatest(x.l, y.l)) * (least(x.b, y.b) - greatest(x.t, y.t)) / least((x.r - x.l) * (x.b - x.t), (y.r - y.l) * (y.b - y.t)), 6) AS share
FROM b x JOIN b y ON x.l_orderkey = y.l_orderkey AND (x.l_partkey, x.l_suppkey) < (y.l_partkey, y.l_suppkey) AND greatest(x.l, y.l) < least(x.r, y.r) AND greatest(x.t, y.t) < least(x.b, y.b)
WHERE (least(x.r, y.r) - greatest(x.l, y.l)) * (least(x.b, y.b) - greatest(x.t, y.t)) / least((x.r - x.l) * (x.b - x.t), (y.r - y.l) * (y.b - y.t)) > 0.05
""")
def rectangle_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rectangles of an order's lines that share more than a twentieth of the smaller."""
    li = table(spark, sf_dir, "lineitem")
    left, top = F.col("l_discount") * 5, F.col("l_quantity") / 60
    # the SQL's 0.05 is a decimal: its product is rounded to a double once
    r = rects.rect(left, top, F.least(F.lit(1.0), left + 0.3), F.least(F.lit(1.0), top + F.col("l_linenumber").cast("long") * 5 / 100))
    b = li.select("l_orderkey", "l_partkey", "l_suppkey", r.alias("r")).withColumn("lo", F.col("r.top")).withColumn("hi", F.col("r.bottom"))
    j = G.overlaps(b, b, ["l_orderkey"], "lo", "hi", 0.25).filter(F.struct("a_l_partkey", "a_l_suppkey") < F.struct(F.col("b_l_partkey").alias("a_l_partkey"), F.col("b_l_suppkey").alias("a_l_suppkey")))
    share = rects.shared(F.col("a_r"), F.col("b_r"))
    return j.filter(share > 0.05).select(F.col("a_l_orderkey").alias("l_orderkey"), F.col("a_l_partkey").alias("a_part"), F.col("b_l_partkey").alias("b_part"), F.col("a_l_suppkey").alias("a_supp"), F.col("b_l_suppkey").alias("b_supp"), F.round(share, 6).alias("share"))
