"""Numbered sequences over the order lines: an order is a section, its line numbers are the labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirework.operators import sequences as S
from quirework.plans.catalog import query
from quirework.session import table


@query("SELECT l_orderkey, l_linenumber, count(*) AS n_rows FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def seq_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.duplicates(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber")


_GAPS = """
WITH d AS (SELECT DISTINCT l_orderkey, l_linenumber AS n FROM lineitem),
g AS (SELECT *, lead(n) OVER (PARTITION BY l_orderkey ORDER BY n) AS nx FROM d)
SELECT l_orderkey, CAST(n + 1 AS BIGINT) AS gap_from, CAST(nx - 1 AS BIGINT) AS gap_to, CAST(nx - n - 1 AS BIGINT) AS n_missing FROM g WHERE nx - n > 1
"""


@query(_GAPS)
def seq_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.gaps(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber")


@query(f"SELECT l_orderkey, gap_from, gap_to, n_missing, unnest(range(gap_from, gap_to + 1)) AS missing FROM ({_GAPS})")
def seq_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.missing_numbers(S.gaps(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber"), "l_orderkey")


@query("""
WITH m AS (SELECT l_orderkey, median(l_quantity) AS section_median FROM lineitem GROUP BY 1)
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, section_median FROM lineitem JOIN m USING (l_orderkey) WHERE l_quantity > section_median * 3
""")
def seq_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity")
    return S.outliers(rows, "l_orderkey", "l_quantity")


@query("""
SELECT l_suppkey, count(*) AS n_items, count(*) FILTER (l_returnflag = 'R') AS n_answered,
  CASE WHEN count(*) FILTER (l_returnflag = 'R') = 0 THEN 'info' WHEN count(*) FILTER (l_returnflag = 'R') * 100 < count(*) * 80 THEN 'warning' ELSE 'none' END AS severity
FROM lineitem GROUP BY 1
""")
def seq_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.coverage(table(spark, sf_dir, "lineitem"), "l_suppkey", F.col("l_returnflag") == "R")


@query("""
WITH g AS (SELECT l_orderkey, count(*) AS n_items, count(DISTINCT l_linenumber) AS n_numbers, CAST(min(l_linenumber) AS BIGINT) AS first_n, CAST(max(l_linenumber) AS BIGINT) AS last_n,
  CAST(median(l_linenumber) AS DOUBLE) AS median_n, count(*) FILTER (l_returnflag = 'R') AS n_answered FROM lineitem GROUP BY 1)
SELECT *, n_items - n_numbers AS n_duplicates, last_n - first_n + 1 - n_numbers AS n_missing, last_n > median_n * 3 AS has_outlier,
  CASE WHEN n_items > n_numbers THEN 'error' WHEN last_n - first_n + 1 > n_numbers OR last_n > median_n * 3 OR (n_answered > 0 AND n_answered * 100 < n_items * 80) THEN 'warning' ELSE 'info' END AS severity
FROM g
""")
def seq_section_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.section_report(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber", F.col("l_returnflag") == "R")


@query("""
WITH c AS (SELECT o_custkey AS section, count(*) AS c, min(year(o_orderdate)) AS start_page, max(year(o_orderdate)) AS end_page FROM orders WHERE o_orderstatus = 'F' GROUP BY 1)
SELECT o_orderkey, o_custkey, CAST(year(o_orderdate) AS INTEGER) AS page, CASE WHEN section IS NULL THEN 'section-unknown' ELSE 'section-page' END AS code,
  CAST(start_page AS INTEGER) AS start_page, CAST(end_page AS INTEGER) AS end_page
FROM orders LEFT JOIN c ON o_custkey = section WHERE section IS NULL OR year(o_orderdate) < start_page OR year(o_orderdate) > end_page
""")
def seq_placement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders placed outside the years of their customer's filled orders."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", F.year("o_orderdate").alias("page"))
    s = o.filter("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("section")).agg(F.min("page").alias("start_page"), F.max("page").alias("end_page"))
    return S.placement(o.drop("o_orderstatus"), s, "o_custkey", "page")


@query("""
WITH d AS (SELECT DISTINCT l_orderkey, CAST(l_linenumber AS BIGINT) AS n FROM lineitem),
g AS (SELECT *, n - row_number() OVER (PARTITION BY l_orderkey ORDER BY n) AS g FROM d),
r AS (SELECT l_orderkey, min(n) AS a, max(n) AS b FROM g GROUP BY l_orderkey, g)
SELECT l_orderkey, string_agg(CASE WHEN a = b THEN CAST(a AS VARCHAR) WHEN b = a + 1 THEN a || ', ' || b ELSE a || '-' || b END, ', ' ORDER BY a) AS ranges FROM r GROUP BY 1
""")
def compact_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.compact_ranges(table(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_linenumber")


@query("""
WITH o AS (SELECT *, coalesce(CAST(l_discount - lag(l_discount) OVER w > 0.015 AS INTEGER), 0) AS o
  FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_discount FROM lineitem) WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_discount, l_linenumber, l_partkey, l_suppkey, l_quantity))
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_discount,
  CAST(sum(o) OVER (PARTITION BY l_orderkey ORDER BY l_discount, l_linenumber, l_partkey, l_suppkey, l_quantity ROWS UNBOUNDED PRECEDING) AS INTEGER) AS island FROM o
""")
def column_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Discounts of an order chained while they are near the one before, as left edges make columns."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_discount")
    return S.lag_islands(rows, ["l_orderkey"], "l_discount", 0.015, ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity"])


@query("""
WITH RECURSIVE d AS (SELECT l_suppkey, CAST(l_quantity AS DOUBLE) AS v, count(*) AS n FROM lineitem GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY v) AS i FROM d),
f AS (SELECT l_suppkey, i, v AS anchor, 0 AS cluster, n FROM r WHERE i = 1
  UNION ALL SELECT r.l_suppkey, r.i, CASE WHEN r.v - f.anchor > 4 THEN r.v ELSE f.anchor END, CASE WHEN r.v - f.anchor > 4 THEN f.cluster + 1 ELSE f.cluster END, r.n FROM f JOIN r ON r.l_suppkey = f.l_suppkey AND r.i = f.i + 1)
SELECT l_suppkey, CAST(cluster AS INTEGER) AS cluster, anchor, CAST(sum(n) AS BIGINT) AS n FROM f GROUP BY ALL
""")
def anchored_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.anchored_clusters(table(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_quantity", 4.0)


@query("""
WITH RECURSIVE o AS (SELECT o_custkey, o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS placed, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS i FROM orders),
f AS (SELECT o_custkey, i, o_totalprice AS v, [i] AS places FROM o
  UNION ALL SELECT o.o_custkey, o.i, o.o_totalprice, list_append(f.places, o.i) FROM f JOIN o ON o.o_custkey = f.o_custkey AND o.i > f.i AND o.o_totalprice >= f.v),
b AS (SELECT o_custkey, places FROM f QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY len(places) DESC, places) = 1)
SELECT o.o_custkey, o_orderkey, placed, o_totalprice, list_contains(places, i) AS in_order FROM o JOIN b ON b.o_custkey = o.o_custkey
""")
def order_lis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of a customer that break the rise of their prices in time."""
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.col("o_orderdate").cast("string").alias("placed"), "o_totalprice")
    return S.out_of_order(rows, ["o_custkey"], ["placed", "o_orderkey"], "o_totalprice")


@query("""
WITH p AS (SELECT user_id, event_type AS kind, CAST(ts AS DATE) AS unit, event_id, ts FROM events),
a AS (SELECT *, row_number() OVER (PARTITION BY kind, user_id, unit ORDER BY ts, event_id) AS part, count(*) OVER (PARTITION BY kind, user_id, unit) AS part_count FROM p),
f AS (SELECT kind, user_id, unit, row_number() OVER (PARTITION BY kind ORDER BY ts, event_id) AS number FROM a WHERE part = 1)
SELECT event_id, kind, CAST(part AS INTEGER) AS part, CAST(part_count AS INTEGER) AS part_count, CAST(number AS INTEGER) AS number,
  upper(kind[1]) || number || CASE WHEN part_count > 1 THEN '.' || part ELSE '' END AS display
FROM a JOIN f USING (kind, user_id, unit)
""")
def positional_numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a kind numbered in time; those of one user and day are parts of a unit."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", F.col("event_type").alias("kind"))
    unit = F.concat_ws("|", F.col("user_id").cast("string"), F.to_date("ts").cast("string"))
    return S.numbering(e, "kind", unit, ["ts", "event_id"]).select("event_id", "kind", "part", "part_count", "number", "display")


@query("""
WITH t AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity AS top, l_quantity + l_linenumber AS bottom FROM lineitem),
d AS (SELECT *, lag(bottom) OVER (PARTITION BY l_orderkey ORDER BY top, bottom, l_partkey, l_suppkey, l_linenumber) AS prev FROM t)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, top, bottom, top - prev AS distance,
  CASE WHEN top - prev > 1 THEN 'unit-gap' WHEN top - prev < -1 THEN 'unit-overlap' ELSE 'unit-snapped' END AS code,
  CASE WHEN top - prev > 0 THEN top ELSE (top + prev) / 2 END AS edge
FROM d WHERE prev IS NOT NULL AND top <> prev
""")
def unit_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantity intervals of an order as the stacked parts of a unit."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").alias("top"), (F.col("l_quantity") + F.col("l_linenumber")).alias("bottom"))
    return S.tiling(rows, ["l_orderkey"], "top", "bottom", 1.0, ["l_partkey", "l_suppkey", "l_linenumber"])


@query("""
WITH RECURSIVE t AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber, l_quantity) AS idx, CAST(l_linenumber - 1 AS INTEGER) AS depth FROM lineitem),
f AS (SELECT l_orderkey, idx, depth, 0 AS clamped FROM t WHERE idx = 1
  UNION ALL SELECT t.l_orderkey, t.idx, t.depth, least(t.depth, f.clamped + 1) FROM f JOIN t ON t.l_orderkey = f.l_orderkey AND t.idx = f.idx + 1)
SELECT l_orderkey, CAST(idx AS INTEGER) AS idx, depth, CAST(clamped AS INTEGER) AS clamped FROM f
""")
def depth_clamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    at = Window.partitionBy("l_orderkey").orderBy("l_partkey", "l_suppkey", "l_linenumber", "l_quantity")
    outline = table(spark, sf_dir, "lineitem").select("l_orderkey", F.row_number().over(at).alias("idx"), (F.col("l_linenumber") - 1).cast("int").alias("depth"))
    return S.clamp_depths(outline, ["l_orderkey"], "idx", "depth")


@query("""
WITH r AS (SELECT c_custkey, c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) - 1 AS i, count(*) OVER (PARTITION BY c_mktsegment) AS m FROM customer),
k AS (SELECT unnest(range(0, 39)) AS k)
SELECT DISTINCT c_custkey, c_mktsegment, i AS place FROM r, k WHERE m <= 40 OR i = (k * m) // 40 OR i = m - 1
""")
def even_stride(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forty customers of each segment at an even stride, the last among them."""
    return S.even_stride(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), ["c_mktsegment"], ["c_custkey"], 40)
