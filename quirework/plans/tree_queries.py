"""Trees, locations and comparisons over the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quirework.operators import reconcile as R
from quirework.operators import trees as T
from quirework.plans.catalog import query
from quirework.session import table


def _outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = Window.partitionBy("l_orderkey").orderBy("l_partkey", "l_suppkey", "l_linenumber", "l_quantity")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", F.row_number().over(at).cast("long").alias("idx"), (F.col("l_linenumber") - 1).cast("int").alias("depth"))


@query("""
WITH t AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber, l_quantity) AS idx, CAST(l_linenumber - 1 AS INTEGER) AS depth FROM lineitem)
SELECT a.l_orderkey, a.idx, a.depth, min(b.idx) FILTER (b.idx > a.idx AND b.depth <= a.depth) AS subtree_end, max(b.idx) FILTER (b.idx < a.idx AND b.depth < a.depth) AS parent
FROM t a JOIN t b ON a.l_orderkey = b.l_orderkey GROUP BY ALL
""")
def tree_extents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of an order as a preorder list of depths: where each subtree ends and what holds it."""
    return T.extents(_outline(spark, sf_dir), ["l_orderkey"], "idx", "depth", 7)


@query("""
WITH m AS (SELECT user_id, ts, min(event_id) AS mark FROM events WHERE event_type = 'signup' GROUP BY ALL)
SELECT e.event_id, e.user_id, m.mark AS located FROM events e ASOF LEFT JOIN m ON e.user_id = m.user_id AND e.ts >= m.ts
""")
def locate_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events in the section that the user's last sign-up opened."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    marks = e.filter("event_type = 'signup'").groupBy("user_id", "ts").agg(F.min("event_id").alias("mark"))
    return T.locate(e.select("event_id", "user_id", "ts"), marks, ["user_id"], ["ts"], "mark").select("event_id", "user_id", "located")


@query("""
WITH c AS (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1),
nat AS (SELECT 'n' || n_nationkey AS node, 'r' || n_regionkey AS parent, coalesce(n, 0) AS own FROM nation LEFT JOIN c ON k = n_nationkey),
reg AS (SELECT 'r' || r_regionkey AS node, sum(nat.own) AS total FROM region LEFT JOIN nat ON nat.parent = 'r' || r_regionkey GROUP BY 1)
SELECT node, CAST(own AS BIGINT) AS own, CAST(own AS BIGINT) AS total FROM nat
UNION ALL SELECT node, 0, CAST(coalesce(total, 0) AS BIGINT) FROM reg UNION ALL SELECT 'world', 0, CAST((SELECT sum(total) FROM reg) AS BIGINT)
""")
def tree_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers of each nation, region and the world: own and below."""
    n, r, c = (table(spark, sf_dir, x) for x in ("nation", "region", "customer"))
    node = lambda p, k: F.concat(F.lit(p), F.col(k).cast("string"))
    edges = n.select(node("n", "n_nationkey").alias("node"), node("r", "n_regionkey").alias("parent")).unionByName(r.select(node("r", "r_regionkey").alias("node"), F.lit("world").alias("parent"))).unionByName(spark.range(1).select(F.lit("world").alias("node"), F.lit(None).cast("string").alias("parent")))
    counts = c.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n")).select(node("n", "c_nationkey").alias("node"), "n")
    return T.rollup(counts, edges, "node", "parent", "n", 2)


@query("""
SELECT o_custkey, count(*) AS n_items, min_by(o_orderkey, (o_orderdate, o_orderkey)) AS first_label, max_by(o_orderkey, (o_orderdate, o_orderkey)) AS last_label FROM orders GROUP BY 1
""")
def book_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.summary(table(spark, sf_dir, "orders"), "o_custkey", ["o_orderdate", "o_orderkey"], "o_orderkey")


@query("""
WITH f AS (SELECT o_custkey AS label, count(*) AS c FROM orders GROUP BY 1),
e AS (SELECT c_custkey AS label, CAST(c_custkey % 20 AS BIGINT) AS c FROM customer)
SELECT coalesce(f.label, e.label) AS label, f.c AS found_count, e.c AS expected_count,
  CASE WHEN f.label IS NULL THEN 'missing' WHEN e.label IS NULL THEN 'extra' WHEN f.c <> e.c THEN 'count' ELSE 'equal' END AS status
FROM f FULL JOIN e ON f.label = e.label
""")
def reference_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders counted by customer against a list that expects them."""
    f = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("label")).agg(F.count(F.lit(1)).alias("c"))
    e = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("label"), (F.col("c_custkey") % 20).alias("c"))
    return R.compare(f, e, "label", "c")


@query("""
WITH p AS (SELECT p_partkey, p_name, CASE WHEN p_partkey % 7 = 0 THEN p_retailprice + 1 ELSE p_retailprice + 0.001 END AS price FROM part WHERE p_partkey % 10 <> 3),
s AS (SELECT p_partkey, p_name, p_retailprice AS price FROM part WHERE p_partkey % 10 <> 4)
SELECT coalesce(p.p_partkey, s.p_partkey) AS p_partkey, CASE WHEN s.p_partkey IS NULL THEN 'added' WHEN p.p_partkey IS NULL THEN 'not-proposed' WHEN p.p_name = s.p_name AND abs(p.price - s.price) <= 0.005 THEN 'unchanged' ELSE 'changed' END AS action
FROM p FULL JOIN s ON p.p_partkey = s.p_partkey
""")
def upsert_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two snapshots of the parts, prices equal within a tolerance."""
    part = table(spark, sf_dir, "part")
    p = part.filter("p_partkey % 10 <> 3").select("p_partkey", "p_name", F.when(F.col("p_partkey") % 7 == 0, F.col("p_retailprice") + 1).otherwise(F.col("p_retailprice") + 0.001).alias("price"))
    s = part.filter("p_partkey % 10 <> 4").select("p_partkey", "p_name", F.col("p_retailprice").alias("price"))
    return R.plan(p, s, ["p_partkey"], ["p_name", "price"], 0.005)


@query("""
WITH a AS (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_returnflag = 'R'), b AS (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_linestatus = 'F')
SELECT k AS l_orderkey, 'without-answer' AS code FROM a ANTI JOIN b USING (k) UNION ALL SELECT k, 'without-item' FROM b ANTI JOIN a USING (k)
""")
def answers_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return R.unmatched(li.filter("l_returnflag = 'R'"), li.filter("l_linestatus = 'F'"), ["l_orderkey"], "without-answer", "without-item")


@query("""
SELECT DISTINCT o_orderkey, o_custkey, o_orderpriority FROM orders WHERE o_orderstatus <> 'F' AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')
""")
def introduced_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return R.introduced(o.filter("o_orderstatus = 'F'"), o.filter("o_orderstatus <> 'F'").select("o_custkey", "o_orderkey", "o_orderpriority"), ["o_custkey"])


@query("""
WITH a AS (SELECT l_partkey, l_quantity FROM lineitem WHERE l_linenumber <= 4), b AS (SELECT l_partkey, l_quantity FROM lineitem WHERE l_linenumber >= 3)
SELECT *, 'left' AS side FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT *, 'right' AS side FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)
""")
def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return R.differences(li.filter("l_linenumber <= 4").select("l_partkey", "l_quantity"), li.filter("l_linenumber >= 3").select("l_partkey", "l_quantity"))


@query("""
WITH a AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step, event_type AS c FROM events),
b AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY value, event_id) AS step, event_type AS c FROM events)
SELECT coalesce(a.user_id, b.user_id) AS user_id, CAST(coalesce(a.step, b.step) AS INTEGER) AS step, a.c AS left_call, b.c AS right_call
FROM a FULL JOIN b ON a.user_id = b.user_id AND a.step = b.step WHERE a.c IS DISTINCT FROM b.c
""")
def log_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's events in order of time and in order of value, step by step."""
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "ts", "value")
    left = e.withColumn("o", F.struct(F.col("ts").cast("string"), F.col("event_id")))
    right = e.withColumn("o", F.struct("value", "event_id"))
    return R.compare_logs(left, right, ["user_id"], ["o"], F.col("event_type"))


@query("""
WITH p AS (SELECT p_partkey, p_brand, p_size, lower(p_name) AS t FROM part)
SELECT a.p_partkey AS a, b.p_partkey AS b, levenshtein(a.t, b.t) <= greatest(2, floor(greatest(length(a.t), length(b.t)) * 0.12)) AS close,
  round(CASE WHEN a.t = b.t THEN 1.0 WHEN contains(a.t, b.t) OR contains(b.t, a.t) THEN 0.85
    ELSE len(list_intersect(string_split(a.t, ' '), string_split(b.t, ' '))) / len(list_distinct(list_concat(string_split(a.t, ' '), string_split(b.t, ' ')))) END, 6) AS score
FROM p a JOIN p b ON a.p_brand = b.p_brand AND a.p_size = b.p_size AND a.p_partkey < b.p_partkey
""")
def title_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of the parts of one brand and size: edit distance and word overlap."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size", F.lower("p_name").alias("t"))
    return R.title_pairs(p, ["p_brand", "p_size"], "p_partkey", "t").withColumn("score", F.round("score", 6))
