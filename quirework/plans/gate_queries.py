"""Findings, judgement, hashes, samples and runs over the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quirework.functions import labels, rects
from quirework.operators import census, gate, reconcile, statistics
from quirework.operators import sequences as S
from quirework.plans.catalog import query
from quirework.session import table


def _findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Duplicates, gaps and outliers of the order lines as findings; a supplier is a book."""
    li = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_quantity")
    book, none = F.col("l_suppkey"), F.lit(None).cast("int")
    dup = gate.findings(S.duplicates(li, "l_suppkey", "l_quantity"), book, F.lit("duplicate"), F.lit("error"), F.col("l_quantity").cast("int"), none, F.format_string("%d times", "n_rows"), "sequence")
    gap = gate.findings(S.gaps(li.withColumn("n", F.col("l_quantity").cast("int")), "l_suppkey", "n"), book, F.lit("gap"), F.lit("warning"), F.col("gap_from"), none, F.format_string("%d missing", "n_missing"), "sequence")
    out = gate.findings(S.outliers(li, "l_suppkey", "l_linenumber"), book, F.lit("label-outlier"), F.lit("info"), F.col("l_orderkey"), F.col("l_linenumber"), F.lit("far above the others"), "sequence")
    return gate.union([dup, gap, out])


_F = """
SELECT CAST(l_suppkey AS VARCHAR) AS book_id, 'duplicate' AS code, 'error' AS severity, CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) AS ref, CAST(NULL AS INTEGER) AS page FROM lineitem GROUP BY l_suppkey, l_quantity HAVING count(*) > 1
UNION ALL SELECT CAST(l_suppkey AS VARCHAR), 'gap', 'warning', CAST(n + 1 AS VARCHAR), NULL FROM (SELECT l_suppkey, n, lead(n) OVER (PARTITION BY l_suppkey ORDER BY n) AS nx FROM (SELECT DISTINCT l_suppkey, CAST(l_quantity AS INTEGER) AS n FROM lineitem)) WHERE nx - n > 1
UNION ALL SELECT CAST(l_suppkey AS VARCHAR), 'label-outlier', 'info', CAST(l_orderkey AS VARCHAR), l_linenumber FROM lineitem JOIN (SELECT l_suppkey AS s, median(l_linenumber) AS m FROM lineitem GROUP BY 1) ON s = l_suppkey WHERE l_linenumber > m * 3
"""


@query(f"SELECT book_id, count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warning') AS warnings, count(*) FILTER (severity = 'info') AS infos FROM ({_F}) GROUP BY 1")
def findings_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gate.summary(_findings(spark, sf_dir))


@query(f"""
WITH f AS ({_F}), n AS (SELECT CAST(s_suppkey AS VARCHAR) AS book_id, CASE WHEN s_suppkey % 2 = 0 THEN 'seen' ELSE '' END AS reason, s_suppkey % 4 = 0 AS confirmed FROM supplier),
s AS (SELECT f.*, CASE WHEN f.code = 'duplicate' AND n.reason = 'seen' THEN CASE WHEN n.confirmed THEN 'acknowledged' ELSE 'unconfirmed' END ELSE 'open' END AS state FROM f LEFT JOIN n USING (book_id)),
g AS (SELECT book_id, count(*) FILTER (state = 'open') AS open, count(*) FILTER (state = 'unconfirmed') AS unconfirmed, count(*) FILTER (state = 'acknowledged') AS acknowledged FROM s GROUP BY 1)
SELECT n.book_id, coalesce(open, 0) AS open, coalesce(unconfirmed, 0) AS unconfirmed, coalesce(acknowledged, 0) AS acknowledged, coalesce(open, 0) = 0 AND coalesce(unconfirmed, 0) = 0 AS perfect FROM n LEFT JOIN g USING (book_id)
""")
def findings_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each supplier's findings, judged by one note on its duplicates: every second note has a reason, every fourth is confirmed."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("book_id"), "s_suppkey")
    notes = s.select("book_id", F.lit(0).alias("note_idx"), F.lit("duplicate").alias("code"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("int").alias("page"), F.when(F.col("s_suppkey") % 2 == 0, "seen").otherwise("").alias("reason"), F.lit(None).cast("int").alias("count"), (F.col("s_suppkey") % 4 == 0).alias("confirmed"))
    proofs = s.select("book_id", F.lit(True).alias("visual"), F.lit(True).alias("survey"), F.lit(True).alias("ink"))
    return gate.gate(gate.judge(_findings(spark, sf_dir), notes), proofs)


@query(f"""
SELECT book_id, code, ref, page, CAST(row_number() OVER (PARTITION BY book_id ORDER BY CASE severity WHEN 'error' THEN 1 WHEN 'warning' THEN 2 ELSE 3 END, CASE code WHEN 'gap' THEN 1 WHEN 'duplicate' THEN 2 ELSE 3 END, page NULLS LAST, ref NULLS LAST) AS INTEGER) AS place
FROM (SELECT DISTINCT * FROM ({_F}))
""")
def findings_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _findings(spark, sf_dir).dropDuplicates(["book_id", "code", "ref", "page"])
    return gate.ordered(f, ["gap", "duplicate", "label-outlier"]).select("book_id", "code", "ref", "page", "place")


@query("""
WITH j AS (SELECT o_custkey, o_orderkey, '{"o_orderkey":' || o_orderkey || ',"o_orderpriority":"' || o_orderpriority || '","o_orderstatus":"' || o_orderstatus || '"}' AS j FROM orders)
SELECT o_custkey, count(*) AS n, sha256('[' || string_agg(j, ',' ORDER BY o_orderkey) || ']') AS sha256 FROM j GROUP BY 1
""")
def canonical_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A digest of each customer's orders, whatever their order in the table."""
    return gate.canonical_hash(table(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderkey"], ["o_orderstatus", "o_orderkey", "o_orderpriority"])


@query("""
WITH i AS (SELECT c_mktsegment AS book_id, c_custkey AS id, CAST(floor(c_acctbal / 5000) AS INTEGER) AS layout, c_nationkey % 5 AS chapter, CAST(floor(c_acctbal / 1000) AS INTEGER) AS section, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) AS n FROM customer),
e AS (SELECT book_id, 1 AS step, min(n) AS first, 0 AS half, min(n) AS n, 'layout ' || layout || ': first' AS why FROM i GROUP BY book_id, layout
  UNION ALL SELECT book_id, 2, min(n), 0, min(n), 'chapter ' || chapter || ': first' FROM i GROUP BY book_id, chapter UNION ALL SELECT book_id, 2, min(n), 1, max(n), 'chapter ' || chapter || ': last' FROM i GROUP BY book_id, chapter HAVING max(n) > min(n)),
p AS (SELECT book_id, (40 - least(40, count(DISTINCT n))) // 2 AS c FROM e GROUP BY 1),
s AS (SELECT book_id, section, min(n) AS a, max(n) AS b, row_number() OVER (PARTITION BY book_id ORDER BY min(n)) - 1 AS k, count(*) OVER (PARTITION BY book_id) AS m FROM i GROUP BY book_id, section),
t AS (SELECT s.* FROM s JOIN p USING (book_id) WHERE m <= c OR (c > 0 AND k = m - 1) OR (c > 1 AND list_contains(list_transform(range(0, c - 1), lambda j: j * m // c), k))),
v AS (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY step, first, half) AS pos FROM (SELECT * FROM e UNION ALL SELECT book_id, 3, a, 0, a, 'section ' || section || ': first' FROM t UNION ALL SELECT book_id, 3, a, 1, b, 'section ' || section || ': last' FROM t WHERE b > a)),
f AS (SELECT book_id, n, row_number() OVER (PARTITION BY book_id ORDER BY min(pos)) AS place, arg_min(why, pos) AS first_reason, string_agg(why, '; ' ORDER BY pos) AS reasons FROM v GROUP BY book_id, n),
g AS (SELECT * FROM f WHERE place <= 40), r AS (SELECT book_id, count(*) AS taken, 40 - count(*) AS r FROM g GROUP BY 1),
l AS (SELECT i.book_id, i.n, taken, r, row_number() OVER (PARTITION BY i.book_id ORDER BY i.n) - 1 AS q, count(*) OVER (PARTITION BY i.book_id) AS m FROM i JOIN r ON r.book_id = i.book_id WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.book_id = i.book_id AND g.n = i.n)),
o AS (SELECT * FROM l WHERE m <= r OR (r > 0 AND q = m - 1) OR (r > 1 AND list_contains(list_transform(range(0, r - 1), lambda j: j * m // r), q))),
w AS (SELECT book_id, n, place, first_reason, reasons FROM g UNION ALL SELECT book_id, n, taken + row_number() OVER (PARTITION BY book_id ORDER BY n), 'stride', 'stride' FROM o)
SELECT w.book_id, i.id, CAST(w.place AS INTEGER) AS place, first_reason, reasons FROM w JOIN i ON i.book_id = w.book_id AND i.n = w.n
""")
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A review sample of each segment's customers: nations are chapters, balances' thousands are sections."""
    c = table(spark, sf_dir, "customer")
    items = c.select(F.col("c_mktsegment").alias("book_id"), F.col("c_custkey").alias("id"), (F.floor(F.col("c_acctbal") / 5000)).cast("int").alias("layout"), (F.col("c_nationkey") % 5).alias("chapter"), F.floor(F.col("c_acctbal") / 1000).cast("int").alias("section"), "c_custkey")
    return gate.stratified_sample(items, ["c_custkey"])


@query()
def numbered_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of rising line numbers among the lines that a supplier delivers of a part's size class, in order of their orders."""
    li = table(spark, sf_dir, "lineitem")
    at = Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    d = li.withColumn("ord", F.row_number().over(at)).select(F.col("l_suppkey").cast("string").alias("book_id"), F.col("l_returnflag").alias("family"), F.col("l_linenumber").alias("n"), F.floor(F.col("ord") / 40).cast("int").alias("page"), "ord", F.col("l_discount").alias("left"), (F.col("l_linestatus") == "F").alias("covered"))
    return census.verdicts(census.census(d, least=3))


@query("""
WITH r AS (SELECT l_suppkey, l_linestatus, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity) - 1 AS i, count(*) OVER (PARTITION BY l_suppkey) AS m FROM lineitem),
b AS (SELECT l_suppkey, i // 12 AS block, i % 12 + 1 AS n, l_linestatus FROM r WHERE i < m // 12 * 12), k AS (SELECT * FROM b WHERE block % 3 = 0 OR n <> 5 + block % 5)
SELECT CAST(l_suppkey AS VARCHAR) AS book_id, CAST(min(n) AS INTEGER) AS first_n, CAST(max(n) AS INTEGER) AS last_n, CAST(count(*) AS INTEGER) AS n_items, 1 AS step, CAST(12 - count(*) AS INTEGER) AS missing, CAST(block * 5 AS INTEGER) AS page, avg(CASE WHEN l_linestatus = 'F' THEN 1.0 ELSE 0.0 END) AS coverage, 'run' AS verdict
FROM k GROUP BY l_suppkey, block
""")
def stitched_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of twelve with a number missing in most: the pieces on both sides of a gap are stitched."""
    li = table(spark, sf_dir, "lineitem")
    i = F.row_number().over(Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")) - 1
    d = li.withColumn("i", i).withColumn("m", F.count(F.lit(1)).over(Window.partitionBy("l_suppkey"))).filter("i < floor(m / 12) * 12")
    d = d.withColumn("block", F.floor(F.col("i") / 12).cast("int")).withColumn("n", (F.col("i") % 12 + 1).cast("int")).filter("block % 3 = 0 OR n <> 5 + block % 5")
    labels_ = d.select(F.col("l_suppkey").cast("string").alias("book_id"), F.lit("dot").alias("family"), "n", (F.col("block") * 5).alias("page"), F.col("n").alias("ord"), F.lit(0.1).alias("left"), (F.col("l_linestatus") == "F").alias("covered"))
    r = census.verdicts(census.census(labels_))
    return r.select("book_id", "first_n", "last_n", "n_items", "step", "missing", F.col("first_page").alias("page"), "coverage", "verdict")


_R = "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_discount * 12 - 0.02 AS l, l_quantity / 50 - 0.004 AS t, l_discount * 12 + l_tax AS r, l_quantity / 50 + l_linenumber * 0.004 AS b FROM lineitem"


@query(f"""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l >= r OR t >= b THEN 'rect-inverted' WHEN least(l, t, r, b) < -0.005 OR greatest(l, t, r, b) > 1.005 THEN 'rect-off-page'
  WHEN r - l < 0.02 OR b - t < 0.01 THEN 'rect-too-small' WHEN least(l, t, r, b) < 0 OR greatest(l, t, r, b) > 1 THEN 'rect-clamped' ELSE 'ok' END AS code FROM ({_R})
""")
def rect_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with the rectangles that the order lines' numbers make."""
    li = table(spark, sf_dir, "lineitem")
    r = rects.rect(F.col("l_discount") * 12 - 0.02, F.col("l_quantity") / 50 - 0.004, F.col("l_discount") * 12 + F.col("l_tax"), F.col("l_quantity") / 50 + F.col("l_linenumber") * 0.004)
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.coalesce(rects.problem(r), F.lit("ok")).alias("code"))


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, floor((l_extendedprice / 7 - 6000) * 1e5 + 0.5) / 1e5 + 0.0 AS rounded FROM lineitem
""")
def rounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers to five digits, halves upward."""
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", rects.round_half_up(F.col("l_extendedprice") / 7 - 6000).alias("rounded"))


@query(r"""
WITH t AS (SELECT p_partkey, p_size || '.' || (p_partkey % 30) || CASE WHEN p_partkey % 3 = 0 THEN chr(97 + CAST(p_partkey % 5 AS INTEGER)) ELSE '' END AS label, p_brand FROM part),
n AS (SELECT *, list_transform(string_split(regexp_extract(label, '^(\d+\.\d+)', 1), '.'), lambda x: CAST(x AS INTEGER)) AS ns, regexp_extract(label, '^\d[\d.]*(.*)$', 1) AS suffix FROM t)
SELECT p_partkey, label, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY ns, suffix, p_partkey) AS INTEGER) AS place FROM n
""")
def label_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dotted labels of each brand's parts in the order of their numbers."""
    p = table(spark, sf_dir, "part")
    letter = F.when(F.col("p_partkey") % 3 == 0, F.char((F.col("p_partkey") % 5 + 97).cast("long"))).otherwise("")
    d = p.withColumn("label", F.concat(F.col("p_size").cast("string"), F.lit("."), (F.col("p_partkey") % 30).cast("string"), letter))
    o = labels.order(F.col("label"))
    w = Window.partitionBy("p_brand").orderBy(o["numbers"], o["suffix"], "p_partkey")
    return d.select("p_partkey", "label", F.row_number().over(w).alias("place"))


@query("""
WITH c AS (SELECT c_custkey AS book_id, c_custkey % 9 <> 0 AS started, c_custkey % 2 = 0 AS claimed_perfect, CAST(c_custkey % 25 AS BIGINT) AS claimed_items FROM customer),
f AS (SELECT o_custkey AS book_id, count(*) AS items, count(*) FILTER (o_orderstatus = 'O') AS open, count(*) FILTER (o_orderstatus = 'P') AS unconfirmed FROM orders GROUP BY 1),
s AS (SELECT CASE WHEN NOT started THEN 'NOT STARTED' WHEN f.book_id IS NULL THEN 'UNREADABLE' WHEN claimed_perfect AND open > 0 THEN 'MISMATCH' WHEN open > 0 THEN 'NOT FINISHED' WHEN unconfirmed > 0 THEN 'AWAITING CONFIRMATION' ELSE 'PERFECT' END AS status FROM c LEFT JOIN f USING (book_id))
SELECT status, count(*) AS n FROM s GROUP BY 1
""")
def delivery_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims of customers against their orders, counted by status."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("book_id"), (F.col("c_custkey") % 9 != 0).alias("started"), (F.col("c_custkey") % 2 == 0).alias("claimed_perfect"), F.lit("h").alias("claimed_hash"))
    f = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("book_id")).agg(F.count(F.lit(1)).alias("items"), F.count_if(F.col("o_orderstatus") == "O").alias("open"), F.count_if(F.col("o_orderstatus") == "P").alias("unconfirmed")).withColumn("readable", F.lit(True)).withColumn("hash", F.lit("h"))
    claims = c.join(f.select("book_id", F.col("items").alias("claimed_items")), "book_id", "left")
    return gate.delivery(claims, f).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT date_trunc('day', ts) AS day, event_type, count(*) AS n, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents FROM events GROUP BY ALL
""")
def event_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batch form of the streamed windows: events of each kind and day."""
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.date_trunc("day", "ts").alias("day"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents")).select(F.col("day").cast("timestamp_ntz").alias("day"), "event_type", "n", "cents")


@query("""
WITH v AS (SELECT o_custkey, o_orderpriority AS title, count(*) AS n, max(CAST(o_orderstatus = 'P' AS INTEGER)) AS listed FROM orders GROUP BY ALL),
m AS (SELECT *, max_by(title, (n, title)) OVER (PARTITION BY o_custkey) AS most, max(n) OVER (PARTITION BY o_custkey) AS top FROM v)
SELECT o_custkey, title FROM m QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN listed = 1 AND NOT (levenshtein(title, most) BETWEEN 1 AND 2 AND top > n) THEN 0 ELSE 1 END, n DESC, title) = 1
""")
def chosen_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One priority for each customer: a listed one wins unless it is nearly spelt as what most say."""
    o = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderpriority").alias("title"), F.when(F.col("o_orderstatus") == "P", "contents").otherwise("page").alias("source"))
    return statistics.choose_title(o, ["o_custkey"], "title", "source")


@query("""
SELECT n_nationkey, lower(n_name) AS key, levenshtein(lower(n_name), lower(r_name)) <= greatest(2, floor(greatest(length(n_name), length(r_name)) * 0.12)) AS close FROM nation JOIN region ON n_regionkey = r_regionkey
""")
def close_spellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    j = n.join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    return j.select("n_nationkey", F.lower("n_name").alias("key"), reconcile.close_spelling(F.lower("n_name"), F.lower("r_name")).alias("close"))
