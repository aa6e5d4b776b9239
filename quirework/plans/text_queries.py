"""Lines of documents and pages: classes, repetitions, statistics, credits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quirework.functions import labels, lines
from quirework.operators import statistics as St
from quirework.plans.catalog import query
from quirework.session import table


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, line_idx, line): every line of every document."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", "source", F.posexplode(F.split("text", "\n")).alias("line_idx", "line"))


_LINES = "SELECT doc_id, source, CAST(i - 1 AS INTEGER) AS line_idx, ls[i] AS line FROM (SELECT doc_id, source, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, source, string_split(text, chr(10)) AS ls FROM documents))"
_KEY = r"trim(regexp_replace(regexp_replace(lower(line), '[0-9]+', '#', 'g'), '[ \t\n\v\f\r]+', ' ', 'g'))"


@query(f"SELECT source, {_KEY} AS key, count(DISTINCT doc_id) AS n_pages FROM ({_LINES}) WHERE {_KEY} <> '' GROUP BY ALL HAVING count(DISTINCT doc_id) >= 3")
def repeated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that at least three documents of a source share but for their numbers."""
    return St.repeated_keys(document_lines(spark, sf_dir), lines.header_key(F.col("line")), "doc_id", 3, ["source"])


@query(f"""
WITH l AS ({_LINES}), k AS (SELECT source, {_KEY} AS key FROM l WHERE {_KEY} <> '' GROUP BY ALL HAVING count(DISTINCT doc_id) >= 3)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (k.key IS NOT NULL) AS n_running FROM l LEFT JOIN k ON l.source = k.source AND {_KEY.replace('line', 'l.line')} = k.key GROUP BY doc_id
""")
def running_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of each document, and how many of them run through its source."""
    rows = document_lines(spark, sf_dir)
    key = lines.header_key(F.col("line"))
    keys = St.repeated_keys(rows, key, "doc_id", 3, ["source"])
    return St.mark_running_lines(rows, keys, key, ["source"]).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_lines"), F.count_if("header_footer").alias("n_running"))


_T = "trim(line)"


@query(rf"""
WITH c AS (SELECT doc_id, CASE
  WHEN (len(regexp_extract_all({_T}, '[A-Za-z]')) >= 3 AND len(regexp_extract_all({_T}, '[A-Z]')) * 5 >= len(regexp_extract_all({_T}, '[A-Za-z]')) * 4 AND regexp_matches({_T}, '^\d+\s|\s\d+$')) OR regexp_matches({_T}, '^\d{{1,4}}$') THEN 'furniture'
  WHEN regexp_matches({_T}, '^\(\d{{1,3}}(?:\.\d{{1,3}})?\)$') OR NOT regexp_matches({_T}, '[A-Za-z0-9À-ɏ]') THEN 'symbol'
  WHEN regexp_matches({_T}, '^(?i:chapter|section|part|appendix|kapitel|abschnitt|teil|chapitre|capítulo)\s+(?:\d+|[ivxlc]+)\b') THEN 'heading'
  WHEN regexp_matches({_T}, '^(?:\d{{1,4}}[a-z]?[.)](?:\D|$)|\((?:\d{{1,4}}[a-z]?|[a-z])\)|\d+\.\d+\.\d+(?:[^\d.]|$))') THEN 'item'
  WHEN regexp_matches({_T}, '^(?i:figure|fig\.|table|abbildung|abb\.|tabelle|figura|tableau)\s*\d') THEN 'caption'
  WHEN regexp_matches({_T}, '{lines.INSTRUCTION}') THEN 'instruction'
  ELSE 'text' END AS kind FROM ({_LINES}))
SELECT doc_id, kind, count(*) AS n FROM c GROUP BY ALL
""")
def line_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_lines(spark, sf_dir).select("doc_id", lines.line_class(F.col("line")).alias("kind")).groupBy("doc_id", "kind").agg(F.count(F.lit(1)).alias("n"))


@query("""
WITH g AS (SELECT p_brand, p_size // 2 AS mode, sum(length(p_name)) AS weight, min(p_partkey) AS f FROM part GROUP BY ALL)
SELECT p_brand, mode, CAST(weight AS BIGINT) AS weight FROM g QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY weight DESC, f) = 1
""")
def body_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The size of most text in each brand, sizes taken in steps of two."""
    size = F.floor(F.col("p_size") / 2).cast("int")
    return St.weighted_mode(table(spark, sf_dir, "part"), ["p_brand"], size, F.length("p_name"), F.col("p_partkey"))


@query("""
WITH g AS (SELECT p_brand, p_size, sum(length(p_name)) AS w FROM part GROUP BY ALL),
r AS (SELECT *, sum(w) OVER (PARTITION BY p_brand ORDER BY p_size) AS run, sum(w) OVER (PARTITION BY p_brand) AS total FROM g)
SELECT p_brand, min(p_size) AS weighted_median FROM r WHERE run * 2 >= total GROUP BY 1
""")
def weighted_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return St.weighted_median(table(spark, sf_dir, "part"), ["p_brand"], "p_size", F.length("p_name"))


@query("SELECT p_type, CAST(median(p_size) AS DOUBLE) AS median, list_sort(list(p_size))[CAST(count(p_size) // 2 + 1 AS BIGINT)] AS upper_median FROM part GROUP BY 1")
def two_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    return St.medians(table(spark, sf_dir, "part"), ["p_type"], "p_size")


@query("""
WITH r AS (SELECT l_orderkey, l_linenumber - row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS o FROM lineitem),
v AS (SELECT l_orderkey, CAST(o AS INTEGER) AS "offset", count(*) AS n_votes FROM r GROUP BY ALL),
b AS (SELECT *, sum(n_votes) OVER (PARTITION BY l_orderkey) AS n_rows, row_number() OVER (PARTITION BY l_orderkey ORDER BY n_votes DESC, abs("offset"), "offset") AS r FROM v)
SELECT l_orderkey, "offset", n_votes, CAST(n_rows AS BIGINT) AS n_rows FROM b WHERE r = 1 AND n_votes >= 3 AND n_votes * 100 >= n_rows * 40
""")
def offset_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far an order's line numbers are from their places, where most agree."""
    at = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    d = table(spark, sf_dir, "lineitem").withColumn("place", F.row_number().over(at))
    return St.offset_mode(d, ["l_orderkey"], F.col("l_linenumber"), F.col("place"))


@query(rf"""
WITH l AS (SELECT * FROM ({_LINES}) WHERE regexp_matches(line, '(?i)licen[sc]e|copyright|\(c\)|©|rights reserved|CC BY|creativecommons')),
f AS (
  SELECT doc_id, 'license' AS field, regexp_extract(line, '(creativecommons\.org/licenses/[a-z\-]+/[0-9.]+)', 1) AS value FROM l
  UNION ALL SELECT doc_id, 'license', regexp_extract(line, '\b(CC BY(?:-(?:NC|ND|SA))*(?: [0-9.]+)?)', 1) FROM l
  UNION ALL SELECT doc_id, 'license', regexp_extract(line, '((?:Apache|MIT|GNU General Public|GNU Lesser General Public|Mozilla Public) License)', 1) FROM l
  UNION ALL SELECT doc_id, 'rights', CASE WHEN regexp_matches(line, '(?i)all rights reserved') THEN 'all rights reserved' ELSE '' END FROM l
  UNION ALL SELECT doc_id, 'author', regexp_extract(line, '(?i)(?:copyright|\(c\)|©)\s*(?:\d{{4}}\s*)?(?:by\s+)?([A-Za-z][A-Za-z .]{{2,40}})', 1) FROM l)
SELECT field, value, count(DISTINCT doc_id) AS n_docs FROM f WHERE value <> '' GROUP BY ALL
""")
def credit_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the documents' lines say of licence, rights and author."""
    d = document_lines(spark, sf_dir).filter(F.col("line").rlike(r"(?i)licen[sc]e|copyright|\(c\)|©|rights reserved|CC BY|creativecommons"))
    f = d.select("doc_id", F.explode(lines.credits(F.col("line"))).alias("f")).select("doc_id", "f.field", "f.value")
    return f.distinct().groupBy("field", "value").agg(F.count(F.lit(1)).alias("n_docs"))


@query("""
WITH m AS (SELECT DISTINCT c_mktsegment AS message, c_nationkey AS section FROM customer WHERE c_acctbal < 0)
SELECT message, count(*) AS n_sections, array_to_string(list_sort(list(CAST(section AS VARCHAR)))[1:12], ', ') AS sections FROM m GROUP BY 1 HAVING count(*) >= 4
""")
def grouped_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").filter("c_acctbal < 0").select(F.col("c_mktsegment").alias("message"), F.col("c_nationkey").alias("section"))
    return St.grouped_messages(c, "message", "section")


@query("""
WITH n AS (SELECT user_id, event_id, event_type, event_type IS DISTINCT FROM lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) OR lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) IS NULL AS new FROM events),
r AS (SELECT *, sum(CAST(new AS INTEGER)) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM n)
SELECT user_id, event_type, min(event_id) AS first, max(event_id) AS last FROM r GROUP BY user_id, event_type, run
""")
def value_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of one kind among a user's events, as runs of pages of one size."""
    return St.value_ranges(table(spark, sf_dir, "events"), ["user_id"], "event_id", "event_type")


@query("""
WITH m AS (SELECT l_orderkey, l_returnflag AS style, l_linenumber AS o, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber, l_quantity) AS pl FROM lineitem),
n AS (SELECT *, CASE WHEN o = lag(o, 1, -1000000000) OVER (PARTITION BY l_orderkey, style ORDER BY pl) + 1 THEN 0 ELSE 1 END AS new FROM m),
r AS (SELECT *, sum(new) OVER (PARTITION BY l_orderkey, style ORDER BY pl) AS run FROM n),
g AS (SELECT l_orderkey, style, run, count(*) AS length, min(o) AS first_ordinal, min(pl) AS pl FROM r GROUP BY ALL)
SELECT l_orderkey, style, first_ordinal, length FROM g QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY length DESC, CASE style WHEN 'A' THEN 1 WHEN 'N' THEN 2 WHEN 'R' THEN 3 ELSE 99 END, pl) = 1
""")
def part_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best rising run of markers of each order, return flags being styles."""
    d = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_returnflag").alias("style"), "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    return St.rising_runs(d, ["l_orderkey"], "style", ["l_partkey", "l_suppkey", "l_linenumber", "l_quantity"], "l_linenumber", {"A": 1, "N": 2, "R": 3})


@query(r"""
SELECT p_partkey, regexp_replace(trim(p_name), '\s+', ' ', 'g') || ' ' || p_size || '.' AS raw, regexp_replace(trim(p_name), '\s+', ' ', 'g') || ' ' || p_size AS label FROM part
""")
def normalized_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.regexp_replace(F.trim("p_name"), r"\s+", " "), F.lit(" "), F.col("p_size").cast("string"), F.lit("."))
    return table(spark, sf_dir, "part").select("p_partkey", raw.alias("raw"), labels.normalized(raw).alias("label"))


@query("""
SELECT p_partkey, array_to_string(list_sort(list_distinct(list_concat(range(p_size, p_size + 4), [CAST(p_partkey % 9000 AS BIGINT)]))), ',') AS named FROM part
""")
def named_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The numbers that an instruction names: a range and one more."""
    text = F.concat(F.lit("In Exercises "), F.col("p_size").cast("string"), F.lit(" - "), (F.col("p_size") + 3).cast("string"), F.lit(" and "), (F.col("p_partkey") % 9000).cast("string"), F.lit(", find x."))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(F.transform(labels.named_numbers(text), lambda x: x.cast("string")), ",").alias("named"))


@query(r"""
WITH h AS (SELECT page_id, regexp_extract(html, '<h1[^>]*>([^<]*)</h1>', 1) AS h FROM pages)
SELECT page_id, trim(regexp_replace(h, '\s+', ' ', 'g')) AS heading, least(1.0, 0.6 + CASE WHEN len(string_split(trim(regexp_replace(h, '\s+', ' ', 'g')), ' ')) <= 8 THEN 0.1 ELSE 0 END) >= 0.55 AS accepted FROM h WHERE h <> ''
""")
def page_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First headings of web pages, accepted by size and brevity."""
    h = F.regexp_extract("html", r"<h1[^>]*>([^<]*)</h1>", 1)
    t = F.trim(F.regexp_replace(h, r"\s+", " "))
    score = F.least(F.lit(1.0), F.lit(0.6) + F.when(F.size(F.split(t, " ")) <= 8, 0.1).otherwise(0.0))
    return table(spark, sf_dir, "pages").filter(h != "").select("page_id", t.alias("heading"), (score >= 0.55).alias("accepted"))
