"""Proposals over lines that the driver's rows spell out: contents, starts, labels, answers; pictures and files."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirework.functions import ink, rects
from quirework.operators import contents, layout, propose, validation
from quirework.plans.catalog import query
from quirework.plans.page_queries import _SQL as _REGIONS
from quirework.plans.page_queries import regions
from quirework.session import shared_dir, table
from quirework.sources import documents

_INLINE = "CASE p_partkey % 6 WHEN 0 THEN concat(p_size, '.', p_partkey % 9, ' Exercise: ', p_name) WHEN 1 THEN concat('Aufgabe ', p_size, '.2.1 ', p_name) WHEN 2 THEN concat('Solution ', p_size, '.', p_partkey % 9) WHEN 3 THEN concat('Problem ', p_size) WHEN 4 THEN concat(p_size, '.1 Exercised ', p_name) ELSE p_name END"


@query(rf"""
WITH l AS (SELECT p_partkey, {_INLINE} AS text FROM part),
r AS (SELECT p_partkey, regexp_extract(text, '^\s*(?i:Lösung|Solution|Answer|Solución)\s+(\d+(?:\.\d+)+)\b', 1) AS answer, regexp_extract(text, '^\s*(\d+(?:\.\d+)+)\s+(?i:Aufgabe|Exercise|Problem|Exercice|Ejercicio)\b', 1) AS a, regexp_extract(text, '^\s*(?i:Aufgabe|Exercise|Problem|Exercice|Ejercicio)\s+(\d+(?:\.\d+)+)\b', 1) AS b FROM l)
SELECT p_partkey, CASE WHEN answer <> '' THEN 'answer' ELSE 'item' END AS role, CASE WHEN answer <> '' THEN answer WHEN a <> '' THEN a ELSE b END AS label FROM r WHERE answer <> '' OR a <> '' OR b <> ''
""")
def inline_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items and answers that are labelled within the text."""
    d = table(spark, sf_dir, "part").select(F.lit("B").alias("book_id"), F.lit(0).alias("page"), F.col("p_partkey").alias("line_idx"), F.expr(_INLINE).alias("text"))
    return propose.labelled_inline(d).select(F.col("line_idx").alias("p_partkey"), "role", "label")


_KEY_LINE = "CASE p_partkey % 4 WHEN 0 THEN concat(p_size, ' - ', p_size + p_partkey % 70, '. see above') WHEN 1 THEN concat(p_size, '. ', p_name) WHEN 2 THEN concat(p_size + 2, ') ', p_name) ELSE p_name END"


@query(rf"""
WITH l AS (SELECT p_partkey, p_brand AS section, {_KEY_LINE} AS text, p_size AS page, p_retailprice AS top FROM part),
r AS (SELECT *, TRY_CAST(regexp_extract(text, '^\s*(\d{{1,4}})', 1) AS INTEGER) AS a, TRY_CAST(regexp_extract(text, '^\s*\d{{1,4}}\s*[-–]\s*(\d{{1,4}})[.):]', 1) AS INTEGER) AS b, regexp_matches(text, '^\s*\d{{1,4}}[.)]\s') AS single FROM l),
n AS (SELECT *, b IS NOT NULL AS by_range, unnest(CASE WHEN b IS NOT NULL AND b >= a AND b - a < 60 THEN range(a, b + 1) WHEN single THEN [a] ELSE [] END) AS n FROM r)
SELECT section, CAST(n AS INTEGER) AS n, page, top, by_range FROM n QUALIFY row_number() OVER (PARTITION BY section, n ORDER BY by_range, page, top) = 1
""")
def answered_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers that the lines of a key answer, alone or in ranges."""
    d = table(spark, sf_dir, "part").select(F.lit("B").alias("book_id"), F.col("p_brand").alias("section"), F.col("p_size").alias("page"), F.col("p_retailprice").alias("top"), F.expr(_KEY_LINE).alias("text"))
    return propose.answer_ranges(d).select("section", "n", "page", "top", "by_range")


@query("""
WITH s AS (SELECT p_partkey, 's' || p_partkey AS label, 'word' || p_partkey || ' other' || (p_partkey % 7) AS title FROM part WHERE p_partkey % 2 = 0),
b AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 's' || p_partkey END AS marker, 'word' || p_partkey || ' other' || (p_partkey % 7) AS title FROM part)
SELECT b.p_partkey AS block, s.label AS section, CASE WHEN marker IS NOT NULL THEN 'marker' ELSE 'title' END AS how FROM b JOIN s ON s.p_partkey = b.p_partkey
""")
def matched_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answer blocks with their sections, by marker or by the nearest title."""
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    title = F.concat(F.lit("word"), k, F.lit(" other"), k % 7)
    s = p.filter("p_partkey % 2 = 0").select(F.lit("B").alias("book_id"), F.concat(F.lit("s"), k).alias("label"), title.alias("title"))
    b = p.select(F.lit("B").alias("book_id"), k.alias("block"), F.when(k % 3 == 0, F.concat(F.lit("s"), k)).alias("marker"), title.alias("title"))
    return propose.match_blocks(b, s).select("block", "section", "how")


_TOC = "CASE p_partkey % 5 WHEN 0 THEN concat('Chapter ', p_size, ' ', p_name, ' ..... ', p_partkey % 900 + 1) WHEN 1 THEN concat(p_size, '.', p_partkey % 8 + 1, ' ', p_name, ' . . . . ', p_partkey % 900 + 1) WHEN 2 THEN concat(p_name, ' ...... ', p_partkey % 900 + 1) WHEN 3 THEN concat(p_size, ' ', p_name, ' ..... ', p_partkey % 900 + 1) ELSE p_name END"


@query(f"""
WITH l AS (SELECT p_partkey, p_partkey // 25 * 10 AS page, p_partkey % 5 AS k, p_name, p_size FROM part), f AS (SELECT * FROM l WHERE k < 4),
g AS (SELECT page FROM f GROUP BY 1 HAVING count(*) >= 3)
SELECT p_partkey, CASE k WHEN 1 THEN 'section' WHEN 2 THEN 'unnumbered' ELSE 'chapter' END AS kind, CASE k WHEN 1 THEN p_size || '.' || (p_partkey % 8 + 1) WHEN 2 THEN NULL ELSE CAST(p_size AS VARCHAR) END AS label, p_name AS title, CAST(p_partkey % 900 + 1 AS INTEGER) AS printed_page, true AS strong
FROM f JOIN g USING (page) WHERE page = (SELECT min(page) FROM g)
""")
def printed_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of the first contents page; later pages stand too far behind it."""
    k = F.col("p_partkey")
    d = table(spark, sf_dir, "part").select(F.lit("B").alias("book_id"), (F.floor(k / 25) * 10).cast("int").alias("page"), k.cast("int").alias("line_idx"), F.expr(_TOC).alias("text"))
    return contents.contents(d).select(F.col("line_idx").cast("long").alias("p_partkey"), "kind", "label", "title", "printed_page", "strong")


@query("""
WITH o AS (SELECT p_brand, p_partkey, CASE WHEN p_partkey % 6 = 0 THEN 0 ELSE 1 + (p_partkey % 6) // 5 END AS depth, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS idx FROM part),
c AS (SELECT *, count(*) FILTER (depth = 0) OVER (PARTITION BY p_brand ORDER BY idx) AS c FROM o),
s AS (SELECT *, count(*) FILTER (depth = 1) OVER (PARTITION BY p_brand, c ORDER BY idx) AS s FROM c)
SELECT p_partkey, CASE WHEN depth = 0 THEN CAST(c AS VARCHAR) WHEN depth = 1 AND c > 0 THEN c || '.' || s END AS label, 0 AS level FROM s
""")
def numbered_bookmarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bookmarks without numbers, numbered by their depth."""
    from pyspark.sql import Window

    k = F.col("p_partkey")
    o = table(spark, sf_dir, "part").select(F.col("p_brand").alias("book_id"), "p_partkey", F.when(k % 6 == 0, 0).otherwise(F.when(k % 6 == 5, 2).otherwise(1)).alias("depth"), F.col("p_name").alias("title"), F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey")).alias("idx"))
    return contents.number_bookmarks(o).select("p_partkey", "label", "level")


@query("""
SELECT 'S' || (p_partkey % 40) AS section, CAST(p_partkey // 40 AS INTEGER) + 1 AS n FROM part
""")
def section_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of a section among candidates, without those that stand a little to the right of its column."""
    k = F.col("p_partkey")
    base = table(spark, sf_dir, "part").select(F.lit("B").alias("book_id"), F.concat(F.lit("S"), k % 40).alias("section"), (F.floor(k / 40) + 1).cast("int").alias("n"), F.lit("").alias("suffix"), F.floor(k / 400).cast("int").alias("page"), (k % 400 / 400).alias("top"), F.lit(0.1).alias("left"))
    # the decoys' numbers are in the column too: one of each label stays
    decoys = base.filter("n % 7 = 3").withColumn("left", F.lit(0.15)).withColumn("n", F.col("n") + 1000)
    return propose.section_items(base.unionByName(decoys)).select("section", "n")


@query(f"""
WITH i AS (SELECT *, 'i' || page || '-' || k AS id, coalesce(CASE WHEN k % 2 = 0 THEN 'u' || supp END, 'i' || page || '-' || k) AS unit FROM ({_REGIONS})),
p AS (SELECT a.book_id, a.id AS a, b.id AS b, a.unit <> b.unit AS apart, a.l AS al, a.t AS at1, a.r AS ar, a.b AS ab, b.l AS bl, b.t AS bt, b.r AS br, b.b AS bb, greatest(least(a.r, b.r) - greatest(a.l, b.l), 0) AS w, greatest(least(a.b, b.b) - greatest(a.t, b.t), 0) AS h, least((a.r - a.l) * (a.b - a.t), (b.r - b.l) * (b.b - b.t)) AS area FROM i a JOIN i b ON a.page = b.page AND a.id <> b.id AND greatest(a.t, b.t) < least(a.b, b.b)),
f AS (SELECT book_id, id AS ref, 'thin-frame' AS code FROM i WHERE greatest(b - t, 0) < 0.02::DOUBLE
  UNION ALL SELECT book_id, a, 'overlap' FROM p WHERE a < b AND apart AND w > 0 AND ((w * h / area > 0.1::DOUBLE AND h >= 0.004::DOUBLE) OR (abs(al - bl) <= 0.001::DOUBLE AND abs(at1 - bt) <= 0.001::DOUBLE AND abs(ar - br) <= 0.001::DOUBLE AND abs(ab - bb) <= 0.001::DOUBLE))
  UNION ALL SELECT DISTINCT book_id, a, 'contained' FROM (SELECT DISTINCT book_id, a, b FROM p WHERE al >= bl - 0.005::DOUBLE AND at1 >= bt - 0.005::DOUBLE AND ar <= br + 0.005::DOUBLE AND ab <= bb + 0.005::DOUBLE))
SELECT DISTINCT book_id, ref, code, 'warning' AS severity FROM f
""")
def linted_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thin frames, and frames that lie over or in another."""
    d = regions(spark, sf_dir).withColumn("id", F.concat(F.lit("i"), "page", F.lit("-"), "k")).withColumn("unit", F.when(F.col("k") % 2 == 0, F.concat(F.lit("u"), "supp")))
    none = F.lit(None).cast(f"array<struct<page:int,rect:{rects.RECT}>>")
    return validation.lint(d.withColumn("context", none)).distinct()


@query("""
SELECT p_partkey, p_size AS first_n, CAST(p_size + 1 + p_partkey % 3 AS INTEGER) AS second_n, p_size || '. ' || p_name AS first_text, (p_size + 1 + p_partkey % 3) || '. of ' || p_size AS second_text FROM part
""")
def cells_of_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of two items cut at their rising numbers; a number that falls is text."""
    n = F.col("p_size")
    text = F.concat(n, F.lit(". "), "p_name", F.lit("  "), n + 1 + F.col("p_partkey") % 3, F.lit(". of "), n)
    d = table(spark, sf_dir, "part").select("p_partkey", layout.cells(text).alias("c"))
    return d.select("p_partkey", F.col("c")[0]["n"].alias("first_n"), F.col("c")[1]["n"].alias("second_n"), F.col("c")[0]["text"].alias("first_text"), F.col("c")[1]["text"].alias("second_text"))


_PIXELS = "(SELECT p_partkey, i, CASE (p_partkey * (1 + i // 8) + i) % 5 WHEN 0 THEN 0 WHEN 1 THEN 200 ELSE 255 END AS v FROM part, range(0, 32) AS x(i))"


@query(f"""
WITH r AS (SELECT p_partkey, i // 8 AS row, count(*) FILTER (v < 235) / 8.0 AS share, CAST(sum(CASE WHEN v < 170 THEN 1 << (7 - i % 8) ELSE 0 END) AS BIGINT) AS byte FROM {_PIXELS} GROUP BY ALL)
SELECT p_partkey, max(share) FILTER (row = 0)::DOUBLE AS top, max(share) FILTER (row = 3)::DOUBLE AS bottom, CAST(round(sum(share) * 100, 3) AS DOUBLE) AS ink, upper(string_agg(printf('%02x', byte), '' ORDER BY row)) AS bits FROM r GROUP BY 1
""")
def page_ink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ink profiles and maps of dark pixels of small pictures."""
    k = F.col("p_partkey")
    shade = lambda i: F.when((k * (1 + F.floor(i / 8)) + i) % 5 == 0, "00").when((k * (1 + F.floor(i / 8)) + i) % 5 == 1, "C8").otherwise("FF")
    pixels = F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(31)), shade), ""))
    d = table(spark, sf_dir, "part").select("p_partkey", pixels.alias("p"), F.lit(8).alias("w"), F.lit(4).alias("h"))
    made = d.select("p_partkey", ink.profiles("p", "w", "h").alias("profile"), ink.bit_maps("p", "w", "h").alias("bits"))
    total = F.aggregate("profile", F.lit(0.0), lambda a, x: a + x)
    return made.select("p_partkey", F.round(F.col("profile")[0], 9).alias("top"), F.round(F.col("profile")[399], 9).alias("bottom"), F.round(total, 3).alias("ink"), F.hex("bits").alias("bits"))


@query("SELECT CAST(c_custkey AS INTEGER) AS \"from\", CAST(c_custkey + c_nationkey AS INTEGER) AS \"to\", c_mktsegment AS kind, 2 AS revision FROM customer")
def listed_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Survey lists written as JSON, a file a nation, read again, and kept as the newest of two revisions."""
    k = F.col("c_custkey").cast("int")
    entry = F.struct(k.alias("from"), (k + F.col("c_nationkey")).alias("to"), F.col("c_mktsegment").alias("kind"))
    c = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.to_json(F.sort_array(F.collect_list(entry))).alias("value"))
    path = f"{shared_dir(spark)}/survey-{uuid.uuid4().hex}"
    c.select("value").write.option("maxRecordsPerFile", 1).text(path)
    read = documents.lists(spark, path, "from int, to int, kind string").select("from", "to", "kind")
    at = f"{shared_dir(spark)}/revisions-{uuid.uuid4().hex}"
    documents.snapshots(read.filter("`from` % 2 = 0"), at, 1)
    documents.snapshots(read, at, 2)
    kept = spark.read.parquet(at)
    return kept.join(kept.agg(F.max("revision").alias("newest")), F.col("revision") == F.col("newest")).select("from", "to", "kind", "revision")
