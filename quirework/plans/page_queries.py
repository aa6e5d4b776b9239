"""Pages built of the driver's rows: order lines as regions, words of documents as runs of text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirework.functions import rects
from quirework.operators import contents, geometry, layout, review, verify
from quirework.operators import statistics as St
from quirework.plans.catalog import query
from quirework.session import table

#: The regions of a page, which is an order: one a line of it, numbered in the page, in SQL that both engines read.
REGIONS = """SELECT 'B' || CAST(l_orderkey % 7 AS STRING) AS book_id, CAST(l_orderkey AS INT) AS page, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS INT) AS k,
  CAST(l_partkey AS INT) AS part, CAST(l_suppkey AS INT) AS supp, l_discount * 5 AS l, l_quantity / 60 AS t, least(CAST(1 AS DOUBLE), l_discount * 5 + CAST(0.3 AS DOUBLE)) AS r, least(CAST(1 AS DOUBLE), l_quantity / 60 + CAST(0.05 AS DOUBLE) * l_linenumber) AS b FROM {}"""
_SQL = REGIONS.format("lineitem").replace("STRING", "VARCHAR")
#: Every part of 7 lines is a printed line as well, of a height of its own.
_LINES = f"(SELECT book_id, page, k, l, t + CAST(0.01 AS DOUBLE) AS t, r, least(CAST(1 AS DOUBLE), t + CAST(0.04 AS DOUBLE)) AS b FROM ({_SQL}) WHERE t < CAST(0.9 AS DOUBLE))"


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    table(spark, sf_dir, "lineitem").createOrReplaceTempView("_page_queries_lineitem")
    d = spark.sql(REGIONS.format("_page_queries_lineitem"))
    return d.select("book_id", "page", "k", "part", "supp", rects.rect(F.col("l"), F.col("t"), F.col("r"), F.col("b")).alias("rect"))


def page_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = F.col("rect")
    d = regions(spark, sf_dir).filter(r["top"] < 0.9)
    return d.select("book_id", "page", "k", rects.rect(r["left"], r["top"] + 0.01, r["right"], F.least(F.lit(1.0), r["top"] + 0.04)).alias("rect"))


@query(f"""
SELECT a.page, a.k AS "inner", b.k AS "outer" FROM ({_SQL}) a JOIN ({_SQL}) b ON a.page = b.page AND a.k <> b.k AND greatest(a.t, b.t) < least(a.b, b.b)
  AND a.l >= b.l - 0.005::DOUBLE AND a.t >= b.t - 0.005::DOUBLE AND a.r <= b.r + 0.005::DOUBLE AND a.b <= b.b + 0.005::DOUBLE
""")
def contained_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geometry.contained(regions(spark, sf_dir), ["page"], "k", "rect")


@query(f"""
SELECT x.page, x.k AS line, y.k AS region FROM {_LINES} x JOIN ({_SQL}) y ON x.page = y.page AND greatest(x.t, y.t) < least(x.b, y.b)
WHERE (x.l + x.r) / 2 >= y.l AND (x.l + x.r) / 2 <= y.r AND (least(x.b, y.b) - greatest(x.t, y.t)) * 2 >= greatest(x.b - x.t, 0)
""")
def lines_in_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = geometry.lines_in_regions(page_lines(spark, sf_dir), regions(spark, sf_dir), ["page"])
    return j.select(F.col("l_page").alias("page"), F.col("l_k").alias("line"), F.col("r_k").alias("region"))


@query(f"""
WITH e AS (SELECT *, 'top' AS side, t AS "at" FROM ({_SQL}) UNION ALL SELECT *, 'bottom', b FROM ({_SQL}))
SELECT x.page, x.k AS line, e.k AS region, side, CASE WHEN ("at" - x.t) / (x.b - x.t) < 0.5 THEN x.t ELSE x.b END AS suggested FROM {_LINES} x JOIN e ON x.page = e.page
WHERE ("at" - x.t) / (x.b - x.t) > 0.2::DOUBLE AND ("at" - x.t) / (x.b - x.t) < 0.8::DOUBLE AND x.l < e.r AND x.r > e.l
""")
def cut_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = geometry.cut_lines(page_lines(spark, sf_dir), regions(spark, sf_dir), ["page"])
    return j.select(F.col("a_page").alias("page"), F.col("a_k").alias("line"), F.col("b_k").alias("region"), F.col("b_side").alias("side"), "suggested")


@query(f"""
SELECT a.book_id, a.page AS a_page, a.k AS a_k, b.page AS b_page, b.k AS b_k FROM ({_SQL}) a JOIN ({_SQL}) b ON a.book_id = b.book_id AND a.supp = b.supp AND a.page < b.page
WHERE abs(a.l - b.l) <= 0.005::DOUBLE AND abs(a.t - b.t) <= 0.005::DOUBLE AND abs(a.r - b.r) <= 0.005::DOUBLE AND abs(a.b - b.b) <= 0.005::DOUBLE
""")
def same_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions of one supplier at one place of two pages of a book."""
    r = regions(spark, sf_dir)
    return geometry.same_place(r, r, ["book_id", "supp"]).filter("a_page < b_page").select(F.col("a_book_id").alias("book_id"), "a_page", "a_k", "b_page", "b_k")


@query(f"""
WITH o AS (SELECT *, row(page, floor(l * 2), t) AS place, lag(row(page, floor(l * 2), t)) OVER (PARTITION BY book_id, part ORDER BY page, k DESC) AS prev FROM ({_SQL}))
SELECT book_id, part, page, k FROM o WHERE prev IS NOT NULL AND place <= prev
""")
def continuation_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions of a part that don't come after the one before them."""
    d = regions(spark, sf_dir).withColumn("ord", F.struct("page", -F.col("k")))
    return geometry.region_order(d, ["book_id", "part"], "ord").select("book_id", "part", "page", "k")


#: Runs of text: a document's words, eight a row and a gap in the middle of a row of a page of two columns.
_WORDS = r"SELECT doc_id, i - 1 AS i, w[i] AS text FROM (SELECT doc_id, w, unnest(range(1, least(len(w), 200) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(text, '[A-Za-z]{2,}') AS w FROM documents))"


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 200 words of each document as text_items of a page of its own: even documents have two columns."""
    w = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.slice(F.regexp_extract_all("text", F.lit("[A-Za-z]{2,}"), 0), 1, 200)).alias("i", "text"))
    column, row, two = F.col("i") % 8, F.floor(F.col("i") / 8), F.col("doc_id") % 2 == 0
    left = F.lit(20.0) + column * 60 + F.when(two & (column >= 4), 80).otherwise(0)
    return w.select(
        F.lit("B").alias("book_id"), F.col("doc_id").cast("int").alias("page"), F.col("i").alias("item_idx"), "text", left.alias("left"), (left + 56).alias("right"), (100.0 + row * 20).alias("baseline"), F.lit(10.0).alias("font_size"),
        F.when(column == 3, 0.3).when(column == 4, 0.9).alias("ascent"), F.when(column == 5, -0.9).alias("descent"), (F.col("doc_id") % 3 == 0).alias("bold"),
    )


@query(f"""
SELECT CAST(doc_id AS INTEGER) AS page, CAST(i AS INTEGER) AS item_idx, 100 + i // 8 * 20 - CASE i % 8 WHEN 3 THEN 5.0 WHEN 4 THEN 9.0 ELSE 8.0 END::DOUBLE AS top, 100 + i // 8 * 20 + CASE i % 8 WHEN 5 THEN 5.0 ELSE 2.0 END::DOUBLE AS bottom FROM ({_WORDS})
""")
def run_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of runs of text: ascents and descents within their bounds."""
    d = layout.boxes(runs(spark, sf_dir))
    return d.select("page", "item_idx", F.round("top", 6).alias("top"), F.round("bottom", 6).alias("bottom"))


@query(f"""
WITH w AS (SELECT *, i // 8 AS row, i % 8 // 4 AS half, max(i) OVER (PARTITION BY doc_id) AS last FROM ({_WORDS})),
-- a page shows its gutter if it has six rows and more, and as many on both sides as the rule asks; a gap of 64 parts a row in any case
l AS (SELECT doc_id, row, CASE WHEN doc_id % 2 = 0 THEN half ELSE 0 END AS half, string_agg(text, ' ' ORDER BY i) AS text, last // 8 + 1 AS n_rows, last FROM w GROUP BY ALL),
c AS (SELECT *, doc_id % 2 = 0 AND n_rows >= 6 AND (last + 4) // 8 >= greatest(4, 0.25 * n_rows) AS columns FROM l)
SELECT CAST(doc_id AS INTEGER) AS page, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN columns THEN half ELSE 0 END, row, half) - 1 AS INTEGER) AS line_idx, text, CAST(CASE WHEN columns THEN half ELSE 0 END AS INTEGER) AS "column", doc_id % 3 = 0 AS bold, CAST(length(text) AS INTEGER) AS chars FROM c
""")
def text_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of text to rows, pieces, columns and lines in reading order."""
    r = runs(spark, sf_dir).withColumns({"ascent": F.lit(0.8), "descent": F.lit(-0.2)})
    pages = r.select("book_id", "page").distinct().withColumns({"width": F.lit(600.0), "height": F.lit(800.0)})
    return layout.lines_of(r, pages).select("page", "line_idx", "text", "column", "bold", "chars")


_FLAT = f"SELECT *, l < 0.25::DOUBLE AS narrow FROM ({_SQL})"


@query(f"""
WITH n AS (SELECT *, CASE WHEN t - lag(b) OVER w > 1.7::DOUBLE * greatest(b - t, 1e-6) OR lag(b) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM ({_FLAT}) WINDOW w AS (PARTITION BY page, narrow ORDER BY t, l, k))
SELECT page, k, CAST(sum(new) OVER (PARTITION BY page, narrow ORDER BY t, l, k) AS INTEGER) AS block FROM n
""")
def line_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of lines in a column: a wide gap begins a new one."""
    d = regions(spark, sf_dir).select("book_id", "page", F.col("k").alias("line_idx"), "rect.*").withColumn("column", F.col("left") < 0.25)
    return layout.blocks(d).select("page", F.col("line_idx").alias("k"), "block")


@query(f"""
WITH n AS (SELECT *, supp % 3 AS size, CASE WHEN supp % 3 = lag(supp % 3) OVER w AND t - lag(b) OVER w < 0.5::DOUBLE * (b - t) THEN 0 ELSE 1 END AS new FROM ({_SQL}) WINDOW w AS (PARTITION BY page ORDER BY t, l, k)),
g AS (SELECT *, sum(new) OVER (PARTITION BY page ORDER BY t, l, k) AS g FROM n)
SELECT page, string_agg('t' || part, ' ' ORDER BY t, l, k) AS text, min(t) AS top, max(b) AS bottom FROM g GROUP BY page, g
""")
def merged_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings of one size right under one another as one."""
    d = regions(spark, sf_dir).select("book_id", "page", "rect.top", (F.col("rect.left") + F.col("k") * 1e-9).alias("left"), "rect.bottom", (F.col("supp") % 3).cast("double").alias("font_size"), F.lit(0.9).alias("confidence"), F.concat(F.lit("t"), "part").alias("text"))
    return layout.merge_headings(d).select("page", "text", "top", "bottom")


@query(f"""
WITH RECURSIVE o AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY t, l, k) AS i FROM ({_SQL})),
f AS (SELECT page, i, k, t AS y1, b AS y2, 0 AS line FROM o WHERE i = 1
  UNION ALL SELECT page, i, k, CASE WHEN x THEN y1 ELSE t END, CASE WHEN x THEN y2 ELSE b END, CASE WHEN x THEN line ELSE line + 1 END
  FROM (SELECT o.*, f.y1, f.y2, f.line, least(o.b, f.y2) - greatest(o.t, f.y1) >= 0.5::DOUBLE * least(o.b - o.t, f.y2 - f.y1) AS x FROM f JOIN o ON o.page = f.page AND o.i = f.i + 1) n)
SELECT page, k, CAST(line AS INTEGER) AS row, CAST(count(*) OVER (PARTITION BY page, line) AS INTEGER) AS row_size FROM f
""")
def item_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = regions(spark, sf_dir).select("book_id", "page", "k", "rect.top", (F.col("rect.left") + F.col("k") * 1e-9).alias("left"), "rect.bottom")
    return review.item_rows(d).select("page", "k", "row", "row_size")


@query(f"""
WITH r AS (SELECT *, part % 20 AS text FROM ({_SQL}))
SELECT a.page, a.k, CAST(count(b.k) AS BIGINT) AS repeats FROM r a LEFT JOIN r b ON a.book_id = b.book_id AND a.text = b.text AND abs(a.page // 7 - b.page // 7) BETWEEN 1 AND 2 AND abs(a.t - b.t) <= 0.01::DOUBLE GROUP BY ALL
""")
def neighbour_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that stand at the same height on pages near by."""
    d = regions(spark, sf_dir).select("book_id", F.floor(F.col("page") / 7).cast("int").alias("sheet"), "page", "k", (F.col("part") % 20).alias("text"), F.col("rect.top").alias("top"))
    return St.neighbour_repeats(d, ["book_id"], F.col("text"), "sheet", "k", "top").select("page", "k", "repeats")


@query(f"""
WITH p AS (SELECT book_id, max(page) + 1 AS n FROM ({_SQL}) GROUP BY 1),
s AS (SELECT DISTINCT book_id, CAST(floor(unnest(range(0, least(n, 12))) * (n - 1) / (least(n, 12) - 1) + 0.5) AS INTEGER) AS page FROM p),
x AS (SELECT *, 'running ' || (supp % 4) AS key, b <= 0.14::DOUBLE OR t >= 0.86::DOUBLE AS band FROM ({_SQL})),
y AS (SELECT book_id, key FROM x JOIN s USING (book_id, page) WHERE band GROUP BY ALL HAVING count(DISTINCT page) >= 3)
SELECT x.page, x.k, x.band AND y.key IS NOT NULL AS header_footer FROM x LEFT JOIN y ON x.book_id = y.book_id AND x.key = y.key
""")
def header_footers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running lines by the keys of a sample of pages."""
    d = regions(spark, sf_dir).withColumn("text", F.concat(F.lit("Running "), F.col("supp") % 4))
    pages = d.groupBy("book_id").agg((F.max("page") + 1).alias("page_count"))
    return review.header_footer(d, pages, F.lower(F.col("text"))).select("page", "k", "header_footer")


@query(f"""
WITH x AS (SELECT *, 'a running head of suppliers ' || supp AS key FROM ({_SQL})),
y AS (SELECT book_id, key FROM x GROUP BY ALL HAVING count(DISTINCT page) >= 9),
z AS (SELECT x.*, y.key IS NOT NULL AS own FROM x LEFT JOIN y ON x.book_id = y.book_id AND x.key = y.key)
SELECT a.page, a.k, a.own OR EXISTS (SELECT 1 FROM z b WHERE b.own AND b.page = a.page AND greatest(a.t, b.t) < least(a.b, b.b)) AS running FROM z a
""")
def running_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running heads of all pages, and what stands beside one."""
    d = regions(spark, sf_dir).withColumn("line_idx", F.col("k"))
    return review.running_heads(d, F.concat(F.lit("a running head of suppliers "), F.col("supp")), 9).select("page", F.col("line_idx").alias("k"), "running")


@query(f"""
WITH i AS (SELECT page, k, supp, CASE WHEN part % 5 = 0 THEN 0 ELSE part % 11 + 1 END AS size FROM ({_SQL}) WHERE supp % 3 < 2), m AS (SELECT page, median(size) AS mid FROM i WHERE size > 0 GROUP BY 1)
SELECT i.page, k, CAST(CASE WHEN size > 0 THEN size ELSE mid END AS DOUBLE) AS font_size FROM i LEFT JOIN m ON m.page = i.page
""")
def upright_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs that stand upright, those without a size with their page's median."""
    size = F.when(F.col("part") % 5 == 0, 0.0).otherwise((F.col("part") % 11 + 1).cast("double"))
    d = regions(spark, sf_dir).withColumns({"font_size": size, "angle": (F.col("supp") % 3) * 0.1})
    return review.upright(d).select("page", "k", "font_size")


@query(f"""
SELECT part, CAST(count(*) AS BIGINT) AS n, CAST(sum(page) AS BIGINT) AS pages, CAST(sum(l) AS BIGINT) AS lefts FROM (SELECT DISTINCT part, page, floor(l * 100000 + 0.5) AS l, floor(t * 100000 + 0.5) AS t, floor(r * 100000 + 0.5) AS r, floor(b * 100000 + 0.5) AS b FROM ({_SQL}))
GROUP BY 1
""")
def union_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The regions of a part's rows, each once though every row tells it twice."""
    d = regions(spark, sf_dir).withColumn("regions", F.array(F.struct("page", "rect"), F.struct(F.col("page"), F.transform(F.array("rect"), lambda r: rects.shifted(r, F.lit(1e-9), F.lit(0.0)))[0].alias("rect"))))
    u = review.union_regions(d, ["part"], "regions").select("part", F.explode("regions").alias("r"))
    return u.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.sum("r.page").cast("decimal(38,0)").alias("pages"), F.sum(F.floor(F.col("r.rect.left") * 100000 + 0.5)).cast("decimal(38,0)").alias("lefts")).select("part", "n", F.col("pages").cast("long").alias("pages"), F.col("lefts").cast("long").alias("lefts"))


@query(f"SELECT page, k, CAST(i // 12 AS INTEGER) AS sheet, CAST(i % 12 // 4 AS INTEGER) AS row, CAST(i % 4 AS INTEGER) AS \"column\" FROM (SELECT page, k, row_number() OVER (PARTITION BY book_id, supp ORDER BY page, k) - 1 AS i FROM ({_SQL}))")
def sheet_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contact sheets of four by three pictures."""
    return review.sheet_plan(regions(spark, sf_dir), ["book_id", "supp"], ["page", "k"], 4, 3).select("page", "k", "sheet", "row", "column")


@query(f"SELECT DISTINCT book_id, CAST(unnest(range(greatest(page - 2, 0), page + 3)) AS INTEGER) AS page FROM ({_SQL}) WHERE supp % 10 = 0")
def pages_to_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify.pages_to_read(regions(spark, sf_dir).filter("supp % 10 = 0"))


@query(f"""
SELECT page, k, CAST(CASE WHEN supp % 4 < 3 THEN part - (supp % 4) * 5 ELSE part - 1 END AS INTEGER) AS index FROM (SELECT *, (SELECT 1) AS one FROM ({_SQL}))
""")
def printed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Printed page numbers as pages, by the offset of a book that has one."""
    d = regions(spark, sf_dir).select((F.col("supp") % 4).cast("string").alias("book_id"), "page", "k", F.col("part").alias("printed_page"))
    offsets = spark.createDataFrame([("0", 0), ("1", 5), ("2", 10)], "book_id string, offset int")
    return contents.page_index(d, offsets).select("page", "k", "index")


@query(f"""
WITH f AS (SELECT 'i' || part AS id, min('s' || supp) AS section, min('n' || part % 50) AS label, max(supp % 2 = 0) AS known FROM ({_SQL}) GROUP BY part),
w AS (SELECT page, k, CASE WHEN part % 3 = 0 THEN 'i' || part ELSE 'none' END AS id FROM ({_SQL}))
SELECT page, k, f.id AS found FROM w LEFT JOIN f ON f.id = w.id
""")
def frames_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames by their id."""
    d = regions(spark, sf_dir)
    frames = d.select(F.lit("B").alias("book_id"), F.concat(F.lit("i"), "part").alias("id"), F.lit(None).cast("string").alias("authority"), F.lit("s").alias("section"), F.lit("l").alias("label")).distinct()
    wanted = d.select(F.lit("B").alias("book_id"), "page", "k", F.when(F.col("part") % 3 == 0, F.concat(F.lit("i"), "part")).otherwise("none").alias("id"), F.lit("s").alias("section"), F.lit("l").alias("label"))
    return review.frame_of(wanted, frames).select("page", "k", "found")


@query("""
WITH c AS (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN CAST(p_partkey AS VARCHAR) END AS label, p_name || ' ' || p_partkey AS title, p_size FROM part WHERE p_partkey % 5 <> 0),
d AS (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN CAST(p_partkey AS VARCHAR) END AS label, p_name || ' ' || p_partkey AS title, CASE WHEN p_partkey % 3 = 0 THEN p_size + 1 ELSE p_size END AS p_size FROM part WHERE p_partkey % 7 <> 0),
k AS (SELECT *, coalesce(label, trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g'))) AS key FROM c), m AS (SELECT *, coalesce(label, trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g'))) AS key FROM d)
SELECT coalesce(k.key, m.key) AS key, CASE WHEN k.key IS NULL THEN 'new' WHEN m.key IS NULL THEN 'gone' WHEN k.p_size = m.p_size THEN 'same' ELSE 'changed' END AS state FROM k FULL JOIN m ON k.key = m.key
""")
def outline_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An outline against one derived anew."""
    p = table(spark, sf_dir, "part")
    base = p.select(F.lit("B").alias("book_id"), "p_partkey", F.when(F.col("p_partkey") % 2 == 0, F.col("p_partkey").cast("string")).alias("label"), F.concat_ws(" ", "p_name", F.col("p_partkey").cast("string")).alias("title"), F.col("p_size").alias("page"), F.lit(0).alias("depth"))
    derived = base.filter("p_partkey % 7 <> 0").withColumn("page", F.when(F.col("p_partkey") % 3 == 0, F.col("page") + 1).otherwise(F.col("page")))
    return review.outline_diff(base.filter("p_partkey % 5 <> 0"), derived).select("key", "state")


@query("""
WITH b AS (SELECT c_custkey, c_name || '|' || c_nationkey AS title, c_nationkey % 5 AS items, c_nationkey % 3 AS answered, c_custkey % 3 AS open, c_custkey % 2 AS unconfirmed, c_custkey % 6 = 0 AS perfect FROM customer),
s AS (SELECT *, CASE WHEN perfect THEN 'PERFECT' WHEN items = 0 THEN 'ZERO EXERCISES' WHEN open > 0 THEN 'NOT FINISHED' ELSE 'AWAITING CONFIRMATION' END AS status FROM b)
SELECT 'C' || c_custkey AS book_id, status, '| ' || concat_ws(' | ', replace(title, '|', chr(92) || '|'), items, answered, open, unconfirmed, status) || ' |' AS line FROM s
""")
def batch_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of a batch's report."""
    c = table(spark, sf_dir, "customer").withColumn("book_id", F.concat(F.lit("C"), "c_custkey"))
    books = c.select("book_id", F.concat("c_name", F.lit("|"), "c_nationkey").alias("title"))
    gates = c.select("book_id", (F.col("c_custkey") % 3).alias("open"), (F.col("c_custkey") % 2).alias("unconfirmed"), (F.col("c_custkey") % 6 == 0).alias("perfect"))
    sums = c.select("book_id", (F.col("c_nationkey") % 5).alias("items"), (F.col("c_nationkey") % 3).alias("answered"))
    return review.batch_index(books, gates, sums).select("book_id", "status", "line")


