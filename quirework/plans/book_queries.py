"""Books built of the driver's rows: items with sections, labels and answers, their checks, notes and files."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirework import schemas
from quirework.functions import rects
from quirework.operators import census, contents, gate, operations, validation, verify
from quirework.plans.catalog import query
from quirework.plans.page_queries import _SQL as _REGIONS
from quirework.plans.page_queries import regions as page_regions
from quirework.session import shared_dir, table
from quirework.sources import documents

#: An item for each region, in SQL that both engines read.
_ITEM = """'p' || page || 'k' || k AS id, 's' || (supp % 20) AS section, CAST(part % 500 AS {s}) || CASE WHEN k = 6 THEN 'a' WHEN k = 7 THEN '.x' ELSE '' END AS label,
  CASE WHEN k < 5 THEN 'book' END AS authority, 'exercise' AS kind, part % 3 <> 0 AS has_answer, CASE WHEN part % 4 < 2 THEN 'c' || (supp % 3) END AS context_key"""
_ITEMS = f"(SELECT *, {_ITEM.format(s='VARCHAR')} FROM ({_REGIONS}))"
_SECTIONS = "(SELECT 'B' || b AS book_id, 's' || s AS section, CASE WHEN s % 2 = 0 THEN 0 ELSE 300 END AS first_page, CASE WHEN s % 2 = 0 THEN 10000000 ELSE 4000 END AS last_page FROM range(0, 7) AS x(b), range(0, 18) AS y(s))"


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = page_regions(spark, sf_dir)
    made = [F.expr(x) for x in _ITEM.format(s="STRING").replace("\n", " ").split(", ") if x]
    return d.select("*", F.col("rect.left").alias("left"), F.col("rect.top").alias("top"), *made)


def sections(spark: SparkSession) -> DataFrame:
    b = spark.range(7).select(F.concat(F.lit("B"), "id").alias("book_id"))
    s = spark.range(18).select("id", F.concat(F.lit("s"), "id").alias("label"))
    odd = F.col("id") % 2 == 1
    # 126 rows: every book has the same sections
    return b.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(17)))).join(s, F.col("s") == F.col("id")).select("book_id", "label", F.when(odd, 300).otherwise(0).alias("page"), F.when(odd, 4000).otherwise(10_000_000).alias("end_page"))


def _parts(i: DataFrame) -> DataFrame:
    """Every item's region, with its unit, role and place."""
    return i.select("book_id", "page", "id", F.when(F.col("k") % 2 == 0, F.concat(F.lit("u"), "supp")).alias("unit"), F.lit("item").alias("role"), F.col("k").alias("ord"), "rect")


_N = "CASE WHEN regexp_matches(label, '^[0-9]') THEN CAST(regexp_extract(label, '^([0-9]+)', 1) AS BIGINT) END"
#: The findings of the checks by number, place and authority, without their places.
_FOUND = f"""
i AS (SELECT *, {_N} AS n, regexp_matches(label, '^[0-9]+$') AS bare, (l, t, r, b) AS q, coalesce(CASE WHEN k % 2 = 0 THEN 'u' || supp END, id) AS unit FROM {_ITEMS}),
s AS {_SECTIONS},
o AS (SELECT a.book_id, a.id, a.page, greatest(least(a.r, b.r) - greatest(a.l, b.l), 0) AS w, greatest(least(a.b, b.b) - greatest(a.t, b.t), 0) AS h, least((a.r - a.l) * (a.b - a.t), (b.r - b.l) * (b.b - b.t)) AS area,
  abs(a.l - b.l) <= 0.001::DOUBLE AND abs(a.t - b.t) <= 0.001::DOUBLE AND abs(a.r - b.r) <= 0.001::DOUBLE AND abs(a.b - b.b) <= 0.001::DOUBLE AS same FROM i a JOIN i b ON a.page = b.page AND a.id < b.id AND a.unit <> b.unit),
sizes AS (SELECT page, count(DISTINCT id) AS n FROM i GROUP BY 1),
c AS (SELECT book_id, section, count(*) AS n, count(*) FILTER (has_answer) AS got FROM i GROUP BY ALL),
d AS (SELECT DISTINCT book_id, section, n FROM i WHERE bare AND n IS NOT NULL), e AS (SELECT *, lead(n) OVER (PARTITION BY book_id, section ORDER BY n) AS nx FROM d),
m AS (SELECT book_id, section, median(n) AS mid FROM i WHERE bare GROUP BY ALL),
x AS (SELECT *, lag(context_key) OVER w AS before, lead(context_key) OVER w AS after FROM i WINDOW w AS (PARTITION BY book_id, section ORDER BY page, t, id)),
f AS (
  SELECT book_id, CASE WHEN same THEN 'duplicate-region' ELSE 'overlap' END AS code, 'error' AS severity, id AS ref, page FROM o WHERE w > 0 AND h > 0 AND (same OR (w * h / area > 0.05::DOUBLE AND h >= 0.004::DOUBLE))
  UNION SELECT book_id, 'region-size', 'warning', id, page FROM i JOIN sizes USING (page) WHERE k % 2 = 1 AND ((sizes.n > 1 AND b - t > 0.45::DOUBLE) OR r - l < 0.05::DOUBLE OR greatest(r - l, 0) * greatest(b - t, 0) < 0.002::DOUBLE)
  UNION SELECT i.book_id, CASE WHEN s.section IS NULL THEN 'section-unknown' ELSE 'section-page' END, 'error', i.section || ':' || label, page FROM i LEFT JOIN s ON s.book_id = i.book_id AND s.section = i.section WHERE s.section IS NULL OR page < first_page OR page > last_page
  UNION SELECT book_id, 'gap', 'warning', section || ':' || (n + 1), NULL FROM e WHERE nx - n > 1
  UNION SELECT book_id, 'duplicate', 'error', section || ':' || label, NULL FROM i GROUP BY book_id, section, label HAVING count(*) > 1
  UNION SELECT i.book_id, 'label-outlier', 'warning', i.section || ':' || label, page FROM i JOIN m ON m.book_id = i.book_id AND m.section = i.section WHERE bare AND n > mid * 3
  UNION SELECT book_id, 'no-solution', 'warning', section, NULL FROM c WHERE got * 100 < n * 80
  UNION SELECT book_id, 'stray-frame', 'warning', id, page FROM i WHERE authority IS NULL
  UNION SELECT book_id, CASE WHEN before IS NOT NULL AND before IS NOT DISTINCT FROM after AND context_key IS DISTINCT FROM before THEN 'context-inconsistent' ELSE 'context-group-end' END, 'warning', section || ':' || label, page FROM x
    WHERE (before IS NOT NULL AND before IS NOT DISTINCT FROM after AND context_key IS DISTINCT FROM before) OR (context_key IS NULL AND before IS NOT NULL AND after IS NULL))"""
_PLACED = ("overlap", "duplicate-region", "region-size", "section-unknown", "section-page", "gap", "duplicate", "label-outlier", "no-solution", "stray-frame", "context-inconsistent", "context-group-end")
_RANKS = ", ".join(f"'{c}'" for c in verify.CODES)


@query(f"""
WITH {_FOUND}
SELECT book_id, code, severity, ref, CAST(page AS INTEGER) AS page, CAST(row_number() OVER (PARTITION BY book_id ORDER BY list_position(['error', 'warning', 'info'], severity), list_position([{_RANKS}], code), page NULLS LAST, ref) AS INTEGER) AS place FROM f
""")
def verify_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every check that items, regions and sections allow, joined and in order; the rising order of labels has its own query."""
    i = items(spark, sf_dir)
    return verify.verify(i, _parts(i), sections(spark), codes=_PLACED)


@query(f"""
WITH RECURSIVE i AS (SELECT *, {_N} AS n, regexp_matches(label, '^[0-9]+$') AS bare FROM {_ITEMS}),
w AS (SELECT *, coalesce(CAST(l - lag(l) OVER (PARTITION BY book_id, section, page ORDER BY l, t, id) > 0.08::DOUBLE AS INTEGER), 0) AS o FROM i WHERE bare),
c AS (SELECT *, sum(o) OVER (PARTITION BY book_id, section, page ORDER BY l, t, id ROWS UNBOUNDED PRECEDING) AS island FROM w),
p AS (SELECT *, row_number() OVER (PARTITION BY book_id, section, page, island ORDER BY t, id) AS pl FROM c),
f AS (SELECT book_id, section, page, island, pl, n, [pl] AS places FROM p UNION ALL SELECT p.book_id, p.section, p.page, p.island, p.pl, p.n, list_append(f.places, p.pl) FROM f JOIN p ON p.page = f.page AND p.section = f.section AND p.island = f.island AND p.pl > f.pl AND p.n >= f.n),
b AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY page, section, island ORDER BY len(places) DESC, places) = 1)
SELECT p.book_id, 'order' AS code, 'warning' AS severity, p.section || ':' || label AS ref, p.page FROM p JOIN b ON b.page = p.page AND b.section = p.section AND b.island = p.island WHERE NOT list_contains(b.places, p.pl)
""")
def verify_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels that break the rise of their column."""
    i = items(spark, sf_dir)
    return verify.check_sequences(i, sections(spark)).filter("code = 'order'")


_TEXTS = f"(SELECT *, CASE k WHEN 1 THEN label || '. text' WHEN 2 THEN 'no ' || label WHEN 3 THEN label || 'x text' WHEN 4 THEN '(' || label || ') text' WHEN 5 THEN 'HEAD OF A PAGE 12' ELSE '9. other' END AS text FROM {_ITEMS})"


def _lines(i: DataFrame) -> DataFrame:
    text = "CASE k WHEN 1 THEN label || '. text' WHEN 2 THEN 'no ' || label WHEN 3 THEN label || 'x text' WHEN 4 THEN '(' || label || ') text' WHEN 5 THEN 'HEAD OF A PAGE 12' ELSE '9. other' END"
    r = F.col("rect")
    line = rects.rect(r["left"], r["top"] + 0.01, r["right"], F.least(F.lit(1.0), r["top"] + 0.04))
    return i.filter(r["top"] < 0.9).select("book_id", "page", F.col("k").alias("line_idx"), F.expr(text).alias("text"), line.alias("rect"), F.lit(False).alias("header_footer"))


@query(f"""
WITH i AS (SELECT * FROM {_TEXTS}), x AS (SELECT page, k, text, l, r, t + 0.01::DOUBLE AS t, least(1::DOUBLE, t + 0.04::DOUBLE) AS b FROM i WHERE t < 0.9::DOUBLE),
j AS (SELECT y.id, x.text, x.k FROM x JOIN i y ON x.page = y.page AND greatest(x.t, y.t) < least(x.b, y.b) WHERE (x.l + x.r) / 2 >= y.l AND (x.l + x.r) / 2 <= y.r AND (least(x.b, y.b) - greatest(x.t, y.t)) * 2 >= greatest(x.b - x.t, 0)),
g AS (SELECT id, arg_min(text, k) AS first FROM j GROUP BY 1),
h AS (SELECT i.*, first, regexp_replace(first, '^\\(', '') AS plain, first IS NULL AS empty FROM i LEFT JOIN g ON g.id = i.id WHERE k = 1 OR k = 2),
s AS (SELECT *, starts_with(plain, label) AND NOT regexp_matches(substr(plain, length(label) + 1, 1), '[\\p{{L}}\\p{{N}}]') AS starts FROM h),
c AS (SELECT *, CASE WHEN empty THEN 'no-text' WHEN starts_with(first, label) AND NOT starts THEN 'label-in-word' WHEN NOT starts AND regexp_matches(label, '\\d') THEN 'label-not-first' END AS code FROM s)
SELECT book_id, code, CASE code WHEN 'label-not-first' THEN 'error' ELSE 'warning' END AS severity, section || ':' || label AS ref, page FROM c WHERE code IS NOT NULL
""")
def verify_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the text of an item's region begins with its label; the first two regions of a page are items'."""
    i = items(spark, sf_dir)
    parts = _parts(i.filter("k <= 2")).withColumn("ord", F.lit(0))
    return verify.check_text(verify.region_texts(_lines(i), parts), i)


@query(f"""
WITH i AS (SELECT *, {_N} AS n FROM {_ITEMS}),
x AS (SELECT book_id, section, id AS item_id, 'In exercises ' || (part % 90) || ' - ' || (part % 90 + 30) || ', show it.' AS text, part % 90 AS lo, part % 90 + 30 AS hi, k % 2 = 0 AS attached FROM i WHERE supp % 5 = 0),
u AS (SELECT DISTINCT book_id, section, text, unnest(range(lo, hi + 1)) AS n FROM x),
w AS (SELECT i.book_id, 'context-range' AS code, i.section || ':' || label AS ref, page FROM x JOIN i ON i.book_id = x.book_id AND i.section = x.section AND i.id = x.item_id WHERE attached AND NOT coalesce(n BETWEEN lo AND hi, false) AND n IS NOT NULL),
v AS (SELECT i.book_id, 'context-missing' AS code, i.section || ':' || label AS ref, page FROM u JOIN i ON i.book_id = u.book_id AND i.section = u.section AND i.n = u.n WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.attached AND x.item_id = i.id AND x.text = u.text AND x.section = u.section AND x.book_id = u.book_id))
SELECT book_id, code, ref, page, CAST(count(*) AS BIGINT) AS n FROM (SELECT * FROM w UNION ALL SELECT * FROM v) GROUP BY ALL
""")
def verify_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instructions that name numbers, against the items that they are attached to."""
    i = items(spark, sf_dir)
    low = F.col("part") % 90
    x = i.filter("supp % 5 = 0").select("book_id", "section", F.col("id").alias("item_id"), F.concat(F.lit("In exercises "), low, F.lit(" - "), low + 30, F.lit(", show it.")).alias("text"), (F.col("k") % 2 == 0).alias("attached"))
    return verify.check_context(x, i).groupBy("book_id", "code", "ref", "page").agg(F.count(F.lit(1)).alias("n"))


@query(f"""
WITH g AS (SELECT *, lag(b) OVER (PARTITION BY book_id, part, page ORDER BY t) AS e FROM (SELECT *, t AS tt FROM ({_REGIONS})))
SELECT DISTINCT g.book_id, 'i' || g.part AS ref, g.page FROM g JOIN (SELECT page, l, r, t + 0.01::DOUBLE AS t, least(1::DOUBLE, t + 0.04::DOUBLE) AS b FROM ({_REGIONS}) WHERE t < 0.9::DOUBLE) x ON x.page = g.page
WHERE e < g.t AND greatest(x.t, e) < least(x.b, g.t) AND (x.t + x.b) / 2 > e AND (x.t + x.b) / 2 < g.t AND (x.l + x.r) / 2 >= g.l AND (x.l + x.r) / 2 <= g.r
""")
def verify_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text between two regions of one item of a page."""
    i = items(spark, sf_dir)
    parts = i.select("book_id", "page", F.concat(F.lit("i"), "part").alias("id"), F.lit("item").alias("role"), "rect")
    return verify.check_spans(_lines(i), parts).select("book_id", "ref", "page")


@query(f"SELECT book_id, 'i' || part AS ref, CAST(max(page) AS INTEGER) AS page, CAST(count(*) AS BIGINT) AS n FROM ({_REGIONS}) GROUP BY book_id, part HAVING count(*) > 4")
def verify_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of more regions than they may have, here four."""
    i = items(spark, sf_dir).withColumn("id", F.concat(F.lit("i"), "part"))
    found = verify.check_limits(_parts(i), 4)
    n = i.groupBy("book_id", F.col("id").alias("ref")).agg(F.count(F.lit(1)).alias("n"))
    return found.join(n, ["book_id", "ref"]).select("book_id", "ref", "page", "n")


@query(f"""
WITH a AS (SELECT *, {_N} AS n FROM {_ITEMS} WHERE part % 3 <> 0), m AS (SELECT book_id, page AS mp, t AS mt, id AS mid, 's' || (supp % 20) AS mark FROM {_ITEMS} WHERE part % 3 = 0 AND k = 1)
SELECT a.book_id, a.section || ':' || label AS ref, a.page, mark FROM a ASOF JOIN (SELECT book_id, mp * 10 + mt AS at, mark FROM m) m ON a.book_id = m.book_id AND a.page * 10 + a.t >= m.at WHERE mark <> a.section
""")
def answer_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers under the marker of another section than their own."""
    i = items(spark, sf_dir)
    marks = i.filter("part % 3 = 0 AND k = 1").select("book_id", "page", "top", "section")
    from quirework.operators.trees import locate

    a = i.filter("part % 3 <> 0").select("book_id", "section", "label", "page", "top")
    d = locate(a, marks.withColumnRenamed("section", "mark"), ["book_id"], ["page", "top"], "mark")
    own = d.filter("located IS NOT NULL AND located <> section").select("book_id", F.concat_ws(":", "section", "label").alias("ref"), "page", F.col("located").alias("mark"))
    found = verify.check_key(a, marks).filter("code = 'solution-section-mismatch'").select("book_id", "ref", "page").distinct()
    return own.join(found, ["book_id", "ref", "page"], "left_semi").select("book_id", "ref", "page", "mark")


_BAD = """SELECT *, CASE WHEN part % 13 = 0 THEN 'bad id!' WHEN part % 13 = 1 THEN 'twice' || supp ELSE id END AS fid, CASE WHEN part % 11 = 0 THEN 'drawing' WHEN part % 11 = 1 THEN 'question' ELSE 'exercise' END AS fkind,
  CASE WHEN part % 7 = 0 THEN 'book' WHEN part % 7 = 1 THEN 'nobody' END AS fauthority, CASE WHEN part % 5 = 0 THEN 'u' || page END AS funit, CASE WHEN part % 3 = 0 THEN section END AS fsection, CASE WHEN part % 4 = 0 THEN label || '.' WHEN part % 4 = 1 THEN label END AS flabel"""


@query(f"""
WITH x AS ({_BAD} FROM {_ITEMS}), f AS (SELECT *, count(*) OVER (PARTITION BY book_id, fid) AS same, fkind = 'exercise' AS ex, fauthority IS NOT NULL AS auth FROM x),
c AS (SELECT fid, book_id, unnest(list_filter([
  CASE WHEN fid = 'bad id!' THEN 'bad-id' END, CASE WHEN same > 1 THEN 'duplicate-id' END, CASE WHEN fkind = 'drawing' THEN 'bad-kind' END, CASE WHEN auth AND fauthority <> 'book' THEN 'bad-authority' END, CASE WHEN funit IS NOT NULL AND NOT ex THEN 'unit-not-exercise' END,
  CASE WHEN auth AND NOT ex THEN 'authority-not-exercise' END, CASE WHEN auth AND funit IS NOT NULL THEN 'authority-unit' END,
  CASE WHEN auth THEN CASE WHEN flabel IS NULL THEN 'label-missing' WHEN flabel LIKE '%.' THEN 'label-style' END END, CASE WHEN auth AND fsection IS NULL THEN 'section-missing' END,
  CASE WHEN NOT auth AND flabel IS NOT NULL THEN 'label-without-authority' END, CASE WHEN NOT auth AND fsection IS NOT NULL THEN 'section-without-authority' END, CASE WHEN page >= 50000 THEN 'page-out-of-range' END,
  CASE WHEN l >= r OR t >= b THEN 'rect-inverted' WHEN r - l < 0.02::DOUBLE OR b - t < 0.01::DOUBLE THEN 'rect-too-small' END], lambda x: x IS NOT NULL)) AS code FROM f)
SELECT book_id, fid AS ref, code, CASE code WHEN 'label-style' THEN 'repair' ELSE 'error' END AS severity, CAST(count(*) AS BIGINT) AS n FROM c GROUP BY ALL
""")
def validate_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules of frames over frames that break them."""
    i = items(spark, sf_dir).select("*", *[F.expr(x) for x in _BAD.removeprefix("SELECT *, ").replace("\n ", "").split(", ")])
    none = F.lit(None).cast(f"array<{schemas.REGION}>")
    frames = i.select("book_id", F.col("fid").alias("id"), F.col("fkind").alias("kind"), "page", "rect", F.col("funit").alias("unit"), none.alias("continues"), none.alias("context"), none.alias("solution"), F.col("fauthority").alias("authority"), F.col("flabel").alias("label"), F.col("fsection").alias("section"))
    books = frames.select("book_id").distinct().withColumn("page_count", F.lit(50_000))
    return validation.check_frames(frames, books).groupBy("book_id", "ref", "code", "severity").agg(F.count(F.lit(1)).alias("n"))


@query("""
WITH f AS (SELECT user_id, 'U' || user_id AS book_id, user_id % 40 + 1 AS page_count FROM (SELECT DISTINCT user_id FROM events)),
r AS (SELECT 'U' || user_id AS book_id, CAST(event_id % 50 AS INTEGER) AS a, CAST(event_id % 50 + event_id % 4 AS INTEGER) AS b, event_type AS kind FROM events WHERE event_id % 7 = 0),
e AS (SELECT r.*, page_count, b >= page_count AS bad FROM r JOIN f USING (book_id)),
n AS (SELECT book_id, unnest(range(a, b + 1)) AS page, kind FROM e WHERE NOT bad), g AS (SELECT book_id, page, count(*) AS n, bool_or(kind IN ('click', 'view')) AS wi, bool_or(kind IN ('view', 'purchase')) AS wa FROM n GROUP BY ALL),
t AS (SELECT 'U' || user_id AS book_id, event_id % 50 AS page, bool_or(event_id % 3 < 2) AS it, bool_or(event_id % 3 = 2) AS an FROM events GROUP BY ALL),
p AS (SELECT book_id, unnest(range(0, page_count)) AS page FROM f),
j AS (SELECT p.book_id, p.page, n, coalesce(wi, false) AS wi, coalesce(wa, false) AS wa, coalesce(it, false) AS it, coalesce(an, false) AS an FROM p LEFT JOIN g ON g.book_id = p.book_id AND g.page = p.page LEFT JOIN t ON t.book_id = p.book_id AND t.page = p.page),
c AS (SELECT book_id, page, unnest(list_filter([CASE WHEN n IS NULL THEN 'survey-missing' END, CASE WHEN n > 1 THEN 'survey-overlap' END, CASE WHEN n = 1 AND ((wi AND NOT it) OR (wa AND NOT an)) THEN 'survey-uncovered' END, CASE WHEN n = 1 AND ((NOT wi AND it) OR (NOT wa AND an)) THEN 'survey-unmarked' END], lambda x: x IS NOT NULL)) AS code FROM j)
SELECT book_id, CAST(page AS INTEGER) AS page, code, CAST(count(*) AS BIGINT) AS n FROM (SELECT * FROM c UNION ALL SELECT book_id, a, 'survey-range' FROM e WHERE bad) GROUP BY ALL
""")
def survey_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Surveyed ranges of pages against what stands on the pages; clicks are exercises, purchases answers, views both."""
    e = table(spark, sf_dir, "events").withColumn("book_id", F.concat(F.lit("U"), "user_id"))
    books = e.select("book_id", (F.col("user_id") % 40 + 1).cast("int").alias("page_count")).distinct()
    kind = F.when(F.col("event_type") == "click", "exercises").when(F.col("event_type") == "purchase", "answers").when(F.col("event_type") == "view", "both").otherwise("text")
    first = (F.col("event_id") % 50).cast("int")
    r = e.filter("event_id % 7 = 0").select("book_id", first.alias("from"), (first + F.col("event_id") % 4).cast("int").alias("to"), kind.alias("kind"))
    there = e.select("book_id", first.alias("page"), F.when(F.col("event_id") % 3 < 2, "item").otherwise("answer").alias("role"))
    return gate.survey(r, there, books).groupBy("book_id", "page", "code").agg(F.count(F.lit(1)).alias("n"))


@query("""
WITH i AS (SELECT p_partkey, 'B' || (p_size % 5) AS book_id, 'r' || p_partkey AS ref, p_name FROM part),
e AS (SELECT *, string_split(p_name, ' ')[1] AS w FROM i WHERE p_partkey % 4 <> 0),
c AS (SELECT i.book_id, i.ref, unnest(list_filter([CASE WHEN e.ref IS NULL THEN 'visual-missing' END, CASE WHEN i.p_partkey % 4 = 1 AND e.ref IS NOT NULL AND i.p_partkey % 3 = 0 THEN 'visual-repeated' END,
  CASE WHEN e.ref IS NOT NULL AND i.p_partkey % 5 = 0 THEN 'visual-incomplete' END, CASE WHEN e.ref IS NOT NULL AND i.p_partkey % 5 <> 0 AND i.p_partkey % 6 = 1 THEN 'visual-words' END,
  CASE WHEN e.ref IS NOT NULL AND i.p_partkey % 2 = 0 THEN 'visual-instruction' END, CASE WHEN e.ref IS NOT NULL AND i.p_partkey % 9 = 0 THEN 'visual-defect' END], lambda x: x IS NOT NULL)) AS code FROM i LEFT JOIN e ON e.ref = i.ref)
SELECT * FROM c
""")
def visual_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A visual record with its faults against the items."""
    p = table(spark, sf_dir, "part").withColumns({"book_id": F.concat(F.lit("B"), F.col("p_size") % 5), "ref": F.concat(F.lit("r"), "p_partkey")})
    k = F.col("p_partkey")
    its = p.select("book_id", "ref", F.col("p_name").alias("text"), (k % 2 == 0).alias("has_context"), F.lit("answer").alias("answer_text"), F.lit("1").alias("label"))
    starts = F.when(k % 5 == 0, F.lit(None)).when(k % 6 == 1, "zzz qqq").otherwise(F.col("p_name"))
    one = p.filter("p_partkey % 4 <> 0").select("book_id", "ref", k.cast("int").alias("entry_idx"), starts.alias("starts_with"), F.lit(False).alias("instruction"), F.lit(None).cast("string").alias("answer_starts_with"), (k % 9 != 0).alias("ok"), k.alias("k"))
    again = one.filter("k % 4 = 1 AND k % 3 = 0").withColumn("entry_idx", F.col("entry_idx") + 100_000_000)
    return gate.visual(one.unionByName(again).drop("k"), its)


@query("""
WITH n AS (SELECT p_partkey, 'B' || (p_size % 5) AS book_id, p_name, p_partkey % 4 AS a, p_partkey % 3 AS b FROM part),
c AS (SELECT book_id, CAST(p_partkey AS INTEGER) AS note_idx, unnest(list_filter([CASE WHEN a = 0 THEN 'no-reason' END, CASE WHEN a = 1 THEN 'quote-not-on-page' END, CASE WHEN b = 0 THEN 'same-identity' END], lambda x: x IS NOT NULL)) AS issue FROM n)
SELECT * FROM c
""")
def note_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes without a reason, with a quote that isn't on its page, and confirmed by their own author."""
    k = F.col("p_partkey")
    p = table(spark, sf_dir, "part").withColumn("book_id", F.concat(F.lit("B"), F.col("p_size") % 5))
    pages = p.select("book_id", k.cast("int").alias("page"), F.concat(F.lit("before\n"), F.upper("p_name"), F.lit("  after")).alias("text"))
    quote = F.when(k % 4 == 1, F.lit("words that no page has")).otherwise(F.concat(F.lit(" "), "p_name", F.lit(" ")))
    notes = p.select("book_id", k.cast("int").alias("note_idx"), F.when(k % 4 == 0, " ").otherwise("a reason").alias("reason"), F.struct(k.cast("int").alias("page"), quote.alias("quote")).alias("evidence"), F.lit("ann").alias("by"), (k % 3 < 2).alias("confirmed"), F.when(k % 3 == 0, "ann").when(k % 3 == 1, "bob").alias("confirmed_by"))
    return gate.acknowledgement_issues(notes, pages)


_HEADS = r"""CASE p_partkey % 9 WHEN 0 THEN 'Chapter ' || p_size WHEN 1 THEN p_size || '.' || (p_partkey % 7 + 1) || ' Lesson of ' || p_name WHEN 2 THEN 'Exercises ' || p_size || '.1' WHEN 3 THEN 'Exercises' WHEN 4 THEN 'Answers' WHEN 5 THEN 'Index'
  WHEN 6 THEN 'Solutions to section ' || p_size || '.2' WHEN 7 THEN 'Chapter' ELSE p_name END"""


@query(rf"""
WITH h AS (SELECT p_partkey, {_HEADS} AS text, CASE p_partkey % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 1.1 ELSE 1.3 END AS ratio, p_partkey % 2 = 0 AS bold FROM part),
k AS (SELECT *, CASE WHEN text = 'Answers' AND ratio >= 1.25 THEN 'answers' WHEN regexp_matches(text, '^Chapter \d') AND ratio >= 1.25 THEN 'chapter' WHEN starts_with(text, 'Solutions to') AND ratio >= 1.25 THEN 'answers' WHEN starts_with(text, 'Solutions to') THEN 'answers-section'
  WHEN text = 'Index' THEN 'stop' WHEN regexp_matches(text, '^Exercises \d') AND (ratio >= 1.1 OR bold) THEN 'practice-labelled' WHEN text = 'Exercises' AND ratio >= 1.25 THEN 'practice' WHEN regexp_matches(text, '^\d+\.\d+ Lesson') AND (ratio >= 1.07 OR bold) THEN 'lesson' END AS kind FROM h)
SELECT p_partkey, kind, nullif(regexp_extract(text, '(\d{{1,3}}(?:\.\d{{1,3}})*)', 1), '') AS label FROM k WHERE kind IS NOT NULL
""")
def scanned_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings of pages by words and size."""
    k = F.col("p_partkey")
    d = table(spark, sf_dir, "part").select("p_partkey", F.lit("B").alias("book_id"), F.expr(_HEADS).alias("text"), F.when(k % 4 == 0, 10.0).when(k % 4 == 1, 11.0).otherwise(13.0).alias("font_size"), (k % 2 == 0).alias("bold"))
    return contents.scan_headings(d, spark.createDataFrame([("B", 10.0)], "book_id string, body double")).select("p_partkey", "kind", "label")


@query("""
WITH r AS (SELECT c_custkey, 'B' || (c_nationkey % 5) AS book_id, c_nationkey + 3 AS n_items, (c_custkey % 11) / 10.0 AS coverage FROM customer),
g AS (SELECT book_id, count(*) FILTER (coverage >= 0.8::DOUBLE AND n_items >= 5) AS n FROM r GROUP BY 1)
SELECT c_custkey FROM r JOIN g USING (book_id) WHERE n_items >= 5 AND coverage < 0.8::DOUBLE AND n_items >= CASE WHEN n >= 3 THEN 8 ELSE 5 END
""")
def uncovered_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered runs that aren't framed."""
    c = table(spark, sf_dir, "customer")
    r = c.select("c_custkey", F.concat(F.lit("B"), F.col("c_nationkey") % 5).alias("book_id"), F.lit("dot").alias("family"), (F.col("c_nationkey") + 3).alias("n_items"), F.lit(2).alias("first_n"), F.lit(90).alias("last_n"), F.lit(1).alias("first_page"), F.lit(3).alias("last_page"), F.lit(1).alias("step"), ((F.col("c_custkey") % 11) / 10).alias("coverage"))
    return census.uncovered(r).select("c_custkey")


@query("""
WITH o AS (SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i, o_orderkey, o_totalprice FROM orders),
k AS (SELECT o_custkey, count(*) AS n FROM o GROUP BY 1)
SELECT 'C' || o_custkey AS book_id, true AS ok, CAST(n + n // 3 AS INTEGER) AS applied, CAST(n - n // 3 AS BIGINT) AS n_frames, CAST(n AS BIGINT) AS seq FROM k
""")
def replayed_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch for each customer: a frame added for each order, every third taken out again."""
    from pyspark.sql import Window

    o = table(spark, sf_dir, "orders").withColumn("i", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))).withColumn("book_id", F.concat(F.lit("C"), "o_custkey"))
    rect = F.struct(F.lit(0.1).alias("left"), (F.col("i") % 8 * 0.1).alias("top"), F.lit(0.9).alias("right"), (F.col("i") % 8 * 0.1 + 0.09).alias("bottom"))
    add = o.select("book_id", F.col("i").cast("long").alias("seq_no"), F.to_json(F.struct(F.lit("add").alias("op"), F.lit("exercise").alias("kind"), F.col("i").alias("page"), rect.alias("rect"))).alias("payload"))
    drop = o.filter("i % 3 = 0").select("book_id", (F.col("i") + 1_000_000).cast("long").alias("seq_no"), F.to_json(F.struct(F.lit("delete").alias("op"), F.concat(F.lit("f"), "i").alias("id"))).alias("payload"))
    state = o.select("book_id").distinct().withColumns({"frames": F.lit("[]"), "outline": F.lit("[]"), "seq": F.lit(0).cast("long"), "meta": F.lit("{}")})
    done = operations.replay_all(state, add.unionByName(drop))
    return done.select("book_id", "ok", "applied", F.size(F.from_json("frames", "array<struct<id:string>>")).cast("long").alias("n_frames"), "seq")


def _scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query(f"""
SELECT CAST(page AS INTEGER) AS page, 'p' || page || 'k' || k AS id, CAST(round(t * 60) AS BIGINT) AS quantity, 's' || (supp % 20) AS section FROM ({_REGIONS}) WHERE k = 1
""")
def project_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Projects written as JSON, one a book, and their frames read again."""
    i = items(spark, sf_dir).filter("k = 1")
    frame = F.struct("id", "kind", "page", "rect", "section", F.lit("kept").alias("unknown"))
    path = _scratch(spark, "projects")
    documents.write_projects(i.select("book_id", "id", frame.alias("frame")), path)
    return documents.project_frames(spark, path).select("page", "id", F.round(F.col("rect.top") * 60).cast("long").alias("quantity"), "section")


@query("SELECT event_id AS exit_code, event_type AS tool, value > 50 AS ok FROM (SELECT CAST(event_id AS INTEGER) AS event_id, event_type, value FROM events)")
def call_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls appended to a log in two parts and read again."""
    e = table(spark, sf_dir, "events").select(F.lit("cli").alias("surface"), F.col("event_type").alias("tool"), F.col("props").alias("arguments"), (F.col("value") > 50).alias("ok"), F.lit(None).cast("string").alias("error"), F.col("event_id").cast("int").alias("exit_code"))
    path = _scratch(spark, "calls")
    documents.append_log(e.filter("exit_code % 2 = 0"), path)
    documents.append_log(e.filter("exit_code % 2 = 1"), path)
    return documents.call_log(spark, path).select("exit_code", "tool", "ok")


@query("""
WITH s AS (SELECT p_brand, 'b' || p_size AS label, CAST(count(*) AS INTEGER) AS count, CASE WHEN p_brand < 'Brand#3' THEN 'I' END AS chapter FROM part GROUP BY ALL)
SELECT label, count, chapter, false AS repeated FROM s
""")
def reference_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reference lists in both shapes, a file a brand."""
    g = table(spark, sf_dir, "part").groupBy("p_brand", "p_size").agg(F.count(F.lit(1)).cast("int").alias("count"))
    section = F.struct(F.concat(F.lit("b"), "p_size").alias("label"), F.lit("t").alias("title"), "count")
    b = g.groupBy("p_brand").agg(F.sort_array(F.collect_list(section)).alias("sections"))
    chapter = F.to_json(F.struct(F.array(F.struct(F.lit("I").alias("label"), F.lit("c").alias("title"), "sections")).alias("chapters")))
    path = _scratch(spark, "reference")
    b.select(F.when(F.col("p_brand") < "Brand#3", chapter).otherwise(F.to_json(F.struct("sections"))).alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    return documents.reference(spark, path).select("label", "count", "chapter", "repeated")


@query(r"""
WITH d AS (SELECT event_id, props FROM events) SELECT event_id, 1 + CAST(event_id % 3 AS INTEGER) AS depth FROM d
""")
def json_nesting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How deep JSON texts nest: properties in lists."""
    n = F.col("event_id") % 3
    text = F.concat(F.when(n == 2, "[[").when(n == 1, "[").otherwise(""), F.col("props"), F.when(n == 2, "]]").when(n == 1, "]").otherwise(""))
    return table(spark, sf_dir, "events").select("event_id", documents.nesting(text).alias("depth"))
