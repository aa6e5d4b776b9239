"""The queries of this subpackage, each over its whole table, and their SQL where SQL can say them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirework.llm import bpe, html_extract, license_scan, line_dedup, minhash, mixing, quality_classifier, quality_rules, topk, warc
from quirework.session import shared_dir, table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(r"""
WITH d AS (SELECT doc_id, source, text, string_split(text, chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, source, unnest(list_distinct(list_filter(list_transform(ls, lambda x: trim(x, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ')), lambda x: x <> ''))) AS line FROM d),
t AS (SELECT source, count(*) AS total FROM documents GROUP BY source),
b AS (SELECT l.source, line FROM l JOIN t ON l.source IS NOT DISTINCT FROM t.source GROUP BY l.source, line, total HAVING count(*) > (total + 30) * CAST(0.05 AS DOUBLE)),
g AS (SELECT source, list(line) AS bad FROM b GROUP BY source),
x AS (SELECT d.doc_id, d.source, d.ls, coalesce(g.bad, []) AS bad, list_transform(d.ls, lambda x: trim(x, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ')) AS ts FROM d LEFT JOIN g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, source,
  CAST(len(list_filter(ts, lambda x: x <> '')) AS BIGINT) AS n_lines,
  CAST(len(list_filter(ts, lambda x: x <> '' AND list_contains(bad, x))) AS BIGINT) AS n_dropped,
  array_to_string(list_filter(ls, lambda x, i: NOT (ts[i] <> '' AND list_contains(bad, ts[i]))), chr(10)) AS clean_text
FROM x
""")
def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without its host's boilerplate lines; the host is the source."""
    out = line_dedup.drop_boilerplate(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "source", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"), F.col("text").alias("clean_text"))


@query(quality_rules.judge_sql())
def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.judge(table(spark, sf_dir, "documents").select("doc_id", "text"))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lost_words")
    return out.select("doc_id", *[F.col(f"_{x}").alias(x) for x in names])


def vocabulary(name: str = "byte_bpe_50k.tiktoken") -> tuple[dict[bytes, int], str]:
    import public_tokenizers

    return bpe.read_ranks(public_tokenizers.path(name)), public_tokenizers.PATTERN


@query()
def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), *vocabulary())


@query(r"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS BIGINT) + 1] AS w, 2 * source_size AS cap FROM s),
o AS (SELECT *, CAST(sum(source_size) OVER () AS DOUBLE) * 1.5 AS total,
  coalesce(sum(cap) OVER (ORDER BY CAST(cap AS DOUBLE) / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
  sum(w) OVER (ORDER BY CAST(cap AS DOUBLE) / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS here FROM w),
p AS (SELECT *, (total - before) * w >= cap * here AS stops FROM o),
q AS (SELECT *, sum(CASE WHEN stops THEN cap ELSE 0 END) OVER () AS spent, sum(CASE WHEN stops THEN 0 ELSE w END) OVER () AS open FROM p),
t AS (SELECT source, source_size, CASE WHEN stops THEN CAST(cap AS DOUBLE) ELSE (total - spent) * w / open END AS target FROM q),
r AS (SELECT d.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate,
  CAST(CAST('0x' || substr(md5('17|' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0 AS draw
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST(size * (floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM r
""")
def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), (F.col("_size") * F.col("_copies")).alias("taken"))


@query(r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM w),
n AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n FROM s), x AS (SELECT doc_id, unnest(s) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 85 * (na.n + nb.n - c)),
b AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id AS node, doc_id AS root FROM n UNION SELECT b.b, r.root FROM r JOIN b ON b.a = r.node)
SELECT n.doc_id, n.n AS n_shingles, m.root AS component_id, n.doc_id = m.root AS kept FROM n JOIN (SELECT node, min(root) AS root FROM r GROUP BY node) m ON m.node = n.doc_id
""")
def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


@query(r"""
WITH v AS (SELECT vec_id, row_number() OVER () AS row, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings),
s AS (SELECT q.vec_id AS query_id, q.row, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.row <> c.row),
r AS (SELECT *, row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10
""")
def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


@query(license_scan.scan_sql())
def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the number of its licence notices, the best coefficient and the licences."""
    out = license_scan.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    names = F.array_join(F.array_sort(F.array_distinct(F.col("_hits.license"))), ",")
    return out.select("doc_id", F.size("_hits").cast("long").alias("n_notices"), F.array_max("_hits.dice").alias("best_dice"), names.alias("licenses"))


@query()
def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_classifier.score(docs, quality_classifier.fit(docs, table(spark, sf_dir, "labels")))


@query()
def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


@query("""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha1(h) AS x, max(page_id) OVER (PARTITION BY h) AS last FROM p),
l AS (SELECT *, list_transform(range(0, 8), lambda i: CAST('0x' || substr(x, CAST(i * 5 + 1 AS BIGINT), 5) AS BIGINT)) AS vs FROM d)
SELECT page_id, payload_bytes, array_to_string(list_transform(vs, lambda v: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (v >> 15) % 32 + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (v >> 10) % 32 + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (v >> 5) % 32 + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', v % 32 + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id = last THEN NULL ELSE last END AS refers_to, true AS intact FROM l
""")
def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"), shared_dir(spark))
