"""What printed lines are: starts, labels, marks and titles, over lines that a part's row spells out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirework.functions import labels, lines, rects
from quirework.plans.catalog import query
from quirework.session import table

#: A printed line for each part, in SQL that both engines read.
PRINTED = """CASE p_partkey % 20
  WHEN 0 THEN concat(p_size, '. ', upper(p_name)) WHEN 1 THEN concat('(', p_size, ') ', p_name) WHEN 2 THEN concat(p_size, '.', p_partkey % 9, '.2 ', p_name)
  WHEN 3 THEN concat('Exercise ', p_size, 'a ', p_name) WHEN 4 THEN concat(p_size, ') ', p_name) WHEN 5 THEN concat('§ ', p_size, ' ', p_name)
  WHEN 6 THEN concat('2.', p_size, ' ', upper(p_name)) WHEN 7 THEN concat(p_name, ' ..... ', p_partkey) WHEN 8 THEN concat('[', p_size, '] ', p_name)
  WHEN 9 THEN concat(upper(p_name), ' ', p_size) WHEN 10 THEN concat('Figure ', p_size, ' ', p_name) WHEN 11 THEN concat('(', p_size, '.', p_partkey % 7, ')')
  WHEN 12 THEN concat('Find the ', p_name, '.') WHEN 13 THEN CASE WHEN p_size % 2 = 0 THEN concat('In exercises ', p_size, ' to 60 show ', p_name) ELSE concat('For each of the following, name ', p_name) END WHEN 14 THEN concat(p_size, ' ', p_name)
  WHEN 15 THEN concat(p_name, ', 12, ', p_size) WHEN 16 THEN concat('(c) ', p_name) WHEN 17 THEN concat(p_size, '.5 ', p_name) WHEN 18 THEN concat(p_size, '') ELSE concat(p_size, '.  ', p_name) END"""
_L = f"(SELECT p_partkey, p_size, p_name, {PRINTED} AS line FROM part)"


def printed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_name", F.expr(PRINTED).alias("line"))


@query(rf"""
SELECT p_partkey, coalesce(nullif(regexp_extract(line, '^(\d{{1,4}}[a-z]?)[.)](?:\D|$)', 1), ''), nullif(regexp_extract(line, '^\((\d{{1,4}}[a-z]?|[a-z])\)', 1), ''), nullif(regexp_extract(line, '^(\d+\.\d+\.\d+)(?:[^\d.]|$)', 1), '')) AS label FROM {_L}
""")
def item_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return printed(spark, sf_dir).select("p_partkey", labels.item_start(F.col("line")).alias("label"))


@query(rf"""
WITH s AS (SELECT p_partkey, line, list_filter([
  {{'style': 'keyword', 'label': regexp_extract(line, '^(?i:exercises?|problems?|questions?|aufgaben?|exercices?|ejercicios?)\s+(\d+[a-z]?)', 1), 'confidence': 0.9::DOUBLE}},
  {{'style': 'number-dot', 'label': regexp_extract(line, '^(\d{{1,4}})\.(?:\s|$)', 1), 'confidence': CASE WHEN regexp_matches(line, '^\d{{1,4}}\.\s+\p{{Ll}}') THEN 0.55::DOUBLE - 0.05::DOUBLE ELSE 0.55::DOUBLE END}},
  {{'style': 'number-paren', 'label': regexp_extract(line, '^(\d{{1,4}})\)(?:\s|$)', 1), 'confidence': 0.5::DOUBLE}},
  {{'style': 'paren-number', 'label': regexp_extract(line, '^\((\d{{1,4}})\)(?:\s|$)', 1), 'confidence': 0.4::DOUBLE}},
  {{'style': 'section', 'label': regexp_extract(line, '^§\s*(\d+)', 1), 'confidence': 0.3::DOUBLE}},
  {{'style': 'heading-number', 'label': regexp_extract(line, '^(\d{{1,3}}(?:\.\d{{1,3}})+)\s+\p{{Lu}}', 1), 'confidence': 0.25::DOUBLE}}], lambda x: x.label <> '')[1] AS s FROM {_L})
SELECT p_partkey, s.style AS style, s.label AS label, s.confidence AS confidence FROM s WHERE s IS NOT NULL
""")
def start_styles(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = printed(spark, sf_dir).withColumn("s", lines.start_style(F.col("line"))).filter("s IS NOT NULL")
    return d.select("p_partkey", "s.style", "s.label", "s.confidence")


@query(rf"""
WITH s AS (SELECT p_partkey, list_filter([{{'family': 'dot', 'n': regexp_extract(line, '^(\d{{1,4}})\.(?:\D|$)', 1)}}, {{'family': 'paren', 'n': regexp_extract(line, '^(\d{{1,4}})\)', 1)}}, {{'family': 'both', 'n': regexp_extract(line, '^\((\d{{1,4}})\)', 1)}},
  {{'family': 'bracket', 'n': regexp_extract(line, '^\[(\d{{1,4}})\]', 1)}}, {{'family': 'bare', 'n': regexp_extract(line, '^(\d{{1,4}})\s+\p{{L}}', 1)}}], lambda x: x.n <> '')[1] AS s FROM {_L})
SELECT p_partkey, s.family AS family, CAST(s.n AS INTEGER) AS n FROM s WHERE s IS NOT NULL
""")
def census_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = printed(spark, sf_dir).withColumn("s", lines.census_label(F.col("line"))).filter("s IS NOT NULL")
    return d.select("p_partkey", "s.family", "s.n")


@query(rf"""
SELECT p_partkey, regexp_matches(line, '(?:\.\s?){{3,}}\s*\d+$|,\s*\d{{1,4}}(?:\s*[-–]\s*\d{{1,4}})?$|^\d{{1,4}}$') AS page_reference,
  len(regexp_extract_all(line, '[A-Za-z]')) >= 3 AND len(regexp_extract_all(line, '[A-Z]')) * 5 >= len(regexp_extract_all(line, '[A-Za-z]')) * 4 AND regexp_matches(line, '^\d+\s|\s\d+$') AS printed_head,
  regexp_matches(line, '{lines.INSTRUCTION}') AS instruction,
  regexp_matches(line, '^(?i:figure|fig\.|table|abbildung|abb\.|tabelle|figura|tableau)\s*\d') AS caption, regexp_matches(line, '^\(\d{{1,3}}(?:\.\d{{1,3}})?\)$') AS equation_tag FROM {_L}
""")
def line_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("line")
    marks = {"page_reference": lines.is_page_reference(t), "printed_head": lines.is_printed_head(t), "instruction": lines.is_instruction(t), "caption": t.rlike(lines.CAPTION), "equation_tag": t.rlike(lines.EQUATION_TAG)}
    return printed(spark, sf_dir).select("p_partkey", *[v.alias(k) for k, v in marks.items()])


@query(rf"SELECT p_partkey, nullif(regexp_extract(line, '^Exercise (\d+)', 1), '') AS label FROM {_L}")
def item_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels by a caller's own pattern."""
    return printed(spark, sf_dir).select("p_partkey", lines.item_label(F.col("line"), r"^Exercise (\d+)").alias("label"))


@query(r"SELECT page_id, regexp_matches(url, '^https?://[^\s/$.?#][^\s]*$') AS address, regexp_matches(replace(url, '://', ':/'), '^https?://[^\s/$.?#][^\s]*$') AS broken FROM pages")
def web_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", lines.is_web_address(F.col("url")).alias("address"), lines.is_web_address(F.replace("url", F.lit("://"), F.lit(":/"))).alias("broken"))


_CLEAN = r"trim(regexp_replace(regexp_replace(regexp_replace(raw, '[\x00-\x1F\x7F]', ' ', 'g'), '\s+', ' ', 'g'), '\s*(?:\.\s?){3,}\s*\d*\s*$', ''))"


@query(rf"""
WITH r AS (SELECT p_partkey, concat('Chapter ', p_size, ': ', chr(9), ' ', line, CASE WHEN p_partkey % 3 = 0 THEN ' & more . . . . 12' ELSE '' END) AS raw FROM {_L}), c AS (SELECT *, {_CLEAN} AS clean FROM r)
SELECT p_partkey, clean, trim(regexp_replace(regexp_replace(replace(lower(clean), '&', ' and '), '^(?:chapter|kapitel|section|part)\s+[0-9ivx]+[.:]?\s+', ''), '[^\p{{L}}\p{{N}}]+', ' ', 'g')) AS key,
  CASE WHEN length(clean) > 30 THEN rtrim(substr(clean, 1, 29)) || '…' ELSE clean END AS excerpt FROM c
""")
def title_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles cleaned, as keys of comparison and as excerpts."""
    raw = F.concat(F.lit("Chapter "), F.col("p_size").cast("string"), F.lit(": \t "), F.col("line"), F.when(F.col("p_partkey") % 3 == 0, " & more . . . . 12").otherwise(""))
    clean = lines.clean_title(raw)
    return printed(spark, sf_dir).select("p_partkey", clean.alias("clean"), lines.title_key(raw).alias("key"), lines.excerpt(clean, 30).alias("excerpt"))


@query(r"""
SELECT p_partkey, trim(regexp_replace(p_name, '[_\-\s]+', ' ', 'g')) AS title, array_to_string(list_filter(regexp_split_to_array(lower(p_name), '[^a-z0-9]+'), lambda x: x <> ''), '-') AS slug, p_size || '-' || (p_size + 1) || ' ' || array_to_string(list_filter(regexp_split_to_array(p_name, '\s+'), lambda x: x <> ''), ' ') AS folded FROM part
""")
def label_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of files as titles, titles as ids, and the compatibility form of labels."""
    path = F.concat(F.lit("C:\\books/old\\"), F.replace("p_name", F.lit(" "), F.lit("_-")), F.lit(".pdf"))
    wide = F.concat(F.col("p_size").cast("string"), F.lit("–"), (F.col("p_size") + 1).cast("string"), F.lit("\u2003 "), F.col("p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", lines.title_from_file(path).alias("title"), labels.slugged(F.col("p_name")).alias("slug"), labels.folded(wide).alias("folded"))


_TENS, _ONES = "['', 'x', 'xx', 'xxx', 'xl', 'l']", "['', 'i', 'ii', 'iii', 'iv', 'v', 'vi', 'vii', 'viii', 'ix']"


@query(f"SELECT p_partkey, ({_TENS})[p_size // 10 + 1] || ({_ONES})[p_size % 10 + 1] AS roman, p_size AS of_roman, CAST(p_partkey AS INTEGER) AS of_digits, CAST(NULL AS INTEGER) AS of_words FROM part")
def numerals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roman numerals and digits as numbers; words are none."""
    part = lambda names, n: F.get(F.array(*[F.lit(x) for x in names]), n)
    n = F.col("p_size")
    roman = F.concat(part(["", "x", "xx", "xxx", "xl", "l"], F.floor(n / 10).cast("int")), part(["", "i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix"], n % 10))
    d = table(spark, sf_dir, "part").select("p_partkey", roman.alias("roman"), F.col("p_partkey").cast("string").alias("digits"), F.concat(F.lit("w"), F.col("p_name")).alias("words"))
    return d.select("p_partkey", "roman", labels.numeral("roman").alias("of_roman"), labels.numeral("digits").alias("of_digits"), labels.numeral("words").alias("of_words"))


@query(rf"""
WITH x AS (SELECT *, CAST(p_size AS VARCHAR) AS label, regexp_replace(line, '^\(', '') AS plain FROM {_L})
SELECT p_partkey, starts_with(plain, label) AND NOT regexp_matches(substr(plain, length(label) + 1, 1), '[\p{{L}}\p{{N}}]') AS starts, starts_with(line, label) AND length(line) > length(label) AND NOT regexp_matches(substr(line, length(label) + 1), '^\d') AS part FROM x
""")
def label_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a line starts with a label, and is named as a part of it."""
    d = printed(spark, sf_dir).withColumn("label", F.col("p_size").cast("string"))
    return d.select("p_partkey", labels.starts_with(F.col("line"), F.col("label")).alias("starts"), labels.is_part_of(F.col("line"), F.col("label")).alias("part"))


@query(rf"""
WITH m AS (SELECT p_partkey, unnest(list_filter([{{'style': 'letter', 'mark': regexp_extract(line, '^\(([a-z])\)', 1)}}, {{'style': 'roman', 'mark': regexp_extract(line, '^\(([ivx]{{1,5}})\)', 1)}}, {{'style': 'number', 'mark': regexp_extract(line, '^\((\d{{1,2}})\)', 1)}},
  {{'style': 'letter-dot', 'mark': regexp_extract(line, '^([a-z])[.)]\s', 1)}}, {{'style': 'number-dot', 'mark': regexp_extract(line, '^(\d{{1,2}})[.)]\s', 1)}}], lambda x: x.mark <> '')) AS m FROM {_L})
SELECT p_partkey, m.style AS style, m.mark AS mark, CASE WHEN starts_with(m.style, 'letter') THEN ascii(m.mark) - 96 ELSE TRY_CAST(m.mark AS INTEGER) END AS ordinal FROM m
""")
def part_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = printed(spark, sf_dir).select("p_partkey", F.explode(lines.part_marks(F.col("line"))).alias("m")).select("p_partkey", "m.style", "m.mark")
    return d.withColumn("ordinal", lines.part_ordinal(F.col("style"), F.col("mark")).cast("int"))


_R = "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_discount * 5 AS l, l_quantity / 60 AS t, least(1.0, l_discount * 5 + 0.3) AS r, least(1.0, l_quantity / 60 + 0.05 * l_linenumber) AS b FROM lineitem"


@query(f"SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, b <= CAST(0.14 AS DOUBLE) OR t >= CAST(0.86 AS DOUBLE) AS in_band, CAST(round(l * 100) AS BIGINT) AS l, CAST(round(t * 1000) AS BIGINT) AS t, true AS again, true AS none FROM ({_R})")
def rect_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rectangles as text and read again, in both notations; and whether they stand in the band of headers and footers."""
    li = table(spark, sf_dir, "lineitem")
    r = rects.rect(F.col("l_discount") * 5, F.col("l_quantity") / 60, F.least(F.lit(1.0), F.col("l_discount") * 5 + 0.3), F.least(F.lit(1.0), F.col("l_quantity") / 60 + 0.05 * F.col("l_linenumber")))
    text = rects.formatted(r)
    back, listed, told = rects.parsed(text), rects.parsed(F.concat(F.lit("[ "), text, F.lit("]"))), rects.parsed(F.to_json(rects.rounded(r)))
    key = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    return li.select(
        *key, lines.in_band(r).alias("in_band"), F.round(back["left"] * 100).cast("long").alias("l"), F.round(back["top"] * 1000).cast("long").alias("t"),
        (rects.equal(back, r, 1e-5) & rects.equal(listed, told, 1e-9)).alias("again"), rects.parsed(F.concat(text, F.lit(",1"))).isNull().alias("none"),
    )
