"""Line-first quality rules: clean a text line by line, then reject it if too much is gone."""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quirework.functions.grouped import append, pack, unpacked

SYMBOLS = "#*$%&|<>"
#: Phrases of notices and menus; a short line with one is boilerplate.
BOILERPLATE = (
    r"\b(cookies?|javascript|all rights reserved|privacy policy|terms of (use|service)|sign up|log ?in|subscribe|newsletter"
    r"|click here|read more|share (this|on)|powered by|back to top|skip to content|lorem ipsum)\b"
)
#: What stands between the entries of a menu.
SEPARATORS = "|»«›‹•·>/"
_gaps = re.compile(r"[\x20\x09-\x0D]+").split
_notice = re.compile(BOILERPLATE, re.I | re.A).search
_small, _capital = regex.compile(r"\p{Ll}").search, regex.compile(r"\p{Lu}").search


def line_fault(line: str, max_symbols: int = 20, max_shout: int = 20, max_separators: int = 15, short: int = 20) -> str | None:
    """Which rule a line with words fails: punctuation, navigation, boilerplate, or none. Limits are per cent of its words."""
    n = len(line.encode().split())
    if any(c in line for c in SEPARATORS):
        words = [x for x in _gaps(line) if x]
        if 100 * sum(not x.strip(SEPARATORS) for x in words) > max_separators * n:
            return "navigation"
    if 100 * sum(map(line.count, SYMBOLS)) > max_symbols * n or (line.count("!") > 2 and 100 * line.count("!") > max_shout * n):
        return "punctuation"
    if n >= 3 and not _small(line) and _capital(line):
        return "punctuation"
    if n <= short and _notice(line):
        return "boilerplate"
    return None


def examine(text: str | None, min_words: int = 50, max_repeat: int = 50, max_loss: int = 40, max_dup_lines: int = 50) -> tuple[tuple, list[tuple[int, int]]]:
    """What measure() gives, and the (begin, end) in characters of the lines that failed, without their line ends."""
    text = text or ""
    words = text.encode().split()  # bytes split at the six ASCII white spaces alone
    n = len(words)
    chars = len(text) - sum(map(text.count, " \t\n\x0b\x0c\r"))
    symbols = sum(map(text.count, SYMBOLS))
    every = text.split("\n")
    lines = [x for x in every if x.strip(" \t\n\x0b\x0c\r")]
    dup = len(lines) - len(set(lines))
    repeat = 0
    windows = list(zip(words, words[1:], words[2:], strict=False))
    seen = Counter(windows)
    if len(seen) < len(windows):
        end = 0  # words before it are counted
        for i, x in enumerate(windows):
            if seen[x] > 1:
                repeat += i + 3 - max(end, i)
                end = i + 3
    failed = n < min_words or 100 * repeat > max_repeat * n
    lost, met, spans, at = 0, set(), [], 0
    for x in every:
        if x.strip(" \t\n\x0b\x0c\r"):
            if line_fault(x) or (x in met and 100 * dup > max_dup_lines * len(lines)):
                lost += len(x.encode().split())
                spans.append((at, at + len(x)))
            met.add(x)
        at += len(x) + 1
    return (n, chars, symbols, dup, repeat, failed, lost, not failed and 100 * lost <= max_loss * n), spans


def measure(text: str | None, **limits) -> tuple:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_lost_words, kept) of one text; see judge()."""
    return examine(text, **limits)[0]


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """A text without the lines at spans, each with one line end; the lines that stay are joined as they were."""
    out, at = [], 0
    for begin, end in spans:
        out.append(text[at:begin])
        at = end + 1
    out.append(text[at:])
    whole = "".join(out)
    # the last line goes with the line end before it
    return whole[:-1] if spans and spans[-1][1] == len(text) and whole else whole


FIELDS = "_n_words long, _word_chars long, _n_symbols long, _n_dup_lines long, _n_repeat_words long, _base_failed boolean, _n_lost_words long, _kept boolean"
#: What judge() adds with lines=True.
LINES = {"_clean": T.StringType(), "_lost_spans": T.ArrayType(T.StructType().add("begin", "long").add("end", "long"))}


def judge(docs: DataFrame, text: str = "text", lines: bool = False, **limits) -> DataFrame:
    """docs with the columns of FIELDS; with lines, also _clean, the text without its failed lines, and _lost_spans, where they stood.

    Words are runs without ASCII white space. A line fails by its punctuation (symbols, shouting), as navigation (separators
    between words) or as boilerplate (notices); the words of failed lines are lost, and a text that loses more than max_loss
    per cent of its words, or fails the base rules, isn't kept. Null and empty text: no words, not kept. Rows are judged one by one, so
    ids may be null or repeat. Blank lines stay. _clean of a null text is null; spans are characters from begin to before end,
    without the line end. A column of docs that is called like an added one gives way. Empty table: no rows.
    """
    added = T.StructType()
    for x in FIELDS.split(", "):
        added.add(*x.split())
    for name, kind in LINES.items() if lines else ():
        added.add(name, kind)
    kinds = to_arrow_schema(added)

    def found(texts: pa.Array) -> list[pa.Array]:
        columns: list[list] = [[] for _ in added]
        for t in texts:
            t = t.as_py()
            row, spans = examine(t, **limits)
            for c, v in zip(columns, row, strict=False):
                c.append(v)
            if lines:
                columns[-2].append(t and without(t, spans))
                columns[-1].append([{"begin": x, "end": y} for x, y in spans])
        return [pa.array(c, k.type) for c, k in zip(columns, kinds, strict=True)]

    return append(docs, text, added, found)


def keep(docs: DataFrame, text: str = "text", **limits) -> DataFrame:
    """The rows of docs that judge() keeps, their text without the failed lines; the other columns stay as they are, whatever they are called."""
    kept = judge(pack(docs, (text,), body=F.col(f"`{text}`")), "body", lines=True, **limits).filter("_kept")
    return kept.select(*unpacked(docs.columns, **{text: F.col("_clean")}))


def judge_sql() -> str:
    """The digest of op3 in DuckDB's SQL."""
    word, faulty = r"[^\x20\x09-\x0D]+", rf"""
  CASE WHEN 100 * len(list_filter(lw, lambda w: regexp_full_match(w, '[|»«›‹•·>/]+'))) > 15 * len(lw) THEN true
    WHEN 100 * len(regexp_extract_all(line, '[#*$%&|<>]')) > 20 * len(lw) THEN true
    WHEN len(regexp_extract_all(line, '!')) > 2 AND 100 * len(regexp_extract_all(line, '!')) > 20 * len(lw) THEN true
    WHEN len(lw) >= 3 AND NOT regexp_matches(line, '\p{{Ll}}') AND regexp_matches(line, '\p{{Lu}}') THEN true
    WHEN len(lw) <= 20 AND regexp_matches(line, '(?i){BOILERPLATE}') THEN true ELSE false END"""
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{word}') AS w FROM documents),
t AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS g FROM d WHERE len(w) > 2),
c AS (SELECT doc_id, i FROM t QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
r AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM c, (VALUES (0), (1), (2)) AS k(k) GROUP BY doc_id),
u AS (SELECT doc_id, unnest(range(1, len(ls) + 1)) AS pos, unnest(ls) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM d)),
l AS (SELECT doc_id, pos, line, regexp_extract_all(line, '{word}') AS lw FROM u),
m AS (SELECT *, row_number() OVER (PARTITION BY doc_id, line ORDER BY pos) > 1 AS again FROM l WHERE len(lw) > 0),
f AS (SELECT *, count(*) FILTER (again) OVER (PARTITION BY doc_id) AS dup, count(*) OVER (PARTITION BY doc_id) AS n_lines, {faulty} AS faulty FROM m),
a AS (SELECT doc_id, max(dup) AS n_dup_lines, sum(CASE WHEN faulty OR (again AND 100 * dup > 50 * n_lines) THEN len(lw) ELSE 0 END) AS n_lost_words FROM f GROUP BY doc_id),
s AS (SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
  CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(n_lost_words, 0) AS BIGINT) AS n_lost_words
  FROM d LEFT JOIN r ON r.doc_id = d.doc_id LEFT JOIN a ON a.doc_id = d.doc_id)
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * n_lost_words <= 40 * n_words AS kept FROM s
"""
