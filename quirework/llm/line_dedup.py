"""Site-relative line dedup: a line on too large a share of a host's pages is boilerplate and goes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirework.functions.grouped import pack, unpacked
from quirework.session import store

#: ASCII white space, trimmed from a line before it is compared.
SPACE = "\t\n\x0b\x0c\r "


def _trim(line: Column) -> Column:
    return F.trim(line, F.lit(SPACE))


def _key(line: Column) -> Column:
    """128 bits of a line: two 64-bit hashes of different input."""
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit("second"), line).alias("b"))


def _keys(body: Column) -> Column:
    """The keys of a text's different lines with a word."""
    return F.transform(F.array_distinct(F.filter(F.transform(F.split(body, "\n", -1), _trim), lambda x: x != "")), _key)


def boilerplate_lines(docs: DataFrame, host: str = "source", text: str = "text", ratio: float = 0.05, prior: int = 30) -> DataFrame:
    """(host, a, b, n_pages, host_pages): the lines on more than ratio of a host's pages.

    The ratio is n_pages / (host_pages + prior): a host is taken to have that many more pages without the line, so that two or
    three pages alone prove little, at any size of a host. With 5 % and 30, that are 2 pages of 9, 3 of 29, 7 of 100 and 5 % of
    many. Counts are summed before the shuffle, so that a common line costs a row per task. A host has at most
    (its lines / (ratio * its pages)) such lines, whatever its size.
    """
    pages = docs.select(F.col(f"`{host}`").alias("host"), _keys(F.col(f"`{text}`")).alias("keys"))
    counts = pages.select("host", F.explode("keys").alias("k")).groupBy("host", "k.a", "k.b").agg(F.count(F.lit(1)).alias("n_pages"))
    totals = docs.groupBy(F.col(f"`{host}`").alias("of")).agg(F.count(F.lit(1)).alias("host_pages"))
    # no line on fewer pages can pass, however few the host has
    least = int(ratio * (1 + prior)) + 1
    met = counts.filter(F.col("n_pages") >= least).join(totals, F.col("host").eqNullSafe(F.col("of"))).drop("of")
    return met.filter(F.col("n_pages") > (F.col("host_pages") + prior) * ratio)


def drop_boilerplate(docs: DataFrame, host: str = "source", text: str = "text", ratio: float = 0.05, prior: int = 30, report: bool = True) -> DataFrame:
    """docs with text cleaned; with report also _n_lines (lines with a word) and _n_dropped (lines taken out).

    Null text stays null (0 lines); a text whose lines all go becomes empty; blank lines stay. A null host is a host of its
    own. Rows that repeat an id are pages of their own. Columns of docs keep their names, whatever they are called; with
    report, one that is called like an added one gives way. Empty table: no rows. The keys of the lines that go are a list per
    host, of a size that its pages' size bounds: it is broadcast where the written table is small, and joined by host, a hot
    one in parts, where it isn't. No page is moved in the first case.
    """
    bad = boilerplate_lines(docs, host, text, ratio, prior).groupBy("host").agg(F.collect_list(F.struct("a", "b")).alias("bad"))
    bad = store(bad.select(F.col("host").alias("of"), "bad"), "boilerplate")
    body = F.col(f"`{text}`")
    joined = pack(docs, (text,), body=body, host=F.col(f"`{host}`")).join(bad, F.col("host").eqNullSafe(F.col("of")), "left")
    # an array of one binds what is used for every line
    gone = F.array_intersect(_keys(F.col("body")), F.col("bad"))
    without = lambda g: F.array_join(F.filter(F.split(F.col("body"), "\n", -1), lambda x: (_trim(x) == "") | ~F.array_contains(g, _key(_trim(x)))), "\n")
    clean = F.when(F.col("bad").isNull() | F.col("body").isNull(), F.col("body")).otherwise(F.get(F.transform(F.array(gone), lambda g: F.when(F.size(g) > 0, without(g)).otherwise(F.col("body"))), F.lit(0)))
    cleaned = joined.select("row", "body", clean.alias("clean"))
    if not report:
        return cleaned.select(*unpacked(docs.columns, **{text: F.col("clean")}))
    lines = lambda c: F.coalesce(F.size(F.filter(F.split(c, "\n", -1), lambda x: _trim(x) != "")), F.lit(0)).cast("long")
    out = cleaned.select("row", "clean", lines(F.col("body")).alias("n"), lines(F.col("clean")).alias("left"))
    own = [c for c in docs.columns if c.lower() not in ("_n_lines", "_n_dropped")]
    return out.select(*unpacked(own, **{text: F.col("clean")}), F.col("n").alias("_n_lines"), (F.col("n") - F.col("left")).alias("_n_dropped"))
