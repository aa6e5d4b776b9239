"""Mixing sources to target weights by repetition rates. DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirework.functions.grouped import pack, unpacked

#: A word: a run without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def count_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int] = (5, 2, 1), budget: float = 1.5, most: int = 2) -> DataFrame:
    """sizes(source, source_size): adds target, a double.

    Sources in code-point order, null last, weigh as `weights`, repeating. They share budget * all words by weight; a target
    stops at most * source_size and the excess is shared again by weight. Sorted by most * size / weight the sources that
    stop are a prefix, so running sums give the fixed point. One row per source is sorted here, never a document.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    n = len(weights)
    w = F.element_at(F.array(*[F.lit(int(x)).cast("long") for x in weights]), (F.row_number().over(by_name) - 1) % n + 1)
    s = sizes.withColumn("_w", w).withColumn("_cap", F.col("source_size") * most)
    order = [F.col("_cap") / F.col("_w"), F.col("source").asc_nulls_last()]
    before, here, all_ = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1), Window.orderBy(*order).rowsBetween(0, Window.unboundedFollowing), Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = (
        s.withColumn("_total", F.sum("source_size").over(all_) * F.lit(float(budget)))
        .withColumn("_left", F.col("_total") - F.coalesce(F.sum("_cap").over(before), F.lit(0)))
        .withColumn("_stops", F.col("_left") * F.col("_w") >= F.col("_cap") * F.sum("_w").over(here))
    )
    s = s.withColumn("_spent", F.sum(F.when(F.col("_stops"), F.col("_cap")).otherwise(0)).over(all_)).withColumn("_open", F.sum(F.when(F.col("_stops"), 0).otherwise(F.col("_w"))).over(all_))
    target = F.when(F.col("_stops"), F.col("_cap").cast("double")).otherwise((F.col("_total") - F.col("_spent")) * F.col("_w") / F.col("_open"))
    return s.select("source", "source_size", target.alias("target"))


ADDED = ("_size", "_source_size", "_target", "_rate", "_copies")


def _mixed(docs: DataFrame, weights: Sequence[int], budget: float, most: int, seed: int) -> DataFrame:
    """docs' rows as structs, row, beside the columns of ADDED: names of docs meet none of these."""
    sized = pack(docs, of=F.col("source"), id=F.col("doc_id").cast("string"), _size=count_words(F.col("text")))
    sizes = docs.select("source", count_words(F.col("text")).alias("n")).groupBy("source").agg(F.sum("n").alias("source_size"))
    targets = source_targets(sizes, weights, budget, most).select("source", F.col("source_size").alias("_source_size"), F.col("target").alias("_target"))
    # 52 bits of a digest as a number from 0 to 1
    draw = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col("id"), F.lit("null")))), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))
    rate = F.when(F.col("_source_size") > 0, F.col("_target") / F.col("_source_size")).otherwise(F.lit(0.0))
    copies = F.floor("_rate") + F.when(draw < F.col("_rate") - F.floor("_rate"), 1).otherwise(0)
    return sized.join(targets, F.col("of").eqNullSafe(F.col("source"))).withColumn("_rate", rate).withColumn("_copies", copies.cast("long"))


def mix(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), budget: float = 1.5, most: int = 2, seed: int = 17) -> DataFrame:
    """docs(doc_id, text, source, ...): adds _size, _source_size, _target, _rate and _copies to every row.

    _copies is floor(rate) plus one copy with the probability of the fraction, decided by a hash of seed and doc_id, so
    reruns agree; rate is target / source_size. Null text: size 0. Null source: a source of its own, last. A source of no
    words has target 0 and no copies. Rows with one doc_id (null too) share a draw. A column of docs that is called like an
    added one gives way. Empty table: no rows. The join is with one row per source, which Spark broadcasts when it is small
    and splits when a source is hot.
    """
    own = [c for c in docs.columns if c.lower() not in ADDED]
    return _mixed(docs, weights, budget, most, seed).select(*unpacked(own), *ADDED)


def repeat(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), budget: float = 1.5, most: int = 2, seed: int = 17) -> DataFrame:
    """The mixed corpus: every row of docs as many times as mix() says, with the columns of docs, whatever they are called.

    A text of no words has size 0 and its source's rate as any other. Empty table: no rows.
    """
    taken = _mixed(docs, weights, budget, most, seed).filter("_copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int"))).alias("copy")).select(*unpacked(docs.columns))
