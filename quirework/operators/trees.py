"""The section tree: extents, location and roll-ups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def extents(outline: DataFrame, key: Sequence[str], idx: str, depth: str, levels: int) -> DataFrame:
    """outline with subtree_end (idx of the next entry of no greater depth, or null) and parent (idx, or null).

    A preorder list is a tree. For each of the `levels` depths a running window knows the next entry at that depth or above
    and the last one above it, so that no entry is paired with another. A deeper entry is an error.
    """
    after = Window.partitionBy(*key).orderBy(idx).rowsBetween(1, Window.unboundedFollowing)
    before = Window.partitionBy(*key).orderBy(idx).rowsBetween(Window.unboundedPreceding, -1)
    end = F.when(F.col(depth) >= levels, F.raise_error(F.concat(F.lit(f"an entry deeper than {levels} levels: "), F.col(depth).cast("string"))).cast("long"))
    parent = F.lit(None).cast("long")
    for d in range(levels):
        end = F.when(F.col(depth) == d, F.min(F.when(F.col(depth) <= d, F.col(idx))).over(after)).otherwise(end)
        parent = F.when(F.col(depth) == d, F.max(F.when(F.col(depth) < d, F.col(idx))).over(before)).otherwise(parent)
    return outline.withColumn("subtree_end", end.cast("long")).withColumn("parent", parent.cast("long"))


def locate(items: DataFrame, marks: DataFrame, key: Sequence[str], position: Sequence[str], mark: str) -> DataFrame:
    """items with located: the last mark at or before their position, by one sort of both; null before the first.

    items and marks share key and position columns; at equal positions a mark comes first.
    """
    both = items.withColumn("_is", F.lit(1)).withColumn("_mark", F.lit(None).cast(dict(marks.dtypes)[mark])).unionByName(marks.select(*key, *position, F.col(mark).alias("_mark")).withColumn("_is", F.lit(0)), allowMissingColumns=True)
    w = Window.partitionBy(*key).orderBy(*position, "_is").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("located", F.last("_mark", ignorenulls=True).over(w)).filter("_is = 1").drop("_is", "_mark")


def closure(nodes: DataFrame, idx: str, subtree_end: str, key: Sequence[str], last: Column) -> DataFrame:
    """(key, ancestor, node): every node below each node and itself, by its index range; an entry's depth bounds its rows."""
    a = nodes.select(*key, F.col(idx).alias("ancestor"), F.explode(F.sequence(F.col(idx), F.coalesce(F.col(subtree_end) - 1, last))).alias("node"))
    return a


def rollup(counts: DataFrame, edges: DataFrame, node: str, parent: str, value: str, levels: int) -> DataFrame:
    """(node, own, total): a value of each node and of its subtree, summed level by level so that no path is listed twice."""
    own = edges.select(F.col(node).alias("node"), F.col(parent).alias("parent")).join(counts.select(F.col(node).alias("_n"), F.col(value).alias("own")), F.col("node") == F.col("_n"), "left").drop("_n").withColumn("own", F.coalesce("own", F.lit(0)))
    total = own.select("node", "parent", F.col("own").alias("total"))
    carried = total
    for _ in range(levels):
        up = carried.groupBy("parent").agg(F.sum("total").alias("up")).filter("parent IS NOT NULL")
        carried = up.join(edges.select(F.col(node).alias("_n"), F.col(parent).alias("_p")), F.col("parent") == F.col("_n")).select(F.col("_n").alias("node"), F.col("_p").alias("parent"), F.col("up").alias("total"))
        total = total.unionByName(carried)
    sums = total.groupBy(F.col("node").alias("_n")).agg(F.sum("total").alias("total"))
    return own.join(sums, F.col("node") == F.col("_n")).select("node", "own", "total")


def summary(items: DataFrame, section: str, order: Sequence[str], label: str) -> DataFrame:
    """(section, n_items, first_label, last_label) by reading order."""
    at = F.struct(*order)
    return items.groupBy(section).agg(F.count(F.lit(1)).alias("n_items"), F.min_by(label, at).alias("first_label"), F.max_by(label, at).alias("last_label"))
