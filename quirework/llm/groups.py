"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirework.session import cut

#: Links of one file of a round, at most about.
FILE_LINKS = 200_000


def components(links: DataFrame, rounds: int = 40) -> DataFrame:
    """links(a, b) -> (node, root): every linked node with the least node of its component.

    Alternating large and small stars: each round hangs neighbours under the least one that is near, so that the number of
    rounds grows with the logarithm of a component. Minima are summed before the shuffle and joined back, so that a node with
    very many neighbours never meets them in one task. The links of a round are written to the shared folder, in as many files
    as they need: a round of few links with a file for each shuffle partition is mostly the making of files.
    """
    edges = cut(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct())
    many, before = edges.count(), None
    for _ in range(rounds):
        # large star: whatever is greater than u hangs under the least of u and its neighbours
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(low, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a > b").distinct()
        # small star: u and its lesser neighbours hang under the least of them
        low = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), "m")
        small = large.join(low, F.col("a") == F.col("u")).select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").filter("a > b").distinct()
        edges = cut(small.coalesce(many // FILE_LINKS + 1))
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        many, before = now[0], now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
