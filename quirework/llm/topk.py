"""Exact top-k search: tiles of integer matrix products, partial selection in each, a tree of merges."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirework.session import bound_batches, cut

#: Queries and candidates of a tile, and how many lists of a query one merge takes.
QUERIES, CANDIDATES, FAN_IN = 1024, 8192, 16
SCALE = 1024


def _products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products of floor(SCALE * x) as longs; one beyond 64 bits is cut to the least or greatest long.

    Sums of products below 2**53 are exact in float64; others are taken in Python's integers.
    """
    most = lambda m: float(np.abs(m).max(initial=0)) * SCALE + 1
    if most(q) * most(c) * q.shape[1] < 2**53:
        return (np.floor(q * SCALE) @ np.floor(c * SCALE).T).astype(np.int64)
    whole = lambda x: math.floor(x * SCALE) if abs(x) < 1e300 else int(x) * SCALE
    exact = lambda m: np.array([[whole(x) for x in r] for r in m.tolist()], dtype=object)
    return np.clip(exact(q) @ exact(c).T, -(2**63), 2**63 - 1).astype(np.int64)


def _best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to smaller ids."""
    if len(score) > 4 * k:
        least = np.partition(score, len(score) - k)[len(score) - k]
        among = np.flatnonzero(score >= least)
    else:
        among = np.arange(len(score))
    # ~x falls as x rises, and the least long has it too
    return among[np.lexsort((ids[among], ~score[among]))][:k]


def top_k(rows: DataFrame, id_col: str = "vec_id", vector: str = "embedding", k: int = 10, every: int = 100, tile: tuple[int, int] = (QUERIES, CANDIDATES)) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id is divisible by `every`, the k best of all other rows.

    The score is the inner product of floor(1024 * x). Vectors that are null or empty or hold null or non-finite components,
    and rows without id, take no part; only vectors of one length are compared. Rows that repeat an id are rows of their own:
    each is a candidate for every other, and each is a query if the id is one. Ties go to the smaller id; fewer than k others
    give fewer rows. Empty table: no rows. A tile's size is fixed: the number of tiles grows, and each is met by one task
    that keeps k rows of a query. A score beyond 64 bits is cut to the least or greatest long, and ranked as such.
    """
    bound_batches(rows.sparkSession)
    n_q, n_c = tile
    named = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).filter("id IS NOT NULL AND v IS NOT NULL")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    # a row's number is settled by the checkpoint
    base = cut(named.filter((F.size("v") > 0) & finite).select("id", "v", F.size("v").alias("d"), F.monotonically_increasing_id().alias("row")))
    queries = base.filter(F.pmod("id", F.lit(every)) == 0)
    count_q, count_c = queries.count(), base.count()
    blocks, shards = max(1, math.ceil(count_q / n_q)), max(1, math.ceil(count_c / n_c))
    place = lambda col, seed, n: F.pmod(F.xxhash64(col, F.lit(seed)), F.lit(n)).cast("int")
    q = queries.withColumn("block", place("row", 1, blocks)).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    q = q.select(*[F.col(x).alias(x) for x in q.columns])  # attributes of its own, or the two sides would be one
    c = base.withColumn("shard", place("row", 2, shards)).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def multiply(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple] = []
        if len(left) and len(right):
            ids, numbers = right["id"].to_numpy(np.int64), right["row"].to_numpy(np.int64)
            m = np.stack(right["v"].to_list())
            for start in range(0, len(left), 128):
                part = left.iloc[start : start + 128]
                scores = _products(np.stack(part["v"].to_list()), m)
                for i, number, s in zip(part["id"].tolist(), part["row"].tolist(), scores, strict=True):
                    others = numbers != number
                    s, names = s[others], ids[others]
                    best = _best(s, names, k)
                    found += zip([number] * len(best), [i] * len(best), names[best].tolist(), s[best].tolist(), strict=True)
        out = pd.DataFrame(found, columns=["row", "query_id", "vec_id", "score"])
        return out.assign(part=int(right["shard"].iloc[0]) if len(right) else 0)

    keys = ["block", "shard", "d"]
    tops = q.groupBy(*keys).cogroup(c.groupBy(*keys)).applyInPandas(multiply, "row long, query_id long, vec_id long, score long, part int")
    one = lambda: F.slice(F.sort_array(F.collect_list(F.struct((-F.col("score").cast("decimal(20,0)")).alias("minus"), F.col("vec_id").alias("vec_id"), F.col("score").alias("score")))), 1, k)
    while True:
        # a merge takes the lists of FAN_IN tiles: no task meets more than FAN_IN * k rows of a query
        merged = tops.groupBy("row", "query_id", F.floor(F.col("part") / FAN_IN).cast("int").alias("part")).agg(one().alias("top"))
        shards = math.ceil(shards / FAN_IN)
        if shards <= 1:
            break
        tops = merged.select("row", "query_id", "part", F.explode("top").alias("t")).select("row", "query_id", "t.vec_id", "t.score", "part")
    return merged.select("query_id", F.posexplode("top").alias("at", "t")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), "t.vec_id", "t.score")
