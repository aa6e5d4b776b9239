"""Quality scores: logistic regression on hashed word n-grams, trained by follow-the-regularised-leader."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quirework.functions.grouped import append

#: Words and runs of punctuation.
TOKENS = re.compile(r"[^\W_]+|[^\w\s]+|_+").findall
MEMO = 100_000
#: Hash of the token that stands for a repetition of the one before.
AGAIN = 0x9E3779B1


@dataclass(frozen=True)
class Settings:
    bits: int = 18
    sample: int = 8000  #: labelled rows that are learned from, at most: those with the least hashes of their ids
    updates: int = 32000  #: examples seen in training, about, in whole passes; a small sample is passed over more often
    passes: int = 30  #: passes at most
    alpha: float = 0.3
    beta: float = 1.0
    l1: float = 1e-4
    l2: float = 1e-4
    threshold: float = 0.7


class _Hashes(dict):
    def __missing__(self, token: str) -> int:
        if len(self) > MEMO:
            self.clear()
        value = self[token] = crc32(token.encode())
        return value


_hashes = _Hashes()


def features(text: str | None, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and values of a text's word 1- and 2-grams: 1 + log of counts, of length 1."""
    tokens = TOKENS(text or "")
    if not tokens:
        return np.zeros(0, np.int64), np.zeros(0)
    h = np.fromiter(map(_hashes.__getitem__, tokens), np.uint64, len(tokens))
    h[1:][h[1:] == h[:-1]] = AGAIN
    spread = np.uint64(0x9E3779B97F4A7C15)
    one = (h * spread) >> np.uint64(64 - bits)
    two = ((h[:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + h[1:] + np.uint64(1)) * spread) >> np.uint64(64 - bits)
    at, count = np.unique(np.concatenate([one, two]), return_counts=True)
    x = 1 + np.log(count)
    return at.astype(np.int64), x / np.sqrt(x @ x)


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], s: Settings) -> np.ndarray:
    """Weights, and the intercept last, after passes over rows(places, values, label) as they stand."""
    size = (1 << s.bits) + 1
    z, n = np.zeros(size), np.zeros(size)

    def weights(i: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z[i]) <= s.l1, 0.0, (np.sign(z[i]) * s.l1 - z[i]) / ((s.beta + np.sqrt(n[i])) / s.alpha + s.l2))

    for _ in range(min(s.passes, -(-s.updates // max(1, len(rows))))):
        for at, x, label in rows:
            i, v = np.append(at, size - 1), np.append(x, 1.0)
            w = weights(i)
            g = (1 / (1 + np.exp(-(w @ v))) - label) * v
            step = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / s.alpha
            z[i] += g - step * w
            n[i] += g * g
    return weights(np.arange(size)).astype(np.float32)


def held_out(doc_id: Column) -> Column:
    """Rows that are never learned from: crc32 of the id as text leaves 2 by 4. A row without id isn't one."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> np.ndarray:  # noqa: B008
    """Weights from the labelled texts that aren't held out.

    Of several labels of one id the least counts; labels without id or value don't. The learned sample has s.sample rows at
    most, whatever the size of the tables, and is learned in the order of its hashes by one task. No labelled text: all
    weights are 0, and every score 0.5.
    """
    known = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").filter(~held_out(F.col("doc_id"))).groupBy(F.col("doc_id").alias("_id")).agg(F.min("quality").alias("_label"))
    chosen = known.withColumn("_h", F.xxhash64("_id", F.lit("sample"))).orderBy("_h", "_id").limit(s.sample)
    # a repeated id is learned once
    rows = docs.select("doc_id", "text").join(chosen, F.col("doc_id") == F.col("_id"))

    def extract(texts: pa.Array) -> list[pa.Array]:
        found = [features(t.as_py(), s.bits) for t in texts]
        return [pa.array([a.astype(np.int32) for a, _ in found], pa.list_(pa.int32())), pa.array([x.astype(np.float32) for _, x in found], pa.list_(pa.float32()))]

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple, tuple] = {}
        for b in batches:
            h, i, y, at, x = (b.column(c) for c in range(5))
            for k in range(len(b)):
                known.setdefault((h[k].as_py(), i[k].as_py()), (at[k].values.to_numpy(), x[k].values.to_numpy(), y[k].as_py()))
        rows = [(a.astype(np.int64), x.astype(np.float64), y) for _, (a, x, y) in sorted(known.items())]
        yield pa.RecordBatch.from_arrays([pa.array([train(rows, s).tobytes()], pa.binary())], ["w"])

    added = T.StructType.fromDDL("at array<int>, x array<float>")
    examples = append(rows.select("_h", "_id", (F.col("_label") > 0).cast("int").alias("y"), "text"), "text", added, extract, ("text",))
    return np.frombuffer(examples.repartition(1).mapInArrow(learn, "w binary").first()["w"], np.float32)


def score(docs: DataFrame, weights: np.ndarray, s: Settings = Settings(), text: str = "text") -> DataFrame:  # noqa: B008
    """docs(doc_id, text) with held_out, score and predicted. Null and empty texts get the intercept's score. Empty table: no rows."""
    sent = docs.sparkSession.sparkContext.broadcast(weights)  # 2**bits + 1 numbers

    def found(texts: pa.Array) -> list[pa.Array]:
        w, out = sent.value, []
        for t in texts:
            at, x = features(t.as_py(), s.bits)
            out.append(1 / (1 + np.exp(-(float(w[at] @ x) + float(w[-1])))))
        return [pa.array(out, pa.float64())]

    scored = append(docs.select("doc_id", F.col(text).alias("t")), "t", T.StructType().add("score", "double"), found, ("t",))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= s.threshold).cast("int").alias("predicted"))
