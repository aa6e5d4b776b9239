"""A training-data pipeline of five stages over documents: clean, line dedup, near-dedup, mix, encode.

Each stage takes (spark, docs, sf_dir), works on every row that the stage before it kept and returns a DataFrame.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirework.llm import bpe, line_dedup, mixing, quality_rules
from quirework.llm.queries import vocabulary
from quirework.session import shared_dir, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line-first rules reject go, and the failed lines of the others; n_chars follows the text."""
    out = quality_rules.keep(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines on too many of a source's documents go; n_chars follows the text."""
    out = line_dedup.drop_boilerplate(docs, report=False)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one with the smallest doc_id; near are 80 % of five-word shingles."""
    from quirework.llm import minhash

    return minhash.keep_one(docs, width=5, percent=80)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as many times as its source's rate says."""
    return mixing.repeat(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number of tokens and digests of the ids and of the decoded bytes, a row for each document of the mix."""
    return bpe.digests(docs, *vocabulary())


STAGES = [("quality", quality), ("line_dedup", dedup_lines), ("near_dedup", near_dedup), ("mix", mix), ("encode", encode)]

#: Byte-level BPE has no SQL; tests/llm hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    at = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if i == len(STAGES) - 1:
            return out
        out.write.parquet(f"{at}/{i}-{name}")
        docs = spark.read.parquet(f"{at}/{i}-{name}")
    return docs
