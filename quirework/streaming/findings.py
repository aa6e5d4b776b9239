"""Incremental audits over streams: an addition to what the batch queries tell."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirework import schemas


def call_log(spark: SparkSession, folder: str) -> DataFrame:
    """The call log as a stream of its JSON lines."""
    return spark.readStream.schema(schemas.CALL_LOG).json(folder)


def failures(calls: DataFrame) -> DataFrame:
    """(tool, calls, failed): running counts; partial sums come before the shuffle, the state is a row for each tool."""
    return calls.groupBy("tool").agg(F.count(F.lit(1)).alias("calls"), F.count_if(~F.coalesce(F.col("ok"), F.lit(False))).alias("failed"))


def rates(events: DataFrame, late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """(window, event_type, n, total): tumbling windows by event time; what comes later than `late` is left out, so that state stays bounded."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    return timed.groupBy(F.window("at", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def sessions(events: DataFrame, late: str = "1 hour", gap: str = "30 minutes") -> DataFrame:
    """(user_id, session, n): events of a user with no longer pause than gap."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    return timed.groupBy(F.session_window("at", gap).alias("session"), "user_id").agg(F.count(F.lit(1)).alias("n"))


def unique(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Events without repetitions of their id within the watermark."""
    return events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late).dropDuplicatesWithinWatermark(["event_id"])
