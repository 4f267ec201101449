"""Leases as sessions of heartbeats."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def with_gap(beats: DataFrame) -> DataFrame:
    """beats (job_id, ts) with the time of the beat before and the gap in milliseconds."""
    order = Window.partitionBy("job_id").orderBy("ts")
    rows = beats.withColumn("before", F.lag("ts").over(order))
    return rows.withColumn("gap_ms", F.timestamp_diff("MILLISECOND", F.col("before"), F.col("ts")))


def lapses(beats: DataFrame, timeout_ms: int) -> DataFrame:
    """Times without a lease: gaps longer than the timeout. A gap of exactly the timeout still holds."""
    return with_gap(beats).filter(F.col("gap_ms") > timeout_ms).select("job_id", F.col("before").alias("last_beat"), F.col("ts").alias("next_beat"), "gap_ms")


def sessions(beats: DataFrame, timeout_ms: int) -> DataFrame:
    """Unbroken leases of each job: first and last beat, and how many."""
    order = Window.partitionBy("job_id").orderBy("ts")
    rows = with_gap(beats).withColumn("session", F.sum(F.when(F.col("gap_ms") > timeout_ms, 1).otherwise(0)).over(order))
    return rows.groupBy("job_id", "session").agg(F.min("ts").alias("first_beat"), F.max("ts").alias("last_beat"), F.count("ts").alias("n_beats"))
