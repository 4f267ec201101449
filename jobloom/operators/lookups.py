"""Reads that change nothing: filters, the public view, outstanding work, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.schemas import PUBLIC

RETENTION_DAYS = 7


def find(jobs: DataFrame, statuses: list[str] | None = None, user_id: int | None = None, **equal: str | int) -> DataFrame:
    """Jobs that match all that is given; user_id looks into the payload."""
    out = jobs
    for name, value in equal.items():
        out = out.filter(F.col(name) == value)
    if statuses is not None:
        out = out.filter(F.col("status").isin(statuses))
    if user_id is not None:
        out = out.filter(F.get_json_object("data", "$.userId").cast("bigint") == user_id)
    return public_view(out)


def find_one(jobs: DataFrame, **query: object) -> DataFrame:
    """The matching job with the smallest id, or no row."""
    return find(jobs, **query).orderBy("id").limit(1)


def public_view(jobs: DataFrame) -> DataFrame:
    """Jobs without what callers must not see: tokens and back-off settings."""
    return jobs.select(*PUBLIC)


def has_outstanding(jobs: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (type, dedupe_key) with outstanding: is a job of that type and key pending or active?"""
    open_keys = jobs.filter("status in ('pending', 'active') and dedupe_key is not null").select("type", "dedupe_key").distinct().withColumn("hit", F.lit(True))
    return wanted.join(open_keys, ["type", "dedupe_key"], "left").select("type", "dedupe_key", F.coalesce("hit", F.lit(False)).alias("outstanding"))


def expired(now: Column, days: int = RETENTION_DAYS) -> Column:
    """Finished longer ago than the retention: completed by completed_at, failed and superseded by failed_at."""
    cutoff = F.timestamp_add("DAY", F.lit(-days), now)
    done = (F.col("status") == "completed") & (F.col("completed_at") < cutoff)
    gone = F.col("status").isin("failed", "superseded") & (F.col("failed_at") < cutoff)
    return F.coalesce(done | gone, F.lit(False))


def retention_victims(jobs: DataFrame, now: Column, days: int = RETENTION_DAYS) -> DataFrame:
    """Jobs that retention deletes."""
    return jobs.filter(expired(now, days))


def retention_survivors(jobs: DataFrame, now: Column, days: int = RETENTION_DAYS) -> DataFrame:
    """What the table is rewritten with."""
    return jobs.filter(~expired(now, days))
