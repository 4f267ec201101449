"""Gauges and metrics: status counts, backlog age, event counts, durations, failure streaks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import lag_ms
from ..sources.schemas import STATUSES

#: Failures in a row at which one alarm is raised.
ESCALATE_AT = 5
#: Durations are counted by ranges of so many thousandths of a millisecond.
RANGE_MICROS = 4096
#: Rows that one sweep of the reaper takes at most.
SWEEP_ROWS = 1_000


def _gauges(now: Column) -> list[Column]:
    due = F.when((F.col("status") == "pending") & (F.col("run_at") <= now), F.col("run_at"))
    counts = [F.count_if(F.col("status") == s).alias(s) for s in STATUSES]
    return [*counts, F.min(due).alias("oldest_due_run_at"), lag_ms(now, F.min(due)).alias("lag_ms")]


def queue_stats(jobs: DataFrame, now: Column, job_type: str | None = None) -> DataFrame:
    """One row: jobs by status, the oldest due run_at, and how late it is. An empty queue gives zeros."""
    rows = jobs if job_type is None else jobs.filter(F.col("type") == job_type)
    return rows.agg(*_gauges(now))


def queue_stats_by_type(jobs: DataFrame, now: Column) -> DataFrame:
    """The same for each type."""
    return jobs.groupBy("type").agg(*_gauges(now))


def backlog(jobs: DataFrame, now: Column) -> DataFrame:
    """For each type with due jobs: how many, the oldest, and its lag."""
    due = jobs.filter((F.col("status") == "pending") & (F.col("run_at") <= now))
    return due.groupBy("type").agg(F.count("id").alias("n_due"), F.min("run_at").alias("oldest_run_at"), lag_ms(now, F.min("run_at")).alias("lag_ms"))


def event_counts(events: DataFrame) -> DataFrame:
    """Events by kind and type; failures told apart into dead and retried."""
    failed = F.col("kind") == "failed"
    return events.groupBy("kind", "type").agg(F.count("event_id").alias("n"), F.count_if(failed & F.col("terminal")).alias("n_dead"), F.count_if(failed & ~F.col("terminal")).alias("n_retried"))


def duration_stats(events: DataFrame) -> DataFrame:
    """Durations of finished runs by kind and type, in thousandths, with the exact median.

    Counts by range of values say in which ranges the median's two values lie; only these are
    looked at value by value. No task holds more than one range's different values.
    """
    group = ["kind", "type"]
    whole = F.round(F.col("duration_ms") * 1000).cast("bigint")
    done = events.filter("kind in ('completed', 'failed')").select(*group, "event_id", whole.alias("micros")).withColumn("range", F.expr(f"micros div {RANGE_MICROS}"))
    stats = done.groupBy(*group).agg(F.count("event_id").alias("n"), F.sum("micros").alias("sum_micros"), F.min("micros").alias("min_micros"), F.max("micros").alias("max_micros"), F.count("micros").alias("m"))

    def upto(rows: DataFrame, within: list[str], by: str) -> DataFrame:
        order = Window.partitionBy(*within).orderBy(by).rowsBetween(Window.unboundedPreceding, 0)
        return rows.withColumn("upto", F.sum("c").over(order))

    def holds(rank: str, below: Column) -> Column:
        return (F.expr(rank) >= below + F.col("upto") - F.col("c")) & (F.expr(rank) < below + F.col("upto"))

    first, second = "(m - 1) div 2", "m div 2"  # places of the two middle values, from 0
    ranges = upto(done.filter("micros is not null").groupBy(*group, "range").agg(F.count("micros").alias("c")), group, "range").join(stats.select(*group, "m"), group)
    none = F.lit(0)
    ranges = ranges.filter(holds(first, none) | holds(second, none)).select(*group, "range", "m", (F.col("upto") - F.col("c")).alias("below"))
    values = done.groupBy(*group, "range", "micros").agg(F.count("micros").alias("c")).join(ranges, [*group, "range"])
    values = upto(values, [*group, "range"], "micros")
    times = holds(first, F.col("below")).cast("int") + holds(second, F.col("below")).cast("int")
    middle = values.groupBy(*group).agg(F.sum(F.col("micros") * times).alias("twice_median_micros"))
    return stats.join(middle, group, "left").select(*group, "n", "sum_micros", "min_micros", "max_micros", "twice_median_micros")


def failure_streaks(events: DataFrame) -> DataFrame:
    """Runs of failures of each type that no completion interrupts, and whether they raise the alarm.

    A streak's failures share the number of completions before them. That is counted hour by
    hour: a window adds up the hours' completions, others number the events within each hour.
    """
    ended = events.filter("kind in ('completed', 'failed')").withColumn("hour", F.date_trunc("hour", "ts")).withColumn("done", (F.col("kind") == "completed").cast("bigint"))
    hours = ended.groupBy("type", "hour").agg(F.sum("done").alias("done_then"))
    before = F.coalesce(F.sum("done_then").over(Window.partitionBy("type").orderBy("hour").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    hours = hours.select("type", "hour", before.alias("before"))
    within = F.sum("done").over(Window.partitionBy("type", "hour").orderBy("ts", "event_id"))
    islands = ended.withColumn("within", within).filter("kind = 'failed'").join(hours, ["type", "hour"]).withColumn("island", F.col("before") + F.col("within"))
    streaks = islands.groupBy("type", "island").agg(F.count("event_id").alias("failures"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    return streaks.select("type", "failures", "first_ts", "last_ts", (F.col("failures") >= ESCALATE_AT).alias("escalated"))


def sweep_load(candidates: DataFrame, most: int = SWEEP_ROWS) -> DataFrame:
    """One row: how many rows a sweep handles, and whether it is saturated."""
    return candidates.agg(F.least(F.count("id"), F.lit(most)).alias("handled"), (F.count("id") >= most).alias("saturated"))
