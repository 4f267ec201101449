"""Batches of a live queue: admit requests, claim, run handlers, sweep; each rewrites the partitions that it touches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import admission, apply, lookups, slots, transitions
from ..operators.gauges import SWEEP_ROWS
from ..sources import schemas
from ..sources.store import QueueStore
from .feed import POLL_MS

#: Wait between sweeps.
REAPER_MS = 60_000


def _seen(store: QueueStore, stream: str, batch: int) -> bool:
    return not store.log("batches").filter((F.col("stream") == stream) & (F.col("batch") == batch)).isEmpty()


def _batch_row(spark: SparkSession, stream: str, batch: int) -> DataFrame:
    return spark.createDataFrame([(stream, batch)], schemas.BATCHES)


def admit_requests(requests: DataFrame, store: QueueStore, checkpoint: str, once: bool = True) -> StreamingQuery:
    """A stream of requests, shaped as jobs, into the store: each batch adds those that slots have room for.

    Only open jobs are read. A batch that ran before changes nothing, and neither does a request
    whose id an open job, or an earlier request of the batch, has.
    """

    def batch(rows: DataFrame, number: int) -> None:
        if _seen(store, checkpoint, number):
            return
        jobs = store.jobs(open_only=True)
        new = admission.distinct_requests(rows).join(jobs.select("id"), "id", "left_anti")
        store.update(admission.enqueue(new, jobs).filter("admitted").select(jobs.columns), None, {"batches": _batch_row(rows.sparkSession, checkpoint, number)})

    writer = requests.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{POLL_MS} milliseconds")).start()


def swept(jobs: DataFrame, now: Column, timeout_ms: int = transitions.VISIBILITY_MS, most: int = SWEEP_ROWS) -> DataFrame:
    """jobs after one sweep of the reaper."""
    return _recovered(jobs, transitions.reaper_outcomes(jobs, now, timeout_ms, most), now, "left")


def _recovered(jobs: DataFrame, out: DataFrame, now: Column, how: str) -> DataFrame:
    rows = jobs.join(out.withColumnRenamed("fail_reason", "new_reason"), "id", how)
    gone = F.col("new_status").isin("failed", "superseded")
    return rows.withColumns(
        {
            "status": F.coalesce("new_status", "status"),
            "fail_reason": F.coalesce("new_reason", "fail_reason"),
            "run_at": F.coalesce("new_run_at", "run_at"),
            "failed_at": F.when(gone, now).otherwise(F.col("failed_at")),
        }
    ).select(jobs.columns)


def apply_batch(commands: DataFrame, store: QueueStore, now: Column) -> None:
    """Apply commands (job_id, op, token, reason), at most one for a job, as operators.apply takes them, to the store."""
    jobs = store.jobs()
    decided = apply.decide(commands, jobs, store.log("receipts")).persist()
    changed = decided.filter("changes").select("id")
    store.update(
        apply.jobs_after(decided, jobs, now, changed_only=True),
        jobs.join(changed, "id", "left_semi"),
        {"events": apply.events(decided, now), "receipts": apply.new_receipts(decided, now)},
    )
    decided.unpersist()


def apply_in_order(commands: DataFrame, store: QueueStore, stream: str, batch: int) -> None:
    """All commands and requests of a stream's batch, as operators.slots takes them: each slot's in the order of at, each with its own time.

    The store is written once, whatever number of commands a job has in the batch. A batch that
    the store has seen changes nothing.
    """
    if _seen(store, stream, batch):
        return
    done = slots.folded(commands, store.jobs(), store.log("receipts")).persist()
    told, at = slots.answers(done), F.col("at")
    logs = {"events": apply.events(told, at), "receipts": apply.new_receipts(told, at), "batches": _batch_row(commands.sparkSession, stream, batch)}
    store.update(slots.changed_jobs(done), slots.jobs_before(done), logs)
    done.unpersist()


def apply_commands(commands: DataFrame, store: QueueStore, checkpoint: str, once: bool = True) -> StreamingQuery:
    """A stream of commands (job_id, op, token, reason, at, and what else operators.slots takes) applied batch by batch, each command once."""

    def batch(rows: DataFrame, number: int) -> None:
        apply_in_order(rows, store, checkpoint, number)

    writer = commands.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{POLL_MS} milliseconds")).start()


def sweep(store: QueueStore, now: Column, timeout_ms: int = transitions.VISIBILITY_MS, most: int = SWEEP_ROWS) -> None:
    """One sweep of the store, with a reaper-recovered event that says how many jobs it handled, and whether that is as many as it may.

    Where no job is stuck nothing is written.
    """
    jobs = store.jobs(open_only=True)
    out = transitions.reaper_outcomes(jobs, now, timeout_ms, most).persist()
    handled = out.count()
    if handled:
        told = jobs.sparkSession.range(1).select(F.lit("reaper-recovered").alias("kind"), now.alias("ts"), F.lit(handled).cast("bigint").alias("handled"), F.lit(handled >= most).alias("saturated"))
        store.update(_recovered(jobs, out, now, "inner"), jobs.join(out.select("id"), "id", "left_semi"), {"events": told})
    out.unpersist()


def sweep_periodically(ticks: DataFrame, store: QueueStore, checkpoint: str, timeout_ms: int = transitions.VISIBILITY_MS) -> StreamingQuery:
    """A stream of ticks (a rate source, say) whose every batch, REAPER_MS apart, sweeps the store once; a sweep that fails is a reaper-error event, and the next goes on."""

    def batch(rows: DataFrame, _: int) -> None:
        now = rows.sparkSession.sql("SELECT cast(current_timestamp() AS timestamp_ntz)").first()[0]
        try:
            sweep(store, F.lit(now), timeout_ms)
        except Exception as e:  # noqa: BLE001  the next sweep tries again
            failed = rows.sparkSession.createDataFrame([("reaper-error", now, str(e))], "kind string, ts timestamp_ntz, reason string")
            store.append("events", failed)

    return ticks.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(processingTime=f"{REAPER_MS} milliseconds").start()


def cleaned(jobs: DataFrame, now: Column, days: int = lookups.RETENTION_DAYS) -> DataFrame:
    """jobs without those that retention deletes."""
    return lookups.retention_survivors(jobs, now, days)
