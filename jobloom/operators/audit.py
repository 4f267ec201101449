"""What two states of the job table, and the receipts written between them, say about the writes in between."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.schemas import TERMINAL
from .lookups import RETENTION_DAYS, expired


def terminal_writes(before: DataFrame, after: DataFrame, receipts: DataFrame, now: Column, days: int = RETENTION_DAYS) -> DataFrame:
    """(rule, job_id, n) for each job whose history between two snapshots can't be.

    job lost: it is gone, though retention doesn't delete it. written again: it was finished
    before, and its end is another now, a failed one completed late by its owner aside. ends
    twice: more than one receipt of an end, a retry or a release being none. end without receipt: it
    finished, and neither a receipt nor the reaper says so. attempt falls back: it has fewer
    attempts than before. receipts are (job_id, token, op, outcome, at) written in between.
    """
    columns = ("id", "status", "attempt", "completed_at", "failed_at", "fail_reason", "claim_token")
    old = before.select(*(F.col(c).alias(f"old_{c}") for c in columns), expired(now, days).alias("old_expired"))
    new = after.select(*columns)
    ends = F.col("outcome").isin("completed", "failed-terminal", "superseded")
    told = receipts.groupBy(F.col("job_id").alias("told_id")).agg(F.count_if(ends).alias("ends"), F.count_if(F.col("outcome") == "completed").alias("completions"))
    rows = old.join(new, F.col("old_id") == F.col("id"), "full").withColumn("job_id", F.coalesce("id", "old_id")).join(told, F.col("job_id") == F.col("told_id"), "left").fillna(0, ["ends", "completions"])
    was, is_ = F.col("old_status").isin(*TERMINAL), F.col("status").isin(*TERMINAL)
    same_end = (F.col("status") == F.col("old_status")) & F.col("completed_at").eqNullSafe(F.col("old_completed_at")) & F.col("failed_at").eqNullSafe(F.col("old_failed_at"))
    late = (F.col("old_status") == "failed") & (F.col("status") == "completed")
    reaped = F.coalesce(F.col("fail_reason").startswith("stuck:"), F.lit(False)) | (F.col("status") == "superseded")
    rules = [
        ("job lost", F.col("id").isNull() & ~F.col("old_expired"), F.lit(1)),
        ("written again", was & F.col("id").isNotNull() & ~same_end & ~late, F.lit(1)),
        # the reaper's failure has no receipt, so a late completion has but its own
        ("ends twice", F.col("ends") > 1, F.col("ends")),
        ("end without receipt", is_ & ~F.coalesce(was, F.lit(False)) & F.col("old_id").isNotNull() & (F.col("ends") == 0) & ~reaped, F.lit(1)),
        ("attempt falls back", F.col("attempt") < F.col("old_attempt"), F.col("old_attempt") - F.col("attempt")),
    ]
    found = F.array_compact(F.array(*(F.when(F.coalesce(broken, F.lit(False)), F.struct(F.lit(name).alias("rule"), n.cast("bigint").alias("n"))) for name, broken, n in rules)))
    return rows.select("job_id", F.explode(found).alias("x")).select("x.rule", "job_id", "x.n")
