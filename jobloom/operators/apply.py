"""A batch of lifecycle commands applied: the jobs afterwards, the receipts, and the events.

Commands are (job_id, op, token, reason): in a batch at most one for a job, or any number of
heartbeats, which change nothing that another depends on. decide() joins them to their jobs once; what follows from its rows are projections, and one join back to the jobs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import backoff_ms, later_by_ms
from .transitions import followed, followers, latest_receipts, miss_class, open_to

TERMINAL_OPS = ("complete", "fail", "failFatal", "release")
HEARTBEATS = ("heartbeat", "heartbeatClaimed")
#: Fixed value: what a superseded job's reason ends with.
SUPERSEDED_NOTE = " (superseded: a queued follow-up already covers this work)"


def decide(commands: DataFrame, jobs: DataFrame, receipts: DataFrame) -> DataFrame:
    """commands with their job's columns (null where there is none), outcome, and whether it changes the job.

    A command that comes again is a command of its own: an unfenced fail, say, counts each time.
    Only where again is set (an optional column: it repeats one whose answer was lost) the
    newest receipt (job_id, token, op, outcome, at) answers it with what that was told, and
    nothing changes. Of the job's columns id and status keep their names.
    """
    told = latest_receipts(receipts)
    if "again" not in commands.columns:
        commands = commands.withColumn("again", F.lit(False))
    answered = receipts.filter("token is not null").select("job_id", F.col("token").alias("t")).distinct().withColumn("answered", F.lit(True))
    rows = commands.join(jobs, commands["job_id"] == jobs["id"], "left").join(followers(jobs), "dedupe_key", "left")
    rows = rows.withColumn("t", F.coalesce("token", F.lit(""))).join(told, ["job_id", "t", "op"], "left").join(answered, ["job_id", "t"], "left")

    op, own = F.col("op"), F.coalesce(F.col("claim_token") == F.col("token"), F.lit(False))
    active, failed = F.col("status") == "active", F.col("status") == "failed"
    covered = F.coalesce(followed(), F.lit(False))
    done = F.when(op == "complete", open_to() | (failed & own & F.col("answered").isNull()))
    done = done.when(op == "release", active & open_to()).when(op == "completeClaimed", own & (active | failed))
    done = done.when(op == "heartbeatClaimed", own & active).when(op == "heartbeat", F.col("token").isNull() | (own & active)).otherwise(open_to())
    hit = F.coalesce(done, F.lit(False))
    told_again = F.when(F.col("again"), F.col("told"))
    result = (
        F.when(op.isin("complete", "completeClaimed"), "completed")
        .when(op == "failFatal", "failed-terminal")
        .when(op == "release", F.when(covered, "superseded").otherwise("released"))
        .when(op == "fail", F.when(covered, "superseded").when(F.col("attempt") >= F.col("max_attempts"), "failed-terminal").otherwise("retry-scheduled"))
        .when(op == "heartbeat", "applied")
        .when(op == "heartbeatClaimed", "heartbeated")
    )
    # only terminal commands say why they missed
    miss = F.when(op.isin(*TERMINAL_OPS), miss_class()).otherwise("lease-lost")
    rows = rows.withColumn("outcome", F.coalesce(told_again, F.when(hit, result).otherwise(miss)))
    return rows.withColumn("changes", told_again.isNull() & hit & F.col("id").isNotNull()).drop("t", "told", "again", "answered", "follower")


def jobs_after(decided: DataFrame, jobs: DataFrame, now: Column, changed_only: bool = False) -> DataFrame:
    """jobs as the decided commands leave them; all others as they are, or left out.

    A retry keeps its token and lease times, as a late completion needs them; a release drops both.
    Two commands that change one job, heartbeats aside, are an error: see operators.slots for those.
    """
    beat = F.col("op").isin(*HEARTBEATS)
    done = decided.filter("changes").groupBy("id").agg(F.count_if(~beat).alias("n"), F.min(F.struct(beat, "op", "outcome", "reason")).alias("x"))
    done = done.withColumn("x", F.when(F.col("n") > 1, F.raise_error(F.concat(F.lit("several commands for job "), F.col("id")))).otherwise(F.col("x"))).select("id", "x.op", "x.outcome", "x.reason")
    rows = jobs.join(done, "id", "inner" if changed_only else "left")
    is_ = lambda *x: F.coalesce(F.col("outcome").isin(*x), F.lit(False))
    delay = backoff_ms(F.col("attempt"), F.col("backoff_strategy"), F.col("backoff_base_ms"), F.col("backoff_cap_ms"), F.col("id"))
    ended = is_("failed-terminal", "superseded")
    reason = F.when(is_("superseded"), F.concat(F.when(F.col("op") == "release", F.lit("Released")).otherwise(F.coalesce("reason", F.lit(""))), F.lit(SUPERSEDED_NOTE)))
    reason = reason.when(is_("failed-terminal", "retry-scheduled"), F.col("reason")).when(is_("completed"), F.lit(None)).otherwise(F.col("fail_reason"))
    changed = {
        "status": F.when(is_("completed"), "completed").when(is_("retry-scheduled", "released"), "pending").when(is_("superseded"), "superseded").when(is_("failed-terminal"), "failed").otherwise(F.col("status")),
        "run_at": F.when(is_("retry-scheduled"), later_by_ms(now, delay)).when(is_("released"), now).otherwise(F.col("run_at")),
        "completed_at": F.when(is_("completed"), now).otherwise(F.col("completed_at")),
        "failed_at": F.when(ended, now).when(is_("completed"), F.lit(None)).otherwise(F.col("failed_at")),
        "fail_reason": reason,
        "claimed_at": F.when(is_("applied", "heartbeated"), now).when(is_("released"), F.lit(None)).otherwise(F.col("claimed_at")),
        "claim_token": F.when(is_("released"), F.lit(None)).otherwise(F.col("claim_token")),
    }
    return rows.withColumns(changed).select(jobs.columns)


def new_receipts(decided: DataFrame, now: Column) -> DataFrame:
    """(job_id, token, op, outcome, at) of the terminal commands that changed a job."""
    return decided.filter(F.col("changes") & F.col("op").isin(*TERMINAL_OPS)).select("job_id", "token", "op", "outcome", now.alias("at"))


def events(decided: DataFrame, now: Column) -> DataFrame:
    """The lifecycle events that the commands give rise to; what was told by a receipt gives none.

    Durations run from the claim to now. lease-lost names the command that found it out.
    """
    op, outcome = F.col("op"), F.col("outcome")
    kind = (
        F.when(outcome == "lease-lost", "lease-lost")
        .when(~F.col("changes"), F.lit(None))
        .when(outcome == "completed", "completed")
        .when(op == "failFatal", "fail-fatal")
        .when(op == "claimOrEnqueue", F.when(outcome == "claimed", "claimed"))
        .when(op == "release", F.when(outcome == "released", "shutdown-released").otherwise("superseded"))
        .when(op == "fail", F.when(outcome == "superseded", "superseded").otherwise("failed"))
    )
    rows = decided.withColumn("kind", kind).filter("kind is not null")
    timed, failed = F.col("kind").isin("completed", "failed", "superseded"), F.col("kind") == "failed"
    return rows.select(
        "job_id",
        "type",
        "kind",
        now.alias("ts"),
        F.when(timed, F.timestamp_diff("MILLISECOND", F.col("claimed_at"), now)).alias("duration_ms"),
        F.when(failed | (F.col("kind") == "claimed"), F.col("attempt")).alias("attempt"),
        F.when(failed, F.col("max_attempts")).alias("max_attempts"),
        F.when(failed, outcome == "failed-terminal").alias("terminal"),
        F.when(F.col("kind").isin("failed", "superseded", "fail-fatal"), F.col("reason")).alias("reason"),
        F.when(F.col("kind") == "lease-lost", op).alias("op"),
    )


def claim_events(claimed: DataFrame, now: Column) -> DataFrame:
    """A claimed event for each claimed job, with the columns of events()."""
    null = lambda kind: F.lit(None).cast(kind)
    return claimed.select(
        F.col("id").alias("job_id"), "type", F.lit("claimed").alias("kind"), now.alias("ts"), null("bigint").alias("duration_ms"), "attempt",
        null("int").alias("max_attempts"), null("boolean").alias("terminal"), null("string").alias("reason"), null("string").alias("op"),
    )
