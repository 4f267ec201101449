"""What lifecycle commands do to jobs, for whole batches of commands on different jobs.

A batch holds at most one command for a job; operators.apply makes the new rows. Commands with
a token are fenced: they count only while the job's own token is the same. The pending job that
supersedes another may be that other itself, where an unfenced command fails a pending job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import backoff_ms, later_by_ms
from .gauges import SWEEP_ROWS

VISIBILITY_MS = 300_000
REAPED = "stuck: attempts exhausted"


def followers(jobs: DataFrame) -> DataFrame:
    """Keys with a pending job in scope 'pending', of any type, due or not."""
    return jobs.filter("status = 'pending' and dedupe_scope = 'pending' and dedupe_key is not null").select("dedupe_key").distinct().withColumn("follower", F.lit(True))


def followed() -> Column:
    """Does a pending job of its slot supersede a row joined with followers()?"""
    return F.coalesce(F.col("follower"), F.lit(False)) & (F.col("dedupe_scope") == "pending")


def open_to(token: str = "token") -> Column:
    """An open row that the command may change."""
    fenced = F.col(token).isNotNull()
    return F.when(fenced, (F.col("status") == "active") & (F.col("claim_token") == F.col(token))).otherwise(F.col("status").isin("pending", "active"))


def miss_class(token: str = "token") -> Column:
    """Why a command on a joined row changed nothing."""
    return (
        F.when(F.col("status").isNull(), "not-found")
        .when(F.col("status").isin("completed", "failed", "superseded"), "already-terminal")
        .otherwise("lease-lost")
    )


def fail_outcomes(commands: DataFrame, jobs: DataFrame, now: Column) -> DataFrame:
    """commands (job_id, token) -> (job_id, outcome, retry_run_at).

    A follower supersedes the failing job; else exhausted attempts end it; else it is pending
    again after its back-off.
    """
    rows = commands.join(jobs, commands["job_id"] == jobs["id"], "left").join(followers(jobs), "dedupe_key", "left")
    outcome = (
        F.when(F.coalesce(open_to(), F.lit(False)), F.when(F.coalesce(followed(), F.lit(False)), "superseded").when(F.col("attempt") >= F.col("max_attempts"), "failed-terminal").otherwise("retry-scheduled"))
        .otherwise(miss_class())
    )
    delay = backoff_ms(F.col("attempt"), F.col("backoff_strategy"), F.col("backoff_base_ms"), F.col("backoff_cap_ms"), F.col("id"))
    return rows.withColumn("outcome", outcome).select("job_id", "outcome", F.when(F.col("outcome") == "retry-scheduled", later_by_ms(now, delay)).alias("retry_run_at"))


def release_outcomes(commands: DataFrame, jobs: DataFrame) -> DataFrame:
    """commands (job_id, token) -> (job_id, outcome): released, or superseded where the slot has a pending job.

    The attempt that the claim counted stays counted. Without a token only active jobs can be
    released; an open job that isn't active has lost its lease.
    """
    rows = commands.join(jobs, commands["job_id"] == jobs["id"], "left").join(followers(jobs), "dedupe_key", "left")
    may = F.coalesce(open_to() & (F.col("status") == "active"), F.lit(False))
    outcome = F.when(may, F.when(F.coalesce(followed(), F.lit(False)), "superseded").otherwise("released")).otherwise(miss_class())
    return rows.select("job_id", outcome.alias("outcome"))


def latest_receipts(receipts: DataFrame) -> DataFrame:
    """(job_id, t, op, told): the newest answer for each job, token ('' for none) and operation."""
    return receipts.groupBy("job_id", F.coalesce("token", F.lit("")).alias("t"), "op").agg(F.max_by("outcome", F.struct("at", "outcome")).alias("told"))


def complete_outcomes(commands: DataFrame, jobs: DataFrame, receipts: DataFrame) -> DataFrame:
    """commands (job_id, token) -> (job_id, outcome).

    A job that the reaper failed while its owner still worked may be completed by that owner, as
    long as the owner's token has no receipt. A command that comes again is one of its own, but
    where again is set (an optional column: it repeats one whose answer was lost) the newest
    receipt (job_id, token, op, outcome, at) of its own operation answers it.
    """
    if "again" not in commands.columns:
        commands = commands.withColumn("again", F.lit(False))
    own = latest_receipts(receipts.filter("op = 'complete'")).drop("op")
    any_receipt = receipts.filter("token is not null").select("job_id", "token").distinct().withColumn("answered", F.lit(True))
    rows = commands.join(jobs, commands["job_id"] == jobs["id"], "left").join(any_receipt, ["job_id", "token"], "left")
    rows = rows.withColumn("t", F.coalesce("token", F.lit(""))).join(own, ["job_id", "t"], "left")
    late = (F.col("status") == "failed") & (F.col("claim_token") == F.col("token")) & F.col("answered").isNull()
    done = F.coalesce(open_to() | late, F.lit(False))
    return rows.select("job_id", F.coalesce(F.when(F.col("again"), F.col("told")), F.when(done, "completed").otherwise(miss_class())).alias("outcome"))


def heartbeat_outcomes(commands: DataFrame, jobs: DataFrame) -> DataFrame:
    """commands (job_id, token) -> (job_id, outcome): applied, or lease-lost whatever the reason; unfenced beats always apply."""
    rows = commands.join(jobs, commands["job_id"] == jobs["id"], "left")
    hit = F.coalesce((F.col("status") == "active") & (F.col("claim_token") == F.col("token")), F.lit(False))
    outcome = F.when(F.col("token").isNull() | hit, "applied").otherwise("lease-lost")
    return rows.select("job_id", outcome.alias("outcome"))


def batch_heartbeat(jobs: DataFrame, beats: DataFrame, now: Column) -> DataFrame:
    """jobs with the lease of every active one among beats (job_id) renewed."""
    hit = beats.select(F.col("job_id").alias("id")).distinct().withColumn("beat", F.lit(True))
    return jobs.join(hit, "id", "left").withColumn("claimed_at", F.when(F.col("beat") & (F.col("status") == "active"), now).otherwise(F.col("claimed_at"))).select(jobs.columns)


def reaper_candidates(jobs: DataFrame, now: Column, timeout_ms: int = VISIBILITY_MS, most: int = SWEEP_ROWS) -> DataFrame:
    """Active jobs whose lease ran out, oldest lease first, as many as a sweep takes."""
    return jobs.filter((F.col("status") == "active") & (F.col("claimed_at") < later_by_ms(now, F.lit(-timeout_ms)))).orderBy("claimed_at", "id").limit(most)


def reaper_outcomes(jobs: DataFrame, now: Column, timeout_ms: int = VISIBILITY_MS, most: int = SWEEP_ROWS) -> DataFrame:
    """(id, new_status, fail_reason, new_run_at) for the jobs of one sweep; attempts stay as they are."""
    rows = reaper_candidates(jobs, now, timeout_ms, most).join(followers(jobs), "dedupe_key", "left")
    spent = F.col("attempt") >= F.col("max_attempts")
    status = F.when(F.coalesce(followed(), F.lit(False)), "superseded").when(spent, "failed").otherwise("pending")
    delay = backoff_ms(F.col("attempt"), F.col("backoff_strategy"), F.col("backoff_base_ms"), F.col("backoff_cap_ms"), F.col("id"))
    rows = rows.withColumn("new_status", status)
    return rows.select("id", "new_status", F.when(F.col("new_status") == "failed", F.lit(REAPED)).alias("fail_reason"), F.when(F.col("new_status") == "pending", later_by_ms(now, delay)).alias("new_run_at"))
