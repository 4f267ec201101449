"""The step journal: what a resumed run replays, where it diverges, and how large it may grow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import JOURNAL_BYTES, LOG_CHARS, LOG_ENTRIES, record_bytes, truncated_log


def replay_plan(requested: DataFrame, journal: DataFrame) -> DataFrame:
    """requested (job_id, seq, name) with action: replay, execute, or diverged (another name at that place)."""
    known = journal.select("job_id", "seq", F.col("name").alias("recorded"), "result")
    rows = requested.join(known, ["job_id", "seq"], "left")
    action = F.when(F.col("recorded").isNull(), "execute").when(F.col("recorded") == F.col("name"), "replay").otherwise("diverged")
    return rows.withColumn("action", action).withColumn("result", F.when(F.col("action") == "replay", F.col("result")))


def first_divergence(requested: DataFrame, journal: DataFrame) -> DataFrame:
    """For each run that diverges, where it first does and the two names."""
    return (
        replay_plan(requested, journal)
        .filter("action = 'diverged'")
        .groupBy("job_id")
        .agg(F.min("seq").alias("seq"), F.min_by("recorded", "seq").alias("recorded"), F.min_by("name", "seq").alias("requested"))
    )


def deduplicated(appends: DataFrame, arrival: str = "arrival") -> DataFrame:
    """Appends with status: the first at a place is appended, later ones of the same name are already recorded, others diverge."""
    order = Window.partitionBy("job_id", "seq").orderBy(arrival)
    rows = appends.withColumn("rn", F.row_number().over(order)).withColumn("kept_name", F.first("name").over(order))
    status = F.when(F.col("rn") == 1, "appended").when(F.col("name") == F.col("kept_name"), "already-recorded").otherwise("diverged")
    return rows.withColumn("status", status).drop("rn", "kept_name")


def with_budget(journal: DataFrame, limit: int = JOURNAL_BYTES) -> DataFrame:
    """Steps with their size, the running total of their run, and whether the total is within the limit."""
    order = Window.partitionBy("job_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    rows = journal.withColumn("bytes", record_bytes(F.col("seq"), F.col("name"), F.col("result")))
    return rows.withColumn("total_bytes", F.sum("bytes").over(order)).withColumn("fits", F.col("total_bytes") <= limit)


def append_steps(appends: DataFrame, jobs: DataFrame, journal: DataFrame, limit: int = JOURNAL_BYTES) -> DataFrame:
    """appends (job_id, token, seq, name, result), at most one for a job, with status and the journal's bytes afterwards.

    lease-lost: the job isn't active under the token. A place that is taken is already-recorded
    or, under another name, diverged. too-large: the journal would pass the limit; nothing is
    written. appended steps renew the lease: see leases_renewed().
    """
    size = record_bytes(F.col("seq"), F.col("name"), F.col("result"))
    totals = journal.groupBy("job_id").agg(F.sum(size).alias("total"))
    known = journal.select("job_id", "seq", F.col("name").alias("recorded"))
    held = jobs.filter("status = 'active'").select(F.col("id").alias("job_id"), F.col("claim_token").alias("token"), F.lit(True).alias("held"))
    rows = appends.join(held, ["job_id", "token"], "left").join(known, ["job_id", "seq"], "left").join(totals, "job_id", "left")
    before = F.coalesce("total", F.lit(0)).cast("bigint")
    status = (
        F.when(F.col("held").isNull(), "lease-lost")
        .when(F.col("recorded") == F.col("name"), "already-recorded")
        .when(F.col("recorded").isNotNull(), "diverged")
        .when(before + size > limit, "too-large")
        .otherwise("appended")
    )
    rows = rows.withColumn("status", status)
    return rows.select(*appends.columns, "status", F.when(F.col("status") == "appended", before + size).otherwise(before).alias("journal_bytes"))


def leases_renewed(jobs: DataFrame, appended: DataFrame, now: Column) -> DataFrame:
    """jobs after append_steps(): those with an appended step hold their lease from now on."""
    hit = appended.filter("status = 'appended'").select(F.col("job_id").alias("id"), F.lit(True).alias("hit"))
    return jobs.join(hit, "id", "left").withColumn("claimed_at", F.when(F.col("hit"), now).otherwise(F.col("claimed_at"))).select(jobs.columns)


def read_steps(journal: DataFrame) -> DataFrame:
    """Each run's records in order of seq, whatever order they were stored in."""
    return journal.groupBy("job_id").agg(F.array_sort(F.collect_list(F.struct("seq", "name", "result"))).alias("steps"))


def sorted_steps(journal: DataFrame) -> DataFrame:
    """Each run's step names in order of seq, whatever order they were stored in."""
    pairs = F.array_sort(F.collect_list(F.struct("seq", "name")))
    return journal.groupBy("job_id").agg(pairs.alias("steps")).select("job_id", F.size("steps").cast("bigint").alias("n_steps"), F.array_join(F.transform("steps", lambda s: s["name"]), ">").alias("names"))


def append_logs(kept: DataFrame, entries: DataFrame, most: int = LOG_ENTRIES, chars: int = LOG_CHARS) -> DataFrame:
    """What is kept of jobs' logs (job_id, seq, message) after entries of that shape were added: the newest of each job.

    Messages are cut to chars; kept ones were when they came. Tasks pass on the newest of each
    job only, whatever the number of entries.
    """
    new = entries.select("job_id", "seq", truncated_log(F.col("message"), chars).alias("message"))
    return log_tail(kept.select("job_id", "seq", "message").unionByName(new), most)


def log_tail(logs: DataFrame, most: int = LOG_ENTRIES) -> DataFrame:
    """The newest entries (job_id, seq, message) of each job."""
    return logs.withColumn("rn", F.row_number().over(Window.partitionBy("job_id").orderBy(F.desc("seq")))).filter(F.col("rn") <= most).drop("rn")
