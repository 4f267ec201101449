"""Which jobs may exist together: slots, admission of requests, coalescing, and the audit.

A slot is a key with its scope. Scope 'pending+active' allows one open job; scope 'pending' one
pending and one active. Slots ignore the job's type, and the two scopes ignore each other.
Jobs without a key are never held back, and never enter a shuffle on the key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLOT = ("dedupe_key", "dedupe_scope")


def slot_part() -> Column:
    """What a scope tells apart within a slot: the status, or nothing."""
    return F.when(F.col("dedupe_scope") == "pending", F.col("status")).otherwise(F.lit("open"))


def admitted_jobs(jobs: DataFrame) -> DataFrame:
    """jobs without the open rows that a slot has no room for: the first by run_at, then id, stays."""
    keyed = F.col("dedupe_key").isNotNull() & F.col("status").isin("pending", "active")
    order = Window.partitionBy(*SLOT, "slot_part").orderBy("run_at", "id")
    first = jobs.filter(keyed).withColumn("slot_part", slot_part()).withColumn("rn", F.row_number().over(order)).filter("rn = 1")
    return jobs.filter(~keyed).union(first.drop("slot_part", "rn"))


def distinct_requests(requests: DataFrame) -> DataFrame:
    """One request for each id: the first by run_at, then by its data."""
    first = Window.partitionBy("id").orderBy("run_at", "data", "type")
    return requests.withColumn("rn", F.row_number().over(first)).filter("rn = 1").drop("rn")


def enqueue(requests: DataFrame, existing: DataFrame) -> DataFrame:
    """requests (id, type, data, dedupe_key, dedupe_scope, run_at, ...) with admitted and blocked_by.

    A keyed request is admitted when the slot is free in existing and no request before it, by
    run_at and id, takes the slot. blocked_by says what held it back: 'existing' or 'batch'.
    """
    held = existing.filter("dedupe_key is not null and (status = 'pending' or status = 'active' and dedupe_scope = 'pending+active')").select(*SLOT).distinct().withColumn("held", F.lit(True))
    order = Window.partitionBy(*SLOT).orderBy("run_at", "id")
    keyed = requests.filter("dedupe_key is not null").withColumn("rn", F.row_number().over(order)).join(held, [*SLOT], "left")
    reason = F.when(F.col("held"), F.lit("existing")).when(F.col("rn") > 1, F.lit("batch"))
    keyed = keyed.withColumn("blocked_by", reason).select(*requests.columns, "blocked_by")
    free = requests.filter("dedupe_key is null").withColumn("blocked_by", F.lit(None).cast("string"))
    return keyed.union(free).withColumn("admitted", F.col("blocked_by").isNull())


def coalesced(requests: DataFrame, latest: bool) -> DataFrame:
    """One follower for each keyed slot: as first asked for, or with the data of the latest request.

    With latest only the data is replaced: priority, run_at and id stay those of the first.
    """
    order = F.struct("run_at", "id")
    data = F.max_by("data", order) if latest else F.min_by("data", order)
    first = [F.min_by(c, order).alias(c) for c in ("id", "type", "priority", "run_at")]
    return requests.filter("dedupe_key is not null").groupBy(*SLOT).agg(*first, data.alias("data"), F.count("id").alias("n_requests"))


def violations(jobs: DataFrame) -> DataFrame:
    """(rule, subject, n) for each broken rule: a slot with too many jobs, or a job in an impossible state."""
    open_jobs = jobs.filter("dedupe_key is not null and status in ('pending', 'active')")
    slots = open_jobs.groupBy(*SLOT, slot_part().alias("part")).agg(F.count("id").alias("n")).filter("n > 1")
    slots = slots.select(F.concat(F.lit("slot:"), "dedupe_scope", F.lit(":"), "part").alias("rule"), F.col("dedupe_key").alias("subject"), "n")
    odd = jobs.select(
        "id",
        F.explode(F.array_compact(F.array(F.when(F.col("attempt") > F.col("max_attempts"), "attempt above maximum"), F.when((F.col("status") == "active") & (F.col("attempt") < 1), "active without attempt")))).alias("rule"),
    )
    return slots.union(odd.select("rule", F.col("id").alias("subject"), F.lit(1).cast("bigint")))
