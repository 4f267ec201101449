"""Which pending jobs are claimed, and what a claim makes of them.

k claims one after another equal one batch: drop what a held slot blocks, keep the best row of
each slot, order, and take k. The best are bounded per task before any exchange
(TakeOrderedAndProject, WindowGroupLimit).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .admission import SLOT

#: Lower priority numbers first, then the longest due; the id breaks ties.
ORDER = ("priority", "run_at", "id")


def held_slots(jobs: DataFrame) -> DataFrame:
    """Slots with an active job."""
    return jobs.filter("status = 'active' and dedupe_key is not null").select(*SLOT).distinct()


def claimable(jobs: DataFrame, now: Column) -> DataFrame:
    """Due pending jobs, one for each slot, whose slot no active job holds. Keyless jobs all count."""
    due = jobs.filter((F.col("status") == "pending") & (F.col("run_at") <= now))
    free = due.filter("dedupe_key is not null").join(held_slots(jobs), [*SLOT], "left_anti")
    best = free.withColumn("rn", F.row_number().over(Window.partitionBy(*SLOT).orderBy(*ORDER))).filter("rn = 1")
    return due.filter("dedupe_key is null").union(best.select(due.columns))


def claim(rows: DataFrame, now: Column, fresh: bool = False) -> DataFrame:
    """The rows as active jobs: one attempt more, a lease from now, and a token of their own.

    The token follows from id and attempt, so it is the same each time that it is worked out. A
    fresh one is random: such rows have to be written before anything is made of them.
    """
    token = F.expr("uuid()") if fresh else F.substring(F.sha2(F.concat_ws(":", F.lit("claim"), "id", (F.col("attempt") + 1).cast("string")), 256), 1, 16)
    return rows.withColumns({"status": F.lit("active"), "claim_token": token, "attempt": F.col("attempt") + 1, "claimed_at": now})


def claim_next(jobs: DataFrame, now: Column, job_type: str, k: int = 1) -> DataFrame:
    """What k claims of one type in a row yield."""
    return claim(claimable(jobs, now).filter(F.col("type") == job_type).orderBy(*ORDER).limit(k), now)


def claim_per_type(jobs: DataFrame, now: Column, k: int) -> DataFrame:
    """Up to k claims of every type at once; a slot that types share goes to its best job."""
    rank = F.row_number().over(Window.partitionBy("type").orderBy(*ORDER))
    return claim(claimable(jobs, now).withColumn("rn", rank).filter(F.col("rn") <= k).drop("rn"), now)


def claim_with_capacity(jobs: DataFrame, now: Column, capacity: DataFrame) -> DataFrame:
    """Claims of every type up to its capacity (type, capacity) less its active jobs.

    capacity has a row for each type of handler. Its largest value bounds what each task passes on.
    """
    most = capacity.agg(F.max("capacity")).first()[0] or 0
    busy = jobs.filter("status = 'active'").groupBy("type").agg(F.count("id").alias("busy"))
    room = capacity.join(busy, "type", "left").select("type", F.greatest(F.lit(0), F.col("capacity") - F.coalesce("busy", F.lit(0))).alias("room"))
    rank = F.row_number().over(Window.partitionBy("type").orderBy(*ORDER))
    ranked = claimable(jobs, now).withColumn("rn", rank).filter(F.col("rn") <= most)
    return claim(ranked.join(room, "type").filter("rn <= room").drop("rn", "room"), now)


def claim_by_key(jobs: DataFrame, now: Column, wanted: DataFrame, fresh: bool = False) -> DataFrame:
    """For each wanted (type, dedupe_key) the job that a claim by key yields, as claimed, or nulls."""
    due = jobs.filter((F.col("status") == "pending") & (F.col("run_at") <= now) & F.col("dedupe_key").isNotNull())
    free = due.join(held_slots(jobs), [*SLOT], "left_anti")
    best = free.withColumn("rn", F.row_number().over(Window.partitionBy("type", "dedupe_key").orderBy(*ORDER))).filter("rn = 1")
    return wanted.join(claim(best, now, fresh).drop("rn"), ["type", "dedupe_key"], "left")


def blocked(jobs: DataFrame, now: Column) -> DataFrame:
    """Due pending jobs that an active job of the slot holds back, with that job's id and type."""
    due = jobs.filter((F.col("status") == "pending") & (F.col("run_at") <= now))
    holder = jobs.filter("status = 'active' and dedupe_key is not null").groupBy(*SLOT).agg(F.min("id").alias("holder_id"), F.min_by("type", "id").alias("holder_type"))
    return due.join(holder, [*SLOT]).withColumn("cross_type", F.col("type") != F.col("holder_type"))


def claim_or_enqueue(requests: DataFrame, jobs: DataFrame) -> DataFrame:
    """requests (id, type, dedupe_key, dedupe_scope, latest, at, ...) with outcome, and the job that each fell to.

    Any number of requests for a key, taken in the order of at, then id. claimed: a new active
    job; queued: a new follower; replaced: the follower's data is the request's (latest only);
    waiting: a pending job of the key is there already; yielded: the follower's place is taken by
    another type; rejected: the slot is taken; refused: latest needs a key of scope 'pending';
    repeated: a job, or an earlier request, has the id. Requests without a key ('' is none) are
    claimed.

    Requests only ever take places: that of scope 'pending', its follower's, and that of scope
    'pending+active'. So it is enough to know who takes each first, which aggregates over the
    key's requests tell, and each row then sees for itself what was taken before it.
    """
    order = F.struct("at", "id")
    names = requests.columns
    latest = F.coalesce("latest", F.lit(False))
    key = F.when(F.col("dedupe_key") != "", F.col("dedupe_key"))
    scope = F.when(key.isNotNull(), F.coalesce("dedupe_scope", F.lit("pending+active")))
    rows = requests.withColumns({"dedupe_key": key, "dedupe_scope": scope, "latest": latest, "place": order})
    known = jobs.select("id").withColumn("known", F.lit(True))
    again = F.row_number().over(Window.partitionBy("id").orderBy("at", "type")) > 1
    rows = rows.withColumn("again", again).join(known, "id", "left")
    early = F.when(F.col("known") | F.col("again"), "repeated").when(F.col("latest") & (F.coalesce("dedupe_scope", F.lit("")) != "pending"), "refused").when(F.col("dedupe_key").isNull(), "claimed")
    rows = rows.withColumn("early", early).drop("known", "again")

    there = jobs.filter("status in ('pending', 'active') and dedupe_key is not null")
    is_ = lambda status, scope: (F.col("status") == status) & (F.col("dedupe_scope") == scope)
    state = there.groupBy("dedupe_key").agg(
        F.max(is_("active", "pending")).alias("active"),
        F.max(is_("active", "pending+active")).alias("alone_active"),
        F.max(is_("pending", "pending+active")).alias("alone_pending"),
        F.min(F.when(is_("pending", "pending"), F.struct("type", "id"))).alias("follower"),
    )
    flags = ["active", "alone_active", "alone_pending"]
    keyed = rows.filter("early is null").join(state, "dedupe_key", "left").fillna(False, flags)
    scoped, new = F.col("dedupe_scope") == "pending", F.col("follower").isNull()
    # who would be claimed in scope 'pending' while that is free, or queued once it isn't
    able = scoped & F.when(F.col("latest"), new | (F.col("follower.type") != F.col("type"))).otherwise(new & ~F.col("alone_pending"))
    first = keyed.filter(able & ~F.col("active")).groupBy("dedupe_key").agg(F.min("place").alias("claims"))
    keyed = keyed.join(first, "dedupe_key", "left")
    second = keyed.filter(able & new & (F.col("active") | (F.col("place") > F.col("claims")))).groupBy("dedupe_key").agg(F.min("place").alias("queues"), F.min_by("type", "place").alias("queued_type"))
    keyed = keyed.join(second, "dedupe_key", "left")
    # a pending job of the key is there when the request comes
    meets = F.col("alone_pending") | ~new | F.coalesce(F.col("queues") < F.col("place"), F.lit(False))
    alone = keyed.filter(~scoped & ~meets & ~F.col("alone_active")).groupBy("dedupe_key").agg(F.min("place").alias("takes"))
    keyed = keyed.join(alone, "dedupe_key", "left")
    mine = lambda c: F.coalesce(F.col("place") == F.col(c), F.lit(False))
    follower_type = F.when(~new, F.col("follower.type")).when(F.col("queues") < F.col("place"), F.col("queued_type"))
    outcome = (
        F.when(F.col("latest") & (F.coalesce(follower_type, F.lit("")) == F.col("type")) & follower_type.isNotNull(), "replaced")
        .when(~F.col("latest") & meets, "waiting")
        .when(mine("claims") | mine("takes"), "claimed")
        .when(~scoped, "rejected")
        .when(mine("queues"), "queued")
        .otherwise("yielded")
    )
    keyed = keyed.withColumn("outcome", outcome)
    job = F.when(F.col("outcome") == "replaced", F.coalesce("follower.id", "queues.id")).when(F.col("outcome").isin("claimed", "queued"), F.col("id"))
    keyed = keyed.select(*names, "outcome", job.alias("job_id"))
    rest = rows.filter("early is not null").select(*names, F.col("early").alias("outcome"), F.when(F.col("early") == "claimed", F.col("id")).alias("job_id"))
    return keyed.unionByName(rest)


def jobs_with_requests(told: DataFrame, jobs: DataFrame) -> DataFrame:
    """jobs after claim_or_enqueue(), whose requests have data and may have any other column of a job.

    Claimed jobs are active from at on; queued ones wait until their run_at, or at where there is
    none. Of the follower only the data is the last request's.
    """
    made = told.filter("outcome in ('claimed', 'queued')")
    claimed = F.col("outcome") == "claimed"
    token = F.substring(F.sha2(F.concat(F.lit("claim:"), "id", F.lit(":1")), 256), 1, 16)
    run_at = F.coalesce("run_at", "at") if "run_at" in told.columns else F.col("at")
    own = {
        "status": F.when(claimed, "active").otherwise("pending"),
        "attempt": claimed.cast("int"),
        "max_attempts": F.coalesce("max_attempts", F.lit(3)) if "max_attempts" in told.columns else F.lit(3),
        "priority": F.coalesce("priority", F.lit(0)) if "priority" in told.columns else F.lit(0),
        "run_at": F.when(claimed, F.col("at")).otherwise(run_at),
        "created_at": F.col("at"),
        "claimed_at": F.when(claimed, F.col("at")),
        "claim_token": F.when(claimed, token),
    }
    null = lambda f: F.lit(None).cast(f.dataType)
    late = ("completed_at", "failed_at", "fail_reason")
    new = made.select(*((own[f.name] if f.name in own else null(f) if f.name in late or f.name not in told.columns else F.col(f.name)).cast(f.dataType).alias(f.name) for f in jobs.schema))
    data = told.filter("outcome = 'replaced'").groupBy(F.col("job_id").alias("id")).agg(F.struct(F.max_by("data", F.struct("at", "id")).alias("data")).alias("now"))
    rows = jobs.unionByName(new).join(data, "id", "left")
    return rows.withColumn("data", F.when(F.col("now").isNotNull(), F.col("now.data")).otherwise(F.col("data"))).select(jobs.columns)


def drain_chain(jobs: DataFrame, now: Column, drains: int = 10) -> DataFrame:
    """Jobs that one handler run may take in a row for a key: its own and so many followers."""
    due = jobs.filter((F.col("status") == "pending") & (F.col("run_at") <= now) & F.col("dedupe_key").isNotNull())
    rank = F.row_number().over(Window.partitionBy("type", "dedupe_key").orderBy(*ORDER))
    return due.withColumn("place", rank).filter(F.col("place") <= 1 + drains)
