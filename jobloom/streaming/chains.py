"""Claimed jobs run, their outcomes applied, and the followers of their keys run after them."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import apply, claims, processing
from ..sources import schemas
from ..sources.store import ParquetStore

#: Followers that a run takes on at most.
MOST_DRAINS = 10
RAN = "chain string, place int, job_id string, dedupe_key string, type string, op string, outcome string, reason string"


def run_chains(claimed: DataFrame, store: ParquetStore, handlers: processing.Handlers, now: Column, drains: int = MOST_DRAINS) -> DataFrame:
    """Run claimed jobs of the store, and after each up to drains followers of its type and key.

    All chains go forward side by side, a round for each place in them. A chain goes on after a
    job that completed or was superseded, as long as a follower is due. Gives (chain, place,
    job_id, outcome, reason, error): chain is the first job's id, and error what the chain ends
    with: what its first superseded job had raised, or else what its last one did. Handlers' outcomes
    are written before they are applied, so a lost executor runs no handler a second time once they are.
    """
    if isinstance(drains, bool) or not isinstance(drains, int) or drains < 0:
        raise ValueError(f"drains must be a non-negative integer, not {drains!r}")
    spark, folder = store.spark, f"{store.path}/runs/{uuid.uuid4().hex}"
    ids, rounds = claimed.select(F.col("id").alias("chain"), "id"), 0
    for place in range(drains + 1):
        ids.write.parquet(f"{folder}/ids-{place}")  # whatever is claimed below, these are the round's
        ids = spark.read.parquet(f"{folder}/ids-{place}")
        jobs = store.jobs(open_only=True).join(ids, "id")
        told = processing.run_claimed(jobs.drop("chain"), handlers)
        told.write.parquet(f"{folder}/told-{place}")
        told = spark.read.parquet(f"{folder}/told-{place}")
        if told.isEmpty():
            break
        decided = apply.decide(told, store.jobs(), store.log("receipts"))
        ran = decided.join(ids.withColumnRenamed("id", "job_id"), "job_id").select("chain", F.lit(place).alias("place"), "job_id", "dedupe_key", "type", "op", "outcome", "reason")
        ran.write.parquet(f"{folder}/ran/place={place}")
        rounds += 1
        decided = decided.persist()
        store.update(
            apply.jobs_after(decided, store.jobs(), now, changed_only=True),
            store.jobs().join(decided.filter("changes").select("id"), "id", "left_semi"),
            {"events": apply.events(decided, now), "receipts": apply.new_receipts(decided, now)},
        )
        decided.unpersist()
        if place == drains:
            break
        on = spark.read.schema(RAN).parquet(f"{folder}/ran/place={place}").filter("outcome in ('completed', 'superseded') and dedupe_key is not null")
        jobs = store.jobs(open_only=True)
        best = claims.claim_by_key(jobs, now, on.select("chain", "type", "dedupe_key"), fresh=True).filter("id is not null")
        # two chains of a key and type take one follower between them
        best = best.groupBy("id").agg(F.min("chain").alias("chain"), *(F.first(c).alias(c) for c in schemas.names(schemas.JOBS) if c != "id"))
        best.write.parquet(f"{folder}/next-{place}")
        best = spark.read.parquet(f"{folder}/next-{place}")
        if best.isEmpty():
            break
        store.update(best.select(*schemas.names(schemas.JOBS)), jobs.join(best.select("id"), "id", "left_semi"), {"events": apply.claim_events(best, now)})
        ids = best.select("chain", "id")
    ran = spark.read.schema(RAN).option("recursiveFileLookup", True).parquet(f"{folder}/ran") if rounds else spark.createDataFrame([], RAN)
    lost = F.min(F.when(F.col("outcome") == "superseded", F.struct("place", "reason")))
    last = F.max(F.struct("place", F.when(F.col("op").isin("fail", "failFatal"), F.col("reason")).alias("reason")))
    ends = ran.groupBy("chain").agg(F.coalesce(lost["reason"], last["reason"]).alias("error"))
    return ran.join(ends, "chain").select("chain", "place", "job_id", "outcome", "reason", "error")
