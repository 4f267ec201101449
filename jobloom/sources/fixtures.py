"""The queue's tables, derived from the supplied ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NOW = "1999-01-01 00:00:00"


def now() -> F.Column:
    """The moment at which every verified query looks."""
    return F.expr(f"timestamp_ntz '{NOW}'")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A supplied table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A job for each order. Slots are not yet unique: see operators.admission."""
    return jobs_from_orders(table(spark, sf_dir, "orders"))


def jobs_from_orders(orders: DataFrame) -> DataFrame:
    """The same for a batch or a stream of orders."""
    return orders.selectExpr(
        "cast(o_orderkey as string) as id",
        "concat('t', o_orderkey % 4) as type",
        """concat('{"userId":', o_custkey, ',"cents":', cast(round(o_totalprice * 100) as bigint), '}') as data""",
        """case o_orderstatus when 'P' then 'pending' when 'O' then 'active'
           else case o_orderkey % 3 when 0 then 'completed' when 1 then 'failed' else 'superseded' end end as status""",
        "cast(substring(o_orderpriority, 1, 1) as int) as priority",
        "cast(o_orderkey % 3 + if(o_orderstatus = 'P', 0, 1) as int) as attempt",
        "3 as max_attempts",
        "if(o_custkey % 5 = 0, null, concat('cust:', o_custkey)) as dedupe_key",
        "if(o_custkey % 5 = 0, null, if(o_custkey % 2 = 0, 'pending', 'pending+active')) as dedupe_scope",
        "if(o_orderkey % 2 = 0, 'fixed', 'exponential') as backoff_strategy",
        "1000L * (1 + o_orderkey % 5) as backoff_base_ms",
        "30000L as backoff_cap_ms",
        "o_orderdate as run_at",
        "o_orderdate as created_at",
        "if(o_orderstatus = 'P', null, timestampadd(SECOND, cast(o_orderkey % 600 as int), o_orderdate)) as claimed_at",
        "if(o_orderstatus = 'F' and o_orderkey % 3 = 0, timestampadd(SECOND, cast(600 + o_orderkey % 3600 as int), o_orderdate), null) as completed_at",
        "if(o_orderstatus = 'F' and o_orderkey % 3 <> 0, timestampadd(SECOND, cast(600 + o_orderkey % 3600 as int), o_orderdate), null) as failed_at",
        "if(o_orderstatus = 'F' and o_orderkey % 3 <> 0, 'handler error', null) as fail_reason",
        # the reaper leaves a failed job its token
        "if(o_orderstatus = 'O' or o_orderstatus = 'F' and o_orderkey % 3 = 1 and o_orderkey % 2 = 0, substring(sha2(concat('tok:', o_orderkey), 256), 1, 16), null) as claim_token",
    )


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Journalled steps: a conversation is a run, its turns are steps."""
    return table(spark, sf_dir, "conversations").selectExpr("cast(conv_id as string) as job_id", "cast(turn as int) as seq", "role as name", "text as result")


def requested_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What resumed runs ask for: the journal's steps, one more for each run, and every 17th name changed."""
    own = steps(spark, sf_dir)
    changed = own.selectExpr("job_id", "seq", "if((cast(job_id as bigint) * 31 + seq) % 17 = 0, concat(name, '2'), name) as name")
    more = own.groupBy("job_id").agg((F.max("seq") + 1).cast("int").alias("seq")).select("job_id", "seq", F.lit("final").alias("name"))
    return changed.union(more)


def lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lifecycle events: kinds and types follow from the events table."""
    return table(spark, sf_dir, "events").selectExpr(
        "event_id",
        "ts",
        "case event_type when 'click' then 'claimed' when 'purchase' then 'completed' when 'error' then 'failed' when 'signup' then 'superseded' else 'lease-lost' end as kind",
        "concat('t', user_id % 4) as type",
        "cast(user_id as string) as job_id",
        "value as duration_ms",
        "event_type = 'error' and cast(get_json_object(props, '$.k') as int) % 2 = 0 as terminal",
    )


def heartbeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beats of workers: each event is a beat of its user's job."""
    return table(spark, sf_dir, "events").selectExpr("cast(user_id as string) as job_id", "ts")
