"""Queries over the queue: gauges, lookups, admission, claims, transitions, upkeep."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import backoff_bounds_ms, heartbeat_interval_ms, receipt_key
from ..operators import admission, apply, audit, claims, gauges, lookups, slots, transitions
from ..sources.fixtures import NOW, now, raw_jobs, table

CLAIM_LIMIT, TYPE_LIMIT, CAPACITY, RETENTION = 50, 10, 700, 365


def jobs_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The job table, with every slot's constraint met."""
    return admission.admitted_jobs(raw_jobs(spark, sf_dir))


def queue_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gauges.queue_stats(jobs_of(spark, sf_dir), now())


def queue_stats_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gauges.queue_stats_by_type(jobs_of(spark, sf_dir), now())


def backlog_oldest_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gauges.backlog(jobs_of(spark, sf_dir), now())


def find_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookups.find(jobs_of(spark, sf_dir), statuses=["pending", "active"], type="t1").select("id", "status", "priority", "dedupe_key")


def find_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookups.find_one(raw_jobs(spark, sf_dir), user_id=7).select("id", "type", "status")


def public_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookups.public_view(raw_jobs(spark, sf_dir)).drop("data")


def has_outstanding(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = table(spark, sf_dir, "customer").selectExpr("concat('t', c_custkey % 4) as type", "concat('cust:', c_custkey) as dedupe_key")
    return lookups.has_outstanding(jobs_of(spark, sf_dir), wanted)


def retention_victims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookups.retention_victims(raw_jobs(spark, sf_dir), now(), RETENTION).select("id", "status")


def retention_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookups.retention_survivors(raw_jobs(spark, sf_dir), now(), RETENTION).groupBy("status").agg(F.count("id").alias("n"))


def invariant_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return admission.violations(raw_jobs(spark, sf_dir))


def _enqueued(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = raw_jobs(spark, sf_dir)
    existing = jobs_of(spark, sf_dir).filter("status = 'active'")
    return admission.enqueue(jobs.filter("status = 'pending'"), existing)


def enqueue_admitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _enqueued(spark, sf_dir).filter("admitted").select("id", "type", "dedupe_key")


def enqueue_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _enqueued(spark, sf_dir).filter("not admitted").select("id", "dedupe_key", "blocked_by")


def _coalesced(spark: SparkSession, sf_dir: str, latest: bool) -> DataFrame:
    requests = raw_jobs(spark, sf_dir).filter("dedupe_scope = 'pending'")
    return admission.coalesced(requests, latest).drop("dedupe_scope")


def coalesce_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _coalesced(spark, sf_dir, False)


def coalesce_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _coalesced(spark, sf_dir, True)


CLAIMED = ("id", "type", "status", "priority", "attempt", "claim_token", "run_at")


def claim_next_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return claims.claim_next(jobs_of(spark, sf_dir), now(), "t1", CLAIM_LIMIT).select(*CLAIMED)


def claim_next_per_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return claims.claim_per_type(jobs_of(spark, sf_dir), now(), TYPE_LIMIT).select(*CLAIMED)


def claim_blocked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return claims.blocked(jobs_of(spark, sf_dir), now()).select("id", "dedupe_key", "holder_id", "holder_type", "cross_type")


def claim_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = table(spark, sf_dir, "customer").selectExpr("explode(array('t0', 't1', 't2', 't3')) as type", "concat('cust:', c_custkey) as dedupe_key")
    return claims.claim_by_key(jobs_of(spark, sf_dir), now(), wanted).select("type", "dedupe_key", "id", "priority", "status", "attempt", "claim_token", "claimed_at")


def claim_with_capacity(spark: SparkSession, sf_dir: str) -> DataFrame:
    capacity = spark.range(4).selectExpr("concat('t', id) as type", f"{CAPACITY} + id as capacity")
    return claims.claim_with_capacity(jobs_of(spark, sf_dir), now(), capacity).select(*CLAIMED)


def drain_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return claims.drain_chain(raw_jobs(spark, sf_dir), now(), drains=2).select("id", "type", "dedupe_key", F.col("place").cast("bigint").alias("place"))


def _commands(jobs: DataFrame) -> DataFrame:
    """A command for each job and for some unknown ones; tokens are right, stale or absent by id."""
    token = "case cast(id as bigint) % 5 when 0 then 'stale' when 1 then null else coalesce(claim_token, 'none') end as token"
    own = jobs.selectExpr("id as job_id", token)
    return own.union(jobs.filter("status = 'pending'").selectExpr("concat('x', id)", "if(cast(id as bigint) % 2 = 0, 'ghost', null)"))


def _receipts(jobs: DataFrame) -> DataFrame:
    """What half of the completed jobs, and half of the failed ones that have a token, were told; and what open ones were told earlier, without a token."""
    completed = jobs.filter("status = 'completed' and cast(id as bigint) % 2 = 0").selectExpr("id as job_id", "'none' as token", "'complete' as op", "'completed' as outcome", "completed_at as at")
    failed = jobs.filter("status = 'failed' and claim_token is not null and cast(id as bigint) % 4 = 0").selectExpr("id", "claim_token", "'fail'", "'failed-terminal'", "failed_at")
    earlier = ", ".join(f"named_struct('op', '{op}', 'outcome', '{told}', 'at', {at})" for op, told, at in (("fail", "superseded", "created_at"), ("fail", "retry-scheduled", "run_at + interval 1 minute"), ("release", "released", "run_at")))
    earlier = jobs.filter("status in ('pending', 'active') and cast(id as bigint) % 3 <> 0").selectExpr("id", "cast(null as string)", f"inline(array({earlier}))")
    return completed.union(failed).union(earlier)


OPS = ("complete", "fail", "failFatal", "release", "completeClaimed", "heartbeat", "heartbeatClaimed")


def _decided(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Commands of all kinds, decided, and the jobs."""
    jobs = jobs_of(spark, sf_dir)
    op = f"element_at(array{OPS}, cast(cast(replace(job_id, 'x', '') as bigint) % {len(OPS)} as int) + 1) as op"
    commands = _commands(jobs).selectExpr("job_id", "token", op, "concat('boom ', job_id) as reason", "cast(replace(job_id, 'x', '') as bigint) % 4 = 1 as again")
    return apply.decide(commands, jobs, _receipts(jobs)), jobs


def apply_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decided(spark, sf_dir)[0].select("job_id", "op", "outcome", "changes")


def apply_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    after = apply.jobs_after(*_decided(spark, sf_dir), now())
    return after.select("id", "status", "run_at", "completed_at", "failed_at", "fail_reason", "claimed_at", "claim_token")


def apply_receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply.new_receipts(_decided(spark, sf_dir)[0], now())


def apply_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply.events(_decided(spark, sf_dir)[0], now())


def claim_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    claimed = claims.claim_per_type(jobs_of(spark, sf_dir), now(), TYPE_LIMIT)
    return apply.claim_events(claimed, now()).select("job_id", "type", "kind", "ts", "attempt")


def batch_heartbeat(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = jobs_of(spark, sf_dir)
    known = jobs.filter("type in ('t0', 't1')")  # one worker's jobs, and as many that are unknown
    beats = known.selectExpr("id as job_id").union(known.selectExpr("concat('x', id)"))
    return transitions.batch_heartbeat(jobs, beats, now()).select("id", "status", "claimed_at")


def claim_or_enqueue(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = table(spark, sf_dir, "customer").select(
        *(F.expr(x) for x in (
            "concat('r', c_custkey) as id", "concat('t', c_custkey % 4) as type", "if(c_custkey % 5 = 0, null, concat('cust:', c_custkey)) as dedupe_key",
            "if(c_custkey % 5 = 0, null, if(c_custkey % 2 = 0, 'pending', 'pending+active')) as dedupe_scope", "c_custkey % 6 in (0, 4) and c_custkey % 5 <> 0 as latest",
        )),
        now().alias("at"),
    )
    return claims.claim_or_enqueue(requests, jobs_of(spark, sf_dir)).drop("at")


def _many_requests(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A request for each order, so one to some twenty for a key, of both scopes, types and modes; and the jobs that there are."""
    requests = raw_jobs(spark, sf_dir).withColumn("n", F.col("id").cast("bigint")).selectExpr(
        "concat('r', id) as id", "concat('t', n % 2) as type", "concat('d', id) as data", "priority", "max_attempts", "dedupe_key",
        "if(dedupe_key is null, null, if(n % 3 = 0, 'pending+active', 'pending')) as dedupe_scope", "n % 4 = 1 as latest",
        "timestampadd(SECOND, cast(n % 90 as int), run_at) as run_at", f"timestampadd(MINUTE, cast(n % 50000 as int), timestamp_ntz '{NOW}') as at",
    )
    return requests, jobs_of(spark, sf_dir)


def claim_or_enqueue_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    return claims.claim_or_enqueue(*_many_requests(spark, sf_dir)).select("id", "type", "dedupe_key", "dedupe_scope", "latest", "outcome", "job_id")


def claim_or_enqueue_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests, jobs = _many_requests(spark, sf_dir)
    after = claims.jobs_with_requests(claims.claim_or_enqueue(requests, jobs), jobs)
    return after.select("id", "type", "data", "status", "attempt", "dedupe_key", "dedupe_scope", "run_at", "claimed_at", "claim_token")


def _slot_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commands for the open jobs of each key, one for each of its orders, applied in the order of their times."""
    jobs = jobs_of(spark, sf_dir)
    held = {s: (F.col("status") == s) for s in ("active", "pending")}
    open_jobs = jobs.filter("dedupe_key is not null").groupBy("dedupe_key").agg(*(F.max(F.when(held[s], F.col(c))).alias(f"{s}_{c}") for s in held for c in ("id", "claim_token")))
    pick = lambda c: f"if(n % 3 = 0, if(pending_id is null, active_{c}, pending_{c}), if(active_id is null, pending_{c}, active_{c}))"
    commands = raw_jobs(spark, sf_dir).select("dedupe_key", F.col("id").cast("bigint").alias("n")).join(open_jobs, "dedupe_key").filter("active_id is not null or pending_id is not null").selectExpr(
        f"{pick('id')} as job_id", f"element_at(array{OPS}, cast(n % {len(OPS)} as int) + 1) as op", f"case n % 5 when 0 then 'stale' when 1 then null when 2 then null else coalesce({pick('claim_token')}, 'none') end as token",
        "concat('boom ', n) as reason", f"timestampadd(SECOND, cast(n as int), timestamp_ntz '{NOW}') as at",
    )
    return slots.folded(commands, jobs, _receipts(jobs))


def slot_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slots.answers(_slot_fold(spark, sf_dir)).select("job_id", "op", "at", "outcome", "changes")


def slot_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slots.changed_jobs(_slot_fold(spark, sf_dir)).select("id", "status", "run_at", "completed_at", "failed_at", "fail_reason", "claimed_at", "claim_token")


def _tampered(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The jobs before and after a batch of commands with its receipts, in which faults are planted by id."""
    decided, jobs = _decided(spark, sf_dir)
    after, receipts = apply.jobs_after(decided, jobs, now()), apply.new_receipts(decided, now())
    n = F.col("id").cast("bigint")
    after = after.filter(n % 97 != 0).withColumns({
        "completed_at": F.when((n % 89 == 0) & F.col("completed_at").isNotNull(), now()).otherwise(F.col("completed_at")),
        "attempt": F.when(n % 83 == 0, F.col("attempt") - 1).otherwise(F.col("attempt")),
    })
    k = F.regexp_replace("job_id", "x", "").cast("bigint")
    return jobs, after, receipts.filter(k % 79 != 0).union(receipts.filter(k % 73 == 0))


def terminal_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs whose writes between two snapshots break a rule."""
    return audit.terminal_writes(*_tampered(spark, sf_dir), now())


def enqueue_against_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All jobs asked for once more, while the open ones are still there."""
    return admission.enqueue(raw_jobs(spark, sf_dir), jobs_of(spark, sf_dir)).select("id", "dedupe_key", "blocked_by", "admitted")


def fail_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = jobs_of(spark, sf_dir)
    return transitions.fail_outcomes(_commands(jobs), jobs, now())


def release_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = jobs_of(spark, sf_dir)
    return transitions.release_outcomes(_commands(jobs), jobs)


def terminal_miss_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All commands come again because their answers were lost: receipts answer those that have one."""
    jobs = jobs_of(spark, sf_dir)
    return transitions.complete_outcomes(_commands(jobs).withColumn("again", F.lit(True)), jobs, _receipts(jobs))


def heartbeat_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = jobs_of(spark, sf_dir)
    return transitions.heartbeat_outcomes(_commands(jobs), jobs)


def reaper_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transitions.reaper_candidates(jobs_of(spark, sf_dir), now()).select("id", "claimed_at")


def reaper_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transitions.reaper_outcomes(jobs_of(spark, sf_dir), now())


def sweep_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gauges.sweep_load(transitions.reaper_candidates(jobs_of(spark, sf_dir), now()))


def retry_backoff_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    low, high = backoff_bounds_ms(F.col("attempt"), F.col("backoff_strategy"), F.col("backoff_base_ms"), F.col("backoff_cap_ms"))
    interval = heartbeat_interval_ms(F.col("backoff_cap_ms") + F.col("attempt"))
    return raw_jobs(spark, sf_dir).select("id", low.alias("low_ms"), high.alias("high_ms"), interval.alias("beat_ms"))


def receipt_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_jobs(spark, sf_dir).select("id", receipt_key(F.col("claim_token")).alias("receipt_key"))


JOBS_SQL = """
WITH RECURSIVE raw AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS id, 't' || (o_orderkey % 4) AS type,
    '{"userId":' || o_custkey || ',"cents":' || CAST(round(o_totalprice * 100) AS BIGINT) || '}' AS data,
    CASE o_orderstatus WHEN 'P' THEN 'pending' WHEN 'O' THEN 'active'
      ELSE CASE o_orderkey % 3 WHEN 0 THEN 'completed' WHEN 1 THEN 'failed' ELSE 'superseded' END END AS status,
    CAST(left(o_orderpriority, 1) AS INT) AS priority,
    CAST(o_orderkey % 3 + CASE WHEN o_orderstatus = 'P' THEN 0 ELSE 1 END AS INT) AS attempt, 3 AS max_attempts,
    CASE WHEN o_custkey % 5 = 0 THEN NULL ELSE 'cust:' || o_custkey END AS dedupe_key,
    CASE WHEN o_custkey % 5 = 0 THEN NULL WHEN o_custkey % 2 = 0 THEN 'pending' ELSE 'pending+active' END AS dedupe_scope,
    CASE WHEN o_orderkey % 2 = 0 THEN 'fixed' ELSE 'exponential' END AS backoff_strategy,
    1000 * (1 + o_orderkey % 5) AS backoff_base_ms, 30000 AS backoff_cap_ms,
    o_orderdate AS run_at, o_orderdate AS created_at,
    CASE WHEN o_orderstatus <> 'P' THEN o_orderdate + to_seconds(o_orderkey % 600) END AS claimed_at,
    CASE WHEN o_orderstatus = 'F' AND o_orderkey % 3 = 0 THEN o_orderdate + to_seconds(600 + o_orderkey % 3600) END AS completed_at,
    CASE WHEN o_orderstatus = 'F' AND o_orderkey % 3 <> 0 THEN o_orderdate + to_seconds(600 + o_orderkey % 3600) END AS failed_at,
    CASE WHEN o_orderstatus = 'F' AND o_orderkey % 3 <> 0 THEN 'handler error' END AS fail_reason,
    CASE WHEN o_orderstatus = 'O' OR o_orderstatus = 'F' AND o_orderkey % 3 = 1 AND o_orderkey % 2 = 0 THEN left(sha256('tok:' || o_orderkey), 16) END AS claim_token,
    TIMESTAMP '1999-01-01 00:00:00' AS now
  FROM orders
), jobs AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY dedupe_key, dedupe_scope, CASE WHEN status IN ('pending', 'active') THEN CASE WHEN dedupe_scope = 'pending' THEN status ELSE 'open' END ELSE 'done' END ORDER BY run_at, id) AS rn
    FROM raw)
  WHERE rn = 1 OR dedupe_key IS NULL OR status NOT IN ('pending', 'active')
), due AS (
  SELECT * FROM jobs WHERE status = 'pending' AND run_at <= now
), held AS (
  SELECT DISTINCT dedupe_key, dedupe_scope FROM jobs WHERE status = 'active' AND dedupe_key IS NOT NULL
), free AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT d.*, row_number() OVER (PARTITION BY d.dedupe_key, d.dedupe_scope ORDER BY priority, run_at, id) AS rn
    FROM due d LEFT JOIN held h ON d.dedupe_key = h.dedupe_key AND d.dedupe_scope = h.dedupe_scope WHERE h.dedupe_key IS NULL)
  WHERE rn = 1 OR dedupe_key IS NULL
), claimed AS (
  SELECT id, type, 'active' AS status, priority, attempt + 1 AS attempt, left(sha256('claim:' || id || ':' || (attempt + 1)), 16) AS claim_token, run_at,
    row_number() OVER (PARTITION BY type ORDER BY priority, run_at, id) AS rn
  FROM free
), followers AS (
  SELECT DISTINCT dedupe_key AS fk FROM jobs WHERE status = 'pending' AND dedupe_scope = 'pending' AND dedupe_key IS NOT NULL
), bounds AS (
  SELECT id, CASE WHEN backoff_strategy = 'fixed' THEN least(backoff_cap_ms, backoff_base_ms) ELSE backoff_base_ms END AS low_ms,
    CASE WHEN backoff_strategy = 'fixed' THEN least(backoff_cap_ms, backoff_base_ms)
      ELSE greatest(backoff_base_ms, CAST(least(backoff_cap_ms, backoff_base_ms * pow(2, greatest(0, attempt - 1))) AS BIGINT)) END AS high_ms,
    ('0x' || left(sha256(id || ':' || attempt), 8))::BIGINT / 4294967296.0::DOUBLE AS share, backoff_strategy
  FROM raw
), delays AS (
  SELECT id AS bid, low_ms, high_ms, CASE WHEN backoff_strategy = 'fixed' THEN low_ms ELSE greatest(low_ms, CAST(floor(high_ms * share) AS BIGINT)) END AS delay_ms FROM bounds
), commands AS (
  SELECT id AS job_id, CASE CAST(id AS BIGINT) % 5 WHEN 0 THEN 'stale' WHEN 1 THEN NULL ELSE coalesce(claim_token, 'none') END AS token FROM jobs
  UNION ALL SELECT 'x' || id, CASE WHEN CAST(id AS BIGINT) % 2 = 0 THEN 'ghost' END FROM jobs WHERE status = 'pending'
), rec AS (
  SELECT id AS rid, 'none' AS rtok, 'complete' AS rop, 'completed' AS rout FROM jobs WHERE status = 'completed' AND CAST(id AS BIGINT) % 2 = 0
  UNION ALL SELECT id, claim_token, 'fail', 'failed-terminal' FROM jobs WHERE status = 'failed' AND claim_token IS NOT NULL AND CAST(id AS BIGINT) % 4 = 0
), lost AS (
  SELECT rid, rtok, rop, rout FROM rec
  UNION ALL SELECT id, NULL, 'fail', 'retry-scheduled' FROM jobs WHERE status IN ('pending', 'active') AND CAST(id AS BIGINT) % 3 <> 0
  UNION ALL SELECT id, NULL, 'release', 'released' FROM jobs WHERE status IN ('pending', 'active') AND CAST(id AS BIGINT) % 3 <> 0
), hit AS (
  SELECT c.job_id, c.token, j.*, f.fk IS NOT NULL AND j.dedupe_scope = 'pending' AS followed,
    CASE WHEN j.id IS NULL THEN 'not-found' WHEN j.status IN ('completed', 'failed', 'superseded') THEN 'already-terminal' ELSE 'lease-lost' END AS miss,
    coalesce(CASE WHEN c.token IS NOT NULL THEN j.status = 'active' AND j.claim_token = c.token ELSE j.status IN ('pending', 'active') END, false) AS applied
  FROM commands c LEFT JOIN jobs j ON c.job_id = j.id LEFT JOIN followers f ON j.dedupe_key = f.fk
), reaped AS (
  SELECT * FROM jobs WHERE status = 'active' AND claimed_at < now - INTERVAL 300 SECOND ORDER BY claimed_at, id LIMIT 1000
)
"""

COUNTS = ", ".join(f"count(*) FILTER (WHERE status = '{s}') AS {s}" for s in ("pending", "active", "completed", "failed", "superseded"))
OLDEST = "min(run_at) FILTER (WHERE status = 'pending' AND run_at <= now)"
GAUGES = f"{COUNTS}, {OLDEST} AS oldest_due_run_at, coalesce(greatest(0, datesub('millisecond', {OLDEST}, any_value(now))), 0) AS lag_ms"
CLAIM_COLS = "id, type, status, priority, attempt, claim_token, run_at"
PUBLIC_COLS = "id, type, status, priority, attempt, max_attempts, dedupe_key, dedupe_scope, run_at, created_at, claimed_at, completed_at, failed_at, fail_reason"
ENQUEUE = """, req AS (
  SELECT r.*, row_number() OVER (PARTITION BY r.dedupe_key, r.dedupe_scope ORDER BY r.run_at, r.id) AS rn, h.dedupe_key IS NOT NULL AS taken
  FROM raw r LEFT JOIN (SELECT * FROM held WHERE dedupe_scope = 'pending+active') h ON r.dedupe_key = h.dedupe_key AND r.dedupe_scope = h.dedupe_scope
  WHERE r.status = 'pending'
), told AS (SELECT *, CASE WHEN dedupe_key IS NULL THEN NULL WHEN taken THEN 'existing' WHEN rn > 1 THEN 'batch' END AS blocked_by FROM req)
"""
COALESCE = "SELECT dedupe_key, first(id ORDER BY run_at, id) AS id, first(type ORDER BY run_at, id) AS type, first(priority ORDER BY run_at, id) AS priority, min(run_at) AS run_at, {data} AS data, count(*) AS n_requests FROM raw WHERE dedupe_scope = 'pending' GROUP BY dedupe_key"
DONE = f"(status = 'completed' AND completed_at < now - INTERVAL {RETENTION} DAY OR status IN ('failed', 'superseded') AND failed_at < now - INTERVAL {RETENTION} DAY)"
DECIDED = f""", ordered AS (
  SELECT h.*, [{", ".join(repr(x) for x in OPS)}][CAST(CAST(replace(job_id, 'x', '') AS BIGINT) % {len(OPS)} AS INT) + 1] AS op, 'boom ' || job_id AS reason FROM hit h
), answered AS (
  SELECT o.*, r.rout AS told, a.rid IS NOT NULL AS answered, coalesce(claim_token = token, false) AS own FROM ordered o
  LEFT JOIN lost r ON job_id = r.rid AND token IS NOT DISTINCT FROM r.rtok AND op = r.rop AND CAST(replace(job_id, 'x', '') AS BIGINT) % 4 = 1 LEFT JOIN (SELECT DISTINCT rid, rtok FROM rec) a ON job_id = a.rid AND token = a.rtok
), tried AS (
  SELECT *, coalesce(CASE op WHEN 'complete' THEN applied OR status = 'failed' AND own AND NOT answered WHEN 'release' THEN applied AND status = 'active' WHEN 'completeClaimed' THEN own AND status IN ('active', 'failed')
    WHEN 'heartbeatClaimed' THEN own AND status = 'active' WHEN 'heartbeat' THEN token IS NULL OR own AND status = 'active' ELSE applied END, false) AS done FROM answered
), decided AS (
  SELECT *, told IS NULL AND done AND id IS NOT NULL AS changes, CASE WHEN told IS NOT NULL THEN told
    WHEN NOT done THEN CASE WHEN op IN ('complete', 'fail', 'failFatal', 'release') THEN miss ELSE 'lease-lost' END
    WHEN op IN ('complete', 'completeClaimed') THEN 'completed' WHEN op = 'failFatal' THEN 'failed-terminal' WHEN op = 'heartbeat' THEN 'applied' WHEN op = 'heartbeatClaimed' THEN 'heartbeated'
    WHEN coalesce(followed, false) THEN 'superseded' WHEN op = 'release' THEN 'released' WHEN attempt >= max_attempts THEN 'failed-terminal' ELSE 'retry-scheduled' END AS outcome FROM tried
)
"""
AFTER = f"""SELECT j.id,
    CASE d.outcome WHEN 'completed' THEN 'completed' WHEN 'retry-scheduled' THEN 'pending' WHEN 'released' THEN 'pending' WHEN 'superseded' THEN 'superseded' WHEN 'failed-terminal' THEN 'failed' ELSE j.status END AS status,
    CASE d.outcome WHEN 'retry-scheduled' THEN j.now + to_milliseconds(delay_ms) WHEN 'released' THEN j.now ELSE j.run_at END AS run_at,
    CASE d.outcome WHEN 'completed' THEN j.now ELSE j.completed_at END AS completed_at,
    CASE WHEN d.outcome IN ('failed-terminal', 'superseded') THEN j.now WHEN d.outcome = 'completed' THEN NULL ELSE j.failed_at END AS failed_at,
    CASE WHEN d.outcome = 'superseded' THEN CASE WHEN d.op = 'release' THEN 'Released' ELSE d.reason END || '{apply.SUPERSEDED_NOTE}' WHEN d.outcome IN ('failed-terminal', 'retry-scheduled') THEN d.reason
      WHEN d.outcome = 'completed' THEN NULL ELSE j.fail_reason END AS fail_reason,
    CASE WHEN d.outcome IN ('applied', 'heartbeated') THEN j.now WHEN d.outcome = 'released' THEN NULL ELSE j.claimed_at END AS claimed_at,
    CASE WHEN d.outcome = 'released' THEN NULL ELSE j.claim_token END AS claim_token
  FROM jobs j LEFT JOIN (SELECT * FROM decided WHERE changes) d ON j.id = d.id LEFT JOIN delays ON j.id = bid"""
EVENTS = """, e AS (
  SELECT *, CASE WHEN outcome = 'lease-lost' THEN 'lease-lost' WHEN NOT changes THEN NULL WHEN outcome = 'completed' THEN 'completed' WHEN op = 'failFatal' THEN 'fail-fatal'
    WHEN op = 'release' THEN CASE WHEN outcome = 'released' THEN 'shutdown-released' ELSE 'superseded' END WHEN op = 'fail' THEN CASE WHEN outcome = 'superseded' THEN 'superseded' ELSE 'failed' END END AS kind FROM decided)
SELECT job_id, type, kind, TIMESTAMP '1999-01-01 00:00:00' AS ts, CASE WHEN kind IN ('completed', 'failed', 'superseded') THEN datesub('millisecond', claimed_at, now) END AS duration_ms,
  CASE WHEN kind = 'failed' THEN attempt END AS attempt, CASE WHEN kind = 'failed' THEN max_attempts END AS max_attempts, CASE WHEN kind = 'failed' THEN outcome = 'failed-terminal' END AS terminal,
  CASE WHEN kind IN ('failed', 'superseded', 'fail-fatal') THEN reason END AS reason, CASE WHEN kind = 'lease-lost' THEN op END AS op FROM e WHERE kind IS NOT NULL"""
#: One request after another, key by key: the state is whether the scopes' places are taken, and the follower.
MANY = """, q AS (
  SELECT 'r' || id AS id, 't' || (CAST(id AS BIGINT) % 2) AS type, 'd' || id AS data, dedupe_key, CASE WHEN dedupe_key IS NULL THEN NULL WHEN CAST(id AS BIGINT) % 3 = 0 THEN 'pending+active' ELSE 'pending' END AS dedupe_scope,
    CAST(id AS BIGINT) % 4 = 1 AS latest, run_at + to_seconds(CAST(id AS BIGINT) % 90) AS run_at, now + to_minutes(CAST(id AS BIGINT) % 50000) AS moment FROM raw
), keyed AS (
  SELECT *, row_number() OVER (PARTITION BY dedupe_key ORDER BY moment, id) AS n FROM q WHERE dedupe_key IS NOT NULL AND NOT (latest AND dedupe_scope <> 'pending')
), start AS (
  SELECT k.dedupe_key AS key, coalesce(bool_or(j.status = 'active' AND j.dedupe_scope = 'pending'), false) AS ap, coalesce(bool_or(j.status = 'pending' AND j.dedupe_scope = 'pending+active'), false) AS op,
    coalesce(bool_or(j.status = 'active' AND j.dedupe_scope = 'pending+active'), false) AS oa, max(j.id) FILTER (WHERE j.status = 'pending' AND j.dedupe_scope = 'pending') AS p_id,
    max(j.type) FILTER (WHERE j.status = 'pending' AND j.dedupe_scope = 'pending') AS p_type, max(j.data) FILTER (WHERE j.status = 'pending' AND j.dedupe_scope = 'pending') AS p_data
  FROM (SELECT DISTINCT dedupe_key FROM keyed) k LEFT JOIN jobs j ON j.dedupe_key = k.dedupe_key GROUP BY k.dedupe_key
), scan AS (
  SELECT key, CAST(0 AS BIGINT) AS n, ap, op, oa, p_id, p_type, p_data, CAST(NULL AS VARCHAR) AS id, CAST(NULL AS VARCHAR) AS outcome, CAST(NULL AS VARCHAR) AS job_id FROM start
  UNION ALL
  SELECT key, n, ap OR outcome = 'claimed' AND scope = 'pending', op, oa OR outcome = 'claimed' AND scope = 'pending+active', CASE WHEN outcome = 'queued' THEN id ELSE p_id END, CASE WHEN outcome = 'queued' THEN type ELSE p_type END,
    CASE WHEN outcome IN ('queued', 'replaced') THEN data ELSE p_data END, id, outcome, CASE WHEN outcome = 'replaced' THEN p_id WHEN outcome IN ('claimed', 'queued') THEN id END
  FROM (SELECT s.key, k.n, s.ap, s.op, s.oa, s.p_id, s.p_type, s.p_data, k.id, k.type, k.data, k.dedupe_scope AS scope,
      CASE WHEN k.latest AND s.p_type = k.type THEN 'replaced' WHEN NOT k.latest AND (s.op OR s.p_id IS NOT NULL) THEN 'waiting'
        WHEN k.dedupe_scope = 'pending+active' THEN CASE WHEN s.oa OR s.op THEN 'rejected' ELSE 'claimed' END WHEN NOT s.ap THEN 'claimed' WHEN s.p_id IS NOT NULL THEN 'yielded' ELSE 'queued' END AS outcome
    FROM scan s JOIN keyed k ON k.dedupe_key = s.key AND k.n = s.n + 1)
), asked AS (
  SELECT q.*, CASE WHEN q.latest AND coalesce(q.dedupe_scope, '') <> 'pending' THEN 'refused' WHEN q.dedupe_key IS NULL THEN 'claimed' ELSE s.outcome END AS outcome,
    CASE WHEN q.latest AND coalesce(q.dedupe_scope, '') <> 'pending' THEN NULL WHEN q.dedupe_key IS NULL THEN q.id ELSE s.job_id END AS job_id FROM q LEFT JOIN scan s ON s.id = q.id
), told_data AS (
  SELECT p_id, p_data FROM scan WHERE p_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY key ORDER BY n DESC) = 1
)
"""
#: One command after another, key by key: the state is the key's active and its pending job.
_SIDE = ("id", "status", "token", "claimed", "run", "done", "failed", "reason", "told", "new")
_PICKED = ", ".join(f"CASE WHEN c.job_id = s.a_id THEN s.a_{x} ELSE s.p_{x} END AS t_{x}" for x in _SIDE[1:])
_NEXT = {
    "status": "CASE outcome WHEN 'completed' THEN 'completed' WHEN 'retry-scheduled' THEN 'pending' WHEN 'released' THEN 'pending' WHEN 'superseded' THEN 'superseded' WHEN 'failed-terminal' THEN 'failed' ELSE t_status END",
    "token": "CASE WHEN outcome = 'released' THEN NULL ELSE t_token END",
    "claimed": "CASE WHEN outcome IN ('applied', 'heartbeated') THEN moment WHEN outcome = 'released' THEN NULL ELSE t_claimed END",
    "run": "CASE outcome WHEN 'retry-scheduled' THEN moment + to_milliseconds(delay_ms) WHEN 'released' THEN moment ELSE t_run END",
    "done": "CASE WHEN outcome = 'completed' THEN moment ELSE t_done END",
    "failed": "CASE WHEN outcome IN ('failed-terminal', 'superseded') THEN moment WHEN outcome = 'completed' THEN NULL ELSE t_failed END",
    "reason": f"CASE WHEN outcome = 'superseded' THEN CASE WHEN op = 'release' THEN 'Released' ELSE reason END || '{apply.SUPERSEDED_NOTE}' WHEN outcome IN ('failed-terminal', 'retry-scheduled') THEN reason WHEN outcome = 'completed' THEN NULL ELSE t_reason END",
    "told": "t_told OR token IS NOT NULL AND op IN ('complete', 'fail', 'failFatal', 'release')",
    "new": "true",
}
_AFTER = ", ".join(f"{side}_id, " + ", ".join(f"CASE WHEN may AND job_id = {side}_id THEN {_NEXT[x]} ELSE {side}_{x} END AS {side}_{x}" for x in _SIDE[1:]) for side in "ap")
SLOTS = f""", slot_open AS (
  SELECT dedupe_key AS key, max(id) FILTER (WHERE status = 'active') AS a0, max(id) FILTER (WHERE status = 'pending') AS p0 FROM jobs WHERE dedupe_key IS NOT NULL AND status IN ('pending', 'active') GROUP BY dedupe_key
), given AS (
  SELECT key, CAST(r.id AS BIGINT) AS k, CASE WHEN CAST(r.id AS BIGINT) % 3 = 0 THEN coalesce(p0, a0) ELSE coalesce(a0, p0) END AS job_id FROM raw r JOIN slot_open ON r.dedupe_key = key
), cmds AS (
  SELECT g.key, g.job_id, [{", ".join(repr(x) for x in OPS)}][CAST(k % {len(OPS)} AS INT) + 1] AS op, CASE k % 5 WHEN 0 THEN 'stale' WHEN 1 THEN NULL WHEN 2 THEN NULL ELSE coalesce(j.claim_token, 'none') END AS token,
    'boom ' || k AS reason, j.now + to_seconds(k) AS moment, d.delay_ms, j.attempt, j.max_attempts, j.dedupe_scope AS scope, row_number() OVER (PARTITION BY g.key ORDER BY k) AS n
  FROM given g JOIN jobs j ON j.id = g.job_id JOIN delays d ON d.bid = g.job_id
), walk AS (
  SELECT key, CAST(0 AS BIGINT) AS n, CAST(NULL AS VARCHAR) AS job_id, CAST(NULL AS VARCHAR) AS op, CAST(NULL AS TIMESTAMP) AS moment, CAST(NULL AS VARCHAR) AS outcome, false AS may,
    {", ".join(f"{s}.id AS {s}_id, {s}.status AS {s}_status, {s}.claim_token AS {s}_token, {s}.claimed_at AS {s}_claimed, {s}.run_at AS {s}_run, {s}.completed_at AS {s}_done, {s}.failed_at AS {s}_failed, {s}.fail_reason AS {s}_reason, false AS {s}_told, false AS {s}_new" for s in "ap")}
  FROM slot_open LEFT JOIN jobs a ON a.id = a0 LEFT JOIN jobs p ON p.id = p0
  UNION ALL
  SELECT key, n, job_id, op, moment, outcome, may, {_AFTER} FROM (
    SELECT *, CASE WHEN NOT may THEN CASE WHEN op IN ('complete', 'fail', 'failFatal', 'release') AND t_status IN ('completed', 'failed', 'superseded') THEN 'already-terminal' ELSE 'lease-lost' END
        WHEN op IN ('complete', 'completeClaimed') THEN 'completed' WHEN op = 'heartbeat' THEN 'applied' WHEN op = 'heartbeatClaimed' THEN 'heartbeated' WHEN op = 'failFatal' THEN 'failed-terminal'
        WHEN scope = 'pending' AND (coalesce(a_status, '') = 'pending' OR coalesce(p_status, '') = 'pending') THEN 'superseded' WHEN op = 'release' THEN 'released' WHEN attempt >= max_attempts THEN 'failed-terminal' ELSE 'retry-scheduled' END AS outcome
    FROM (SELECT *, CASE op WHEN 'heartbeat' THEN token IS NULL OR own AND t_status = 'active' WHEN 'heartbeatClaimed' THEN own AND t_status = 'active' WHEN 'completeClaimed' THEN own AND t_status IN ('active', 'failed')
          WHEN 'release' THEN hit AND t_status = 'active' WHEN 'complete' THEN hit OR t_status = 'failed' AND own AND NOT t_told ELSE hit END AS may
      FROM (SELECT *, coalesce(t_token = token, false) AS own, CASE WHEN token IS NULL THEN t_status IN ('pending', 'active') ELSE t_status = 'active' AND coalesce(t_token = token, false) END AS hit
        FROM (SELECT s.* EXCLUDE (n, job_id, op, moment, outcome, may), c.* EXCLUDE (key), {_PICKED} FROM walk s JOIN cmds c ON c.key = s.key AND c.n = s.n + 1))))
), last AS (SELECT * FROM walk QUALIFY row_number() OVER (PARTITION BY key ORDER BY n DESC) = 1)
"""

SQL = {
    "queue_stats": f"SELECT {GAUGES} FROM jobs",
    "queue_stats_by_type": f"SELECT type, {GAUGES} FROM jobs GROUP BY type",
    "backlog_oldest_by_type": "SELECT type, count(*) AS n_due, min(run_at) AS oldest_run_at, greatest(0, datesub('millisecond', min(run_at), any_value(now))) AS lag_ms FROM due GROUP BY type",
    "find_jobs": "SELECT id, status, priority, dedupe_key FROM jobs WHERE type = 't1' AND status IN ('pending', 'active')",
    "find_one": "SELECT id, type, status FROM raw WHERE CAST(json_extract_string(data, '$.userId') AS BIGINT) = 7 ORDER BY id LIMIT 1",
    "public_view": f"SELECT {PUBLIC_COLS} FROM raw",
    "has_outstanding": "SELECT 't' || (c_custkey % 4) AS type, 'cust:' || c_custkey AS dedupe_key, EXISTS (SELECT 1 FROM jobs j WHERE j.type = 't' || (c_custkey % 4) AND j.dedupe_key = 'cust:' || c_custkey AND j.status IN ('pending', 'active')) AS outstanding FROM customer",
    "retention_victims": f"SELECT id, status FROM raw WHERE {DONE}",
    "retention_survivors": f"SELECT status, count(*) AS n FROM raw WHERE NOT coalesce({DONE}, false) GROUP BY status",
    "invariant_violations": """SELECT 'slot:' || dedupe_scope || ':' || CASE WHEN dedupe_scope = 'pending' THEN status ELSE 'open' END AS rule, dedupe_key AS subject, count(*) AS n
        FROM raw WHERE dedupe_key IS NOT NULL AND status IN ('pending', 'active') GROUP BY dedupe_scope, dedupe_key, CASE WHEN dedupe_scope = 'pending' THEN status ELSE 'open' END HAVING count(*) > 1
        UNION ALL SELECT 'attempt above maximum', id, 1 FROM raw WHERE attempt > max_attempts
        UNION ALL SELECT 'active without attempt', id, 1 FROM raw WHERE status = 'active' AND attempt < 1""",
    "enqueue_admitted": ENQUEUE + "SELECT id, type, dedupe_key FROM told WHERE blocked_by IS NULL",
    "enqueue_rejected": ENQUEUE + "SELECT id, dedupe_key, blocked_by FROM told WHERE blocked_by IS NOT NULL",
    "coalesce_first": COALESCE.format(data="first(data ORDER BY run_at, id)"),
    "coalesce_latest": COALESCE.format(data="last(data ORDER BY run_at, id)"),
    "claim_next_topk": f"SELECT {CLAIM_COLS} FROM claimed WHERE type = 't1' AND rn <= {CLAIM_LIMIT}",
    "claim_next_per_type": f"SELECT {CLAIM_COLS} FROM claimed WHERE rn <= {TYPE_LIMIT}",
    "claim_blocked": """SELECT d.id, d.dedupe_key, j.id AS holder_id, j.type AS holder_type, d.type <> j.type AS cross_type
        FROM due d JOIN jobs j ON d.dedupe_key = j.dedupe_key AND d.dedupe_scope = j.dedupe_scope AND j.status = 'active'""",
    "claim_by_key": """SELECT w.type, w.dedupe_key, f.id, f.priority, CASE WHEN f.id IS NOT NULL THEN 'active' END AS status, f.attempt + 1 AS attempt,
          CASE WHEN f.id IS NOT NULL THEN left(sha256('claim:' || f.id || ':' || (f.attempt + 1)), 16) END AS claim_token, CASE WHEN f.id IS NOT NULL THEN f.now END AS claimed_at FROM (SELECT unnest(['t0', 't1', 't2', 't3']) AS type, 'cust:' || c_custkey AS dedupe_key FROM customer) w
        LEFT JOIN free f ON w.type = f.type AND w.dedupe_key = f.dedupe_key""",
    "claim_with_capacity": f"""SELECT {CLAIM_COLS} FROM claimed c WHERE rn <= greatest(0, {CAPACITY} + CAST(substr(type, 2) AS INT) - (SELECT count(*) FROM jobs j WHERE j.type = c.type AND j.status = 'active'))""",
    "drain_chain": """SELECT id, type, dedupe_key, place FROM (
        SELECT *, row_number() OVER (PARTITION BY type, dedupe_key ORDER BY priority, run_at, id) AS place FROM raw WHERE status = 'pending' AND run_at <= now AND dedupe_key IS NOT NULL) WHERE place <= 3""",
    "fail_outcomes": """, o AS (SELECT job_id, id, now, CASE WHEN NOT applied THEN miss WHEN followed THEN 'superseded' WHEN attempt >= max_attempts THEN 'failed-terminal' ELSE 'retry-scheduled' END AS outcome FROM hit)
        SELECT job_id, outcome, CASE WHEN outcome = 'retry-scheduled' THEN now + to_milliseconds(delay_ms) END AS retry_run_at FROM o LEFT JOIN delays ON id = bid""",
    "release_outcomes": "SELECT job_id, CASE WHEN NOT (applied AND status = 'active') THEN miss WHEN followed THEN 'superseded' ELSE 'released' END AS outcome FROM hit",
    "terminal_miss_class": """SELECT job_id, CASE WHEN r.rout IS NOT NULL THEN r.rout WHEN applied THEN 'completed' WHEN status = 'failed' AND claim_token = token AND a.rid IS NULL THEN 'completed' ELSE miss END AS outcome
        FROM hit LEFT JOIN rec r ON job_id = r.rid AND token = r.rtok AND r.rop = 'complete' LEFT JOIN (SELECT DISTINCT rid, rtok FROM rec) a ON job_id = a.rid AND token = a.rtok""",
    "apply_outcomes": DECIDED + "SELECT job_id, op, outcome, changes FROM decided",
    "apply_jobs": DECIDED + AFTER,
    "apply_receipts": DECIDED + "SELECT job_id, token, op, outcome, TIMESTAMP '1999-01-01 00:00:00' AS at FROM decided WHERE changes AND op IN ('complete', 'fail', 'failFatal', 'release')",
    "apply_events": DECIDED + EVENTS,
    "claim_events": f"SELECT id AS job_id, type, 'claimed' AS kind, TIMESTAMP '1999-01-01 00:00:00' AS ts, attempt FROM claimed WHERE rn <= {TYPE_LIMIT}",
    "batch_heartbeat": "SELECT id, status, CASE WHEN status = 'active' AND type IN ('t0', 't1') THEN now ELSE claimed_at END AS claimed_at FROM jobs",
    "claim_or_enqueue": """, q AS (
          SELECT 'r' || c_custkey AS id, 't' || (c_custkey % 4) AS type, CASE WHEN c_custkey % 5 <> 0 THEN 'cust:' || c_custkey END AS dedupe_key,
            CASE WHEN c_custkey % 5 = 0 THEN NULL WHEN c_custkey % 2 = 0 THEN 'pending' ELSE 'pending+active' END AS dedupe_scope, c_custkey % 6 IN (0, 4) AND c_custkey % 5 <> 0 AS latest FROM customer
        ), p AS (
          SELECT q.*, (SELECT count(*) FROM jobs j WHERE j.dedupe_key = q.dedupe_key AND j.status = 'pending') AS n_pending,
            (SELECT max(j.id) FROM jobs j WHERE j.dedupe_key = q.dedupe_key AND j.status = 'pending' AND j.dedupe_scope = 'pending') AS follower,
            (SELECT max(j.type) FROM jobs j WHERE j.dedupe_key = q.dedupe_key AND j.status = 'pending' AND j.dedupe_scope = 'pending') AS follower_type,
            (SELECT count(*) FROM jobs j WHERE j.dedupe_key = q.dedupe_key AND j.dedupe_scope = q.dedupe_scope AND (j.status = 'active' OR j.status = 'pending' AND j.dedupe_scope = 'pending+active')) AS taken
          FROM q
        ), o AS (
          SELECT *, CASE WHEN dedupe_key IS NULL THEN 'claimed' WHEN latest AND follower_type = type THEN 'replaced' WHEN NOT latest AND n_pending > 0 THEN 'waiting' WHEN taken = 0 THEN 'claimed'
            WHEN dedupe_scope <> 'pending' THEN 'rejected' WHEN follower IS NOT NULL THEN 'yielded' ELSE 'queued' END AS outcome FROM p)
        SELECT id, type, dedupe_key, dedupe_scope, latest, outcome, CASE WHEN outcome = 'replaced' THEN follower WHEN outcome IN ('claimed', 'queued') THEN id END AS job_id FROM o""",
    "claim_or_enqueue_many": MANY + "SELECT id, type, dedupe_key, dedupe_scope, latest, outcome, job_id FROM asked",
    "claim_or_enqueue_jobs": MANY + """SELECT id, type, coalesce(p_data, data) AS data, status, attempt, dedupe_key, dedupe_scope, run_at, claimed_at, claim_token FROM jobs LEFT JOIN told_data ON p_id = id
        UNION ALL SELECT a.id, a.type, coalesce(p_data, data), CASE outcome WHEN 'claimed' THEN 'active' ELSE 'pending' END, CASE outcome WHEN 'claimed' THEN 1 ELSE 0 END, dedupe_key, dedupe_scope, CASE outcome WHEN 'claimed' THEN moment ELSE run_at END,
          CASE outcome WHEN 'claimed' THEN moment END, CASE outcome WHEN 'claimed' THEN left(sha256('claim:' || a.id || ':1'), 16) END FROM asked a LEFT JOIN told_data ON p_id = a.id WHERE outcome IN ('claimed', 'queued')""",
    "terminal_audit": DECIDED + """, later AS (
          SELECT a.id, a.status, CASE WHEN CAST(a.id AS BIGINT) % 89 = 0 AND a.completed_at IS NOT NULL THEN TIMESTAMP '1999-01-01 00:00:00' ELSE a.completed_at END AS completed_at, a.failed_at, a.fail_reason,
            j.attempt - CASE WHEN CAST(a.id AS BIGINT) % 83 = 0 THEN 1 ELSE 0 END AS attempt FROM (""" + AFTER + """) a JOIN jobs j ON j.id = a.id WHERE CAST(a.id AS BIGINT) % 97 <> 0
        ), receipts AS (
          SELECT job_id, outcome FROM decided, range(2) t(k) WHERE changes AND op IN ('complete', 'fail', 'failFatal', 'release')
            AND (t.k = 0 AND CAST(replace(job_id, 'x', '') AS BIGINT) % 79 <> 0 OR t.k = 1 AND CAST(replace(job_id, 'x', '') AS BIGINT) % 73 = 0)
        ), ends AS (SELECT job_id, count(*) AS ends FROM receipts WHERE outcome IN ('completed', 'failed-terminal', 'superseded') GROUP BY job_id)
        SELECT 'job lost' AS rule, id AS job_id, 1 AS n FROM jobs j WHERE NOT EXISTS (SELECT 1 FROM later l WHERE l.id = j.id)
          AND NOT coalesce(status = 'completed' AND completed_at < now - INTERVAL 7 DAY OR status IN ('failed', 'superseded') AND failed_at < now - INTERVAL 7 DAY, false)
        UNION ALL SELECT 'written again', j.id, 1 FROM jobs j JOIN later l ON l.id = j.id WHERE j.status IN ('completed', 'failed', 'superseded')
          AND NOT (l.status = j.status AND l.completed_at IS NOT DISTINCT FROM j.completed_at AND l.failed_at IS NOT DISTINCT FROM j.failed_at) AND NOT (j.status = 'failed' AND l.status = 'completed')
        UNION ALL SELECT 'ends twice', job_id, ends FROM ends WHERE ends > 1
        UNION ALL SELECT 'end without receipt', j.id, 1 FROM jobs j JOIN later l ON l.id = j.id WHERE l.status IN ('completed', 'failed') AND j.status IN ('pending', 'active')
          AND NOT EXISTS (SELECT 1 FROM ends e WHERE e.job_id = j.id) AND NOT coalesce(l.fail_reason LIKE 'stuck:%', false)
        UNION ALL SELECT 'attempt falls back', j.id, j.attempt - l.attempt FROM jobs j JOIN later l ON l.id = j.id WHERE l.attempt < j.attempt""",
    "slot_outcomes": SLOTS + "SELECT job_id, op, moment AS at, outcome, may AS changes FROM walk WHERE n > 0",
    "slot_jobs": SLOTS + " UNION ALL ".join(f"SELECT {x}_id AS id, {x}_status AS status, {x}_run AS run_at, {x}_done AS completed_at, {x}_failed AS failed_at, {x}_reason AS fail_reason, {x}_claimed AS claimed_at, {x}_token AS claim_token FROM last WHERE {x}_new" for x in "ap"),
    "enqueue_against_open": """, h2 AS (SELECT DISTINCT dedupe_key, dedupe_scope FROM jobs WHERE dedupe_key IS NOT NULL AND (status = 'pending' OR status = 'active' AND dedupe_scope = 'pending+active')),
        r2 AS (SELECT r.id, r.dedupe_key, CASE WHEN r.dedupe_key IS NULL THEN NULL WHEN h2.dedupe_key IS NOT NULL THEN 'existing' WHEN row_number() OVER (PARTITION BY r.dedupe_key, r.dedupe_scope ORDER BY r.run_at, r.id) > 1 THEN 'batch' END AS blocked_by
          FROM raw r LEFT JOIN h2 ON r.dedupe_key = h2.dedupe_key AND r.dedupe_scope = h2.dedupe_scope)
        SELECT *, blocked_by IS NULL AS admitted FROM r2""",
    "heartbeat_outcomes": "SELECT job_id, CASE WHEN token IS NULL OR coalesce(status = 'active' AND claim_token = token, false) THEN 'applied' ELSE 'lease-lost' END AS outcome FROM hit",
    "reaper_candidates": "SELECT id, claimed_at FROM reaped",
    "reaper_outcomes": f""", o AS (SELECT r.*, CASE WHEN f.fk IS NOT NULL AND dedupe_scope = 'pending' THEN 'superseded' WHEN attempt >= max_attempts THEN 'failed' ELSE 'pending' END AS new_status FROM reaped r LEFT JOIN followers f ON dedupe_key = fk)
        SELECT id, new_status, CASE WHEN new_status = 'failed' THEN '{transitions.REAPED}' END AS fail_reason, CASE WHEN new_status = 'pending' THEN now + to_milliseconds(delay_ms) END AS new_run_at FROM o LEFT JOIN delays ON id = bid""",
    "sweep_load": "SELECT least(count(*), 1000) AS handled, count(*) >= 1000 AS saturated FROM reaped",
    "retry_backoff_bounds": "SELECT b.id, b.low_ms, b.high_ms, CAST(greatest(1, floor((r.backoff_cap_ms + r.attempt) / 3)) AS BIGINT) AS beat_ms FROM bounds b JOIN raw r USING (id)",
    "receipt_keys": "SELECT id, CASE WHEN claim_token IS NULL THEN 'unfenced' ELSE 'token_' || replace(translate(to_base64(encode(claim_token)), '+/', '-_'), '=', '') END AS receipt_key FROM raw",
}

QUERIES = {name: globals()[name] for name in SQL}
ORACLES = {name: JOBS_SQL + sql for name, sql in SQL.items()}
