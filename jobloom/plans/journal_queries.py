"""Queries over step journals, logs, lifecycle events, and leases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import typed
from ..functions.scalars import derived_uuid, idempotency_key, is_fatal, next_error_backoff_ms, truncated_log
from ..operators import gauges, journal, leases
from ..sources.fixtures import heartbeats, lifecycle, requested_steps, steps, table

TAIL, LINE, BUDGET, LEASE_MS = 2, 200, 1_500, 12 * 3_600_000


def step_replay_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return journal.replay_plan(requested_steps(spark, sf_dir), steps(spark, sf_dir)).select("job_id", "seq", "name", "action", "result")


def step_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return journal.first_divergence(requested_steps(spark, sf_dir), steps(spark, sf_dir))


def _appends(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = steps(spark, sf_dir)
    again = requested_steps(spark, sf_dir).withColumn("arrival", F.lit(2))
    return own.select("job_id", "seq", "name", F.lit(1).alias("arrival")).union(again)


def step_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return journal.deduplicated(_appends(spark, sf_dir))


def journal_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return journal.with_budget(steps(spark, sf_dir), BUDGET).select("job_id", "seq", "bytes", "total_bytes", "fits")


def journal_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return journal.sorted_steps(steps(spark, sf_dir))


def derive_uuid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return steps(spark, sf_dir).select("job_id", "seq", derived_uuid(F.concat(F.lit("run-"), "job_id"), F.concat_ws(":", F.col("seq").cast("string"), "name")).alias("uuid"))


def idempotency_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = F.when(F.col("seq") % 3 == 0, F.concat(F.lit("own-"), "job_id"))
    return steps(spark, sf_dir).select("job_id", "seq", idempotency_key(F.col("job_id"), F.col("seq"), F.col("name"), given).alias("key"))


def log_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return journal.log_tail(steps(spark, sf_dir).select("job_id", "seq", F.col("result").alias("message")), TAIL)


def log_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each run's first steps are in its log, cut to its newest; then the others' texts come."""
    logs = steps(spark, sf_dir).select("job_id", "seq", F.col("result").alias("message"))
    first = F.col("seq") % 3 == 0
    kept = journal.append_logs(logs.limit(0), logs.filter(first), TAIL, LINE)
    return journal.append_logs(kept, logs.filter(~first), TAIL, LINE)


def typed_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored value of some kind for each event, and what it is."""
    rows = table(spark, sf_dir, "events").selectExpr(
        "event_id", """case event_id % 10 when 0 then 'null' when 1 then 'true' when 2 then cast(event_id as string) when 3 then concat(event_id, '.5') when 4 then concat('"', event_type, '"')
          when 5 then concat('[', event_id, ',null]') when 6 then concat('{"a":', event_id, '}') when 7 then concat('{"$date":"', date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), 'Z"}') when 8 then '{"$void":true}' else 'no json' end as stored""",
    )
    value = typed.variant(F.col("stored"))
    return rows.select("event_id", typed.kind(value).alias("kind"), typed.is_void(value).alias("void"), typed.as_date(value).alias("moment"), F.try_variant_get(value, "$.a", "bigint").alias("a"))


def log_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", truncated_log(F.coalesce("text", F.lit("")), LINE).alias("line"))


def fatal_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = "array('NonRetryable', 'NondeterminismError', 'StepTimeout', 'JournalTooLarge', 'Error')"
    rows = table(spark, sf_dir, "events").selectExpr("event_id", f"element_at({names}, cast(event_id % 5 as int) + 1) as error")
    return rows.select("event_id", is_fatal(F.col("error")).alias("fatal"), next_error_backoff_ms(F.col("event_id") * 100).alias("next_ms"))


def event_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gauges.event_counts(lifecycle(spark, sf_dir))


def event_duration_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gauges.duration_stats(lifecycle(spark, sf_dir))


def failure_streaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gauges.failure_streaks(lifecycle(spark, sf_dir))


def lease_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leases.sessions(heartbeats(spark, sf_dir), LEASE_MS)


def lease_lapses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leases.lapses(heartbeats(spark, sf_dir), LEASE_MS)


def journal_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An append for each run: to jobs held or not, under right and stale tokens, at new places and taken ones."""
    own = steps(spark, sf_dir)
    runs = own.groupBy("job_id").agg(F.min("seq").alias("low"), F.max("seq").alias("top"), F.min_by("name", "seq").alias("first")).withColumn("j", F.col("job_id").cast("bigint"))
    jobs = runs.selectExpr("job_id as id", "if(j % 4 = 0, 'pending', 'active') as status", "concat('tok', j) as claim_token")
    appends = runs.selectExpr(
        "job_id", "if(j % 7 = 0, 'stale', concat('tok', j)) as token", "if(j % 3 = 0, low, top + 1) as seq", "if(j % 3 = 0, if(j % 2 = 0, first, 'other'), 'final') as name",
        "repeat('é\"x', cast(j % 40 as int)) as result",
    )
    return journal.append_steps(appends, jobs, own, BUDGET).select("job_id", "seq", "status", "journal_bytes")


def journal_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = journal.read_steps(steps(spark, sf_dir)).select("job_id", F.posexplode("steps").alias("place", "step"))
    return got.select("job_id", F.col("place").cast("bigint").alias("place"), "step.seq", "step.name", "step.result")


STEPS_SQL = """
WITH steps AS (SELECT CAST(conv_id AS VARCHAR) AS job_id, CAST(turn AS INT) AS seq, role AS name, text AS result FROM conversations),
requested AS (
  SELECT job_id, seq, CASE WHEN (CAST(job_id AS BIGINT) * 31 + seq) % 17 = 0 THEN name || '2' ELSE name END AS name FROM steps
  UNION ALL SELECT job_id, CAST(max(seq) + 1 AS INT), 'final' FROM steps GROUP BY job_id
), plan AS (
  SELECT r.*, s.name AS recorded, CASE WHEN s.name IS NULL THEN 'execute' WHEN s.name = r.name THEN 'replay' ELSE 'diverged' END AS action, s.result
  FROM requested r LEFT JOIN steps s USING (job_id, seq)
), life AS (
  SELECT event_id, ts, CASE event_type WHEN 'click' THEN 'claimed' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'superseded' ELSE 'lease-lost' END AS kind,
    't' || (user_id % 4) AS type, CAST(user_id AS VARCHAR) AS job_id, CAST(round(value * 1000) AS BIGINT) AS micros,
    event_type = 'error' AND CAST(json_extract_string(props, '$.k') AS INT) % 2 = 0 AS terminal FROM events
), beats AS (
  SELECT CAST(user_id AS VARCHAR) AS job_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS before FROM events
), gaps AS (SELECT *, datesub('millisecond', before, ts) AS gap_ms FROM beats)
"""
#: A line cut to LINE units of UTF-16, in which characters beyond the basic plane count twice.
UNITS = "(length({x}) + length(regexp_replace({x}, '[^\\x{{10000}}-\\x{{10FFFF}}]', '', 'g')))"
CUT = f"CASE WHEN {UNITS} > {LINE} THEN left({{x}}, list_max(list_filter(range(0, {LINE - 12}), lambda k: {UNITS.replace('{x}', 'left({x}, CAST(k AS INT))')} <= {LINE - 13}))::INT) || '… [truncated]' ELSE {{x}} END"
BYTES = "CAST(strlen(CAST(to_json({'seq': seq, 'name': name, 'result': result}) AS VARCHAR)) + 32 AS BIGINT)"
H = "sha256('run-' || job_id || chr(0) || seq || ':' || name)"
SQL = {
    "step_replay_plan": "SELECT job_id, seq, name, action, CASE WHEN action = 'replay' THEN result END AS result FROM plan",
    "step_divergence": "SELECT job_id, min(seq) AS seq, first(recorded ORDER BY seq) AS recorded, first(name ORDER BY seq) AS requested FROM plan WHERE action = 'diverged' GROUP BY job_id",
    "step_dedup": """, a AS (SELECT job_id, seq, name, 1 AS arrival FROM steps UNION ALL SELECT job_id, seq, name, 2 FROM requested)
        SELECT job_id, seq, name, arrival, CASE WHEN row_number() OVER w = 1 THEN 'appended' WHEN name = first_value(name) OVER w THEN 'already-recorded' ELSE 'diverged' END AS status
        FROM a WINDOW w AS (PARTITION BY job_id, seq ORDER BY arrival)""",
    "journal_budget": f""", b AS (SELECT job_id, seq, {BYTES} AS bytes FROM steps),
        t AS (SELECT *, CAST(sum(bytes) OVER (PARTITION BY job_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS total_bytes FROM b)
        SELECT job_id, seq, bytes, total_bytes, total_bytes <= {BUDGET} AS fits FROM t""",
    "journal_append": f""", r AS (SELECT job_id, CAST(job_id AS BIGINT) AS j, min(seq) AS low, max(seq) AS top, first(name ORDER BY seq) AS head, sum({BYTES}) AS total FROM steps GROUP BY job_id),
        a AS (SELECT *, CASE WHEN j % 3 = 0 THEN low ELSE top + 1 END AS seq, CASE WHEN j % 3 <> 0 THEN 'final' WHEN j % 2 = 0 THEN head ELSE 'other' END AS name, repeat('é"x', CAST(j % 40 AS INT)) AS result FROM r),
        b AS (SELECT *, {BYTES} AS size FROM a),
        o AS (SELECT *, CASE WHEN j % 4 = 0 OR j % 7 = 0 THEN 'lease-lost' WHEN j % 3 = 0 AND name = head THEN 'already-recorded' WHEN j % 3 = 0 THEN 'diverged' WHEN total + size > {BUDGET} THEN 'too-large' ELSE 'appended' END AS status FROM b)
        SELECT job_id, CAST(seq AS INT) AS seq, status, CAST(CASE WHEN status = 'appended' THEN total + size ELSE total END AS BIGINT) AS journal_bytes FROM o""",
    "journal_records": "SELECT job_id, row_number() OVER (PARTITION BY job_id ORDER BY seq) - 1 AS place, seq, name, result FROM steps",
    "journal_sorted": "SELECT job_id, count(*) AS n_steps, string_agg(name, '>' ORDER BY seq) AS names FROM steps GROUP BY job_id",
    "derive_uuid": f"SELECT job_id, seq, left({H}, 8) || '-' || substr({H}, 9, 4) || '-4' || substr({H}, 14, 3) || '-' || substr('89ab89ab89ab89ab', instr('0123456789abcdef', substr({H}, 17, 1)), 1) || substr({H}, 18, 3) || '-' || substr({H}, 21, 12) AS uuid FROM steps",
    "idempotency_keys": "SELECT job_id, seq, CASE WHEN seq % 3 = 0 THEN 'own-' || job_id ELSE job_id || ':' || seq || ':' || name END AS key FROM steps",
    "log_tail": f"SELECT job_id, seq, message FROM (SELECT job_id, seq, result AS message, row_number() OVER (PARTITION BY job_id ORDER BY seq DESC) AS rn FROM steps) WHERE rn <= {TAIL}",
    "log_truncate": f"SELECT doc_id, {CUT.format(x="coalesce(text, '')")} AS line FROM documents",
    "log_append": f""", kept AS (SELECT job_id, seq, result, row_number() OVER (PARTITION BY job_id ORDER BY seq DESC) AS rn FROM steps WHERE seq % 3 = 0),
        both_ AS (SELECT job_id, seq, result FROM kept WHERE rn <= {TAIL} UNION ALL SELECT job_id, seq, result FROM steps WHERE seq % 3 <> 0)
        SELECT job_id, seq, {CUT.format(x="result")} AS message FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY seq DESC) AS rn FROM both_) WHERE rn <= {TAIL}""",
    "typed_values": """SELECT event_id, ['null', 'boolean', 'number', 'number', 'string', 'array', 'object', 'date', 'void', NULL][CAST(event_id % 10 AS INT) + 1] AS kind, event_id % 10 = 8 AS void,
        CASE WHEN event_id % 10 = 7 THEN date_trunc('second', ts) END AS moment, CASE WHEN event_id % 10 = 6 THEN event_id END AS a FROM events""",
    "fatal_errors": "SELECT event_id, event_id % 5 IN (0, 1, 3) AS fatal, CAST(least(60000, greatest(1000, 200 * event_id)) AS BIGINT) AS next_ms FROM events",
    "event_counts": "SELECT kind, type, count(*) AS n, count(*) FILTER (WHERE kind = 'failed' AND terminal) AS n_dead, count(*) FILTER (WHERE kind = 'failed' AND NOT terminal) AS n_retried FROM life GROUP BY kind, type",
    "event_duration_stats": "SELECT kind, type, count(*) AS n, CAST(sum(micros) AS BIGINT) AS sum_micros, min(micros) AS min_micros, max(micros) AS max_micros, CAST(round(quantile_cont(micros, 0.5) * 2) AS BIGINT) AS twice_median_micros FROM life WHERE kind IN ('completed', 'failed') GROUP BY kind, type",
    "failure_streaks": """, e AS (SELECT *, sum(CASE WHEN kind = 'completed' THEN 1 ELSE 0 END) OVER (PARTITION BY type ORDER BY ts, event_id) AS island FROM life WHERE kind IN ('completed', 'failed'))
        SELECT type, count(*) AS failures, min(ts) AS first_ts, max(ts) AS last_ts, count(*) >= 5 AS escalated FROM e WHERE kind = 'failed' GROUP BY type, island""",
    "lease_sessions": f""", s AS (SELECT *, CAST(sum(CASE WHEN gap_ms > {LEASE_MS} THEN 1 ELSE 0 END) OVER (PARTITION BY job_id ORDER BY ts) AS BIGINT) AS session FROM gaps)
        SELECT job_id, session, min(ts) AS first_beat, max(ts) AS last_beat, count(*) AS n_beats FROM s GROUP BY job_id, session""",
    "lease_lapses": f"SELECT job_id, before AS last_beat, ts AS next_beat, gap_ms FROM gaps WHERE gap_ms > {LEASE_MS}",
}

QUERIES = {name: globals()[name] for name in SQL}
ORACLES = {name: STEPS_SQL + sql for name, sql in SQL.items()}
