from __future__ import annotations

import datetime as dt
import random
import time

import pytest
from pyspark.sql import functions as F

from jobloom.operators import apply, claims, processing, slots, transitions
from jobloom.plans import queue_queries
from jobloom.sources import fixtures, schemas
from jobloom.sources.fixtures import NOW
from jobloom.sources.store import ParquetStore
from jobloom.streaming import chains, slot_state, upkeep

SF = "/root/testdata/sf0.001"
COMMAND = "job_id string, op string, token string, reason string, at timestamp"


def at(sec):
    return dt.datetime(1999, 1, 1) + dt.timedelta(seconds=sec)


def job(id_, status, key="k", scope="pending", attempt=1, token=None, type_="t0"):
    return (id_, type_, "{}", status, 0, attempt, 3, key, scope, "fixed", 1000, 30000, at(-100), at(-100), at(-50) if status == "active" else None, None, None, None, token)


def jobs_of(spark, *rows):
    return spark.createDataFrame(list(rows), schemas.JOBS)


def none(spark, ddl=schemas.RECEIPTS):
    return spark.createDataFrame([], ddl)


def test_commands_for_two_jobs_of_a_slot_follow_their_times(spark, tmp_path):
    s = ParquetStore(spark, str(tmp_path), parts=2)
    s.save_jobs(jobs_of(spark, job("a", "active", token="x"), job("b", "pending", attempt=3)))
    commands = spark.createDataFrame([("a", "fail", "x", "late", at(50)), ("b", "failFatal", None, "early", at(1))], COMMAND)
    upkeep.apply_in_order(commands, s, "stream", 0)
    after = {r.id: r for r in s.jobs().collect()}
    # b was gone when a failed, so a is tried again, and each has its own time
    assert (after["b"].status, after["b"].failed_at) == ("failed", at(1)) and (after["a"].status, after["a"].run_at) == ("pending", at(51))


def test_unfenced_commands_count_each_time(spark):
    told = spark.createDataFrame([("a", None, "fail", "retry-scheduled", at(-5)), ("b", None, "release", "released", at(-5))], schemas.RECEIPTS)
    jobs = jobs_of(spark, job("a", "active", attempt=3, key=None, scope=None, token="x"), job("b", "active", key=None, scope=None, token="y"))
    commands = spark.createDataFrame([("a", "fail", None, "again", at(1)), ("b", "release", None, None, at(1))], COMMAND)
    for decided in (apply.decide(commands, jobs, told), slots.answers(slots.folded(commands, jobs, told))):
        assert {r.job_id: (r.outcome, r.changes) for r in decided.collect()} == {"a": ("failed-terminal", True), "b": ("released", True)}
    # only a command whose answer was lost is told what it was told before
    lost = commands.withColumn("again", F.lit(True))
    for decided in (apply.decide(lost, jobs, told), slots.answers(slots.folded(lost, jobs, told))):
        assert {r.job_id: (r.outcome, r.changes) for r in decided.collect()} == {"a": ("retry-scheduled", False), "b": ("released", False)}


def test_a_failed_job_is_completed_late_only_without_receipt(spark):
    jobs = jobs_of(spark, *(job(i, "active", key=None, scope=None, token="x", attempt=3) for i in "ab"))
    rows = [("a", "fail", None, "unfenced", at(1)), ("a", "complete", "x", None, at(2)), ("b", "fail", "x", "own", at(1)), ("b", "complete", "x", None, at(2)), ("c", "complete", None, None, at(0)), ("c", "heartbeat", None, None, at(0))]
    got = {(r.job_id, r.op): (r.outcome, r.changes) for r in slots.answers(slots.folded(spark.createDataFrame(rows, COMMAND), jobs, none(spark))).collect()}
    assert got == {("a", "fail"): ("failed-terminal", True), ("a", "complete"): ("completed", True), ("b", "fail"): ("failed-terminal", True), ("b", "complete"): ("already-terminal", False), ("c", "complete"): ("not-found", False), ("c", "heartbeat"): ("applied", False)}


def test_a_lost_answer_to_a_completion_is_given_again(spark):
    jobs = jobs_of(spark, *(job(i, "completed", key=None, scope=None, token="x") for i in "abc"), job("d", "active", key=None, scope=None, token="x"), job("e", "failed", key=None, scope=None, token="x"))
    told = spark.createDataFrame([("a", "x", "complete", "completed", at(0)), ("b", "x", "complete", "completed", at(0)), ("c", "x", "fail", "retry-scheduled", at(0)), ("e", "x", "fail", "failed-terminal", at(0))], schemas.RECEIPTS)
    commands = spark.createDataFrame([(i, "x", i != "b") for i in "abcdef"], "job_id string, token string, again boolean")
    want = {"a": "completed", "b": "already-terminal", "c": "already-terminal", "d": "completed", "e": "already-terminal", "f": "not-found"}
    assert {r.job_id: r.outcome for r in transitions.complete_outcomes(commands, jobs, told).collect()} == want
    # without the column all are commands of their own
    assert {r.job_id: r.outcome for r in transitions.complete_outcomes(commands.drop("again"), jobs, told).collect()} == want | {"a": "already-terminal"}


def test_the_fold_of_single_commands_is_the_batch_operator(spark):
    decided, jobs = queue_queries._decided(spark, SF)
    commands = queue_queries._commands(jobs).withColumn("n", F.regexp_replace("job_id", "x", "").cast("bigint"))
    op = F.element_at(F.array(*map(F.lit, queue_queries.OPS)), (F.col("n") % len(queue_queries.OPS) + 1).cast("int"))
    # one command a key, so that none depends on another
    keyed = commands.join(jobs.select(F.col("id").alias("job_id"), "dedupe_key"), "job_id", "left")
    one = keyed.groupBy(F.coalesce("dedupe_key", "job_id").alias("k")).agg(F.min_by(F.struct("job_id", "token", "n"), "job_id").alias("c")).select("c.*")
    one = one.select("job_id", op.alias("op"), "token", F.concat(F.lit("boom "), "job_id").alias("reason"), fixtures.now().alias("at"), (F.col("n") % 4 == 1).alias("again"))
    receipts = queue_queries._receipts(jobs)
    done = slots.folded(one, jobs, receipts).cache()
    want = apply.decide(one.drop("at"), jobs, receipts)
    columns = ["job_id", "op", "outcome", "changes"]
    assert sorted(map(tuple, slots.answers(done).select(columns).collect())) == sorted(map(tuple, want.select(columns).collect()))
    after, expected = (sorted(map(repr, x.select(sorted(jobs.columns)).collect())) for x in (slots.jobs_afterwards(jobs, slots.changed_jobs(done)), apply.jobs_after(want, jobs, fixtures.now())))
    assert after == expected


def test_requests_in_the_fold_are_those_of_the_aggregates(spark):
    rng = random.Random(4)
    rows = []
    for i in range(400):
        key = rng.choice([None, "", *(f"k{n}" for n in range(25))])
        rows.append((f"r{i % 390}", rng.choice(["t0", "t1"]), f"d{i}", key, rng.choice([None, "pending", "pending", "pending+active"]), rng.choice([None, True, False]), at(rng.randint(0, 60)), at(500)))
    requests = spark.createDataFrame(rows, "id string, type string, data string, dedupe_key string, dedupe_scope string, latest boolean, at timestamp, run_at timestamp").withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("at", "run_at")})
    # an id that comes twice at one time may be taken in either order
    requests = requests.dropDuplicates(["id", "at"])
    there = []
    for n in range(25):
        for status, scope in (("active", "pending"), ("pending", "pending"), (rng.choice(["active", "pending"]), "pending+active")):
            if rng.random() < 0.3:
                there.append(job(f"j{n}{status}{scope}", status, key=f"k{n}", scope=scope, type_=rng.choice(["t0", "t1"])))
    jobs = jobs_of(spark, *there)
    told = claims.claim_or_enqueue(requests, jobs)
    after = claims.jobs_with_requests(told, jobs)
    rest = {c: F.lit(None) for c in schemas.names(schemas.JOBS) if c not in requests.columns} | {"priority": F.lit(0), "max_attempts": F.lit(3)}
    shaped = requests.withColumns(rest).select(F.col("id").alias("job_id"), F.lit("claimOrEnqueue").alias("op"), F.lit(None).cast("string").alias("token"), F.lit(None).cast("string").alias("reason"), "at", "latest", F.struct(*schemas.names(schemas.JOBS)).alias("request"))
    done = slots.folded(shaped, jobs, none(spark)).cache()
    got = sorted((r.job_id, r["at"], r.outcome, r.fell_to or "") for r in slots.answers(done).collect())
    assert got == sorted((r.id, r["at"], r.outcome, r.job_id or "") for r in told.collect())
    assert {x[2] for x in got} == {"claimed", "queued", "replaced", "waiting", "yielded", "rejected", "refused", "repeated"}
    one, two = (sorted(map(repr, x.select(schemas.names(schemas.JOBS)).collect())) for x in (slots.jobs_afterwards(jobs, slots.changed_jobs(done)), after))
    assert one == two and len(one) > len(there)


def test_no_commands(spark):
    assert slots.folded(none(spark, COMMAND), jobs_of(spark, job("a", "active")), none(spark)).count() == 0
    assert NOW


def test_repeated_requests_of_a_batch_are_admitted_once(spark, tmp_path):
    rows = jobs_of(spark, job("a", "pending", key=None, scope=None), job("a", "pending", key=None, scope=None), job("b", "pending"))
    rows.write.parquet(str(tmp_path / "requests"))
    s = ParquetStore(spark, str(tmp_path / "store"), parts=2)
    upkeep.admit_requests(spark.readStream.schema(schemas.JOBS).parquet(str(tmp_path / "requests")), s, str(tmp_path / "offsets")).awaitTermination()
    assert sorted(r.id for r in s.jobs().collect()) == ["a", "b"]


def test_a_stream_keeps_slots_as_state(spark, tmp_path):
    request = lambda i, sec, data, scope="pending", latest=False: ("k", i, "claimOrEnqueue", None, None, at(sec), latest, (i, "t0", data, None, 0, None, 1, "k", scope, "fixed", 1000, 30000, None, None, None, None, None, None, None))
    command = lambda i, op, sec, token=None, reason=None: ("k", i, op, token, reason, at(sec), None, None)
    batches = [
        [request("a", 0, "one"), request("b", 1, "two"), request("c", 2, "three", latest=True)],
        [command("a", "fail", 11, reason="late"), command("b", "failFatal", 10, reason="early")],
        [command("a", "complete", 20), command("b", "heartbeat", 21, token="none"), command("a", "complete", 22)],
    ]
    schema = f"slot string, job_id string, op string, token string, reason string, at timestamp_ntz, latest boolean, request {slots.JOB}"
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"part={i}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    q = slot_state.slot_stream(stream).writeStream.format("memory").queryName("slot_rows").option("checkpointLocation", str(tmp_path / "offsets")).start()
    until = time.time() + 50
    while time.time() < until and spark.table("slot_rows").filter("told is not null").count() < 8:
        time.sleep(1)
    q.stop()
    told = {(r.told.job_id, r.told.op, (r.told["at"] - at(0)).seconds): r.told.outcome for r in spark.table("slot_rows").collect() if r.told}
    assert told == {
        ("a", "claimOrEnqueue", 0): "claimed", ("b", "claimOrEnqueue", 1): "queued", ("c", "claimOrEnqueue", 2): "replaced", ("b", "failFatal", 10): "failed-terminal",
        ("a", "fail", 11): "failed-terminal", ("a", "complete", 20): "already-terminal", ("b", "heartbeat", 21): "lease-lost", ("a", "complete", 22): "already-terminal",
    }
    made = [(r.job.id, r.job.status, r.job.data) for r in spark.table("slot_rows").collect() if r.job]
    assert sorted(made) == sorted([("a", "active", "one"), ("b", "pending", "three"), ("a", "failed", "one"), ("b", "failed", "three")])


def test_chains_run_followers_and_keep_the_first_error(spark, tmp_path):
    s = ParquetStore(spark, str(tmp_path), parts=1)
    rows = [job("a0", "active", key="a", token="x")] + [job(f"a{i:02d}", "pending", key="a", attempt=0) for i in range(1, 13)]
    rows += [job("b0", "active", key="b", token="y"), job("b1", "pending", key="b", attempt=0), job("c0", "active", key=None, scope=None, token="z"), job("d0", "active", key="d", token="w", attempt=3), job("d1", "pending", key="d", type_="t1", attempt=0)]
    s.save_jobs(jobs_of(spark, *rows))

    def handler(row):
        if row["id"] in ("b0", "c0"):
            raise ValueError(f"stale {row['id']}")

    handlers = processing.Handlers()
    handlers.process("t0", handler)
    for wrong in (-1, 1.5, True, float("inf")):
        with pytest.raises(ValueError):
            chains.run_chains(s.jobs(), s, handlers, fixtures.now(), drains=wrong)
    ran = chains.run_chains(s.jobs(open_only=True).filter("status = 'active'"), s, handlers, F.lit(at(100)).cast("timestamp_ntz"), drains=3).collect()
    by = {(r.chain, r.place): (r.job_id, r.outcome, r.error) for r in ran}
    assert [by["a0", k][:2] for k in range(4)] == [("a0", "completed"), ("a01", "completed"), ("a02", "completed"), ("a03", "completed")] and ("a0", 4) not in by
    # the first job was superseded by its follower, which ran; the chain ends with the first error
    assert by["b0", 0] == ("b0", "superseded", "stale b0") and by["b0", 1] == ("b1", "completed", "stale b0")
    assert by["c0", 0] == ("c0", "retry-scheduled", "stale c0") and by["d0", 0] == ("d0", "completed", None) and len(by) == 8
    after = {r.id: r.status for r in s.jobs().collect()}
    assert after["a04"] == "pending" and after["d1"] == "pending" and after["b0"] == "superseded" and after["c0"] == "pending"
    tokens = [r.claim_token for r in s.jobs().collect() if r.id in ("a01", "a02", "a03", "b1")]
    assert len(set(tokens)) == 4 and all(len(t) == 36 for t in tokens)  # random ones, written before they were used
    kinds = [r.kind for r in s.log("events").collect()]
    assert kinds.count("claimed") == 4 and kinds.count("completed") == 6 and kinds.count("superseded") == 1 and kinds.count("failed") == 1
