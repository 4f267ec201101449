from __future__ import annotations

import datetime as dt
import json
import time

import pytest
from pyspark.sql import functions as F

from jobloom.operators import processing
from jobloom.sources import fixtures, schemas, store
from jobloom.streaming import feed, leases, listeners, upkeep

SF = "/root/testdata/sf0.001"


def test_store_keeps_jobs_and_logs(spark, tmp_path):
    s = store.ParquetStore(spark, str(tmp_path), parts=2)
    assert s.jobs().count() == 0
    jobs = fixtures.raw_jobs(spark, SF).limit(20)
    s.save_jobs(jobs)
    assert s.jobs().count() == 20 and s.jobs(open_only=True).count() == s.jobs().filter("status in ('pending', 'active')").count()
    s.save_jobs(s.jobs().limit(10))
    assert s.jobs().count() == 10
    s.append("events", spark.createDataFrame([("a",)], "job_id string"))
    assert s.log("events").count() == 1 and s.log("steps").count() == 0
    s.reset()
    assert s.jobs().count() == 0
    with store.with_store(s):
        assert store.default_store() is s
        with pytest.raises(RuntimeError), store.with_store(s):
            pass
    with pytest.raises(LookupError):
        store.default_store()
    with pytest.raises(TypeError):
        store.set_default_store("no store")


def written(path):
    """Bytes of each data file by its path and time of writing."""
    return {(str(p), p.stat().st_mtime_ns): p.stat().st_size for p in path.rglob("*.parquet")}


def test_a_batch_writes_what_it_touches(spark, tmp_path):
    raw = fixtures.raw_jobs(spark, SF)
    for folder, copies in (("one", 1), ("many", 30)):
        s = store.ParquetStore(spark, str(tmp_path / folder), parts=4)
        # the same open jobs beside ever more finished ones
        done = raw.filter("status not in ('pending', 'active')").crossJoin(spark.range(copies).withColumnRenamed("id", "k")).withColumn("id", F.concat("id", F.lit("-"), "k")).drop("k")
        s.save_jobs(raw.filter("status in ('pending', 'active')").unionByName(done))
    sizes = []
    for folder in ("one", "many"):
        s = store.ParquetStore(spark, str(tmp_path / folder), parts=4)
        before = written(tmp_path / folder / "jobs")
        upkeep.sweep(s, fixtures.now(), most=5)
        after = written(tmp_path / folder / "jobs")
        sizes.append((sum(after.values()), sum(v for k, v in after.items() if k not in before)))
    (small, wrote_small), (large, wrote_large) = sizes
    assert large > 1.5 * small and wrote_large < 1.1 * wrote_small and wrote_large < 0.5 * large


def test_partitions_follow_their_jobs(spark, tmp_path):
    s = store.ParquetStore(spark, str(tmp_path), parts=2)
    jobs = fixtures.raw_jobs(spark, SF).filter("status = 'active'").orderBy("id").limit(6)
    s.save_jobs(jobs)
    held = s.jobs()
    done = held.withColumns({"status": F.lit("failed"), "failed_at": fixtures.now()})
    s.update(done, held, {})
    assert s.jobs().count() == 6 and s.jobs(open_only=True).count() == 0
    assert not [p for p in (tmp_path / "jobs" / "area=open").rglob("*.parquet")]
    first = s.jobs().orderBy("id").limit(1)
    s.update(first.withColumns({"status": F.lit("completed"), "completed_at": F.lit(dt.datetime(2001, 1, 1)).cast("timestamp_ntz"), "failed_at": F.lit(None).cast("timestamp_ntz")}), first, {})
    assert {r.status: r["count"] for r in s.jobs().groupBy("status").count().collect()} == {"failed": 5, "completed": 1}
    s.forget("2000-01-01")
    assert [r.status for r in s.jobs().collect()] == ["completed"]


def test_a_batch_that_was_cut_off_is_finished(spark, tmp_path):
    jobs = fixtures.raw_jobs(spark, SF).filter("status = 'active'").orderBy("id").limit(4)

    class Dies(store.ParquetStore):
        def recover(self):
            if self._exists("unfinished/ready"):
                raise RuntimeError("dies")

    class DiesLater(store.ParquetStore):
        def _delete(self, name):
            if name == "unfinished/ready":
                raise RuntimeError("dies")
            super()._delete(name)

    for n, kind in enumerate((Dies, DiesLater)):
        path = str(tmp_path / str(n))
        store.ParquetStore(spark, path, parts=2).save_jobs(jobs)
        dying = kind(spark, path, parts=2)
        with pytest.raises(RuntimeError):
            upkeep.sweep(dying, F.expr("timestamp_ntz '2030-01-01'"))
        s = store.ParquetStore(spark, path, parts=2)
        assert s.log("events").count() == n
        for _ in range(2):
            s.recover()
            assert s.jobs().filter("status = 'active'").count() == 0 and s.jobs().count() == 4 and s.log("events").count() == 1


def test_requests_stream_in_and_are_swept(spark, tmp_path):
    jobs = fixtures.raw_jobs(spark, SF).filter("status = 'pending'")
    jobs.repartition(2).write.parquet(str(tmp_path / "requests"))
    s = store.ParquetStore(spark, str(tmp_path / "store"), parts=2)
    requests = feed.job_changes(spark, str(tmp_path / "requests"), schemas.JOBS)
    upkeep.admit_requests(requests, s, str(tmp_path / "offsets")).awaitTermination()
    admitted = s.jobs()
    assert admitted.groupBy("dedupe_key", "dedupe_scope").count().filter("dedupe_key is not null and count > 1").count() == 0
    assert admitted.filter("dedupe_key is null").count() == jobs.filter("dedupe_key is null").count()
    stuck = fixtures.raw_jobs(spark, SF).filter("status = 'active'")
    after = upkeep.swept(stuck, fixtures.now())
    assert after.count() == stuck.count()
    assert after.filter("status <> 'active'").count() > 0
    assert upkeep.cleaned(fixtures.raw_jobs(spark, SF), fixtures.now()).filter("status = 'pending'").count() == jobs.count()


def test_sweeps_tell_what_they_handled(spark, tmp_path):
    s = store.ParquetStore(spark, str(tmp_path), parts=2)
    s.save_jobs(fixtures.raw_jobs(spark, SF).filter("status = 'active'"))
    want = sorted(upkeep.swept(s.jobs(), fixtures.now(), most=5).collect(), key=lambda r: r.id)
    upkeep.sweep(s, fixtures.now(), most=5)
    assert sorted(s.jobs().select(list(want[0].asDict())).collect(), key=lambda r: r.id) == want
    upkeep.sweep(s, fixtures.now())
    before = written(tmp_path)
    upkeep.sweep(s, fixtures.now())
    told = [(r.kind, r.saturated) for r in s.log("events").orderBy("handled").collect()]
    assert written(tmp_path) == before and ("reaper-recovered", True) in told and ("reaper-recovered", False) in told and len(told) == 2


def test_periodic_sweeps_run_on_ticks(spark, tmp_path):
    s = store.ParquetStore(spark, str(tmp_path / "store"), parts=2)
    s.save_jobs(fixtures.raw_jobs(spark, SF).filter("status = 'active'").limit(10))
    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    q = upkeep.sweep_periodically(ticks, s, str(tmp_path / "offsets"))
    until = time.time() + 60
    while s.log("events").isEmpty() and time.time() < until:
        time.sleep(0.5)
    q.stop()
    assert s.jobs().filter("status = 'active'").count() == 0 and s.log("events").first().handled == 10


def test_listener_hears_of_types(spark, tmp_path):
    fixtures.raw_jobs(spark, SF).write.parquet(str(tmp_path / "changes"))
    heard = []
    changes = feed.pending_feed(feed.job_changes(spark, str(tmp_path / "changes"), schemas.JOBS))
    feed.on_job_available(changes, heard.append, str(tmp_path / "offsets"), once=True).awaitTermination()
    assert sorted(set(sum(heard, []))) == ["t0", "t1", "t2", "t3"]


def test_leases_end_by_timer_and_by_gap(spark, tmp_path):
    at = dt.datetime(2024, 1, 1)
    beat = lambda s, seq, job, kind, token: (job, at + dt.timedelta(seconds=s), seq, kind, token)
    rows = [beat(0, 0, "a", "claim", "x"), beat(10, 1, "a", "beat", "x"), beat(20, 2, "a", "beat", "y"), beat(30, 3, "b", "claim", "z"), beat(300, 4, "b", "beat", "z"), beat(900, 5, "c", "claim", "q")]
    for i, r in enumerate(rows):
        spark.createDataFrame([r], "job_id string, ts timestamp, seq int, kind string, token string").coalesce(1).write.mode("append").parquet(str(tmp_path / "beats" / f"part={i:02d}"))
    stream = spark.readStream.schema("job_id string, ts timestamp, seq int, kind string, token string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "beats" / "*"))
    out = leases.lease_events(stream, 60_000)
    q = out.writeStream.format("memory").queryName("lease_out").option("checkpointLocation", str(tmp_path / "offsets")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r.job_id, r.kind, r.n_beats) for r in spark.table("lease_out").collect()}
    assert ("a", "stale-token", 2) in got and ("a", "lease-lost", 2) in got and ("b", "lease-lost", 1) in got
    assert not any(j == "c" for j, _, _ in got)


def test_late_ends_are_suppressed(spark, tmp_path):
    at = dt.datetime(2024, 1, 1)
    row = lambda s, seq, job, kind, token: (job, at + dt.timedelta(seconds=s), seq, kind, token)
    rows = [[row(0, 0, "a", "claim", "x"), row(10, 1, "a", "end", "x"), row(0, 0, "b", "claim", "y"), row(0, 0, "c", "claim", "z")]]
    rows += [[row(100, 2, "b", "end", "y"), row(20, 1, "c", "end", "other")], [row(500, 9, "d", "claim", "w")], [row(505, 3, "c", "end", "z")], [row(900, 9, "d", "beat", "v")]]
    for i, part in enumerate(rows):
        spark.createDataFrame(part, "job_id string, ts timestamp, seq int, kind string, token string").coalesce(1).write.parquet(str(tmp_path / "beats" / f"part={i:02d}"))
    stream = spark.readStream.schema("job_id string, ts timestamp, seq int, kind string, token string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "beats" / "*"))
    q = leases.lease_events(stream, 60_000).writeStream.format("memory").queryName("lease_ends").option("checkpointLocation", str(tmp_path / "offsets")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted((r.job_id, r.kind) for r in spark.table("lease_ends").collect() if r.job_id in "abc")
    assert got == [("a", "ended"), ("b", "lease-lost"), ("b", "suppressed"), ("c", "lease-lost"), ("c", "suppressed"), ("c", "suppressed")]


def test_listeners_hear_events_after_their_jobs(spark, tmp_path):
    s = store.ParquetStore(spark, str(tmp_path / "store"), parts=2)
    s.save_jobs(fixtures.raw_jobs(spark, SF).filter("status = 'active'").limit(3))
    upkeep.sweep(s, F.expr("timestamp_ntz '2030-01-01'"))
    heard = []

    def listener(events):
        heard.append((sorted(r.kind for r in events.collect()), s.jobs().filter("status = 'active'").count()))
        raise ValueError("a listener's own fault")

    for _ in range(2):  # the second time there is nothing new
        listeners.on_job_event(s, listener, str(tmp_path / "offsets"), once=True).awaitTermination()
    listeners.on_job_event(s, listener, str(tmp_path / "other"), kinds=["failed"], once=True).awaitTermination()
    assert heard == [(["reaper-recovered"], 0)]


def test_a_failing_sweep_is_an_event(spark, tmp_path):
    class Fails(store.ParquetStore):
        def jobs(self, open_only=False):
            raise OSError("no such disk")

    s = Fails(spark, str(tmp_path / "store"), parts=2)
    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    q = upkeep.sweep_periodically(ticks, s, str(tmp_path / "offsets"))
    until = time.time() + 60
    while s.log("events").isEmpty() and time.time() < until:
        time.sleep(0.5)
    q.stop()
    assert (s.log("events").first().kind, s.log("events").first().reason) == ("reaper-error", "no such disk")


def test_handlers_give_outcomes(spark):
    handlers = processing.Handlers()

    def work(job):
        assert "claim_token" not in job
        n = int(job["id"])
        if n % 3 == 0:
            raise processing.FatalJobError("never")
        if n % 3 == 1:
            raise ValueError("later")

    handlers.process("t0", work)
    with pytest.raises(ValueError):
        handlers.process("t0", work)
    claimed = fixtures.raw_jobs(spark, SF).filter("status = 'active' and type in ('t0', 't1')")
    got = processing.run_claimed(claimed, handlers).groupBy("op").count().collect()
    assert {r.op for r in got} == {"complete", "fail", "failFatal", "release"}


def test_resumed_runs_replay_their_steps(spark):
    def body(run):
        a = run.step("first", lambda key: {"key": key, "n": 1})
        if run.job_id == "r3":
            raise RuntimeError("crash")
        b = run.step("second", lambda key: a["n"] + 1)
        return [a["key"], b, run.uuid("x")]

    jobs = spark.createDataFrame([("r1", None), ("r2", None), ("r3", None), ("r4", None)], "job_id string, data string")
    steps = spark.createDataFrame([("r2", 0, "first", json.dumps({"key": "old", "n": 5})), ("r4", 0, "other", "1")], schemas.STEPS)
    got = {r.job_id: r for r in processing.run_orchestrations(jobs, steps, body).collect()}
    assert json.loads(got["r1"].result)[:2] == ["r1:0:first", 2] and [s.seq for s in got["r1"].new_steps] == [0, 1, -1]
    assert json.loads(got["r2"].result)[:2] == ["old", 6] and [s.seq for s in got["r2"].new_steps] == [1, -1]
    assert got["r3"].op == "fail" and [s.name for s in got["r3"].new_steps] == ["first"]
    assert got["r4"].op == "failFatal"
    with pytest.raises(processing.NonSerializableStepResult):
        processing.serializable({"a": [object()]})


def test_orchestrations_are_configured_by_type(spark):
    config = processing.OrchestrationConfig
    made = processing.Orchestrations(reaper_ms=9_000)
    full = made.define("t0", lambda run: run.step("a", lambda key: time.sleep(0.05)), config(step_timeout_ms=10))
    assert (full.visibility_timeout_ms, full.heartbeat_interval_ms, full.step_timeout_ms) == (9_000, 3_000, 10)
    made.define("t1", lambda run: run.step("a", lambda key: time.sleep(0.05)), config(max_duration_ms=10, concurrency=3))
    made.define("t2", lambda run: run.step("a", lambda key: 7))
    assert made.handlers.concurrency == {"t0": 1, "t1": 3, "t2": 1} and config(visibility_timeout_ms=2).resolved().heartbeat_interval_ms == 1
    with pytest.raises(processing.OrchestrationConflictError):
        made.define("t0", print)
    with pytest.raises(processing.OrchestrationConflictError):
        made.handlers.process("t2", print)
    with pytest.raises(processing.HeartbeatConfigConflict):
        made.define("t3", print, config(visibility_timeout_ms=9_001))
    for wrong in (0, -1, float("inf"), float("nan")):
        for name in ("visibility_timeout_ms", "heartbeat_interval_ms", "step_timeout_ms", "max_duration_ms", "poll_interval_ms"):
            with pytest.raises(ValueError, match=name):
                made.define("t3", print, config(**{name: wrong}))
    jobs = spark.createDataFrame([("a", "t0", None), ("b", "t1", None), ("c", "t2", None), ("d", "other", None)], "job_id string, type string, data string")
    got = {r.job_id: r for r in made.run(jobs, spark.createDataFrame([], schemas.STEPS)).collect()}
    assert {k: r.op for k, r in got.items()} == {"a": "fail", "b": "fail", "c": "complete"} and got["c"].result == "7" and "more than 10 ms" in got["a"].reason


def test_uuids_are_a_runs_own_and_frozen():
    one, two = processing.Run("r", None, {}), processing.Run("r", None, {})
    assert one.uuid("x") != two.uuid("x") and one.uuid("x") == one.uuid("x") != one.uuid("y")
    (seq, name, result), *rest = one.new
    again = processing.Run("r", None, {seq: (name, result)})
    assert seq == -1 and not rest and again.uuid("x") == one.uuid("x") and again.now() == one.now() and not again.new


def test_a_journal_has_a_limit_and_steps_a_time():
    run = processing.Run("r", None, {}, limit=200)
    run.step("small", lambda key: "x" * 50)
    with pytest.raises(processing.JournalTooLarge):
        run.step("large", lambda key: "x" * 100)
    with pytest.raises(processing.StepTimeout):
        processing.Run("r", None, {}).step("slow", lambda key: time.sleep(0.02), timeout_ms=5)
    with pytest.raises(processing.StepTimeout):
        processing.Run("r", None, {}, duration_ms=5).step("slow", lambda key: time.sleep(0.02))


def test_json_bytes_agree(spark):
    from jobloom.functions.scalars import record_bytes

    rows = [(0, "a", "plain"), (1, 'q"\\', "é\n\t 日本 🙂/"), (2, None, None)]
    df = spark.createDataFrame(rows, "seq int, name string, result string")
    got = [r[0] for r in df.orderBy("seq").select(record_bytes(F.col("seq"), F.col("name"), F.col("result"))).collect()]
    assert got == [processing.json_bytes(*r) for r in rows]


def test_commands_are_applied_once(spark, tmp_path):
    s = store.ParquetStore(spark, str(tmp_path / "store"), parts=2)
    jobs = fixtures.raw_jobs(spark, SF).filter("status = 'active'").limit(30)
    s.save_jobs(jobs)
    held = s.jobs().select(F.col("id").alias("job_id"), F.lit("complete").alias("op"), F.col("claim_token").alias("token"), F.lit("r").alias("reason"), F.lit("1999-01-01").cast("timestamp").alias("at"))
    held.write.parquet(str(tmp_path / "commands"))
    for k in range(2):  # the second time they are told what they were told before
        stream = spark.readStream.schema(held.schema).parquet(str(tmp_path / "commands"))
        upkeep.apply_commands(stream, s, str(tmp_path / f"offsets{k}")).awaitTermination()
    assert s.jobs().filter("status = 'completed'").count() == 30
    assert s.log("events").filter("kind = 'completed' and duration_ms is not null").count() == 30 and s.log("receipts").count() == 30


def test_commands_for_one_job_are_applied_in_order(spark, tmp_path):
    s = store.ParquetStore(spark, str(tmp_path), parts=2)
    jobs = fixtures.raw_jobs(spark, SF).filter("status = 'active' and dedupe_key is null and attempt < max_attempts").orderBy("id").limit(2)
    s.save_jobs(jobs)
    one, two = sorted(s.jobs().collect(), key=lambda r: r.id)
    at = lambda sec: dt.datetime(1999, 1, 1, 0, 0, sec)
    rows = [(one.id, op, one.claim_token, None, at(i)) for i, op in enumerate(("heartbeat", "heartbeat", "complete", "complete"))]
    rows += [(two.id, "fail", two.claim_token, "first", at(0)), (two.id, "heartbeat", two.claim_token, None, at(1)), ("none", "complete", "t", None, at(2))]
    commands = spark.createDataFrame(rows[::-1], "job_id string, op string, token string, reason string, at timestamp")

    class Dies(store.ParquetStore):
        def update(self, changed, before, logs):
            super().update(changed.withColumn("id", F.raise_error(F.lit("dies"))), before, logs)

    with pytest.raises(Exception, match="dies"):
        upkeep.apply_in_order(commands, Dies(spark, str(tmp_path), parts=2), "stream", 0)
    assert not s.log("events").count() and not s.log("receipts").count() and s.jobs().filter("status = 'active'").count() == 2
    for _ in range(2):  # the second time there is nothing left to do
        upkeep.apply_in_order(commands, s, "stream", 0)
        after = {r.id: r for r in s.jobs().collect()}
        assert after[one.id].status == "completed" and after[two.id].status == "pending" and after[two.id].fail_reason == "first"
        assert after[one.id].claimed_at == at(1) and after[one.id].completed_at == at(2) and after[two.id].fail_reason == "first"
        assert sorted((r.job_id, r.kind) for r in s.log("events").collect()) == sorted([(one.id, "completed"), (two.id, "failed"), (two.id, "lease-lost")])
        assert s.log("receipts").count() == 2
    assert s.log("batches").count() == 1 and s.jobs().count() == 2


def test_leases_follow_appended_steps(spark):
    from jobloom.operators import journal

    jobs = fixtures.raw_jobs(spark, SF).filter("status = 'active'").limit(2)
    first = jobs.orderBy("id").first()
    appended = journal.append_steps(spark.createDataFrame([(first.id, first.claim_token, 0, "a", "1")], "job_id string, token string, seq int, name string, result string"), jobs, spark.createDataFrame([], schemas.STEPS))
    after = {r.id: r.claimed_at for r in journal.leases_renewed(jobs, appended, fixtures.now()).collect()}
    assert sorted(str(t) == "1999-01-01 00:00:00" for t in after.values()) == [False, True] and str(after[first.id]) == "1999-01-01 00:00:00"


def test_times_lie_any_distance_apart(spark):
    from jobloom.functions.scalars import later_by_ms

    rows = spark.createDataFrame([(ms,) for ms in (0, 1, -1, -300_000, 86_400_000, -86_400_000, 90 * 86_400_000 + 5, -90 * 86_400_000 - 5)], "ms bigint")
    got = rows.select("ms", later_by_ms(fixtures.now(), F.col("ms")).alias("t")).collect()
    assert all(r.t == dt.datetime(1999, 1, 1) + dt.timedelta(milliseconds=r.ms) for r in got)


def test_backoff_never_leaves_its_bounds(spark):
    from jobloom.functions.scalars import backoff_bounds_ms, backoff_ms

    rows = spark.range(1, 21).selectExpr("cast(id as int) as attempt", "explode(array('fixed', 'exponential')) as s", "1000L as b", "8000L as c", "cast(id as string) as id")
    low, high = backoff_bounds_ms(F.col("attempt"), F.col("s"), F.col("b"), F.col("c"))
    got = rows.select("attempt", "s", low.alias("lo"), high.alias("hi"), backoff_ms(F.col("attempt"), F.col("s"), F.col("b"), F.col("c"), F.col("id")).alias("x")).collect()
    assert all(r.lo <= r.x <= r.hi <= 8000 for r in got)
    assert {r.hi for r in got if r.s == "exponential"} == {1000, 2000, 4000, 8000}
