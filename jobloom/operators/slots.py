"""Commands and requests of many slots, each slot's in the order of their times.

What a command does depends on the other jobs of its slot: a pending one supersedes an active one
that fails, and a request is claimed, queued or turned away by what is open. So all commands for
a key are folded one after another, each with its own time, while different keys go on side by
side. A key has three open jobs at most, and the rows of a key come sorted, so a task holds
those few and what it closed, never a key's commands. Commands for jobs that were finished
before, and for jobs without a key, only depend on that job and are dealt out by it.
"""

from __future__ import annotations

import datetime as dt
import hashlib
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import BACKOFF_BASE_MS, BACKOFF_CAP_MS
from ..sources import schemas
from .apply import SUPERSEDED_NOTE, TERMINAL_OPS, latest_receipts

#: Requests; all other commands are about a job that exists.
REQUESTS = ("enqueue", "claimOrEnqueue")
OPEN, TERMINAL = schemas.OPEN, schemas.TERMINAL
JOB = schemas.as_struct(schemas.JOBS)
TOLD = "job_id string, op string, token string, reason string, at timestamp_ntz, outcome string, changes boolean, fell_to string, type string, claimed_at timestamp_ntz, attempt int, max_attempts int"

ARROW = {"string": pa.string(), "boolean": pa.bool_(), "int": pa.int32(), "timestamp_ntz": pa.timestamp("us")}
Row = dict[str, Any]


def backoff_of(job: Row) -> int:
    """functions.scalars.backoff_ms() of one job."""
    base = BACKOFF_BASE_MS if job["backoff_base_ms"] is None else job["backoff_base_ms"]
    cap = BACKOFF_CAP_MS if job["backoff_cap_ms"] is None else job["backoff_cap_ms"]
    if job["backoff_strategy"] == "fixed":
        return min(cap, base)
    high = max(base, int(min(float(cap), base * 2.0 ** max(0, job["attempt"] - 1))))
    share = int(hashlib.sha256(f"{job['id']}:{job['attempt']}".encode()).hexdigest()[:8], 16) / 4294967296.0
    return max(base, int(high * share))


class SlotFold:
    """The jobs of one key, and what commands in order make of them."""

    def __init__(self) -> None:
        self.jobs: dict[str, Row] = {}
        self.before: dict[str, Row] = {}
        self.changed: set[str] = set()
        self.asked: set[str] = set()
        #: tokens of jobs under which some command was answered, and all answers of this fold
        self.answered: set[tuple[str, str]] = set()
        self.receipts: dict[tuple[str, str | None, str], str] = {}

    def add(self, job: Row, answered: bool = False) -> None:
        """A job as it was before; answered says whether there is a receipt for its own token."""
        self.jobs[job["id"]] = job
        self.before[job["id"]] = dict(job)
        if answered:
            self.answered.add((job["id"], job["claim_token"]))

    def _open(self, scope: str, *statuses: str) -> list[Row]:
        return [j for j in self.jobs.values() if j["dedupe_scope"] == scope and j["dedupe_key"] and j["status"] in statuses]

    def _insert(self, request: Row, at: dt.datetime, **own: Any) -> None:
        self.jobs[request["id"]] = request | {"created_at": at, "completed_at": None, "failed_at": None, "fail_reason": None, "claimed_at": None, "claim_token": None} | own
        self.changed.add(request["id"])

    def request(self, op: str, request: Row, latest: bool, at: dt.datetime) -> tuple[str, str | None]:
        """The outcome of a request for a new job, and the job that it fell to.

        enqueued, claimed, queued: it is there now; replaced: the follower has its data; waiting:
        a pending job of the key is there; yielded: another type's follower is; rejected: the slot
        is taken; refused: latest needs a key of scope 'pending'; repeated: a job has its id.
        """
        key = request["dedupe_key"] or None
        scope = (request["dedupe_scope"] or "pending+active") if key else None
        request = request | {"dedupe_key": key, "dedupe_scope": scope}
        if request["id"] in self.jobs or request["id"] in self.asked:
            return "repeated", None
        self.asked.add(request["id"])
        if op == "claimOrEnqueue" and latest and scope != "pending":
            return "refused", None
        taken = bool(key) and bool(self._open(scope, *OPEN) if scope == "pending+active" else self._open(scope, "active"))
        pending = {"status": "pending", "attempt": 0, "run_at": request["run_at"] or at}
        if op == "enqueue":
            if key and self._open(scope, *(OPEN if scope == "pending+active" else ("pending",))):
                return "rejected", None
            self._insert(request, at, **pending)
            return "enqueued", request["id"]
        follower = next(iter(self._open("pending", "pending")), None)
        own = follower is not None and follower["type"] == request["type"]
        if latest and own:
            follower["data"] = request["data"]
            self.changed.add(follower["id"])
            return "replaced", follower["id"]
        if key and not latest and (follower or self._open("pending+active", "pending")):
            return "waiting", None
        if not taken:
            token = hashlib.sha256(f"claim:{request['id']}:1".encode()).hexdigest()[:16]
            self._insert(request, at, status="active", attempt=1, run_at=at, claimed_at=at, claim_token=token)
            return "claimed", request["id"]
        if scope != "pending":
            return "rejected", None
        if follower:
            return "yielded", None
        self._insert(request, at, **pending)
        return "queued", request["id"]

    def command(self, job_id: str, op: str, token: str | None, reason: str | None, at: dt.datetime) -> tuple[str, bool]:
        """The outcome of a command for a job, and whether the job has changed."""
        job = self.jobs.get(job_id)
        miss = "not-found" if job is None else "already-terminal" if job["status"] in TERMINAL else "lease-lost"
        if op not in TERMINAL_OPS:
            miss = "lease-lost"
        active = job is not None and job["status"] == "active"
        own = token is not None and job is not None and job["claim_token"] == token
        if op == "heartbeat" and (token is None or (active and own)):
            return "applied", self._changed(job, claimed_at=at) if job else False
        if op == "heartbeatClaimed" and active and own:
            return "heartbeated", self._changed(job, claimed_at=at)
        failed = job is not None and job["status"] == "failed"
        may = (active and own) if token is not None else job is not None and job["status"] in OPEN
        if op == "complete":
            may = may or (failed and own and (job_id, token) not in self.answered)
        elif op == "completeClaimed":
            may = own and (active or failed)
        elif op == "release":
            may = may and active
        elif op in ("heartbeat", "heartbeatClaimed"):
            may = False
        if not may:
            return miss, False
        followed = job["dedupe_scope"] == "pending" and bool(self._open("pending", "pending"))
        if op in ("complete", "completeClaimed"):
            outcome = "completed"
            self._changed(job, status="completed", completed_at=at, failed_at=None, fail_reason=None)
        elif op != "failFatal" and followed:
            outcome = "superseded"
            said = "Released" if op == "release" else reason or ""
            self._changed(job, status="superseded", failed_at=at, fail_reason=said + SUPERSEDED_NOTE)
        elif op == "release":
            outcome = "released"
            self._changed(job, status="pending", run_at=at, claimed_at=None, claim_token=None)
        elif op == "failFatal" or job["attempt"] >= job["max_attempts"]:
            outcome = "failed-terminal"
            self._changed(job, status="failed", failed_at=at, fail_reason=reason)
        else:
            outcome = "retry-scheduled"
            self._changed(job, status="pending", fail_reason=reason, run_at=at + dt.timedelta(milliseconds=backoff_of(job)))
        if op in TERMINAL_OPS:
            self.receipts[job_id, token, op] = outcome
            if token is not None:
                self.answered.add((job_id, token))
        return outcome, True

    def _changed(self, job: Row, **new: Any) -> bool:
        job.update(new)
        self.changed.add(job["id"])
        return True

    def apply(self, c: Row) -> Row:
        """A command's answer, with what its job was before."""
        before = self.jobs.get(c["job_id"])
        told = {k: c[k] for k in ("job_id", "op", "token", "reason", "at")} | {k: before[k] if before else None for k in ("type", "claimed_at", "attempt", "max_attempts")}
        if c["op"] in REQUESTS:
            outcome, fell_to = self.request(c["op"], c["request"], bool(c["latest"]), c["at"])
            made = self.jobs[fell_to] if fell_to else c["request"]
            told |= {"type": made["type"], "attempt": made["attempt"] if outcome == "claimed" else None}
            return told | {"outcome": outcome, "changes": fell_to is not None, "fell_to": fell_to}
        first = self.receipts.get((c["job_id"], c["token"], c["op"]), c["told"]) if c["again"] else None
        if first is not None:
            return told | {"outcome": first, "changes": False, "fell_to": None}
        outcome, changes = self.command(c["job_id"], c["op"], c["token"], c["reason"], c["at"])
        return told | {"outcome": outcome, "changes": changes, "fell_to": None}


def _group(job_id: str, key: str, is_open: Column) -> Column:
    return F.when(is_open & (F.coalesce(F.col(key), F.lit("")) != ""), F.concat(F.lit("k:"), F.col(key))).otherwise(F.concat(F.lit("j:"), F.col(job_id)))


def folded(commands: DataFrame, jobs: DataFrame, receipts: DataFrame) -> DataFrame:
    """(job, was, told): the new state of each job that changed or is new with its old one, and the answer to each command.

    commands are (job_id, op, token, reason, at), and may have again (it repeats one whose answer
    was lost, and is told what that was told), request (a job's row, for 'enqueue' and
    'claimOrEnqueue', whose id is job_id) and latest. Ties in at go by op, token, reason and
    job_id. A request whose id a job has already, or an earlier request of the batch, is
    repeated and changes nothing. Null ids or times are an error of the caller's; an empty table of commands gives no rows.
    """
    given = commands.columns
    for name, kind in (("again", "boolean"), ("latest", "boolean"), ("request", JOB)):
        if name not in given:
            commands = commands.withColumn(name, F.lit(None).cast(kind))
    commands = commands.select("job_id", "op", "token", "reason", F.col("at").cast("timestamp_ntz"), F.coalesce("again", F.lit(False)).alias("again"), "latest", F.col("request").cast(JOB))
    asked = F.col("op").isin(*REQUESTS)
    wanted = commands.select(F.col("job_id").alias("id")).distinct()
    target = jobs.select("id", "status", "dedupe_key").join(wanted, "id", "left_semi").select(F.col("id").alias("job_id"), _group("id", "dedupe_key", F.col("status").isin(*OPEN)).alias("old"))
    first = commands.filter(asked).groupBy("job_id").agg(F.min_by(F.struct("request.dedupe_key", "job_id"), F.struct("at", "op", "token", "reason")).alias("r"))
    new = first.select("job_id", _group("r.job_id", "r.dedupe_key", F.lit(True)).alias("new"))
    own = F.coalesce("old", "new", F.concat(F.lit("j:"), F.col("job_id")))
    placed = commands.join(target, "job_id", "left").join(new, "job_id", "left").withColumn("grp", own).drop("old", "new")
    told = latest_receipts(receipts)
    placed = placed.withColumn("t", F.coalesce("token", F.lit(""))).join(told, ["job_id", "t", "op"], "left").drop("t")

    members = jobs.withColumn("grp", _group("id", "dedupe_key", F.col("status").isin(*OPEN))).join(placed.select("grp").distinct(), "grp", "left_semi")
    answered = receipts.filter("token is not null").select(F.col("job_id").alias("id"), F.col("token").alias("claim_token")).distinct().withColumn("answered", F.lit(True))
    members = members.join(answered, ["id", "claim_token"], "left")
    command = F.struct("job_id", "op", "token", "reason", "at", "again", "latest", "request", "told")
    rows = members.select("grp", F.lit(0).alias("kind"), F.lit(None).cast("timestamp_ntz").alias("at"), F.struct(*schemas.names(schemas.JOBS)).cast(JOB).alias("job"), F.coalesce("answered", F.lit(False)).alias("answered"), F.lit(None).alias("cmd"))
    rows = rows.unionByName(placed.select("grp", F.lit(1).alias("kind"), "at", F.lit(None).cast(JOB).alias("job"), F.lit(None).cast("boolean").alias("answered"), command.alias("cmd")))
    dealt = rows.repartition("grp").sortWithinPartitions("grp", "kind", "at", "cmd.op", "cmd.token", "cmd.reason", "cmd.job_id")
    return dealt.mapInArrow(_run, f"job {JOB}, was {JOB}, told {schemas.as_struct(TOLD)}")


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema, group, fold, out = None, None, SlotFold(), []

    def settled() -> None:
        out.extend({"job": fold.jobs[i], "was": fold.before.get(i), "told": None} for i in sorted(fold.changed))

    for batch in batches:
        if schema is None:
            job = batch.schema.field("job").type
            told = pa.struct([(n, ARROW[t]) for n, t in map(str.split, TOLD.split(", "))])
            schema = pa.schema([("job", job), ("was", job), ("told", told)])
        for row in batch.to_pylist():
            if row["grp"] != group:
                settled()
                group, fold = row["grp"], SlotFold()
            if row["kind"] == 0:
                fold.add(row["job"], row["answered"])
            else:
                out.append({"job": None, "was": None, "told": fold.apply(row["cmd"])})
        if len(out) > 5_000:
            yield pa.RecordBatch.from_pylist(out, schema)
            out.clear()
    settled()
    if out:
        yield pa.RecordBatch.from_pylist(out, schema)


def changed_jobs(done: DataFrame) -> DataFrame:
    """The jobs' rows of folded()."""
    return done.filter("job is not null").select("job.*")


def jobs_before(done: DataFrame) -> DataFrame:
    """The old rows of the jobs that folded() changes."""
    return done.filter("was is not null").select("was.*")


def answers(done: DataFrame) -> DataFrame:
    """The answers of folded(), shaped as apply.events() and apply.new_receipts() take them."""
    return done.filter("told is not null").select("told.*")


def jobs_afterwards(jobs: DataFrame, changed: DataFrame) -> DataFrame:
    """jobs with the changed rows in place of the old ones, and the new ones besides."""
    return jobs.join(changed.select("id"), "id", "left_anti").unionByName(changed.select(jobs.columns))
