"""Handlers over claimed jobs, and durable steps, run by Spark's tasks.

A handler is a Python function of a job. Spark runs handlers over partitions of claimed rows and
gives back what became of each, as rows for operators.transitions. Tasks may run again, so a
handler's effects have to be idempotent: a step's idempotency key is there for that.
"""

from __future__ import annotations

import hashlib
import json
import math
import secrets
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import typed
from ..functions.scalars import JOURNAL_BYTES, TIME_BYTES
from .transitions import VISIBILITY_MS

OUTCOMES = "job_id string, token string, op string, reason string"
RUNS = "job_id string, op string, reason string, result string, new_steps array<struct<seq: int, name: string, result: string>>"


class FatalJobError(Exception):
    """Ends a job without another attempt."""


class NonRetryable(FatalJobError):
    """A step's failure that no retry can mend."""


class NondeterminismError(FatalJobError):
    """A resumed run asked for another step than its journal has."""


class NonSerializableStepResult(FatalJobError):
    """A step's result that the journal can't hold."""


class JournalTooLarge(FatalJobError):
    """A journal that would pass its limit."""


class OrchestrationUnsupportedError(FatalJobError):
    """A store without a journal."""


class StepTimeout(Exception):
    """A step, or a whole run, that took too long; another attempt may succeed."""


class MaxDurationExceeded(StepTimeout):
    """A run that took longer than it may in all; another attempt may succeed."""


class HeartbeatConfigConflict(ValueError):
    """A lease that is to last longer than the reaper lets it."""


class LeaseLostError(Exception):
    """A run whose job another worker has claimed."""


class OrchestrationConflictError(ValueError):
    """A second definition for a type."""


class Handlers:
    """One function for each type of job."""

    def __init__(self) -> None:
        self.by_type: dict[str, Callable[[dict], None]] = {}
        self.concurrency: dict[str, int] = {}

    def process(self, job_type: str, handler: Callable[[dict], None], concurrency: int = 1) -> None:
        """Register a handler; a type can have one only."""
        if job_type in self.by_type:
            raise OrchestrationConflictError(f"{job_type} has a handler already")
        if concurrency < 1:
            raise ValueError("concurrency must be positive")
        self.by_type[job_type], self.concurrency[job_type] = handler, concurrency

    def capacity(self, spark: SparkSession) -> DataFrame:
        """(type, capacity), for claims.claim_with_capacity()."""
        return spark.createDataFrame(list(self.concurrency.items()), "type string, capacity int")


def run_claimed(claimed: DataFrame, handlers: Handlers) -> DataFrame:
    """(job_id, token, op, reason) for claimed jobs: complete, fail, failFatal; types without handler are released."""
    by_type = dict(handlers.by_type)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for job in frame.to_dict("records"):
                token = job.pop("claim_token")  # handlers never see it
                op, reason = "complete", None
                try:
                    if job["type"] not in by_type:
                        op = "release"
                    else:
                        by_type[job["type"]](job)
                except FatalJobError as e:
                    op, reason = "failFatal", str(e)
                except Exception as e:  # noqa: BLE001  any other failure is the job's, not the task's
                    op, reason = "fail", str(e)
                out.append((job["id"], token, op, reason))
            yield pd.DataFrame(out, columns=["job_id", "token", "op", "reason"])

    return claimed.select("id", "type", "data", "attempt", "claim_token").mapInPandas(run, OUTCOMES)


def serialized(value: object) -> str:
    """A result as the journal holds it; what it can't hold is rejected with the place of it."""
    try:
        return typed.encoded(value)
    except typed.NotStorable as e:
        raise NonSerializableStepResult(str(e)) from None


def serializable(value: object) -> None:
    """Reject what the journal can't hold, with the place of it."""
    serialized(value)


#: Place and name of the record that freezes a run's start and seed.
BOOTSTRAP_SEQ, BOOTSTRAP_NAME = -1, "$bootstrap"


def json_bytes(seq: int, name: str, result: str | None) -> int:
    """What functions.scalars.record_bytes() gives."""
    return len(json.dumps({"seq": seq, "name": name, "result": result}, ensure_ascii=False, separators=(",", ":")).encode()) + TIME_BYTES


class Run:
    """A run of an orchestration: steps found in the journal are not run again."""

    def __init__(self, job_id: str, data: str | None, journal: dict[int, tuple[str, str]], limit: int = JOURNAL_BYTES, duration_ms: float | None = None, step_timeout_ms: float | None = None) -> None:
        self.step_timeout_ms = step_timeout_ms
        self.job_id, self.data, self.journal, self.limit = job_id, data, journal, limit
        self.new: list[tuple[int, str, str]] = []
        self.next_seq, self.began, self.duration_ms = 0, time.monotonic(), duration_ms
        self.bytes = sum(json_bytes(seq, *x) for seq, x in journal.items())

    def key(self, seq: int, name: str) -> str:
        """The step's idempotency key."""
        return f"{self.job_id}:{seq}:{name}"

    def _record(self, seq: int, name: str, value: object) -> None:
        result = serialized(value)
        self.bytes += json_bytes(seq, name, result)
        if self.bytes > self.limit:
            raise JournalTooLarge(f"{name}: {self.bytes} bytes")
        self.new.append((seq, name, result))

    def _bootstrap(self) -> dict:
        """The start time and the seed that the first attempt wrote down before all steps."""
        if BOOTSTRAP_SEQ not in self.journal:
            value = {"startedAt": int(time.time() * 1000), "seed": secrets.token_hex(16)}
            self._record(BOOTSTRAP_SEQ, BOOTSTRAP_NAME, value)
            self.journal[BOOTSTRAP_SEQ] = BOOTSTRAP_NAME, json.dumps(value)
        return json.loads(self.journal[BOOTSTRAP_SEQ][1])

    def now(self) -> int:
        """Milliseconds at which the first attempt began, in every attempt."""
        return self._bootstrap()["startedAt"]

    def uuid(self, label: str) -> str:
        """An id that every attempt of this run gets alike, and no other run does."""
        h = hashlib.sha256(f"{self._bootstrap()['seed']}\0{label}".encode()).hexdigest()
        return f"{h[:8]}-{h[8:12]}-4{h[13:16]}-{'89ab'[int(h[16], 16) % 4]}{h[17:20]}-{h[20:32]}"

    def step(self, name: str, f: Callable[[str], object], timeout_ms: int | None = None) -> object:
        """The step's recorded result, or that of f(idempotency key), to be recorded.

        A step that took longer than its timeout, or ends after the run's whole time, isn't recorded.
        """
        seq, self.next_seq = self.next_seq, self.next_seq + 1
        if seq in self.journal:
            known, result = self.journal[seq]
            if known != name:
                raise NondeterminismError(f"step {seq} is {known!r} in the journal, {name!r} in the code")
            return typed.decoded(result)
        began = time.monotonic()
        value = f(self.key(seq, name))
        for since, most, error in ((began, timeout_ms or self.step_timeout_ms, StepTimeout), (self.began, self.duration_ms, MaxDurationExceeded)):
            if most is not None and (time.monotonic() - since) * 1000 > most:
                raise error(f"{name}: more than {most} ms")
        self._record(seq, name, value)
        return value


@dataclass(frozen=True)
class OrchestrationConfig:
    """How runs of a type go: milliseconds, positive and finite where they are given.

    A lease may be shorter than the reaper's timeout, and not longer. Where nothing else is said,
    it is that timeout, the heartbeat comes three times in a lease, and a step may take a lease.
    """

    visibility_timeout_ms: float | None = None
    heartbeat_interval_ms: float | None = None
    step_timeout_ms: float | None = None
    max_duration_ms: float | None = None
    poll_interval_ms: float | None = None
    concurrency: int = 1

    def resolved(self, reaper_ms: float = VISIBILITY_MS) -> OrchestrationConfig:
        """With everything that follows filled in, or an error that names what can't be."""
        for name in ("visibility_timeout_ms", "heartbeat_interval_ms", "step_timeout_ms", "max_duration_ms", "poll_interval_ms"):
            value = getattr(self, name)
            if value is not None and not (math.isfinite(value) and value > 0):
                raise ValueError(f"{name} must be a positive finite number of milliseconds, not {value}")
        lease = self.visibility_timeout_ms or reaper_ms
        if lease > reaper_ms:
            raise HeartbeatConfigConflict(f"a lease of {lease} ms is longer than the reaper's {reaper_ms} ms")
        return replace(self, visibility_timeout_ms=lease, heartbeat_interval_ms=self.heartbeat_interval_ms or max(1, lease // 3), step_timeout_ms=self.step_timeout_ms or lease)


class Orchestrations:
    """Bodies of durable runs by type; a type has one body, or one handler."""

    def __init__(self, handlers: Handlers | None = None, reaper_ms: float = VISIBILITY_MS) -> None:
        self.handlers, self.reaper_ms = handlers or Handlers(), reaper_ms
        self.bodies: dict[str, tuple[Callable[[Run], object], OrchestrationConfig]] = {}

    def define(self, job_type: str, body: Callable[[Run], object], config: OrchestrationConfig | None = None) -> OrchestrationConfig:
        """Register a body; gives the configuration in full."""
        made = (config or OrchestrationConfig()).resolved(self.reaper_ms)
        self.handlers.process(job_type, lambda job: None, made.concurrency)  # the type is taken from here on
        self.bodies[job_type] = body, made
        return made

    def run(self, jobs: DataFrame, steps: DataFrame) -> DataFrame:
        """run_orchestrations() of jobs (job_id, type, data), each by its type's body; other types are left out."""
        return run_orchestrations(jobs.filter(F.col("type").isin(list(self.bodies))), steps, dict(self.bodies))


def run_orchestrations(jobs: DataFrame, steps: DataFrame, body: Callable[[Run], object] | dict[str, tuple[Callable[[Run], object], OrchestrationConfig]]) -> DataFrame:
    """jobs (job_id, data) resumed with their journal: what became of each run, and its new steps.

    With bodies by type, jobs have a type besides. A run that fails keeps the steps that it finished. Each job's journal, which is bounded in
    bytes, travels to its run as one array.
    """
    journal = steps.groupBy("job_id").agg(F.collect_list(F.struct("seq", "name", "result")).alias("journal"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for job_id, kind, data, known in zip(frame["job_id"], frame["type"], frame["data"], frame["journal"], strict=True):
                one, config = body[kind] if isinstance(body, dict) else (body, OrchestrationConfig())
                r = Run(job_id, data, {s["seq"]: (s["name"], s["result"]) for s in (known if known is not None else [])}, duration_ms=config.max_duration_ms, step_timeout_ms=config.step_timeout_ms)
                op, reason, result = "complete", None, None
                try:
                    result = serialized(one(r))
                except FatalJobError as e:
                    op, reason = "failFatal", str(e)
                except Exception as e:  # noqa: BLE001
                    op, reason = "fail", str(e)
                out.append((job_id, op, reason, result, [{"seq": s, "name": n, "result": v} for s, n, v in r.new]))
            yield pd.DataFrame(out, columns=["job_id", "op", "reason", "result", "new_steps"])

    kind = F.col("type") if isinstance(body, dict) else F.lit("").alias("type")
    return jobs.join(journal, "job_id", "left").select("job_id", kind, "data", "journal").mapInPandas(run, RUNS)
