"""Slots as keyed state of a stream: commands in, changed jobs and answers out, without a job table to read.

A key's state is its open jobs. Those that finish are kept for as long as retention keeps them,
so that late commands are told so, and then go by themselves.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions.typed import decoded, encoded
from ..operators.lookups import RETENTION_DAYS
from ..operators.slots import JOB, TOLD, SlotFold
from ..sources import schemas

OUT = f"job {JOB}, told {schemas.as_struct(TOLD)}"


class SlotState(StatefulProcessor):
    """The fold of operators.slots, a micro-batch at a time."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        one = "stored string, answered string"
        self.open = handle.getMapState("open", "id string", one)
        self.closed = handle.getMapState("closed", "id string", one, RETENTION_DAYS * 86_400_000)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        fold = SlotFold()
        for state in (self.open, self.closed):
            for (job_id,), (stored, answered) in state.iterator():
                job = {k: v.replace(tzinfo=None) if hasattr(v, "tzinfo") else v for k, v in decoded(stored).items()}
                fold.add(job)
                fold.answered |= {(job_id, t) for t in json.loads(answered)}
        commands = [dict(r["cmd"]) for r in rows]
        commands.sort(key=lambda c: (c["at"], c["op"], c["token"] or "", c["reason"] or "", c["job_id"]))
        for c in commands:
            yield Row(job=None, told=fold.apply(c | {"told": None}))
        for job_id in sorted(fold.changed):
            job = fold.jobs[job_id]
            value = encoded(job), json.dumps(sorted(t for i, t in fold.answered if i == job_id))
            if job["status"] in schemas.OPEN:
                self.open.updateValue((job_id,), value)
            else:
                if self.open.containsKey((job_id,)):
                    self.open.removeKey((job_id,))
                self.closed.updateValue((job_id,), value)
            yield Row(job=job, told=None)

    def close(self) -> None:
        pass


def slot_stream(commands: DataFrame) -> DataFrame:
    """(job, told) of a stream of commands, as operators.slots.folded() gives them.

    commands are (slot, job_id, op, token, reason, at) with request and latest where there are
    requests: slot is the job's key, or its id where it has none, so that the stream needs no
    table of jobs. Of several changes in a micro-batch a job's last is given. A command that
    comes in a later micro-batch than one of a later time is applied when it comes. As finished
    jobs go by the clock, the stream has to run on: it never ends by itself.
    """
    for name, kind in (("again", "boolean"), ("latest", "boolean"), ("request", JOB)):
        if name not in commands.columns:
            commands = commands.withColumn(name, F.lit(None).cast(kind))
    command = F.struct("job_id", "op", "token", "reason", F.col("at").cast("timestamp_ntz").alias("at"), F.coalesce("again", F.lit(False)).alias("again"), "latest", F.col("request").cast(JOB).alias("request"))
    rows = commands.select("slot", command.alias("cmd"))
    return rows.groupBy("slot").transformWithState(SlotState(), OUT, "append", "ProcessingTime")
