"""The queue's storage: Parquet partitions of jobs, of which a batch rewrites those that it touches, and logs.

Open jobs lie apart from finished ones, by a hash of their slot; finished jobs by the day on which
they ended. A batch first writes what it changes beside the table, then overwrites the touched
partitions and adds to the logs; both can be done again with the same result, so a writer that
died is caught up with by the next. One writer at a time; a reader that has to see whole
batches reads between them, and a DataFrame of jobs is good until the next batch.
"""

from __future__ import annotations

from contextlib import contextmanager
from dataclasses import dataclass
from typing import Protocol, runtime_checkable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schemas


@runtime_checkable
class QueueStore(Protocol):
    """What the rest of the library needs of a storage."""

    def jobs(self, open_only: bool = False) -> DataFrame: ...

    def save_jobs(self, jobs: DataFrame) -> None: ...

    def update(self, changed: DataFrame, before: DataFrame | None, logs: dict[str, DataFrame]) -> None: ...

    def append(self, log: str, rows: DataFrame) -> None: ...

    def log(self, name: str) -> DataFrame: ...

    def reset(self) -> None: ...


LOGS = {"commands": schemas.COMMANDS, "events": schemas.EVENTS, "steps": schemas.STEPS, "receipts": schemas.RECEIPTS, "batches": schemas.BATCHES}
JOB_COLUMNS = schemas.names(schemas.JOBS)
#: Where a job lies; all but the last never change for an open job.
PLACE = ("area", "day", "part")
OPEN_AREA, DONE_AREA = "open", "done"


def placed(jobs: DataFrame, parts: int) -> DataFrame:
    """jobs with the partition that each belongs to."""
    is_open = F.col("status").isin(*schemas.OPEN)
    slot = F.coalesce(F.when(F.col("dedupe_key") != "", F.col("dedupe_key")), F.col("id"))
    ended = F.date_format(F.coalesce("completed_at", "failed_at", "created_at"), "yyyy-MM-dd")
    return jobs.withColumns({"area": F.when(is_open, OPEN_AREA).otherwise(DONE_AREA), "day": F.when(is_open, "-").otherwise(F.coalesce(ended, F.lit("-"))), "part": F.pmod(F.xxhash64(slot), F.lit(parts)).cast("int")})


@dataclass
class ParquetStore:
    """Jobs under path/jobs/area=/day=/part=, a batch that isn't done yet under path/unfinished, logs under path/<name>,
    and what each batch changed under path/changes/batch=, which sources.datasource streams.

    parts is how many partitions the open jobs, and those that ended on one day, are dealt out to;
    it has to stay as it is. The larger it is, the less a batch of few changes rewrites.
    """

    spark: SparkSession
    path: str
    parts: int = 16

    def _file(self, name: str):
        file = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return file.getFileSystem(self.spark._jsc.hadoopConfiguration()), file

    def _exists(self, name: str) -> bool:
        fs, file = self._file(name)
        return fs.exists(file)

    def _delete(self, name: str) -> None:
        fs, file = self._file(name)
        fs.delete(file, True)

    def _table(self) -> DataFrame:
        schema = f"{schemas.JOBS}, area string, day string, part int"
        return self.spark.read.schema(schema).parquet(f"{self.path}/jobs") if self._exists("jobs") else self.spark.createDataFrame([], schema)

    def _write(self, rows: DataFrame, name: str, mode: str) -> None:
        out = rows.select(*JOB_COLUMNS, *PLACE).repartition(*PLACE).write.mode(mode).option("partitionOverwriteMode", "dynamic")
        out.partitionBy(*PLACE).parquet(f"{self.path}/{name}")

    def jobs(self, open_only: bool = False) -> DataFrame:
        """All jobs, or those that are pending or active, whose partitions alone are read."""
        rows = self._table()
        return (rows.filter(F.col("area") == OPEN_AREA) if open_only else rows).select(*JOB_COLUMNS)

    def save_jobs(self, jobs: DataFrame) -> None:
        """Start anew with these jobs."""
        self._write(placed(jobs, self.parts), "next", "overwrite")
        self._delete("jobs")
        fs, file = self._file("next")
        fs.rename(file, self._file("jobs")[1])

    def update(self, changed: DataFrame, before: DataFrame | None, logs: dict[str, DataFrame]) -> None:
        """Put changed jobs in the place of before, their old rows, add those that have none there, and add rows to logs."""
        self.recover()
        rows = placed(changed.select(*JOB_COLUMNS), self.parts)
        touched = rows.select(*PLACE) if before is None else rows.select(*PLACE).union(placed(before, self.parts).select(*PLACE))
        for name, part in (("changed", rows), ("touched", touched.distinct()), *((f"log-{n}", r) for n, r in logs.items())):
            part.write.mode("overwrite").parquet(f"{self.path}/unfinished/{name}")
        self.spark.range(1).write.mode("overwrite").parquet(f"{self.path}/unfinished/ready")
        self.recover()

    def recover(self) -> None:
        """Finish the batch that was written last, or forget it where it wasn't written to its end.

        What it changed becomes the change log's next batch, last of all: where it is there, the rest is done.
        """
        if self._exists("unfinished/ready/_SUCCESS") and self._exists("unfinished/changed"):
            self._rewrite(self.spark.read.parquet(f"{self.path}/unfinished/changed"), self.spark.read.parquet(f"{self.path}/unfinished/touched"))
            fs, folder = self._file("unfinished")
            for name in (x.getPath().getName() for x in fs.listStatus(folder)):
                if name.startswith("log-"):  # the events of a batch come after its jobs
                    log, (_, to) = name[4:], self._file(name[4:])
                    fs.mkdirs(to)
                    fs.rename(self._file(f"unfinished/{name}")[1], self._file(f"{log}/batch={len(fs.listStatus(to))}")[1])
            self._move("unfinished/changed", f"changes/batch={self._next_change()}")
        if self._exists("unfinished/ready"):
            self._delete("unfinished/ready")
        self._delete("unfinished")

    def _move(self, name: str, to: str) -> None:
        fs, target = self._file(to)
        fs.mkdirs(target.getParent())
        fs.rename(self._file(name)[1], target)

    def _changes(self) -> list[int]:
        fs, folder = self._file("changes")
        return sorted(int(x.getPath().getName().removeprefix("batch=")) for x in fs.listStatus(folder)) if fs.exists(folder) else []

    def _next_change(self) -> int:
        return max(self._changes(), default=-1) + 1

    def forget_changes(self, keep: int = 1) -> None:
        """Drop all but the newest batches of the change log, of which one has to stay, as its number is the next one's base."""
        for n in self._changes()[: -max(1, keep)]:
            self._delete(f"changes/batch={n}")

    def _rewrite(self, changed: DataFrame, touched: DataFrame) -> None:
        """Overwrite the touched partitions with what was there of other jobs, and the changed ones."""
        where = [tuple(r) for r in touched.select(*PLACE).collect()]  # partitions of one batch: those of the open jobs, and of a few days
        if not where:
            return
        here = F.lit(False)
        for area, day in {x[:2] for x in where}:
            here = here | ((F.col("area") == area) & (F.col("day") == day) & F.col("part").isin([x[2] for x in where if x[:2] == (area, day)]))
        others = lambda: self._table().filter(here).join(changed.select("id"), "id", "left_anti")
        self._write(others().unionByName(changed), "jobs", "overwrite")
        # partitions that nothing is left in aren't overwritten
        filled = {tuple(r) for r in others().select(*PLACE).union(changed.select(*PLACE)).distinct().collect()}
        for area, day, part in set(where) - filled:
            self._delete(f"jobs/area={area}/day={day}/part={part}")

    def append(self, log: str, rows: DataFrame) -> None:
        """Add rows to a log at once."""
        rows.write.mode("append").parquet(f"{self.path}/{log}/batch=-1")

    def log(self, name: str) -> DataFrame:
        """All rows of a log so far."""
        if not self._exists(name):
            return self.spark.createDataFrame([], LOGS[name])
        return self.spark.read.schema(LOGS[name]).option("recursiveFileLookup", True).parquet(f"{self.path}/{name}")

    def reset(self) -> None:
        """Start with an empty queue."""
        self._delete("unfinished")
        self._delete("jobs")

    def forget(self, before: str) -> None:
        """Drop jobs that ended before a day (yyyy-MM-dd): whole partitions go, and nothing is rewritten."""
        if self._exists(f"jobs/area={DONE_AREA}"):
            fs, folder = self._file(f"jobs/area={DONE_AREA}")
            for x in fs.listStatus(folder):
                if "day=-" != x.getPath().getName() < f"day={before}":
                    fs.delete(x.getPath(), True)


_default: list[QueueStore] = []
_scoped: list[QueueStore] = []


def default_store() -> QueueStore:
    """The store that with_store() or set_default_store() has set."""
    found = _scoped or _default
    if not found:
        raise LookupError("no default store is set")
    return found[0]


def set_default_store(store: QueueStore | None) -> None:
    """Set or clear the store of this process."""
    if store is not None and not isinstance(store, QueueStore):
        raise TypeError("not a QueueStore")
    _default[:] = [] if store is None else [store]


@contextmanager
def with_store(store: QueueStore):
    """A default store for a block; blocks can't be nested."""
    if _scoped:
        raise RuntimeError("a scoped store is already set")
    _scoped.append(store)
    try:
        yield store
    finally:
        _scoped.clear()
