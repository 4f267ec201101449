"""The job table as a named source: spark.read and spark.readStream .format("jobloom"), with a store's path.

Read, it is the table as the newest batch left it; streamed, it is what batches changed, in their
order, from the change log that the store keeps beside the table. Give a schema with fewer
columns to read fewer. Tasks read single Parquet files with pyarrow.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from . import schemas

NAME = "jobloom"
COMPARE = {EqualTo: pc.equal, GreaterThan: pc.greater, GreaterThanOrEqual: pc.greater_equal, LessThan: pc.less, LessThanOrEqual: pc.less_equal}


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path there."""
    return fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)


def data_files(path: str) -> list[str]:
    """Parquet files below a folder, which needn't exist; names that Spark hides are left out."""
    files, root = opened(path)
    found = files.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
    return sorted(x.path for x in found if x.is_file and x.path.endswith(".parquet") and not any(p[:1] in "._" for p in x.path[len(root) :].split("/") if p))


@dataclass
class JobFile(InputPartition):
    """One file; tasks open it by the store's file system."""

    path: str


def rows_of(store: str, file: JobFile | None, schema: StructType, keep: pc.Expression | None = None) -> Iterator[pa.RecordBatch]:
    """A file's rows, some at a time, with the columns of schema; where there are no files, Spark asks for None."""
    if file is None:
        return
    wanted = to_arrow_schema(schema)
    data = ds.dataset(file.path, filesystem=opened(store)[0], format="parquet", partitioning=None)
    for batch in data.to_batches(columns=wanted.names, filter=keep):
        if batch.num_rows:
            yield pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(batch.columns, wanted.types, strict=True)], schema=wanted)


class JobReader(DataSourceReader):
    """All jobs. Filters on status skip the open or the finished ones' folders, those on completed_at skip days, and all skip row groups."""

    def __init__(self, path: str, schema: StructType) -> None:
        self.path, self.schema = path, schema
        self.keep: pc.Expression | None = None
        self.areas = {"open", "done"}
        self.days = ("", "~")  # no day lies outside

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, In) or type(f) in COMPARE:
                (*_, name) = f.attribute
                field = pc.field(name)
                one = field.isin(list(f.value)) if isinstance(f, In) else COMPARE[type(f)](field, f.value)
                self.keep = one if self.keep is None else self.keep & one
                if name == "status" and isinstance(f, (In, EqualTo)):
                    self.areas &= {"open" if x in schemas.OPEN else "done" for x in (f.value if isinstance(f, In) else [f.value])}
                if name == "completed_at" and isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                    self.days = (max(self.days[0], f"{f.value:%Y-%m-%d}"), self.days[1])
                if name == "completed_at" and isinstance(f, (LessThan, LessThanOrEqual)):
                    self.days = (self.days[0], min(self.days[1], f"{f.value:%Y-%m-%d}"))
            yield f  # Spark looks at what is left once more

    def partitions(self) -> list[JobFile]:
        out = []
        for file in data_files(f"{self.path}/jobs"):
            place = dict(p.split("=", 1) for p in file.split("/") if "=" in p)
            # a row's day is that of completed_at wherever it has one; open jobs have none
            in_time = self.days == ("", "~") or place["area"] == "open" or self.days[0] <= place["day"] <= self.days[1]
            if place["area"] in self.areas and in_time:
                out.append(JobFile(file))
        return out

    def read(self, partition: JobFile | None) -> Iterator[pa.RecordBatch]:
        return rows_of(self.path, partition, self.schema, self.keep)


class ChangeReader(DataSourceStreamReader):
    """Rows that batches changed. An offset is the number of the first batch that isn't read yet."""

    def __init__(self, path: str, schema: StructType, latest: bool) -> None:
        self.path, self.schema, self.latest = path, schema, latest

    def _numbers(self) -> list[int]:
        files, root = opened(f"{self.path}/changes")
        found = files.get_file_info(fs.FileSelector(root, allow_not_found=True))
        return sorted(int(x.base_name.removeprefix("batch=")) for x in found if x.base_name.startswith("batch="))

    def initialOffset(self) -> dict:
        found = self._numbers()
        return {"batch": (found[-1] + 1 if self.latest else found[0]) if found else 0}

    def latestOffset(self) -> dict:
        found = self._numbers()
        return {"batch": found[-1] + 1 if found else 0}

    def partitions(self, start: dict, end: dict) -> list[JobFile]:
        return [JobFile(x) for n in range(start["batch"], end["batch"]) for x in data_files(f"{self.path}/changes/batch={n}")]

    def read(self, partition: JobFile | None) -> Iterator[pa.RecordBatch]:
        return rows_of(self.path, partition, self.schema)


class JobSource(DataSource):
    """Options: path, the store's; from, for streams: earliest (all that the change log holds, the default) or latest."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return schemas.JOBS

    def _path(self) -> str:
        if not self.options.get("path"):
            raise ValueError("the option path has to name a store's folder")
        return self.options["path"].rstrip("/")

    def reader(self, schema: StructType) -> JobReader:
        return JobReader(self._path(), schema)

    def streamReader(self, schema: StructType) -> ChangeReader:
        start = self.options.get("from", "earliest")
        if start not in ("earliest", "latest"):
            raise ValueError(f"from is earliest or latest, not {start}")
        return ChangeReader(self._path(), schema, start == "latest")


def register(spark: SparkSession) -> None:
    """Make the format known to a session, with filters pushed down to it."""
    spark.dataSource.register(JobSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
