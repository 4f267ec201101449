"""What the operators of this package share: reading, checkpoints and Arrow text buffers."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A supplied table by its name."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_width(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; in local mode, where none is set, a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        found = getattr(spark, "_jobloom_shared", None) or f"file://{tempfile.mkdtemp(prefix='jobloom-')}"
        spark._jobloom_shared = found
    return found


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's path below the shared one; what lies there goes when the application ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    file = spark._jvm.org.apache.hadoop.fs.Path(path)
    file.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(file)
    return path


def saved(df: DataFrame, name: str = "step") -> DataFrame:
    """The same rows as a written table in the shared folder: lineage ends there, and lost executors cost no more than their tasks."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._jobloom_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table of saved() that nothing will read again."""
    spark = df.sparkSession
    file = spark._jvm.org.apache.hadoop.fs.Path(df._jobloom_path)
    file.getFileSystem(spark._jsc.hadoopConfiguration()).delete(file, True)


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts of an Arrow column and their n + 1 offsets; null reads as empty."""
    if column.type not in (pa.string(), pa.large_string(), pa.binary(), pa.large_binary()):
        raise TypeError(f"text or binary expected, got {column.type}")
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = column.type in (pa.large_string(), pa.large_binary())
    _, offsets, values = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(values, np.uint8)[at[0] : at[-1]] if values is not None and len(column) else np.empty(0, np.uint8)
    return data, at - at[0]


def from_buffer(data: bytes, at: np.ndarray, kind: pa.DataType) -> pa.Array:
    """The reverse of text_buffer(): an Arrow column over one run of bytes."""
    wide = kind in (pa.large_string(), pa.large_binary())
    return pa.Array.from_buffers(kind, len(at) - 1, [None, pa.py_buffer(at.astype(np.int64 if wide else np.int32).tobytes()), pa.py_buffer(data)])


def mixed(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x
