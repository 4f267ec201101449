"""Exact dedup by content sort.

Sampled splitters range-partition the normalised bytes, each partition is sorted
(externally, by Spark), and neighbours are compared in full. Rows are ordered by the first
bytes, then by digest, so equal texts are neighbours however long they are. The splitters
include the row's id, so a text that a third of all rows share is spread over several
partitions; the few groups that touch a partition's edge are then joined up by digest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import from_buffer, saved, shuffle_width, table, text_buffer

#: Leading bytes of a normalised text that take part in the splitters.
SPLIT_BYTES = 48
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def _normalise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last column becomes its A-Z lower-cased UTF-8, null becoming empty, and its digest follows."""
    for batch in batches:
        data, at = text_buffer(batch.column(batch.num_columns - 1))
        low = data.tobytes().translate(LOWER)
        norm = from_buffer(low, at, pa.large_binary()).cast(pa.binary())
        digest = pa.array([hashlib.sha256(low[a:b]).hexdigest() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], pa.string())
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], norm, digest], [*batch.schema.names[:-1], "norm", "text_sha256"])


def _neighbours(batches: Iterator[pa.RecordBatch], row_key: int) -> Iterator[pa.RecordBatch]:
    """Rows in content order -> their run of equal texts, by full comparison of neighbours.

    A run's rows are held until it ends; a partition bounds them.
    """
    names: list[str] = []
    held: list[pa.RecordBatch] = []  # rows of the run that is open
    last: pa.Scalar | None = None
    first_run = True

    def closed(rows: list[pa.RecordBatch], edge: bool) -> Iterator[pa.RecordBatch]:
        rows = [x for x in rows if x.num_rows]
        size, keep, kind = sum(x.num_rows for x in rows), rows[0].column(row_key)[0].as_py(), rows[0].column(row_key).type
        for i, x in enumerate(rows):
            n = x.num_rows
            first = np.zeros(n, bool)
            first[0] = i == 0
            yield pa.RecordBatch.from_arrays([*x.columns, pa.array([keep] * n, kind), pa.array(np.full(n, size)), pa.array(first), pa.array(np.full(n, edge))], [*names, "run_keep", "run_size", "first", "edge"])

    for batch in batches:
        if not batch.num_rows:
            continue
        names = [x for x in batch.schema.names if x != "norm"]
        norm, rest = batch.column(batch.schema.get_field_index("norm")), batch.select(names)
        same = np.zeros(len(norm), bool)
        same[1:] = pc.equal(norm[1:], norm[:-1]).to_numpy(zero_copy_only=False)
        same[0] = last is not None and norm[0].as_py() == last
        starts = np.flatnonzero(~same)
        if not len(starts):
            held.append(rest)
            continue
        if held or starts[0]:
            yield from closed([*held, rest.slice(0, starts[0])], first_run)
            first_run = False
        ends = starts[1:]
        inner = starts[:-1]
        if len(inner):
            # the runs that begin and end in this batch, at once
            lo, size = inner, ends - inner
            of = np.repeat(np.arange(len(inner)), size)
            part = rest.slice(lo[0], ends[-1] - lo[0])
            ids = part.column(row_key)
            edge = np.zeros(len(inner), bool)
            edge[0], first_run = first_run, False
            row = np.arange(len(part))
            yield pa.RecordBatch.from_arrays(
                [*part.columns, ids.take(pa.array(lo[of] - lo[0])), pa.array(size[of]), pa.array(row == (lo - lo[0])[of]), pa.array(edge[of])],
                [*names, "run_keep", "run_size", "first", "edge"],
            )
        held, last = [rest.slice(starts[-1])], norm[int(starts[-1])].as_py()
    if held:
        yield from closed(held, True)


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry_text: bool = True, partitions: int | None = None) -> DataFrame:
    """Every row of df with keep_id, group_size, kept and text_sha256 of its group of equal texts.

    Texts are equal when identical after lower-casing A-Z; null equals empty. The row with the
    largest id of a group is kept; null ids count as smallest. Of rows alike in id and text, one
    is kept. Other columns pass through; columns of df that have the names of results are
    replaced. Without carry_text the text itself is left out of the result, and out of the shuffle
    but for its normalised form. An empty df gives no rows.
    """
    made = ["keep_id", "group_size", "kept", "text_sha256"]
    rest = [c for c in df.columns if c not in made and (carry_text or c != text_col)]
    # positional names inside, so that no column of df can clash with a helper
    inner = {c: f"c{i}" for i, c in enumerate(rest)}
    row_id = inner[id_col]
    n = partitions or shuffle_width(df.sparkSession)
    plain = df.select(*(F.col(f"`{c}`").alias(inner[c]) for c in rest), F.col(f"`{text_col}`").cast("string").alias("norm"))
    types = ", ".join(f"{inner[f.name]} {f.dataType.simpleString()}" for f in df.schema if f.name in inner)
    rows = plain.mapInArrow(_normalise, f"{types}, norm binary, text_sha256 string").withColumn("head", F.substring("norm", 1, SPLIT_BYTES))
    order = ["head", "text_sha256", F.desc_nulls_last(row_id)]
    dealt = rows.repartitionByRange(n, *order).sortWithinPartitions("head", "text_sha256", "norm", order[-1])
    key = list(inner.values()).index(row_id)
    id_type = df.schema[id_col].dataType.simpleString()
    runs = dealt.drop("head").mapInArrow(
        lambda b: _neighbours(b, key), f"{types}, text_sha256 string, run_keep {id_type}, run_size bigint, first boolean, edge boolean"
    )
    runs = saved(runs, "exact")
    # two runs of a partition touch its edges at most
    edges = runs.filter("edge and first").groupBy(F.col("text_sha256").alias("edge_sha")).agg(F.max("run_keep").alias("edge_keep"), F.sum("run_size").alias("edge_size"))
    joined = runs.join(edges, F.col("edge") & (F.col("text_sha256") == F.col("edge_sha")), "left")
    keep = F.when(F.col("edge"), F.col("edge_keep")).otherwise(F.col("run_keep"))
    return joined.select(
        *(F.col(inner[c]).alias(c) for c in rest),
        keep.alias("keep_id"),
        F.when(F.col("edge"), F.col("edge_size")).otherwise(F.col("run_size")).alias("group_size"),
        (F.col("first") & F.col("run_keep").eqNullSafe(keep)).alias("kept"),
        "text_sha256",
    )


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact dedup of all documents: one row for each document, dropped ones too."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return exact_dedup(docs, carry_text=False).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP9_SQL = """
WITH d AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents
)
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY norm) AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY norm) AS kept,
       sha256(norm) AS text_sha256
FROM d
"""
