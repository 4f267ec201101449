"""Document fingerprints of closed syncmers.

A k-mer of code points is chosen when the smallest hash among its inner substrings lies at its
first or last place. That depends on the k-mer alone, so an edit elsewhere never changes the
choice. A fingerprint holds all chosen k-mers, whatever the text's length, and where each stands;
two fingerprints are alike as far as they share k-mers along one diagonal.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mixed, shuffle_width, table

#: Code points of a k-mer and of its inner substrings (their difference is a power of two).
K, S = 24, 8
#: Code points by which shared anchors may leave the common diagonal.
SLACK = 48
BLOCK = 1 << 18
#: Bytes of fingerprints that a task gathers before it hands them on.
FLUSH = 1 << 23
#: An anchor in a fingerprint: its hash, and how far it stands from the one before (at most K - S).
ANCHOR = np.dtype([("hash", ">u4"), ("step", "u1")])
P = 0x9E3779B97F4A7C15
LOWEST = -(1 << 63)


Anchors = tuple[np.ndarray, np.ndarray]


def _block_syncmers(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (32 bits) and positions of the closed syncmers of some code points."""
    h = (points.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    width = 1
    while width < S:
        h = h[:-width] * np.uint64(pow(P, width, 1 << 64)) + h[width:]
        width *= 2
    kmer = h[: len(h) - 2 * S] * np.uint64(pow(P, 2 * S, 1 << 64)) + h[S : len(h) - S] * np.uint64(pow(P, S, 1 << 64)) + h[2 * S :]
    small = mixed(h)
    least, width = small, 1
    while width < K - S:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    least = np.minimum(least[:-1], small[K - S :])
    at = np.flatnonzero((small[: len(least)] == least) | (small[K - S :] == least))
    return (mixed(kmer[at]) >> np.uint64(32)).astype(np.uint32), at


def syncmers(text: str) -> Anchors:
    """The hashes and positions of all closed syncmers of the whole text, in order of position."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    if len(points) < K:
        if not len(points):
            return np.empty(0, np.uint32), np.empty(0, np.int64)
        whole = int.from_bytes(hashlib.blake2b(points.tobytes(), digest_size=4).digest())
        return np.array([whole], np.uint32), np.zeros(1, np.int64)
    found = [(h, at + lo) for lo in range(0, len(points) - K + 1, BLOCK) for h, at in [_block_syncmers(points[lo : lo + BLOCK + K - 1])]]
    return np.concatenate([h for h, _ in found]), np.concatenate([at for _, at in found])


def to_text(anchors: Anchors) -> str:
    """A fingerprint: base64 of 4 bytes of hash and 1 byte of distance from the last, for each anchor.

    Every K - S k-mers in a row have a closed syncmer among them, so no distance is larger.
    """
    rows = np.empty(len(anchors[0]), ANCHOR)
    rows["hash"], rows["step"] = anchors[0], np.diff(anchors[1], prepend=0)
    return base64.b64encode(rows.tobytes()).decode()


def from_text(fingerprint: str) -> Anchors:
    """The reverse of to_text()."""
    rows = np.frombuffer(base64.b64decode(fingerprint), ANCHOR)
    return rows["hash"].astype(np.uint32), np.cumsum(rows["step"], dtype=np.int64)


def likeness(a: Anchors, b: Anchors) -> float:
    """Twice the shared anchors over all anchors of both (1 for two empty texts).

    Distinct hashes count, each where it stands first, and as shared along one diagonal.
    """
    if not len(a[0]) or not len(b[0]):
        return float(len(a[0]) == len(b[0]))
    (ha, ia), (hb, ib) = (np.unique(x[0], return_index=True) for x in (a, b))
    shared, i, j = np.intersect1d(ha, hb, assume_unique=True, return_indices=True)
    if not len(shared):
        return 0.0
    shift = np.sort(a[1][ia[i]] - b[1][ib[j]])
    on = np.searchsorted(shift, shift + SLACK, "right") - np.arange(len(shift))
    share = on.max() / (len(ha) + len(hb) - len(shared))
    return float(2 * share / (1 + share))


def fingerprints(df: DataFrame, text_col: str = "text") -> DataFrame:
    """df with fingerprint, of each whole text: no shuffle. Null and empty texts have an empty one.

    Other columns pass through; a column named fingerprint is replaced. Equal texts have equal
    fingerprints; repeated rows stay. An empty df gives no rows.
    """
    rest = [c for c in df.columns if c != "fingerprint"]
    at = rest.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made, size, lo = [], 0, 0
            for hi, x in enumerate(batch.column(at), 1):
                made.append(to_text(syncmers(x.as_py() or "")))
                size += len(made[-1])
                if size > FLUSH or hi == batch.num_rows:
                    yield pa.RecordBatch.from_arrays([*batch.slice(lo, hi - lo).columns, pa.array(made, pa.string())], [*batch.schema.names, "fingerprint"])
                    made, size, lo = [], 0, hi

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*(f"`{c}`" for c in rest)).schema)
    return df.select(*(f"`{c}`" for c in rest)).mapInArrow(run, f"{types}, fingerprint string")


def with_next(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None) -> DataFrame:
    """(dest, spare, id, text), dealt and sorted so that each row's successor by descending id follows it.

    Ids are cut into ranges at approximate quantiles, a partition each. The first document of a
    range is sent to the range before it as well, as a spare row at its end; the first of all
    goes to the last range. Only ids of ranges' first documents come to the driver.
    """
    spark = df.sparkSession
    docs = df.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    docs = docs.withColumn("key", F.coalesce("id", F.lit(LOWEST)))
    n = partitions or shuffle_width(spark)
    found = docs.select(F.percentile_approx("key", [k / n for k in range(1, n)] or [0.5], 100 * n)).first()[0] or []
    edges = np.unique(np.array(found, np.int64))
    sent = spark.sparkContext.broadcast(edges)

    @F.pandas_udf("int")
    def range_of(key: pd.Series) -> pd.Series:
        return pd.Series(len(sent.value) - np.searchsorted(sent.value, key.to_numpy(np.int64), "left"), dtype="int32")

    ranges = docs.select(range_of("key").alias("r"), "key").groupBy("r").agg(F.max("key")).collect()
    first = dict(sorted(map(tuple, ranges)))
    order = list(first)
    before = {first[r]: order[k - 1] for k, r in enumerate(order)}  # the first of all goes to the last range
    heads = spark.sparkContext.broadcast((np.array(sorted(before), np.int64), np.array([before[k] for k in sorted(before)], np.int32)))

    @F.pandas_udf("int")
    def spare_for(key: pd.Series) -> pd.Series:
        keys, to = heads.value
        k = np.minimum(np.searchsorted(keys, key.to_numpy(np.int64)), len(keys) - 1)
        return pd.Series(np.where(keys[k] == key.to_numpy(np.int64), to[k], -1), dtype="int32")

    rows = docs.withColumns({"own": range_of("key"), "other": spare_for("key")})
    both = rows.select("id", "key", "text", F.explode(F.expr("filter(array(named_struct('dest', own, 'spare', false), named_struct('dest', other, 'spare', true)), x -> x.dest >= 0)")).alias("to"))
    flat = both.select(F.col("to.dest").alias("dest"), F.col("to.spare").alias("spare"), "id", "key", "text")
    return flat.repartitionById(len(edges) + 1, F.col("dest")).sortWithinPartitions("dest", "spare", F.desc("key"), "text").drop("key")


EDITED = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of with_next() -> each document against its edited text and against its successor."""
    names = [x.split()[0] for x in EDITED.split(", ")]
    prior: tuple[int, int | None, str, Anchors] | None = None

    def row(doc_id: int | None, text: str, own: Anchors, after: str, other: Anchors) -> tuple:
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        marks = own if edited == text else syncmers(edited)
        return doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), to_text(own), to_text(marks), likeness(own, marks), likeness(own, other)

    def packed(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c) if i else pa.array(c, pa.int64()) for i, c in enumerate(zip(*out, strict=True))], names)

    for batch in batches:
        out, size = [], 0
        for dest, spare, doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if prior is None and spare:
                continue  # a second spare row, of a repeated id
            own = syncmers(text)
            if prior is not None:
                out.append(row(*prior[1:], text, own))
                size += len(out[-1][3]) + len(out[-1][4])
                if size > FLUSH:
                    yield packed(out)
                    out, size = [], 0
            prior = None if spare else (dest, doc_id, text, own)
        if out:
            yield packed(out)


def compare_with_edited(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None) -> DataFrame:
    """Fingerprints of each document and of its edited text, and how alike they are.

    The edited text has its last floor(n / 2) code points replaced by as many first ones (or
    all) of the next document by descending id; after the last comes the first, and a lone
    document follows itself. Null texts are empty; null ids come last; rows that share an id
    follow each other in order of text. A text of fewer than K code points has one anchor, the
    hash of all of it. One document with its successor is in memory at a time, and all rows of
    one id are in one task. Other columns are left out. An empty df gives no rows.
    """
    return with_next(df, id_col, text_col, partitions).mapInArrow(_compare, EDITED)


def op3_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' fingerprints, against their edited texts and the next documents."""
    return compare_with_edited(table(spark, sf_dir, "documents"))
