"""WARC archives: a writer of one gzip member a record, and a splittable reader.

Writing goes through Spark's own file writer, so task retries and lost executors leave no
half-written archive. Reading deals out byte ranges: a task looks for gzip magic in its range,
accepts a candidate when what it decodes to starts as a WARC header and other members follow it
without a gap, and owns the records that start inside its range, reading past the end of the
range to finish the last one.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch, table

#: Equal payloads of fewer bytes are all written in full.
REVISIT_BYTES = 100
#: Bytes of an archive that one reading task scans.
SPLIT_BYTES = 8 << 20
READ_BYTES = 1 << 18
#: Ranges are dealt out over at most so many tasks for each core.
TASKS_A_CORE = 64
#: The longest run of bytes that a deflate stream can hold as they are. A member that lies within
#: another one's data is cut there at the latest, and so are members that follow it.
STORED_BYTES = 65_535
MAGIC = b"\x1f\x8b\x08"
ID_PREFIX = "urn:record:"
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def encode_record(record_id: str | None, url: str | None, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    """One gzip member with one record; its last byte is 0, which Spark's text writer adds as line end."""
    revisit = refers_to is not None
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        *([f"WARC-Record-ID: <{ID_PREFIX}{quote(record_id, safe='')}>"] if record_id is not None else []),
        f"WARC-Date: {DATE}",
        *([f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~')}"] if url is not None else []),
        f"WARC-Payload-Digest: sha256:{digest}",
        *([f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{ID_PREFIX}{quote(refers_to, safe='')}>"] if revisit else []),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    pack = zlib.compressobj(4, zlib.DEFLATED, 31)
    member = pack.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + pack.flush()
    if member[-1]:  # only past 16 MiB; an empty member ends with the 0 that is wanted
        pack = zlib.compressobj(4, zlib.DEFLATED, 31)
        member += pack.flush()
    return member[:-1]


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", body_col: str = "html") -> None:
    """Write a record for each row of pages to archives under path.

    Of rows with equal payloads of at least REVISIT_BYTES bytes the one with the smallest id is
    a response and the others revisit it; smaller payloads are all responses, and so are rows
    without an id, and all rows that share the smallest id. A null body is an empty payload; a
    null url leaves its header out. No pages give no records. Other columns are left out.
    """
    rows = pages.select(
        F.col(f"`{id_col}`").cast("bigint").alias("id"),
        F.col(f"`{url_col}`").cast("string").alias("url"),
        F.coalesce(F.col(f"`{body_col}`").cast("string"), F.lit("")).cast("binary").alias("payload"),
    ).withColumn("digest", F.sha2("payload", 256))
    first = (
        rows.filter(F.octet_length("payload") >= REVISIT_BYTES)
        .groupBy(F.col("digest").alias("d"))
        .agg(F.min("id").alias("first_id"), F.count("id").alias("n"))
        .filter("n > 1")
        .select("d", "first_id")
    )
    known = rows.join(first, F.col("digest") == F.col("d"), "left").select("id", "url", "payload", "digest", F.expr("case when id > first_id then first_id end").alias("refers_to"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = lambda x: None if x is None else str(x)
            out = [encode_record(text(r["id"]), r["url"], r["payload"], r["digest"], text(r["refers_to"])) for r in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["member"])

    # a cast to string keeps the bytes as they are
    known.mapInArrow(encode, "member binary").select(F.col("member").cast("string").alias("value")).write.option("lineSep", "\0").option("compression", "none").text(path)


def _opened(path: str) -> pa.NativeFile:
    path = re.sub(r"^file:/+", "file:///", path)
    path = re.sub(r"^s3[an]:", "s3:", path)
    fs, inner = pafs.FileSystem.from_uri(path)
    return fs.open_input_file(unquote(inner) if path.startswith("file:") else inner)


def _member(f: pa.NativeFile, at: int, ahead: bytes) -> tuple[bytes | None, int]:
    """The member that starts at a byte of f, and its length. Without one: None and 0, or -1 where the file ends within it."""
    unpack = zlib.decompressobj(31)
    try:
        out = [unpack.decompress(ahead[:4096], 64)]
        if not out[0].startswith(b"WARC/1."):
            return None, 0
        read, feed = min(len(ahead), 4096), unpack.unconsumed_tail
        out.append(unpack.decompress(feed))
        while not unpack.eof:
            more = ahead[read : read + READ_BYTES]
            if not more:
                f.seek(at + read)
                more = f.read(READ_BYTES)
            if not more:
                return None, -1
            read += len(more)
            out.append(unpack.decompress(more))
    except zlib.error:
        return None, 0
    return b"".join(out), read - len(unpack.unused_data)


def _goes_on(f: pa.NativeFile, begin: int, end: int) -> bool:
    """Do members follow [begin, end) without a gap, further than they could within another member?

    Where the file breaks off within one of them, its members from the start on tell.
    """
    size = f.size()
    while end < size and end - begin <= STORED_BYTES:
        f.seek(end)
        _, length = _member(f, end, f.read(READ_BYTES))
        if length < 0:
            return any(at == begin for at, _ in members(f, 0, begin + 1))
        if not length:
            return False
        end += length
    return True


def members(f: pa.NativeFile, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(offset, decoded bytes) of the members that start in [start, end).

    A member that lies as it is within another one's data is none of the file's. From such a
    one, as from any byte by chance, no row of members leads on for long.
    """
    at, base, data = start, start, b""
    sure = start == 0  # whether what is at this byte can be nothing but a member's start
    while at < end:
        if at - base > len(data) - 4096 or not data:
            f.seek(at)
            base, data = at, f.read(READ_BYTES + 4096)
        found = data.find(MAGIC, at - base)
        if found < 0:
            if len(data) < READ_BYTES + 4096:
                return
            sure, at = False, base + len(data) - len(MAGIC) + 1
            data = b""
            continue
        sure = sure and base + found == at
        at = base + found
        if at >= end:
            return
        if found > len(data) - 4096:
            f.seek(at)
            base, data, found = at, f.read(READ_BYTES + 4096), 0
        raw, length = _member(f, at, data[found:])
        if sure and length < 0:
            return  # all that is left belongs to a member that the file breaks off in
        if raw is None or not sure and not _goes_on(f, at, at + length):
            sure, at = False, at + 1
            continue
        yield at, raw
        sure, at = True, at + length


def parse_record(raw: bytes) -> dict:
    """Fields of a decoded record; the payload of a revisit is None."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode().split("\r\n")[1:])}
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = re.search(rb"(?im)^content-length: *(\d+)", http)
    ident = lambda x: unquote(x.strip("<>").removeprefix(ID_PREFIX)) if x is not None else None
    response = fields["warc-type"] == "response"
    return {
        "record_type": fields["warc-type"],
        "record_id": ident(fields.get("warc-record-id")),
        "url": fields.get("warc-target-uri"),
        "refers_to": ident(fields.get("warc-refers-to")),
        "payload_bytes": len(payload) if response else int(length[1]),
        "payload_digest": hashlib.sha256(payload).hexdigest() if response else fields["warc-payload-digest"].removeprefix("sha256:"),
        "intact": not response or fields["warc-payload-digest"] == "sha256:" + hashlib.sha256(payload).hexdigest(),
        "payload": payload if response else None,
    }


RECORD = "path string, offset bigint, record_type string, record_id string, url string, refers_to string, payload_bytes bigint, payload_digest string, intact boolean"


def read_warc(spark: SparkSession, path: str, with_payload: bool = True, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """The records of all archives under path; payload_digest is computed from what was read.

    Archives have a gzip member for each record, one after another. Ranges are dealt out evenly
    over as many tasks as there are ranges, or TASKS_A_CORE for each core. Empty files, and empty
    archives, give no rows; what is damaged is passed over up to the next member.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "length")
    count = files.agg(F.sum(F.expr(f"greatest(ceil(length / {split_bytes}), 1)"))).first()[0] or 1
    tasks = int(min(count, TASKS_A_CORE * spark.sparkContext.defaultParallelism))
    ranges = files.select("path", F.explode(F.expr(f"sequence(0L, greatest(length - 1, 0), {split_bytes}L)")).alias("start"))
    schema = RECORD + (", payload binary" if with_payload else "")
    fields = [x.split()[0] for x in schema.split(", ")]
    kinds = {"string": pa.string(), "bigint": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}
    arrow = pa.schema([(n, kinds[k]) for n, k in (x.split() for x in schema.split(", "))])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                with _opened(r["path"]) as f:
                    rows, size = [], 0
                    for at, raw in members(f, r["start"], r["start"] + split_bytes):
                        row = parse_record(raw) | {"path": r["path"], "offset": at}
                        rows.append({k: row[k] for k in fields})
                        size += len(raw) if with_payload else 0
                        if len(rows) >= 2000 or size > 1 << 24:
                            yield pa.RecordBatch.from_pylist(rows, arrow)
                            rows, size = [], 0
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, arrow)

    return ranges.repartition(tasks).mapInArrow(scan, schema)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives of all pages, written to the shared folder and read back."""
    path = scratch(spark, "warc")
    write_warc(table(spark, sf_dir, "pages"), path)
    got = read_warc(spark, path, with_payload=False)
    return got.select(F.col("record_id").cast("bigint").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("bigint").alias("refers_to"))


OP5_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS d FROM pages
), f AS (
  SELECT *, min(page_id) OVER (PARTITION BY d) AS first_id FROM p
)
SELECT page_id, n AS payload_bytes, d AS payload_digest,
       CASE WHEN n >= 100 AND page_id > first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND page_id > first_id THEN first_id END AS refers_to
FROM f
"""
