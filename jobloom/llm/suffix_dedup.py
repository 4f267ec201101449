"""Removal of long repeated byte strings with run-length indexes.

Every string of LEAST bytes holds an anchor, the k-mer with the smallest hash of all that the
string contains, and equal strings hold it at the same place. So only text around anchors that
occur twice can repeat. That text is dealt out by the anchor's owner, of the texts that
have it the one with the smallest digest; where an owner has very much of it, by the anchor as
well. Each task builds run-length indexes of what it gets, streams the matching statistics and
marks what also starts earlier. A heavy owner's fragments are cut at places that their content
decides, and of those with equal bytes only the earliest is indexed: all of the others starts
earlier there. Tasks settle that among their own fragments first, so a passage that all documents
share leaves each of them with a span or two, and the group with what differs. Where what is left of a group is more than a task should hold, as with a passage that
a third of all documents share and vary, its strings are settled by 128-bit digests in place of
an index: they are counted in tasks first, so no task gets a whole group, and the work grows with
the group's bytes. Copies of a whole text are told by digest and aren't indexed again.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mixed, saved, table, text_buffer
from .run_index import STOP, earlier_copies

#: Bytes of a string that is removed where it repeats, and bytes of an anchor.
LEAST, K = 100, 32
BLOCK = 1 << 15
#: Bytes of text that are indexed together, unless one group has more; an order of more suffixes costs more for each.
CHUNK = 1 << 17
#: Anchors of one owner from which on its fragments are cut by content, and equal ones indexed once.
HEAVY_ANCHORS = 20_000
#: Anchors of one owner from which on they are dealt out apart.
OWNER_ANCHORS = 200_000
#: Bytes of different fragments of one group from which on digests settle it.
BLOCK_BYTES = 1 << 21
#: Of so many anchors one is a place where fragments are cut.
CUT_EVERY = 8
#: A document's place in the order: is its id known (null ids come first), its id, its digest.
KEY = ("known", "d", "tie", "lo")
#: Neighbouring string starts that travel as the bits of one number.
BITS = 64


def anchors(data: np.ndarray, at: np.ndarray, least: int = LEAST, k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """Positions in data, and hashes, of the anchors of all strings of least bytes within texts.

    at holds the texts' n + 1 offsets.
    """
    w = least - k + 1
    places, hashes = [], []
    for lo in range(0, len(data), BLOCK):
        part = data[lo : lo + BLOCK + least - 1]
        if len(part) < least:
            break
        h, width = (part.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93), 1
        h ^= h >> np.uint64(29)
        while width < k:
            h = h[:-width] * np.uint64(pow(0x9E3779B97F4A7C15, width, 1 << 64)) + h[width:]
            width *= 2
        h = mixed(h)
        low = (h & ~np.uint64((1 << 20) - 1)) | np.arange(len(h), dtype=np.uint64)
        width = 1
        while 2 * width <= w:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        low = np.minimum(low[: len(part) - least + 1], low[w - width :])
        inside = np.ones(len(low), bool)
        for end in at[np.searchsorted(at, lo, "right") : np.searchsorted(at, lo + len(part))].tolist():
            inside[max(0, end - least + 1 - lo) : end - lo] = False
        low = low[inside]
        if not len(low):
            continue
        low = low[np.append(True, low[1:] != low[:-1])]
        i = np.unique((low & np.uint64((1 << 20) - 1)).astype(np.int64))
        places.append(i + lo)
        hashes.append(h[i])
    if not places:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    place, first = np.unique(np.concatenate(places), return_index=True)
    return place, np.concatenate(hashes)[first]


def _digest(text: bytes) -> tuple[int, int]:
    d = hashlib.blake2b(text, digest_size=16).digest()
    return int.from_bytes(d[:8], signed=True), int.from_bytes(d[8:], signed=True)


def _tie(high: int) -> int:
    """What orders texts that share an id, from the digest's first half; its other half comes after."""
    return high


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text) -> (h, tie, pos) for each anchor."""
    for batch in batches:
        data, at = text_buffer(batch.column(0))
        ids = np.array([_tie(_digest(data[a:b].tobytes())[0]) for a, b in zip(at[:-1], at[1:], strict=True)], np.int64)
        lo = 0
        while lo < len(ids):  # some texts at a time, to bound memory
            hi = max(lo + 1, int(np.searchsorted(at, at[lo] + (4 << 20), "right")) - 1)
            place, h = anchors(data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo])
            row = np.searchsorted(at, place + at[lo], "right") - 1
            yield pa.RecordBatch.from_pydict({"h": h.view(np.int64), "tie": ids[row], "pos": place + at[lo] - at[row]})
            lo = hi


def _packed_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(known, d, text) -> (known, d, tie, lo, n, z): digests, and the text compressed for the shuffle."""
    pack = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        data, at = text_buffer(batch.column(2))
        raw = [data[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
        hi, lo = zip(*map(_digest, raw), strict=True) if raw else ((), ())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(map(_tie, hi), pa.int64()), pa.array(lo, pa.int64()), pa.array(np.diff(at)), pa.array(map(pack.compress, raw), pa.binary())],
            [*KEY, "n", "z"],
        )


def _fragment_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(known, d, tie, lo, n, z, m, marks) -> the text around each owner's anchors, and for heavy ones its digest.

    Of heavy owners' fragments that are held together and equal, the earliest goes on; the others
    become spans, rows without bytes, in which neighbours are one.
    Should two texts ever share a tie, marks has the anchors of both, and so some text that
    needn't be looked at.
    """
    unpack = zstandard.ZstdDecompressor()
    for batch in batches:
        keys = list(zip(*(c.to_pylist() for c in batch.columns[:4]), strict=True))
        row, (owner, part, pos) = pc.list_parent_indices(batch.column(7)).to_numpy(), _mark_columns(batch.column(7))
        by = np.lexsort((pos, part, owner, row))
        row, owner, part, pos = row[by], owner[by], part[by], pos[by]
        begin, end = np.maximum(0, pos - LEAST + K), np.minimum(batch.column(4).to_numpy()[row], pos + LEAST)
        # text around neighbours of one owner and part is one fragment where it touches
        new = (row[1:] != row[:-1]) | (owner[1:] != owner[:-1]) | (part[1:] != part[:-1]) | (begin[1:] > end[:-1])
        first = np.flatnonzero(np.append(np.ones(min(1, len(row)), bool), new))
        last = np.append(first[1:], len(row)) - 1 if len(first) else first
        out: list[tuple] = []
        size, held, text = 0, None, b""
        for i, j, r, *group, a, b in zip(*(x.tolist() for x in (first, last, row[first], owner[first], part[first], begin[first], end[last])), strict=True):
            if r != held:
                if size > 1 << 22:
                    yield _batch(_settled_here(out), FRAGMENT)
                    out, size = [], 0
                held, text = r, unpack.decompress(batch.column(5)[r].as_py())
            if a >= b:
                continue
            if group[1] < 0:
                out.append((*group, *keys[r], a, b, 0, 0, text[a:b]))
                size += b - a
                continue
            # content decides the cuts, and pieces overlap by all but one byte of a string
            cuts = [p for p in pos[i : j + 1].tolist() if a < p and zlib.crc32(text[p : p + K]) % CUT_EVERY == 0]
            for lo, hi in zip([a, *cuts], [*cuts, b], strict=True):
                piece = text[lo : min(b, hi + LEAST - 1)]
                out.append((*group, *keys[r], lo, lo + len(piece), *_digest(piece), piece))
                size += len(piece)
        if out:
            yield _batch(_settled_here(out), FRAGMENT)


def _mark_columns(marks: pa.ListArray) -> list[np.ndarray]:
    """owner, part and pos of all marks."""
    flat = pc.list_flatten(marks)
    return [flat.field(x).to_numpy() for x in ("owner", "part", "pos")]


def _settled_here(rows: list[tuple]) -> list[tuple]:
    """FRAGMENT rows, of which those of heavy owners that equal an earlier one of them become spans without bytes."""
    first: dict[tuple, tuple] = {}
    out, spans = [], []
    for row in rows:
        owner, part, *place = row[:7]
        if part < 0:
            out.append(row)
            continue
        # equal bytes of one owner and part; place is KEY and start
        name = (owner, part, row[8], row[9])
        other = first.setdefault(name, row)
        if other is not row:
            later = row
            if place < [*other[2:7]]:
                first[name], later = row, other
            if later[7] - later[6] >= LEAST:
                spans.append(later[2:8])
    merged: list[tuple] = []
    for span in sorted(spans):
        if merged and merged[-1][:4] == span[:4] and span[4] <= merged[-1][5]:
            merged[-1] = (*merged[-1][:5], max(merged[-1][5], span[5]))
        else:
            merged.append(span)
    return [*out, *first.values(), *((0, 0, *span, 0, 0, None) for span in merged)]


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


FRAGMENT = pa.schema([("owner", pa.int64()), ("part", pa.int64()), ("known", pa.bool_()), ("d", pa.int64()), ("tie", pa.int64()), ("lo", pa.int64()), ("start", pa.int64()), ("stop", pa.int64()), ("fp1", pa.int64()), ("fp2", pa.int64()), ("bytes", pa.binary())])
SPAN = pa.schema([("known", pa.bool_()), ("d", pa.int64()), ("tie", pa.int64()), ("lo", pa.int64()), ("start", pa.int64()), ("stop", pa.int64())])


def repeated_spans(fragments: list[tuple[bool, int, int, int, int, bytes]], least: int = LEAST) -> list[tuple[bool, int, int, int, int, int]]:
    """Fragments (*KEY, start, bytes) of texts -> spans (*KEY, start, stop) of their bytes that
    lie in a string of least bytes that also starts earlier in one of the fragments.

    Earlier means in a smaller KEY, or in the same at a smaller position.
    """
    text = np.frombuffer(b"".join(x for f in fragments for x in (f[-1], bytes([STOP]))), np.uint8)
    sizes = np.array([len(f[-1]) + 1 for f in fragments], np.int64)
    begin = np.cumsum(sizes) - sizes
    names = {x: i for i, x in enumerate(sorted({f[:4] for f in fragments}))}
    base = np.array([(names[f[:4]] << 40) + f[4] for f in fragments], np.int64) - begin
    key = np.arange(len(text)) + np.repeat(base, sizes)
    hit = earlier_copies(text, np.repeat(begin + sizes - 1, sizes), key, least)
    edge = np.diff(np.concatenate([[0], hit.view(np.int8), [0]]))
    out = []
    for a, b in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True):
        # a STOP is never marked, so a run lies in one fragment
        i = int(np.searchsorted(begin, a, "right")) - 1
        *key, start, _ = fragments[i]
        out.append((*key, start + a - int(begin[i]), start + b - 1 - int(begin[i]) + least))
    return out


def _span_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fragments sorted by group -> spans; whole groups are indexed together, about CHUNK bytes at a time."""
    held: list[tuple[bool, int, int, int, int, bytes]] = []
    size, last = 0, None
    for batch in batches:
        for owner, part, *at, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if size > CHUNK and (owner, part) != last:
                if held and (spans := repeated_spans(held)):
                    yield _batch(spans, SPAN)
                held, size = [], 0
            last = owner, part
            held.append((*at, data))
            size += len(data) + 1
    if held and (spans := repeated_spans(held)):
        yield _batch(spans, SPAN)


def _string_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(*KEY, start, bytes) -> (h1, h2, *KEY, start) for each string of LEAST bytes of the fragments."""
    for batch in batches:
        data, at = text_buffer(batch.column(5))
        begin, row, size = [], [], 0
        for i, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
            begin.append(np.arange(a, max(a, b - LEAST + 1)))
            row.append(np.full(len(begin[-1]), i))
            size += len(begin[-1])
            if size and (size > 1 << 16 or i == len(at) - 2):
                places, of = np.concatenate(begin), np.concatenate(row)
                raw = memoryview(data)
                h = np.frombuffer(b"".join(hashlib.blake2b(raw[x : x + LEAST], digest_size=16).digest() for x in places.tolist()), np.int64).reshape(-1, 2)
                key = [batch.column(k).take(pa.array(of)) for k in range(len(KEY))]
                start = batch.column(4).to_numpy()[of] + places - at[of]
                yield pa.RecordBatch.from_arrays([pa.array(h[:, 0]), pa.array(h[:, 1]), *key, pa.array(start)], ["h1", "h2", *KEY, "start"])
                begin, row, size = [], [], 0


def _bit_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(*KEY, base, bits) -> spans of the strings that start at base + i for each bit i."""
    for batch in batches:
        bits = np.unpackbits(np.ascontiguousarray(batch.column(5).to_numpy()).view(np.uint8), bitorder="little").reshape(-1, BITS)
        edge = np.diff(np.pad(bits.astype(np.int8), ((0, 0), (1, 1))))
        (row, begin), (_, end) = np.nonzero(edge == 1), np.nonzero(edge == -1)
        base = batch.column(4).to_numpy()[row] * BITS
        key = [batch.column(i).take(pa.array(row)) for i in range(len(KEY))]
        yield pa.RecordBatch.from_arrays([*key, pa.array(base + begin), pa.array(base + end - 1 + LEAST)], schema=SPAN)


def _settled_by_digest(fragments: DataFrame) -> DataFrame:
    """Fragments (*KEY, start, bytes) of any number -> SPAN rows of their strings that also start earlier in one of them."""
    place = [*KEY, "start"]
    types = "known boolean, d bigint, tie bigint, lo bigint"
    strings = fragments.select(*place, "bytes").mapInArrow(_string_rows, f"h1 bigint, h2 bigint, {types}, start bigint")
    first = strings.groupBy("h1", "h2").agg(F.count("*").alias("c"), F.min(F.struct(*place)).alias("at")).filter("c > 1")
    later = strings.join(first, ["h1", "h2"]).filter(F.struct(*place) > F.col("at"))
    held = later.groupBy(*KEY, F.expr(f"start div {BITS}").alias("base")).agg(F.expr(f"bit_or(shiftleft(1L, cast(start % {BITS} AS int)))").alias("bits"))
    return held.mapInArrow(_bit_spans, f"{types}, start bigint, stop bigint")


RESULT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("removed", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), ("kept", pa.binary())])


def _kept_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(known, d, n, z, m, own, spans) -> m results; of rows alike one counts as first.

    own isn't null where the text is no copy of one with a smaller id.
    """
    unpack = zstandard.ZstdDecompressor()

    def result(d: int | None, n: int, text: bytes, spans: list[tuple[int, int]]) -> tuple:
        merged: list[tuple[int, int]] = []
        for a, b in sorted(spans):
            if merged and a <= merged[-1][1]:
                merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
            else:
                merged.append((a, b))
        at, parts = 0, []
        for a, b in merged:
            parts.append(text[at:a])
            at = b
        kept = b"".join([*parts, text[at:]])
        return (d, n, sum(b - a for a, b in merged), len(merged), hashlib.sha256(kept).hexdigest(), [{"start": a, "stop": b} for a, b in merged], kept)

    for batch in batches:
        out: list[tuple] = []
        size = 0
        for known, d, n, z, m, own, spans in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            text, d = unpack.decompress(z), d if known else None
            first = result(d, n, text, [(s["start"], s["stop"]) for s in spans or ()]) if own else None
            copy = result(d, n, text, [(0, n)] if n >= LEAST else []) if m > 1 or not own else None
            for k in range(m):
                out.append(copy if k or not own else first)
                size += len(out[-1][-1]) + 200
                if size > 1 << 23:
                    yield _batch(out, RESULT)
                    out, size = [], 0
        if out:
            yield _batch(out, RESULT)


def suffix_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, removed, kept) of every document.

    Removed is each byte that lies in a string of LEAST bytes, within one text's UTF-8, that
    also starts earlier: in a document with a smaller id, or earlier in the same. Strings are
    judged on the input. removed lists the maximal runs and kept has the other bytes. Null texts
    are empty; null ids come before all others. Texts that share
    an id are ordered by digest, and of rows alike in both one counts as first. Other columns
    are left out. An empty df gives no rows.
    """
    number = F.col(f"`{id_col}`").cast("bigint")
    docs = df.select(number.isNotNull().alias("known"), F.coalesce(number, F.lit(0)).alias("d"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    found = docs.select("text").mapInArrow(_anchor_rows, "h bigint not null, tie bigint not null, pos bigint not null")
    twice = found.groupBy("h").agg(F.count("tie").alias("c"), F.min("tie").alias("owner")).filter("c > 1")
    # part -1 has what isn't heavy; an owner of very many anchors is split by anchor, as finely as their number asks
    load = twice.groupBy("owner").agg(F.sum("c").alias("load")).filter(F.col("load") > HEAVY_ANCHORS)
    twice = twice.join(load, "owner", "left").select("h", "owner", F.expr(f"coalesce(pmod(h, load div {OWNER_ANCHORS} + 1), -1)").alias("part"))

    # keys that can't be null need no filter, so both joins read one and the same exchange of texts
    texts = docs.mapInArrow(_packed_rows, "known boolean not null, d bigint not null, tie bigint not null, lo bigint not null, n bigint, z binary")
    firsts = texts.groupBy("tie", "lo").agg(F.min("known").alias("known"), F.min("d").alias("d")).withColumn("d", F.when(F.col("known"), F.col("d")).otherwise(0))
    # rows alike in id and text become one with their number, wherever they come from
    key = [*KEY]
    rows = texts.groupBy(*key).agg(F.first("n").alias("n"), F.first("z").alias("z"), F.count("*").alias("m"))

    # copies of a text have the same anchors, which the set holds once
    marks = saved(found.join(twice, "h").groupBy("tie").agg(F.collect_set(F.struct("pos", "owner", "part")).alias("marks")), "marks")
    no_heavy = marks.filter(F.exists("marks", lambda m: m["part"] >= 0)).isEmpty()
    marks = marks.join(firsts, "tie").select(*key, "marks")

    def around(heavy: bool) -> DataFrame:
        some = marks.select(*key, F.filter("marks", lambda m: (m["part"] >= 0) == heavy).alias("marks")).filter(F.size("marks") > 0)
        return rows.join(some, key).select(*key, "n", "z", "m", "marks").mapInArrow(
            _fragment_rows, "owner bigint, part bigint, known boolean, d bigint, tie bigint, lo bigint, start bigint, stop bigint, fp1 bigint, fp2 bigint, bytes binary"
        )

    group, place = ["owner", "part"], [*key, "start"]
    dealt = around(False).select(*group, *place, "bytes")
    others: list[DataFrame] = []
    if not no_heavy:
        found_here = saved(around(True), "fragments")
        others.append(found_here.filter("bytes is null").select(*place, "stop"))
        fragments = found_here.filter("bytes is not null")
        first = fragments.groupBy(*group, "fp1", "fp2").agg(F.min(F.struct(*place)).alias("at"), F.first("bytes").alias("bytes"))
        first = first.select(*group, "at.*", "bytes")
        # of fragments with equal bytes all but the earliest go as a whole
        size = F.col("stop") - F.col("start")
        others.append(fragments.filter(size >= LEAST).join(first.select(*group, *place), [*group, *place], "left_anti").select(*place, "stop"))
        bulk = fragments.select(*group, "fp1", "fp2", size.alias("size")).distinct().groupBy(*group).agg(F.sum("size").alias("size")).filter(F.col("size") > BLOCK_BYTES)
        bulk = saved(bulk.select(*group), "bulk")
        if not bulk.isEmpty():
            others.append(_settled_by_digest(first.join(bulk, group, "left_semi")))
            first = first.join(bulk, group, "left_anti")
        dealt = dealt.union(first.select(*group, *place, "bytes"))
    dealt = dealt.repartition(*group).sortWithinPartitions(*group, *place)
    spans = dealt.mapInArrow(_span_rows, "known boolean, d bigint, tie bigint, lo bigint, start bigint, stop bigint")
    for more in others:
        spans = spans.union(more)
    spans = spans.groupBy(*key).agg(F.collect_list(F.struct("start", "stop")).alias("spans"))

    about = firsts.join(spans, key, "left").select(*key, F.lit(True).alias("own"), "spans")
    done = rows.join(about, key, "left").select("known", "d", "n", "z", "m", "own", "spans")
    return done.mapInArrow(_kept_rows, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, removed array<struct<start: bigint, stop: bigint>>, kept binary")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the strings of 100 bytes that occur earlier."""
    got = suffix_dedup(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
