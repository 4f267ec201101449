"""Order-preserving packing into token windows by dynamic programming.

Documents, in order of id, form a token stream; each range partition packs its own part of it.
A window is at most WINDOW tokens. Cuts may lie at document ends, at sentence ends, and, in
stretches without either, on a grid. The programme minimises padding plus penalties for cuts
that truncate a document or a sentence. As the padding of a window from j to i is linear in j,
the best j is the head of a monotone queue; windows of a power of two need no padding and are
tried besides.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .byte_level import ByteLevel
from .common import shuffle_width, table

WINDOW = 1024
END_ID = 0
#: Encoded as one id, the first after those of the vocabulary.
SPECIAL = "<|endoftext|>"
#: Costs in tokens of padding: a cut inside a document, and inside a sentence.
CUT_DOCUMENT, CUT_SENTENCE = 4, 24
#: Shortest window that may go without padding, and what it costs to have one more window.
SHORT_WINDOW, SHORT_COST = 128, 8
#: Tokens that are planned together; the last windows of a block are planned anew with the next.
BLOCK = 1 << 19


class Piece(NamedTuple):
    """A part of a document in a window."""

    doc_id: int | None
    start: int
    length: int
    ids_crc32: int
    doc_tokens: int
    sequence: int
    offset: int


class Codec:
    """Ids of a byte-level vocabulary, the special token's string included, and which ids end a sentence."""

    def __init__(self, path: str | None = None) -> None:
        self.level = ByteLevel(path, (SPECIAL,))
        self.ends = np.zeros(max(self.level.ranks.values()) + 2, bool)
        for token, i in self.level.ranks.items():
            self.ends[i] = token.rstrip(b'"\')').endswith((b".", b"!", b"?", b"\n"))

    def encode(self, text: str) -> np.ndarray:
        """Ids of the whole text, then END_ID."""
        return np.array([*self.level.encode(text), END_ID], np.uint32)


def candidates(doc_end: np.ndarray, sentence_end: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted cut positions in a stream of n tokens (0 and n included), and what cutting there costs."""
    cost = np.full(n + 1, CUT_SENTENCE, np.int64)
    cost[sentence_end] = CUT_DOCUMENT
    cost[doc_end] = 0
    cost[[0, n]] = 0
    at = np.flatnonzero(cost < CUT_SENTENCE)
    gaps = np.flatnonzero(np.diff(at) > WINDOW // 4)
    if len(gaps):
        fill = [np.arange(at[g] + WINDOW // 8, at[g + 1], WINDOW // 8) for g in gaps]
        at = np.union1d(at, np.concatenate(fill))
    return at, cost[at]


def padding(length: int) -> int:
    """Tokens of padding for a window: none at a power of two."""
    return 0 if length & (length - 1) == 0 else WINDOW - length


def plan(at: np.ndarray, cost: np.ndarray) -> list[int]:
    """The cut positions, from at[0] to at[-1], of least total cost."""
    pos, price = at.tolist(), cost.tolist()
    n = len(pos)
    where = {p: k for k, p in enumerate(pos)}
    best, came = [0] * n, [0] * n
    queue: deque[tuple[int, int]] = deque([(pos[0], 0)])  # (best[j] + pos[j], j), increasing
    shorts = [1 << k for k in range(SHORT_WINDOW.bit_length() - 1, WINDOW.bit_length() - 1)]
    find = where.get
    for i in range(1, n):
        p = pos[i]
        low = p - WINDOW
        while pos[queue[0][1]] < low:
            queue.popleft()
        key, j = queue[0]
        least = key + WINDOW - p
        k = find(low)
        if k is not None and best[k] < least:
            least, j = best[k], k
        for size in shorts:
            k = find(p - size)
            if k is not None and best[k] + SHORT_COST < least:
                least, j = best[k] + SHORT_COST, k
        least += price[i]
        best[i], came[i] = least, j
        key = least + p
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, i))
    cuts, k = [pos[-1]], n - 1
    while k:
        k = came[k]
        cuts.append(pos[k])
    return cuts[::-1]


class Packer:
    """Documents in order -> pieces of windows; holds one block of tokens."""

    def __init__(self, ends: np.ndarray, first_sequence: int = 0, block: int = BLOCK) -> None:
        self.ends, self.sequence, self.block = ends, first_sequence, block
        #: (doc_id, tokens of the whole document, start of the part that is still held, ids of it)
        self.docs: list[tuple[int | None, int, int, np.ndarray]] = []
        self.held = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> Iterator[Piece]:
        """Take a document; give the pieces that are settled."""
        for lo in range(0, len(ids), self.block):  # a very long document comes block by block
            part = ids[lo : lo + self.block]
            if lo and self.docs and self.docs[-1][2] + len(self.docs[-1][3]) == lo:
                last = self.docs.pop()
                self.docs.append((doc_id, len(ids), last[2], np.concatenate([last[3], part])))
            else:
                self.docs.append((doc_id, len(ids), lo, part))
            self.held += len(part)
            if self.held >= self.block:
                yield from self.flush(final=False)

    def flush(self, final: bool = True) -> Iterator[Piece]:
        """Plan what is held; without final, its last windows stay."""
        if not self.docs:
            return
        stream = np.concatenate([d[3] for d in self.docs])
        ends = np.cumsum([len(d[3]) for d in self.docs])
        whole = np.array([d[2] + len(d[3]) == d[1] for d in self.docs])
        cuts = plan(*candidates(ends[whole], np.flatnonzero(self.ends[stream]) + 1, len(stream)))
        if not final:
            cuts = cuts[: max(2, len(cuts) - 16)]
        k, begin = 0, 0
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            at = a
            while at < b:
                doc_id, total, start, ids = self.docs[k]
                stop = min(b, int(ends[k]))
                part = stream[at:stop]
                yield Piece(doc_id, start + at - begin, stop - at, zlib.crc32(part.astype("<u4").tobytes()), total, self.sequence, at - a)
                at = stop
                if stop == ends[k]:
                    begin, k = stop, k + 1
            self.sequence += 1
        rest = self.docs[k:]
        if rest:
            doc_id, total, start, ids = rest[0]
            used = cuts[-1] - begin
            rest[0] = (doc_id, total, start + used, ids[used:])
        self.docs, self.held = rest, len(stream) - cuts[-1]


def pack_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None, vocab: str | None = None) -> DataFrame:
    """Pieces (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of all documents.

    Documents keep their order of id, nulls first, repeated rows next to each other. A null or
    empty text is the end id alone. Sequences do not cross partitions, which costs one padded
    sequence for each; cuts are the best ones within blocks of BLOCK tokens of a partition, not
    over all of them. A very long text is planned block by block. Other columns are left out. An
    empty df gives no rows. vocab is a path to a vocabulary of ranks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(vocab)
        packer = Packer(codec.ends, TaskContext.get().partitionId() << 32)
        out: list[Piece] = []

        def batch_of(pieces: list[Piece]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*pieces, strict=True), [pa.int64()] * 7, strict=True)], names=[*NAMES])

        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                out += packer.add(doc_id.as_py(), codec.encode(text.as_py() or ""))
            if len(out) >= 20_000:
                yield batch_of(out)
                out = []
        out += packer.flush()
        if out:
            yield batch_of(out)

    docs = df.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    dealt = docs.repartitionByRange(partitions or shuffle_width(df.sparkSession), "doc_id").sortWithinPartitions("doc_id", "text")
    return dealt.mapInArrow(run, ", ".join(f"{x} bigint" for x in NAMES))


NAMES = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed: a row for each piece of a document in a sequence."""
    return pack_documents(table(spark, sf_dir, "documents"))
