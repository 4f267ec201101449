"""Cross-tokenizer alignment by a dangling-suffix transducer, and corpus-wide counts of linked ids.

Both tokenizers cover the same bytes. The transducer reads the token of the side that lags; its
state is which side leads and the bytes by which it does. A state and the next token decide the
next state, which is remembered, and an empty rest closes a group. Linked id pairs are counted
within blocks of documents first, and only distinct pairs of blocks are exchanged: once for the
counts, and once back to the block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from .byte_level import ByteLevel
from .common import saved, table

#: Characters of text in a block (one document at least), and links that are laid out at a time.
BLOCK_CHARS, LINKS = 1 << 22, 1 << 20
#: Links of a group from which its distinct ids are paired instead of its tokens.
GROUP_LINKS = 1 << 12
#: Transitions that a task remembers before it starts anew.
MEMO = 2_000_000
#: A pair of ids is one number: the first times PAIR plus the second.
PAIR = 1 << 20


class Transducer:
    """Groups of two token sequences over the same bytes."""

    def __init__(self, a_bytes: list[bytes], b_bytes: list[bytes]) -> None:
        self.bytes = (a_bytes, b_bytes)
        #: of each first token the second with the same bytes: from the empty state, the two are a group
        equal = {x: i for i, x in enumerate(b_bytes)}
        self.equal = [equal.get(x, -1) for x in a_bytes]
        self.reset()

    def reset(self) -> None:
        """Forget all states but the empty one."""
        self.number = {(False, b""): 0}
        #: per state: whether the second side lags, the unmatched bytes of the leading one, and the next state by token
        self.takes_b, self.rest, self.next = [False], [b""], [{}]
        self.known = 0

    def _step(self, state: int, token: int) -> int:
        """The state that a token of the lagging side leads to."""
        lag, rest = self.takes_b[state], self.rest[state]
        data = self.bytes[lag][token]
        if len(data) <= len(rest):
            if not rest.startswith(data):
                raise ValueError("the sides' bytes differ")
            key = (lag, rest[len(data) :])
        else:
            if not data.startswith(rest):
                raise ValueError("the sides' bytes differ")
            key = (not lag, data[len(rest) :])
        if not key[1]:
            key = (False, b"")
        to = self.number.get(key)
        if to is None:
            to = self.number[key] = len(self.rest)
            self.takes_b.append(key[0])
            self.rest.append(key[1])
            self.next.append({})
        self.next[state][token] = to
        self.known += 1
        return to

    def groups(self, a: list[int], b: list[int]) -> tuple[list[int], list[int]]:
        """For each group how many tokens of either side end with it or before it."""
        if self.known > MEMO:
            self.reset()
        ends_a, ends_b = [], []
        takes_b, follow, equal = self.takes_b, self.next, self.equal
        i = j = state = 0
        n, m = len(a), len(b)
        while i < n or j < m:
            if takes_b[state]:
                token = b[j]
                j += 1
            else:
                token = a[i]
                i += 1
                if not state and j < m and equal[token] == b[j]:
                    j += 1
                    ends_a.append(i)
                    ends_b.append(j)
                    continue
            to = follow[state].get(token)
            state = self._step(state, token) if to is None else to
            if not state:
                ends_a.append(i)
                ends_b.append(j)
        if state:
            raise ValueError("the sides' bytes differ")
        return ends_a, ends_b


class Aligner:
    """Texts -> ids of both tokenizers and the ends of their groups; four empty lists where they don't cover the same bytes."""

    def __init__(self, a_path: str | None = None, b_path: str | None = None) -> None:
        self.a = ByteLevel(a_path)
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path or public_tokenizers.path("piece_bpe_32k.model"))
        self.a_bytes = self.a.token_bytes()
        self.b_bytes = []
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            self.b_bytes.append(bytes([int(piece[1:-1], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode())
        self.transducer = Transducer(self.a_bytes, self.b_bytes)
        #: ids as text with what follows them in groups_text(): of the first side within and at the end of a group, and of the second
        sides = ((len(self.a_bytes), ",|"), (len(self.b_bytes), ",;"))
        self.strings = [f"{i}{mark}" for n, marks in sides for mark in marks for i in range(n)]

    def align(self, text: str | None) -> tuple[list[int], list[int], list[int], list[int]]:
        if not text:
            return [], [], [], []
        whole = " " + text
        data = whole.encode()
        b = self.b.encode(text, num_threads=1)
        own = self.b_bytes
        if b"".join([own[i] for i in b]) != data:
            return [], [], [], []
        a = self.a.encode(whole)  # covers any bytes; the transducer would find out if it didn't
        return a, b, *self.transducer.groups(a, b)


    def groups_text(self, a: np.ndarray, b: np.ndarray, ends_a: np.ndarray, ends_b: np.ndarray) -> str:
        """`a1,a2|b1;a3|b2,b3`: the groups' ids."""
        if not len(ends_a):
            return ""
        n, m = len(self.a_bytes), len(self.b_bytes)
        one, two = a.copy(), b + 2 * n
        one[ends_a - 1] += n
        two[ends_b - 1] += m
        out = np.empty(len(a) + len(b), np.int64)
        # a group's first ids come after all second ids before it, and its second ids after all its first ones
        out[np.arange(len(a)) + np.repeat(np.concatenate([[0], ends_b[:-1]]), np.diff(ends_a, prepend=0))] = one
        out[np.arange(len(b)) + np.repeat(ends_a, np.diff(ends_b, prepend=0))] = two
        strings = self.strings
        return "".join([strings[i] for i in out.tolist()])[:-1]


def _summed(keys: list[np.ndarray], sums: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    found, where = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.zeros(len(found), np.int64)
    np.add.at(total, where, np.concatenate(sums))
    return found, total


def links(a: np.ndarray, b: np.ndarray, ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct linked pairs (as numbers, sorted) and how often each is linked."""
    size_a, size_b = np.diff(ends_a, prepend=0), np.diff(ends_b, prepend=0)
    first_a, first_b = ends_a - size_a, ends_b - size_b
    product = size_a * size_b
    single = product == 1
    plain = a[first_a[single]] * PAIR + b[first_b[single]]
    rest = np.flatnonzero(~single)
    n = product[rest]
    few = n < GROUP_LINKS
    small, large = rest[few], rest[~few]
    n = n[few]
    part = np.cumsum(n) // LINKS  # so many links are laid out at a time
    edges = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [len(small)]])
    keys, sums = [], []
    for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        g, k = small[lo:hi], n[lo:hi]
        inside = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
        width = np.repeat(size_b[g], k)
        pairs = a[np.repeat(first_a[g], k) + inside // width] * PAIR + b[np.repeat(first_b[g], k) + inside % width]
        found, times = np.unique(np.concatenate([plain, pairs]) if not lo else pairs, return_counts=True)
        keys.append(found)
        sums.append(times)
    for g in large:
        x, nx = np.unique(a[first_a[g] : first_a[g] + size_a[g]], return_counts=True)
        y, ny = np.unique(b[first_b[g] : first_b[g] + size_b[g]], return_counts=True)
        keys.append((x[:, None] * PAIR + y).ravel())
        sums.append((nx[:, None] * ny).ravel())
    return (keys[0], sums[0]) if len(keys) == 1 else _summed(keys, sums)


def align_tokens(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """(doc_id, a_ids, b_ids, a_ends, b_ends): the ids of each text, and how many of either side's end with each group or before.

    The first tokenizer, of ranks, reads a space and the text; the second, of sentencepiece, adds
    that space itself. Null and empty texts, and those whose bytes the tokens of one don't give
    back, have empty lists. Repeated rows stay, other columns are left out, an empty df gives no
    rows. One text is in memory at a time, whatever its length.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(a_path, b_path)
        for batch in batches:
            for i, text in enumerate(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), *(pa.array([x], pa.list_(pa.int32())) for x in aligner.align(text.as_py()))], ALIGNED)

    rows = df.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, a_ids array<int>, b_ids array<int>, a_ends array<int>, b_ends array<int>")


ALIGNED = ["doc_id", "a_ids", "b_ids", "a_ends", "b_ends"]


def _planes(x: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers as their low halves, then their high ones, which compress to next to nothing."""
    x = x.astype("<u4")
    return (x & 0xFFFF).astype("<u2").tobytes() + (x >> 16).astype("<u2").tobytes()


def _from_planes(data: bytes) -> np.ndarray:
    low, high = np.frombuffer(data, "<u2").reshape(2, -1).astype(np.int64)
    return low | high << 16


class Block:
    """Documents of a task whose links are exchanged together."""

    def __init__(self) -> None:
        self.docs: list[tuple] = []
        self.keys: list[np.ndarray] = []
        self.times: list[np.ndarray] = []
        self.chars = 0

    def add(self, doc_id: int | None, text: str | None, aligner: Aligner) -> None:
        got = a, b, ends_a, _ = [np.array(x, np.int64) for x in aligner.align(text)]
        keys, times = links(*got)
        digest = hashlib.sha256(aligner.groups_text(*got).encode()).hexdigest() if len(a) else ""
        self.docs.append((doc_id, len(a), len(b), len(ends_a), int(times.sum()), digest, len(keys)))
        self.keys.append(keys)
        self.times.append(times)
        self.chars += len(text or "")

    def row(self, number: int) -> pa.RecordBatch:
        """The block as one row: its distinct pairs with the documents that have them, and of each document the pairs' places."""
        pairs, place = np.unique(np.concatenate(self.keys), return_inverse=True)
        times = np.concatenate(self.times)
        starts = np.cumsum([0] + [len(k) for k in self.keys])[:-1]
        step = np.diff(place, prepend=0)
        starts = starts[starts < len(place)]
        step[starts] = place[starts]  # places ascend within a document, so steps are never negative
        more = np.flatnonzero(times > 1)
        columns = {
            "block": [number],
            "pairs": [pairs],
            "docs": [np.bincount(place, minlength=len(pairs)).astype(np.int32)],
            **{name: [list(x)] for name, x in zip(DOC, zip(*self.docs, strict=True), strict=True)},
            "steps": [_planes(step)],
            "more": [_planes(np.diff(more, prepend=0))],
            "times": [times[more].astype("<i8").tobytes()],
        }
        return pa.RecordBatch.from_pydict(columns, BLOCK)


DOC = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_pairs")
BLOCK = pa.schema(
    [("block", pa.int64()), ("pairs", pa.list_(pa.int64())), ("docs", pa.list_(pa.int32()))]
    + [(n, pa.list_(pa.string() if n == "groups_sha256" else pa.int64())) for n in DOC]
    + [("steps", pa.binary()), ("more", pa.binary()), ("times", pa.binary())]
)
OUT = pa.schema([(n, pa.string() if n == "groups_sha256" else pa.int64()) for n in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")])


def _ddl(schema: pa.Schema) -> str:
    kinds = {pa.int64(): "bigint", pa.string(): "string", pa.binary(): "binary", pa.list_(pa.int64()): "array<bigint>", pa.list_(pa.int32()): "array<int>", pa.list_(pa.string()): "array<string>"}
    return ", ".join(f"{f.name} {kinds[f.type]}" for f in schema)


def pair_counts(pairs: DataFrame) -> DataFrame:
    """(block, pair, n) -> (pair, count, best): documents that have the pair, and whether no pair of its first id has more."""
    counts = saved(pairs.groupBy("pair").agg(F.sum("n").alias("count")), "pair-counts")
    first = F.call_function("div", F.col("pair"), F.lit(PAIR).cast("bigint"))
    top = counts.groupBy(first.alias("a")).agg(F.max("count").alias("top"))
    return counts.withColumn("a", first).join(top, "a").select("pair", "count", (F.col("count") == F.col("top")).alias("best"))


def link_statistics(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of each text's alignment.

    A link is a token of either side in one group; a pair's count is the rows of df that have it
    linked. n_best are the links whose pair no other pair of its first id exceeds, count_sum is
    the links' counts added up. Texts without tokens (see align_tokens()) have zeros and an empty
    digest, and count for nothing. Repeated rows and rows without an id each count. An empty df
    gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, block, number = Aligner(a_path, b_path), Block(), TaskContext.get().partitionId() << 32
        for batch in batches:
            for doc_id, text in zip(*batch.columns, strict=True):
                block.add(doc_id.as_py(), text.as_py(), aligner)
                if block.chars > BLOCK_CHARS or len(block.docs) >= BLOCK_CHARS >> 6:
                    yield block.row(number)
                    block, number = Block(), number + 1
        if block.docs:
            yield block.row(number)

    def finished(blocks: pa.Table, counts: pa.Table) -> pa.Table:
        order = np.argsort(counts["pair"].to_numpy())  # as the block's pairs are, of which each has its row
        count, best = counts["count"].to_numpy()[order], counts["best"].to_numpy()[order]
        (row,) = blocks.to_pylist()
        step, more = _from_planes(row["steps"]), np.cumsum(_from_planes(row["more"]))
        times = np.ones(len(step), np.int64)
        times[more] = np.frombuffer(row["times"], "<i8")
        out = {n: row[n] for n in DOC if n != "n_pairs"} | {"n_best": [], "count_sum": []}
        at = 0
        for n in row["n_pairs"]:
            place, t = np.cumsum(step[at : at + n]), times[at : at + n]
            out["n_best"].append(int(t[best[place]].sum()) if n else 0)
            out["count_sum"].append(int((t * count[place]).sum()) if n else 0)
            at += n
        return pa.Table.from_pydict(out, OUT)

    rows = df.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    blocks = saved(rows.mapInArrow(run, _ddl(BLOCK)), "blocks")
    pairs = blocks.select("block", F.explode(F.arrays_zip("pairs", "docs")).alias("x")).select("block", F.col("x.pairs").alias("pair"), F.col("x.docs").alias("n"))
    back = pairs.drop("n").join(pair_counts(pairs), "pair").select(F.col("block").alias("of"), "pair", "count", "best")
    return blocks.drop("pairs", "docs").groupBy("block").cogroup(back.groupBy("of")).applyInArrow(finished, _ddl(OUT))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents aligned, with the counts of their links over all of them."""
    return link_statistics(table(spark, sf_dir, "documents"))
