"""Byte-level BPE by replaying the merges over a corpus of words, and decoding.

A task gathers the distinct words of a block of documents and lays their bytes end to end. An
inverted index leads from each token pair, by the rank of what it merges to, to the positions
where it stands. The pairs are taken in the order of rank, whatever words they stand in, and a
merge touches its two neighbours only: their new pairs enter the index. Ids of words stay in
memory, so a later block replays only words that are new.
"""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Iterable, Iterator
from functools import cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from .common import table

#: Characters of text whose words are gathered before a replay, and of a slice that is split at a time.
BLOCK_CHARS, SLICE_CHARS = 1 << 22, 1 << 20
#: Bytes of distinct words that are replayed together (one word at least).
REPLAY_BYTES = 1 << 18
#: Words that a task remembers before it starts anew.
WORD_MEMO = 400_000
#: Bytes of ids in an Arrow batch, about.
BATCH_BYTES = 1 << 23
#: The rank of a pair that merges to nothing.
NONE = 1 << 30


def _class(members: list[int]) -> str:
    """Code points as the inside of a character class."""
    at = np.array(members)
    new = np.flatnonzero(np.diff(at, prepend=-2) > 1)
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(at[new].tolist(), at[np.append(new[1:], len(at)) - 1].tolist(), strict=True))


@cache
def words_patterns() -> tuple[re.Pattern, re.Pattern]:
    """public_tokenizers.PATTERN for re, with letters, numbers and blanks as the library has them; for texts of the basic plane, and for all.

    Python's own tables are of another version of Unicode, so the library is asked once a process
    which characters it takes for what. Classes of the basic plane alone are looked up at once.
    """
    every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    rules = []
    for top in (1 << 16, 1 << 21):
        rule, inside = public_tokenizers.PATTERN, []
        for name in (r"\p{L}", r"\p{N}", r"\s"):
            found = tiktoken.Encoding("class", pat_str=name, mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={}).encode_ordinary(every)
            inside.append((name, _class([c for c in map(ord, bytes(found).decode()) if c < top])))
        rule = rule.replace(r"[^\s\p{L}\p{N}]", "[^" + "".join(x for _, x in inside) + "]").replace(r"\S", f"[^{inside[2][1]}]")
        for name, members in inside:
            rule = rule.replace(name, f"[{members}]")
        rules.append(re.compile(rule))
    return rules[0], rules[1]


def slices(text: str) -> Iterator[str]:
    """A text in parts that split into words as the whole does: cut before a space that follows no blank."""
    lo = 0
    while len(text) - lo > SLICE_CHARS:
        cut = text.find(" ", lo + SLICE_CHARS)
        while cut > 0 and text[cut - 1].isspace():
            cut = text.find(" ", cut + 1)
        if cut < 0:
            break
        yield text[lo:cut]
        lo = cut
    yield text[lo:]


class MergeReplay:
    """Ids of words by a table of ranks, as the tiktoken library gives them."""

    def __init__(self, path: str | None = None, ranks: dict[bytes, int] | None = None) -> None:
        if ranks is None:
            with open(path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.ranks = ranks
        self.token = [b""] * (max(self.ranks.values()) + 1)
        for token, i in self.ranks.items():
            self.token[i] = token
        self.byte_id = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        self.first = np.array([[self.ranks.get(bytes([a, b]), NONE) for b in range(256)] for a in range(256)], np.int32)
        #: (left id, right id) as one number -> rank of what they merge to
        self.shift = len(self.token).bit_length()
        self.pairs: dict[int, int] = {}
        find = self.ranks.get
        for token, i in self.ranks.items():
            for k in range(1, len(token)):
                left, right = find(token[:k]), find(token[k:])
                if left is not None and right is not None:
                    self.pairs[left << self.shift | right] = i
        #: words that were replayed, with their ids
        self.words: dict[str, bytes] = {}
        self.rule, self.wide_rule = words_patterns()

    def replay(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of the words, all merges of all words in the order of rank, and of position within a rank.

        A merge that gives rise to a pair of lower rank lets that one go first, as it is in its word.
        """
        data = np.frombuffer(b"".join(words), np.uint8)
        n = len(data)
        ends = np.cumsum([len(w) for w in words])
        rank = np.full(n, NONE, np.int32)
        rank[:-1] = self.first[data[:-1], data[1:]]
        rank[ends - 1] = NONE
        after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        after[ends - 1] = -1
        before[np.concatenate([[0], ends[:-1]])] = -1
        # the index: rank -> positions of pairs that merge to it
        order = np.argsort(rank, kind="stable")
        order = order[: int(np.searchsorted(rank[order], NONE))]
        found, starts = np.unique(rank[order], return_index=True)
        index: dict[int, np.ndarray | list[int]] = dict(zip(found.tolist(), np.split(order, starts[1:]), strict=True)) if len(found) else {}
        due = found.tolist()
        ids, rank, after, before = (array("i", x.astype(np.int32).tobytes()) for x in (self.byte_id[data], rank, after, before))
        pairs, shift = self.pairs, self.shift
        while due:
            r = due[0]
            bucket = index[r]
            if not isinstance(bucket, list):
                bucket = index[r] = bucket.tolist()
            lower = False
            while bucket and not lower:
                at = heappop(bucket)
                if rank[at] != r:
                    continue
                gone, left = after[at], before[at]
                right = after[gone]
                ids[at], ids[gone] = r, -1
                after[at] = right
                rank[gone] = rank[at] = NONE
                touched = ()
                if right >= 0:
                    before[right] = at
                    new = pairs.get(r << shift | ids[right])
                    if new is not None:
                        touched = ((new, at),)
                if left >= 0:
                    new = pairs.get(ids[left] << shift | r)
                    rank[left] = NONE
                    if new is not None:
                        touched += ((new, left),)
                for new, place in touched:
                    rank[place] = new
                    lower |= new < r
                    entry = index.get(new)
                    if entry is None:
                        index[new] = [place]
                        heappush(due, new)
                    elif isinstance(entry, list):
                        heappush(entry, place)
                    else:
                        entry = index[new] = entry.tolist()
                        heappush(entry, place)
            if not bucket:
                del index[r]
                due.remove(r) if lower else heappop(due)
                if lower:
                    heapify(due)
        done = np.frombuffer(ids, np.int32)
        return [part[part >= 0] for part in np.split(done, ends[:-1])]

    def learn(self, words: Iterable[str]) -> None:
        """Put the words' ids into memory; those that are tokens themselves aren't replayed."""
        held: list[tuple[str, bytes]] = []
        size = 0

        def settle() -> None:
            for (word, _), ids in zip(held, self.replay([b for _, b in held]), strict=True):
                self.words[word] = ids.astype("<u4").tobytes()
            held.clear()

        for word in words:
            data = word.encode()
            own = self.ranks.get(data)
            if own is not None:
                self.words[word] = own.to_bytes(4, "little")
                continue
            held.append((word, data))
            size += len(data)
            if size > REPLAY_BYTES:
                settle()
                size = 0
        if held:
            settle()

    def split(self, text: str) -> list[str]:
        """The words of a text, which the table of ranks is applied to one by one."""
        basic = text.isascii() or len(text.encode("utf-16-le")) == 2 * len(text)
        return (self.rule if basic else self.wide_rule).findall(text)

    def encode(self, texts: Iterable[str]) -> list[bytes]:
        """Ids of whole texts as little-endian unsigned 32-bit integers; words are gathered over texts."""
        out: list[list[bytes]] = []
        block: list[tuple[int, list[str]]] = []
        size = 0

        def settle() -> None:
            distinct = set().union(*(words for _, words in block))
            new = distinct.difference(self.words)
            if len(self.words) + len(new) > WORD_MEMO:
                self.words.clear()
                new = distinct
            self.learn(new)
            known = self.words
            for k, words in block:
                out[k].append(b"".join([known[w] for w in words]))
            block.clear()

        for k, text in enumerate(texts):
            out.append([])
            for part in slices(text):
                block.append((k, self.split(part)))
                size += len(part)
                if size > BLOCK_CHARS:
                    settle()
                    size = 0
        settle()
        return [b"".join(x) for x in out]

    def decode(self, ids: bytes) -> bytes:
        """The bytes that ids stand for."""
        token = self.token
        return b"".join([token[i] for i in np.frombuffer(ids, "<u4").tolist()])


def _by_size(column: pa.Array, made: Iterator[bytes], rest: list[pa.Array], names: list[str]) -> Iterator[pa.RecordBatch]:
    """The columns with one more, as batches of about BATCH_BYTES of it."""
    out: list[bytes] = []
    size, done = 0, 0
    for i, x in enumerate(made):
        out.append(x)
        size += len(x)
        if size > BATCH_BYTES or i + 1 == len(column):
            yield pa.RecordBatch.from_arrays([*(c.slice(done, len(out)) for c in rest), pa.array(out, pa.binary())], names)
            out, size, done = [], 0, i + 1


def replay_encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(doc_id, ids): ids of each whole text, little-endian unsigned 32-bit, one after another.

    Null and empty texts have no ids; repeated rows stay; other columns are left out; an empty df
    gives no rows. A text's words are gathered slice by slice, so of a very long text its ids and
    a slice are held; a very long word takes some 40 bytes a byte. No shuffle: the corpus that a
    replay sees is a task's block of documents, and words that it knows from earlier ones.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        replay = MergeReplay(path)

        def encoded(texts: pa.Array) -> Iterator[bytes]:
            held: list[str] = []
            size = 0
            for text in texts:
                held.append(text.as_py() or "")
                size += len(held[-1])
                if size > BLOCK_CHARS:
                    yield from replay.encode(held)
                    held, size = [], 0
            yield from replay.encode(held)

        for batch in batches:
            yield from _by_size(batch.column(1), encoded(batch.column(1)), [batch.column(0)], ["doc_id", "ids"])

    rows = df.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema[0].dataType.simpleString()}, ids binary")


def replay_decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids, decoded) of (doc_id, ids): the bytes that the ids stand for; null ids are none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        replay = MergeReplay(path)
        for batch in batches:
            ids = batch.column(1)
            yield from _by_size(ids, (replay.decode(x.as_py() or b"") for x in ids), batch.columns, ["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, ids binary, decoded binary")


def op12_merge_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded and decoded, as digests."""
    got = replay_decode(replay_encode(table(spark, sf_dir, "documents")))
    return got.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
