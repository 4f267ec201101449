"""BPE encoding that encodes shared content once, and decoding.

A rolling hash over a text's characters cuts it into content-defined chunks: passages that
documents share give equal chunks wherever they stand, and a task encodes each once. Where two
chunks join, what the first one ends with is encoded anew together with more and more of the
second, until both encodings have a word begin at the same place; from there on the second
chunk's ids hold. Words are what the vocabulary's own splitting rule yields. It looks a few
characters ahead at most, so places that near an end are never trusted.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import public_tokenizers

from .common import table

#: Characters that the rolling hash sees (a power of two), and bits of it that are 0 at a cut.
HASH_WINDOW, CUT_BITS = 16, 8
#: Entries that a task's memories hold before they start anew.
CHUNK_MEMO, WORD_MEMO = 50_000, 300_000
#: Bytes of ids in an Arrow batch, about.
BATCH_BYTES = 1 << 23
#: Characters before the end of what is seen in which a word's beginning may still change.
AHEAD = 8
#: Beginnings of words that a chunk remembers from its start.
HEAD_WORDS = 6
LETTER, NUMBER = "a-zªµºß-öø-ÿ", "0-9²³¹¼½¾"
#: Characters whose classes, case and normal form are certain here.
PLAIN = re.compile(r"[\t\n\r -~¡-ÿ]*")
#: The splitting rule below, for plain text in lower case.
WORD = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTER}]+|[{NUMBER}]|[^ \t\n\r{LETTER}{NUMBER}]+")
#: The normal form and the splitting rule of vocabularies whose plain text is looked up word by word.
WORD_FORM = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
WORD_RULE = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"


@cache
def _joined_marks() -> frozenset[str]:
    """Characters that the composition of normal forms can join to the one before them, Hangul vowels and ends included."""
    pairs = (unicodedata.decomposition(chr(c)).split() for c in range(0x110000))
    return frozenset({chr(int(p[1], 16)) for p in pairs if len(p) == 2 and p[0][0] != "<"} | {chr(c) for c in (*range(0x1161, 0x1176), *range(0x11A8, 0x11C3))})


@cache
def stands_alone(c: str) -> bool:
    """Does a character's normal form, and that of what follows, never depend on what stands before it?

    Unknown characters may be marks in a newer version of Unicode than Python's.
    """
    return PLAIN.fullmatch(c) is not None or (unicodedata.combining(c) == 0 and unicodedata.category(c) not in ("Cn", "Mn", "Mc", "Me") and c not in _joined_marks())


def cuts(text: str) -> list[int]:
    """Positions after which the rolling hash cuts the text."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    if len(points) < HASH_WINDOW:
        return []
    h = (points * np.uint32(0x9E3779B1)) ^ (points >> np.uint32(3))
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B)
    width = 1
    while width < HASH_WINDOW:
        h = h[width:] + h[:-width] * np.uint32(pow(0x01000193, width, 1 << 32))
        width *= 2
    h = (h ^ (h >> np.uint32(16))) * np.uint32(0xC2B2AE35)
    places = (np.flatnonzero(h >> np.uint32(32 - CUT_BITS) == 0) + HASH_WINDOW).tolist()
    return [p for p in places if p < len(text) and stands_alone(text[p])]


class Encoded(NamedTuple):
    """Ids of a piece of text, and (position, ids before it) of places where words begin."""

    ids: bytes
    begins: list[tuple[int, int]]


class Chunk(NamedTuple):
    """Ids of a chunk, its first words' beginnings, and its last one that what follows can't change."""

    ids: bytes
    head: tuple[tuple[int, int], ...]
    last: tuple[int, int] | None


def _parts(spec: dict | None, key: str) -> list[dict]:
    return [] if spec is None else spec[key] if spec["type"] == "Sequence" else [spec]


class ChunkEncoder:
    """Encodes texts as the tokenizer itself does, with memories of chunks and words.

    chunked says whether the vocabulary's rules are known to depend on nearby text alone; where
    they aren't, texts are encoded whole.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        spec = json.loads(self.tokenizer.to_str())
        forms, rules = _parts(spec["normalizer"], "normalizers"), _parts(spec["pre_tokenizer"], "pretokenizers")
        added = spec["added_tokens"]
        self.chunked = (
            bool(rules)
            and all(x["type"] in ("NFC", "NFD", "NFKC", "NFKD", "Lowercase") or (x["type"] == "Replace" and x["pattern"] == {"Regex": "\\s+"}) for x in forms)
            and all(x["type"] == "Split" or (x["type"] == "ByteLevel" and not x["add_prefix_space"]) for x in rules)
            and not any(t[x] for t in added for x in ("single_word", "lstrip", "rstrip", "normalized"))
        )
        self.by_word = self.chunked and spec["normalizer"] == WORD_FORM and [r.get("pattern") for r in rules] == [{"Regex": WORD_RULE}, None] and rules[0]["behavior"] == "Removed" and not rules[1]["use_regex"]
        self.special = re.compile("(" + "|".join(re.escape(t["content"]) for t in added) + ")") if added else None
        self.chunks: dict[str, Chunk] = {}
        self.words: dict[str, bytes] = {}
        self.reused = 0

    def _library(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _word(self, word: str) -> bytes:
        if word not in self.words:
            if len(self.words) > WORD_MEMO:
                self.words.clear()
            self.words[word] = self._library([word])[0]
        return self.words[word]

    def _looked_up(self, texts: list[str]) -> list[list[bytes]]:
        """Ids word by word of plain texts."""
        found = [WORD.findall(t.lower()) for t in texts]
        missing = {w for x in found for w in x if w not in self.words}
        if missing:
            if len(self.words) + len(missing) > WORD_MEMO:
                self.words.clear()
                missing = {w for x in found for w in x}
            missing = list(missing)
            self.words.update(zip(missing, self._library(missing), strict=True))
        known = self.words
        return [[known[w] for w in x] for x in found]

    def _by_library(self, texts: list[str]) -> list[Encoded]:
        out = []
        for text, e in zip(texts, self.tokenizer.encode_batch(texts, add_special_tokens=False) if texts else (), strict=True):
            begins, end, before = [], 0, None
            for k, ((a, b), w) in enumerate(zip(e.offsets, e.word_ids, strict=True)):
                if w != before and a >= end and stands_alone(text[a]):  # not within a character that became several
                    begins.append((a, k))
                before, end = w, max(end, b)
            out.append(Encoded(np.array(e.ids, "<u4").tobytes(), begins))
        return out

    def _is_plain(self, text: str) -> bool:
        return self.by_word and PLAIN.fullmatch(text) is not None

    def _ids(self, text: str) -> bytes:
        """A text without special tokens, as it is."""
        return b"".join(self._looked_up([text])[0]) if self._is_plain(text) else self._library([text])[0]

    def _new_chunks(self, texts: list[str]) -> Iterator[tuple[str, Chunk]]:
        plain = [t for t in texts if self._is_plain(t)]
        for t, words in zip(plain, self._looked_up(plain), strict=True):
            low, head, n = t.lower(), [], 0
            for m, i in zip(WORD.finditer(low), words[:HEAD_WORDS], strict=False):
                head.append((m.start(), n))
                n += len(i) >> 2
            ids, last = b"".join(words), None
            blank = max(low.rfind(" ", 0, max(0, len(t) - AHEAD)), low.rfind("\n", 0, max(0, len(t) - AHEAD)))
            # after a blank a word begins, whatever it is
            rest = list(WORD.finditer(low, blank + 1)) if blank >= 0 else []
            if rest and rest[0].start() <= len(t) - AHEAD:
                last = rest[0].start(), (len(ids) - sum(map(len, words[-len(rest) :]))) >> 2
            yield t, Chunk(ids, tuple(head), last)
        odd = [t for t in texts if not self._is_plain(t)]
        for t, e in zip(odd, self._by_library(odd), strict=True):
            yield t, Chunk(e.ids, tuple(e.begins[:HEAD_WORDS]), next((x for x in reversed(e.begins) if x[0] <= len(t) - AHEAD), None))

    def _chunks(self, texts: list[str]) -> list[Chunk]:
        """The chunks of a text, from memory or encoded now."""
        if len(self.chunks) > CHUNK_MEMO:
            self.chunks.clear()
        new = [t for t in dict.fromkeys(texts) if t not in self.chunks]
        self.reused += len(texts) - len(new)
        self.chunks.update(self._new_chunks(new))
        return [self.chunks[t] for t in texts]

    def _agreed(self, tail: str, text: str, chunk: Chunk, final: bool) -> tuple[bytes, tuple[int, int]] | None:
        """Ids from tail's start up to the first place where chunk's own ids hold, and that place; None where there is none."""
        if not chunk.head:
            return None
        known, n = dict(chunk.head), len(tail)
        for far in (chunk.head[min(1, len(chunk.head) - 1)], chunk.head[-1]):
            width = far[0] + 2 * AHEAD
            while width < len(text) and not stands_alone(text[width]):
                width += 1
            seen = tail + text[:width]
            sure = len(seen) if final and width >= len(text) else len(seen) - AHEAD
            if self._is_plain(seen):
                ids: list[bytes] = []
                for m in WORD.finditer(seen.lower()):
                    place = m.start() - n
                    if place + n > sure:
                        break
                    if place in known:
                        return b"".join(ids), (place, known[place])
                    ids.append(self._word(m[0]))
            else:
                made = self._by_library([seen])[0]
                for at, before in made.begins:
                    if at <= sure and at - n in known:
                        return made.ids[: 4 * before], (at - n, known[at - n])
        return None

    def _plain(self, text: str) -> bytes:
        """A text without special tokens."""
        if not self.chunked:
            return self._library([text])[0]
        ends = [*cuts(text), len(text)]
        pieces = [text[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True) if a < b]
        if len(pieces) == 1:
            return self._ids(pieces[0])
        out, tail = [], ""  # tail: what follows the last place that is sure to begin a word
        for k, (piece, chunk) in enumerate(zip(pieces, self._chunks(pieces), strict=True)):
            place = (0, 0)
            if k:
                got = self._agreed(tail, piece, chunk, k + 1 == len(pieces))
                if got is None:
                    tail += piece
                    continue
                ids, place = got
                out.append(ids)
            if chunk.last is None or chunk.last[0] < place[0]:
                tail = piece[place[0] :]
            else:
                out.append(chunk.ids[4 * place[1] : 4 * chunk.last[1]])
                tail = piece[chunk.last[0] :]
        out.append(self._ids(tail))
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        """Ids of the whole text as little-endian unsigned 32-bit integers."""
        if self.chunked and self.special and self.special.search(text):
            # the strings of special tokens are found before all else and stand for one id each
            pieces = self.special.split(text)
            return b"".join(np.array([self.tokenizer.token_to_id(x)], "<u4").tobytes() if i % 2 else self._plain(x) for i, x in enumerate(pieces))
        return self._plain(text)


def bpe_encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(doc_id, ids): ids of each whole text, little-endian unsigned 32-bit, one after another.

    Null and empty texts have no ids; repeated rows stay. Other columns are left out. An empty
    df gives no rows. No shuffle: chunks are shared within a task.
    """
    path = path or public_tokenizers.path("word_bpe_49k.json")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = ChunkEncoder(path)
        for batch in batches:
            out, size, done = [], 0, 0
            for i, text in enumerate(batch.column(1)):
                out.append(encoder.encode(text.as_py() or ""))
                size += len(out[-1])
                if size > BATCH_BYTES or i + 1 == batch.num_rows:
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(done, len(out)), pa.array(out, pa.binary())], ["doc_id", "ids"])
                    out, size, done = [], 0, i + 1

    rows = df.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema[0].dataType.simpleString()}, ids binary")


def bpe_decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids, decoded): what the ids of bpe_encode() stand for, special tokens included.

    A vocabulary without a decoder of its own has its tokens with a space between them.
    """
    path = path or public_tokenizers.path("word_bpe_49k.json")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = Tokenizer.from_file(path)
        token = np.array([tokenizer.id_to_token(i) for i in range(tokenizer.get_vocab_size())], object)

        def text_of(ids: np.ndarray) -> str:
            return " ".join(token[ids].tolist()) if tokenizer.decoder is None else tokenizer.decode(ids.tolist(), skip_special_tokens=False)

        for batch in batches:
            texts, size, done = [], 0, 0
            for i, ids in enumerate(batch.column(1)):
                texts.append(text_of(np.frombuffer(ids.as_py(), "<u4")))
                size += len(texts[-1])
                if size > BATCH_BYTES or i + 1 == batch.num_rows:
                    part = batch.slice(done, len(texts))
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], ["doc_id", "ids", "decoded"])
                    texts, size, done = [], 0, i + 1

    return encoded.mapInArrow(run, f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, ids binary, decoded string")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded and decoded, as digests."""
    got = bpe_decode(bpe_encode(table(spark, sf_dir, "documents")))
    return got.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
