"""Chat formatting with loss masks aligned by offsets.

Whole conversations are rendered and encoded once. The tokens' byte offsets follow from their
lengths, and a binary search of the sorted spans of assistant texts gives each token's mask.
Turn markers are tokens of their own, so no token straddles the edge of a text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .byte_level import ByteLevel
from .common import table

#: Their ids follow those of the vocabulary.
OPEN, SAY, CLOSE = "<|turn|>", "<|say|>", "<|done|>"


def escape(text: str) -> str:
    """Text without any control string: a backslash goes before each backslash, and inside each '<|'."""
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    """The reverse of escape()."""
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


def render(turns: list[tuple[str, str]], loss_role: str = "assistant") -> tuple[str, np.ndarray]:
    """The formatted conversation and the byte spans (n x 2, sorted) of the texts of loss_role."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{OPEN}{escape(role)}{SAY}", escape(text)
        start = at + len(head.encode())
        at = start + len(body.encode())
        if role == loss_role:
            spans.append((start, at))
        at += len(CLOSE)
        parts += [head, body, CLOSE]
    return "".join(parts), np.array(spans, np.int64).reshape(-1, 2)


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation."""
    turns = formatted.split(CLOSE)[:-1]
    return [(unescape(role), unescape(text)) for role, _, text in (x.removeprefix(OPEN).partition(SAY) for x in turns)]


class Codec:
    """A byte-level encoding with the three markers, and each token's length in bytes."""

    def __init__(self, path: str | None = None) -> None:
        self.level = ByteLevel(path, (OPEN, SAY, CLOSE))
        self.length = np.array([len(x) for x in self.level.token_bytes()], np.int64)

    def encode(self, formatted: str) -> np.ndarray:
        """Ids of the whole text; every marker in it is meant as one."""
        return np.array(self.level.encode(formatted), np.int32)

    def spans(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Byte offsets at which each token starts and ends."""
        end = np.cumsum(self.length[ids])
        return end - self.length[ids], end


def loss_mask(start: np.ndarray, end: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """Which tokens overlap one of the sorted, disjoint spans."""
    if not len(spans):
        return np.zeros(len(start), bool)
    # the last span that begins before the token's end is the only one that can reach over its start
    k = np.searchsorted(spans[:, 0], end, "left") - 1
    return (k >= 0) & (spans[k, 1] > start)


def format_chat(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", loss_role: str = "assistant", vocab: str | None = None) -> DataFrame:
    """(conv_id, formatted, ids, mask): each conversation rendered, encoded, and masked for loss.

    Turns follow turn, then role, then text, nulls first; repeated rows all count. Null roles and
    texts are empty; rows without a conversation id form one conversation. One conversation at a
    time is in memory, however long; other columns are left out. vocab is a path to a vocabulary of ranks. An empty df gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, out, size = Codec(vocab), [], 0
        for conv, turns in conversations(batches):
            formatted, spans = render(turns, loss_role)
            ids = codec.encode(formatted)
            out.append({"conv_id": conv, "formatted": formatted, "ids": ids, "mask": loss_mask(*codec.spans(ids), spans)})
            size += len(formatted)
            if size > 1 << 22:
                yield pa.RecordBatch.from_pylist(out, ROW)
                out, size = [], 0
        if out:
            yield pa.RecordBatch.from_pylist(out, ROW)

    cols = [F.col(f"`{c}`") for c in (conv_col, turn_col, role_col, text_col)]
    rows = df.select(cols[0].cast("bigint").alias("conv_id"), cols[1].cast("bigint").alias("turn"), cols[2].cast("string").alias("role"), cols[3].cast("string").alias("text"))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(run, "conv_id bigint, formatted string, ids array<int>, mask array<boolean>")


ROW = pa.schema([("conv_id", pa.int64()), ("formatted", pa.string()), ("ids", pa.list_(pa.int32())), ("mask", pa.list_(pa.bool_()))])


def conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, list[tuple[str, str]]]]:
    """Rows sorted by conversation and turn -> (conversation, its turns)."""
    held: list[tuple[str, str]] = []
    last = None
    for batch in batches:
        conv, _, role, text = (x.to_pylist() for x in batch.columns)
        for c, r, t in zip(conv, role, text, strict=True):
            if held and c != last:
                yield last, held
                held = []
            last = c
            held.append((r or "", t or ""))
    if held:
        yield last, held


def read_back(formatted: DataFrame, vocab: str | None = None) -> DataFrame:
    """What format_chat()'s rows say: the turns, and the text under the mask, as digests and lengths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(vocab)
        for batch in batches:
            out = []
            for conv, text, ids, mask in zip(*batch.columns, strict=True):
                turns = parse(text.as_py())
                start, end = codec.spans(ids.values.to_numpy())
                on = mask.values.to_numpy(zero_copy_only=False)
                data = text.as_py().encode()
                loss = unescape(b"".join(data[a:b] for a, b in zip(start[on], end[on], strict=True)).decode())
                digest = hashlib.sha256()
                for role, said in turns:
                    digest.update(f"{role}\n{said}\n".encode())
                out.append({"conv_id": conv.as_py(), "n_turns": len(turns), "turns_sha256": digest.hexdigest(), "loss_chars": len(loss), "loss_sha256": hashlib.sha256(loss.encode()).hexdigest(), "formatted_chars": len(text.as_py())})
            yield pa.RecordBatch.from_pylist(out, READ)

    return formatted.mapInArrow(run, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")


READ = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

#: Text of the two turns of conversation -7.
PROBE = r"\### Assistant: </turn> ok"


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and the probe, formatted and read back."""
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), "role", "text")
    probe = spark.createDataFrame([(-7, 0, "user", PROBE), (-7, 1, "assistant", PROBE)], "conv_id bigint, turn bigint, role string, text string")
    return read_back(format_chat(rows.union(probe)))


OP8_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, role AS r0, text AS t0 FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok', 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok', 'assistant', '\### Assistant: </turn> ok'
), g AS (
  SELECT conv_id,
         count(*) AS n_turns,
         string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, r0 NULLS FIRST, t0 NULLS FIRST) AS turns,
         coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, r0 NULLS FIRST, t0 NULLS FIRST) FILTER (WHERE role = 'assistant'), '') AS loss,
         sum(length(replace(replace(role, '\', '\\'), '<|', '<\|')) + length(replace(replace(text, '\', '\\'), '<|', '<\|')) + 23)::BIGINT AS formatted_chars
  FROM c GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM g
"""
