"""Ids of a byte-level vocabulary of ranks for any text: by the library where that is safe, by merge replay elsewhere."""

from __future__ import annotations

import base64
import re
from collections.abc import Sequence

import numpy as np
import tiktoken

import public_tokenizers

from .merge_replay import MergeReplay

#: Texts with a longer run of blanks are split here: the library's search for words runs out of stack at some 990,000.
LONG_RUN = 50_000
BLANKS = re.compile(r"\s{%d}" % LONG_RUN)


class ByteLevel:
    """A vocabulary of ranks, and special strings whose ids follow those of the vocabulary."""

    def __init__(self, path: str | None = None, special: Sequence[str] = ()) -> None:
        with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.special = {x: max(self.ranks.values()) + 1 + i for i, x in enumerate(special)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=self.ranks, special_tokens=self.special)
        self.marks = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None
        self.replay: MergeReplay | None = None

    def token_bytes(self) -> list[bytes]:
        """The bytes of each id; those of special ids are their strings."""
        out = [b""] * (max([*self.ranks.values(), *self.special.values()]) + 1)
        for token, i in [*self.ranks.items(), *((s.encode(), i) for s, i in self.special.items())]:
            out[i] = token
        return out

    def _replayed(self, text: str) -> list[int]:
        if self.replay is None:
            self.replay = MergeReplay(ranks=self.ranks)
        return np.frombuffer(self.replay.encode([text])[0], "<u4").tolist()

    def encode(self, text: str) -> list[int]:
        """Ids of the whole text; each special string in it stands for one id."""
        if len(text) < LONG_RUN or not BLANKS.search(text):
            return self.encoding.encode(text, allowed_special="all") if self.special else self.encoding.encode_ordinary(text)
        out: list[int] = []
        for i, part in enumerate(self.marks.split(text) if self.marks else [text]):
            out += [self.special[part]] if i % 2 else self._replayed(part)
        return out
