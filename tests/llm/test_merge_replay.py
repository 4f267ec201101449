from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from jobloom.llm import merge_replay

from .helpers import ROWS, SF, documents

REPLAY = merge_replay.MergeReplay()
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=REPLAY.ranks, special_tokens={})


def want(text):
    return np.array(LIBRARY.encode_ordinary(text or ""), "<u4").tobytes()


def test_query_equals_the_library(spark):
    rows = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = merge_replay.op12_merge_replay(spark, SF).collect()
    assert len(got) == len(rows)
    for r in got:
        ids = want(rows[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(rows[r.doc_id].encode()).hexdigest())


def test_replay_of_odd_rows(spark):
    rows = [*ROWS, (70, "x" * 100_000), (71, "abc" * 50_000), (72, "\x1c\x85  a"), (73, "word " * 300_000)]
    got = merge_replay.replay_decode(merge_replay.replay_encode(documents(spark, rows))).collect()
    assert Counter((r.doc_id, bytes(r.ids), bytes(r.decoded)) for r in got) == Counter((i, want(t), (t or "").encode()) for i, t in rows)
    assert merge_replay.replay_encode(documents(spark, [])).count() == 0


@pytest.mark.parametrize("block,part,replay", [(1 << 22, 1 << 20, 1 << 18), (40, 7, 20)])
def test_any_text_is_encoded_as_the_library_does(monkeypatch, block, part, replay):
    for name, value in (("BLOCK_CHARS", block), ("SLICE_CHARS", part), ("REPLAY_BYTES", replay), ("WORD_MEMO", 300 if block == 40 else 400_000)):
        monkeypatch.setattr(merge_replay, name, value)
    rng = random.Random(block)
    parts = ["'", "'re", "s", "e", "the ", "Word", " ", "   ", "\n\n", "\t", "1", "23", "é", "é", "İ", "ﬁ", "Σ", "日本", "日本語テキスト", "🙂", "...", "!?", " ", "a" * 30, " and", "<|endoftext|>", "\x1c", "\x85", "՘", "࢏", "𞤀", "ab", "abc", "bc", "xyxyx", "aaaa", "abab"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    texts += ["".join(rng.choice("abcdeéлатин") for _ in range(rng.randint(0, 300))) for _ in range(300)]
    fresh = merge_replay.MergeReplay()
    assert fresh.encode(texts) == [want(t) for t in texts]
    assert all(fresh.decode(want(t)) == t.encode() for t in texts)


def test_classes_are_the_librarys():
    for c in range(0x80, 0x110000, 7):
        if not 0xD800 <= c < 0xE000:
            text = f"a{chr(c)}a 1{chr(c)}1 .{chr(c)}."
            assert REPLAY.split(text) == _pieces(text)


def _pieces(text):
    """The library's words: where bytes alone are tokens, a word's end shows as a gap in a pattern of its own."""
    rule = _pieces.rules.setdefault("rule", {})
    out = []
    for name, pattern in (("L", r"\p{L}"), ("N", r"\p{N}"), ("s", r"\s")):
        if name not in rule:
            e = tiktoken.Encoding("x", pat_str=pattern, mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
            rule[name] = set(bytes(e.encode_ordinary("".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000))).decode())
    kind = lambda c: next((k for k in "LNs" if c in rule[k]), "o")
    i = 0
    while i < len(text):
        start = i
        if text[i] == " " and i + 1 < len(text) and kind(text[i + 1]) != "s":
            i += 1
        if kind(text[i]) == "s":
            while i < len(text) and kind(text[i]) == "s":
                i += 1
            if i < len(text) and i - start > 1:
                i -= 1
        else:
            k = kind(text[i])
            while i < len(text) and kind(text[i]) == k:
                i += 1
        out.append(text[start:i])
    return out


_pieces.rules = {}


def test_merges_keep_the_order_of_their_word():
    # after the first "ab" a pair of lower rank stands beside it, which has to go before the second "ab"
    ranks = {bytes([b]): b for b in range(256)} | {b"abc": 256, b"cab": 257, b"ab": 258, b"cabc": 259}
    own = merge_replay.MergeReplay(ranks=ranks)
    library = tiktoken.Encoding("own", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(3)
    words = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 40))) for _ in range(500)]
    got = own.replay([w.encode() for w in words])
    assert all(x.tolist() == library.encode_ordinary(w) for x, w in zip(got, words, strict=True) if w.encode() not in ranks)
