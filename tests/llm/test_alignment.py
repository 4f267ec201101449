from __future__ import annotations

import bisect
import hashlib
import random
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from jobloom.llm import alignment

from .helpers import ROWS, SF, documents

A = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def byte_of():
    """The characters by which a byte-level vocabulary writes bytes: printable ones are themselves, the others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


BYTE = byte_of()


def groups_of(text):
    """Groups by the ends that both sides have, from the libraries alone."""
    if not text:
        return []
    a, b = A.encode(" " + text, add_special_tokens=False).ids, B.encode(text)
    a_bytes = [bytes(BYTE[c] for c in A.id_to_token(i)) for i in a]
    b_bytes = [bytes([int(B.id_to_piece(i)[1:-1], 16)]) if B.is_byte(i) else B.id_to_piece(i).replace("▁", " ").encode() for i in b]
    if not b"".join(a_bytes) == b"".join(b_bytes) == (" " + text).encode():
        return []
    ends = []
    for parts in (a_bytes, b_bytes):
        at, own = 0, []
        for x in parts:
            at += len(x)
            own.append(at)
        ends.append(own)
    common = sorted(set(ends[0]) & set(ends[1]))
    found = [([], []) for _ in common]
    for side, (ids, own) in enumerate(zip((a, b), ends, strict=True)):
        for i, e in zip(ids, own, strict=True):
            found[bisect.bisect_left(common, e)][side].append(i)
    return found


def brute(rows):
    groups = [(i, groups_of(t)) for i, t in rows]
    linked = [Counter((x, y) for a, b in g for x in a for y in b) for _, g in groups]
    count = Counter(p for c in linked for p in c)
    top = defaultdict(int)
    for (x, _), n in count.items():
        top[x] = max(top[x], n)
    out = Counter()
    for (i, g), c in zip(groups, linked, strict=True):
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g)
        digest = hashlib.sha256(text.encode()).hexdigest() if g else ""
        out[i, sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), sum(c.values()), sum(n for p, n in c.items() if count[p] == top[p[0]]), sum(n * count[p] for p, n in c.items()), digest] += 1
    return out


def test_query_equals_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert Counter(tuple(r) for r in alignment.op11_alignment(spark, SF).collect()) == brute(rows)


@pytest.mark.parametrize("chars,group", [(1 << 22, 1 << 12), (50, 4)])
def test_alignment_of_odd_rows(spark, monkeypatch, chars, group):
    monkeypatch.setattr(alignment, "BLOCK_CHARS", chars)
    monkeypatch.setattr(alignment, "GROUP_LINKS", group)
    monkeypatch.setattr(alignment, "LINKS", 16)
    rng = random.Random(5)
    rows = [*ROWS, (70, "x" * 5000), (71, "".join(rng.choice("abcdefghij0123456789") for _ in range(3000))), (72, "▁ a"), (73, " lead"), (74, "日本" * 500), (75, "\n\n\n a  b\t"), (76, "<0x41> <unk> <s>")]
    assert Counter(tuple(r) for r in alignment.link_statistics(documents(spark, rows)).collect()) == brute(rows)


def test_no_rows_and_no_tokens(spark):
    assert alignment.link_statistics(documents(spark, [])).count() == 0 and alignment.align_tokens(documents(spark, [])).count() == 0
    rows = alignment.link_statistics(documents(spark, [(1, None), (2, ""), (3, "▁")])).collect()
    assert sorted(map(tuple, rows)) == [(i, 0, 0, 0, 0, 0, 0, "") for i in (1, 2, 3)]


def test_a_very_long_text_is_whole(spark):
    text = " " * 1_000_000 + "b " + "x" * 200_000
    (row,) = alignment.align_tokens(documents(spark, [(1, text)])).collect()
    assert row.a_ids == A.encode(" " + text, add_special_tokens=False).ids and row.b_ids == B.encode(text)
    assert row.a_ends[-1] == len(row.a_ids) and row.b_ends[-1] == len(row.b_ids)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=60), st.data())
def test_transducer_closes_groups_where_both_end(cuts, data):
    tokens = [b"a", b"aa", b"aaa", b"ab", b"b"]
    transducer = alignment.Transducer(tokens, tokens)
    whole = b"".join(tokens[i] for i in cuts)
    other, at = [], 0
    while at < len(whole):
        fits = [i for i, t in enumerate(tokens) if whole.startswith(t, at)]
        other.append(data.draw(st.sampled_from(fits)))
        at += len(tokens[other[-1]])
    ends = []
    for ids in (cuts, other):
        at, own = 0, {0: 0}
        for k, i in enumerate(ids):
            at += len(tokens[i])
            own[at] = k + 1
        ends.append(own)
    common = sorted((ends[0].keys() & ends[1].keys()) - {0})
    assert transducer.groups(cuts, other) == ([ends[0][e] for e in common], [ends[1][e] for e in common])


def test_transducer_rejects_other_bytes():
    transducer = alignment.Transducer([b"a", b"bc"], [b"ab", b"c", b"x"])
    assert transducer.groups([0, 1], [0, 1]) == ([2], [2])
    for a, b in (([0, 1], [0, 2]), ([0], [0]), ([0, 0], [0])):
        with pytest.raises(ValueError):
            transducer.groups(a, b)
