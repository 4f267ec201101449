from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from jobloom.llm import components, exact_dedup, jaccard_join, run_index, shingles, suffix_dedup
from jobloom.llm.common import text_buffer

from .helpers import ROWS, SF, documents


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


@pytest.mark.parametrize("partitions", [1, 3, 17])
def test_exact_copies_of_odd_rows(spark, partitions):
    got = exact_dedup.exact_dedup(documents(spark), partitions=partitions).select("doc_id", "text", "keep_id", "group_size", "kept").collect()
    assert len(got) == len(ROWS)
    groups = {}
    for i, t in ROWS:
        groups.setdefault(lower(t), []).append(i)
    for r in got:
        ids = groups[lower(r.text)]
        assert r.group_size == len(ids)
        assert r.keep_id == max((i for i in ids if i is not None), default=None)
    assert Counter(lower(r.text) for r in got if r.kept) == Counter(dict.fromkeys(groups, 1))


def test_a_hot_text_is_spread_and_still_one_group(spark):
    rows = [(i, "same text again") for i in range(3000)] + [(5000 + i, f"own {i}") for i in range(500)]
    got = exact_dedup.exact_dedup(documents(spark, rows, clash=False), carry_text=False, partitions=12).collect()
    hot = [r for r in got if r.group_size > 1]
    assert len(hot) == 3000 and {r.keep_id for r in hot} == {2999} and sum(r.kept for r in hot) == 1
    assert all(r.kept for r in got if r.group_size == 1)


def test_empty_tables(spark):
    none = documents(spark, [])
    assert exact_dedup.exact_dedup(none).count() == 0
    assert suffix_dedup.suffix_dedup(none).count() == 0
    assert jaccard_join.jaccard_components(none).count() == 0


def sets_of(rows, words):
    out = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
        out.append(frozenset(tuple(w[i : i + words]) for i in range(len(w) - words + 1)) if len(w) >= words else frozenset([tuple(w)] if w else []))
    return out


def brute_components(rows, percent, words):
    sets = sets_of(rows, words)
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            k = len(a & b)
            if a and b and 100 * k >= percent * (len(a) + len(b) - k):
                root[find(i)] = find(j)
    names = {}
    for i, (doc_id, _) in enumerate(rows):
        names.setdefault(find(i), []).append(doc_id)
    smallest = {r: min((x for x in ids if x is not None), default=None) for r, ids in names.items()}
    return Counter((rows[i][0], len(sets[i]), smallest[find(i)]) for i in range(len(rows)))


@pytest.mark.parametrize("percent,words", [(90, 3), (80, 5)])
def test_near_copies_equal_brute_force(spark, percent, words):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = list(ROWS)
    for g in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([2, 5, 30, 120]))]
        for _ in range(rng.choice([1, 2, 12])):
            own = list(base)
            for _ in range(rng.choice([0, 1, 2, 4])):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            rows.append((100 + len(rows), " ".join(own)))
    # words whose sums of powers modulo 2 ** 64 are equal whatever the base
    thue = ["".join("ab"[(i.bit_count() + k) % 2] for i in range(2048)) for k in (0, 1)]
    # words that collide under an unkeyed mix of eight bytes at a time
    probe = ["pqzpsgilaaaaaaab", "rlzmjfwqwyyeidpx"]
    rows += [(710, probe[0]), (711, probe[1]), (712, f"some {probe[0]} words here"), (713, f"some {probe[1]} words here")]
    rows += [(700, thue[0]), (701, thue[1]), (702, " ".join(["x", thue[0], "y", "z", "q"])), (703, " ".join(["x", thue[1], "y", "z", "q"]))]
    # a chain: neighbours are alike, its ends aren't
    chain = [f"c{i}" for i in range(140)]
    rows += [(900 + k, " ".join(chain[k * 2 : k * 2 + 100])) for k in range(20)]
    got = Counter(tuple(r) for r in jaccard_join.jaccard_components(documents(spark, rows), percent=percent, words=words).collect())
    assert got == brute_components(rows, percent, words)


def test_word_hashes_tell_words_apart():
    rng = random.Random(11)
    words = {"".join(rng.choice("abé😀") for _ in range(rng.choice([1, 2, 7, 8, 9, 15, 16, 17, 63, 64, 65, 200]))) for _ in range(5000)}
    words |= {"".join("ab"[(i.bit_count() + k) % 2] for i in range(n)) for k in (0, 1) for n in (16, 64, 512, 2048)}
    text = pa.array([" ".join(w.upper() for w in words), "\t".join(words)])
    data, at = text_buffer(text)
    made, of = shingles.word_hashes(data, at, (1, 2))
    # É isn't lower-cased, all else is
    assert len(set(made[of == 1].tolist())) == len(words) and made[of == 0].size == made[of == 1].size
    plain = np.array(["é" not in w for w in words])
    assert (made[of == 0] == made[of == 1])[plain].all()


def sip13(data, key):
    """SipHash-1-3, a word at a time."""
    top = (1 << 64) - 1
    turned = lambda x, n: (x << n | x >> (64 - n)) & top
    v = [c ^ key[i % 2] for i, c in enumerate(shingles.SIP_START)]

    def mix():
        v[0] = (v[0] + v[1]) & top
        v[1] = turned(v[1], 13) ^ v[0]
        v[0] = turned(v[0], 32)
        v[2] = (v[2] + v[3]) & top
        v[3] = turned(v[3], 16) ^ v[2]
        v[0] = (v[0] + v[3]) & top
        v[3] = turned(v[3], 21) ^ v[0]
        v[2] = (v[2] + v[1]) & top
        v[1] = turned(v[1], 17) ^ v[2]
        v[2] = turned(v[2], 32)

    whole = len(data) // 8 * 8
    for m in [*(int.from_bytes(data[i : i + 8], "little") for i in range(0, whole, 8)), int.from_bytes(data[whole:], "little") | (len(data) & 255) << 56]:
        v[3] ^= m
        mix()
        v[0] ^= m
    v[2] ^= 255
    for _ in range(3):
        mix()
    return v[0] ^ v[1] ^ v[2] ^ v[3]


def test_word_hashes_are_keyed():
    words = ["a" * n for n in range(1, 65)] + ["pqzpsgilaaaaaaab", "rlzmjfwqwyyeidpx"]
    data, at = text_buffer(pa.array([" ".join(words)]))
    for key in ((0, 0), (5, 1 << 63), shingles.new_key()):
        made, _ = shingles.word_hashes(data, at, key)
        assert made.tolist() == [sip13(w.encode(), key) for w in words]
    assert shingles.new_key() != shingles.new_key()
    one, two = (shingles.word_hashes(*text_buffer(pa.array(["x" * 100])), (k, 0))[0][0] for k in (1, 2))
    assert one != two


def test_a_set_in_very_many_pairs_is_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "SET_PAIRS", 3)
    monkeypatch.setattr(jaccard_join, "LIST_ROWS", 2)
    words = [f"w{i}" for i in range(60)]
    rows = [(k, " ".join([*words, f"own{k}"])) for k in range(40)] + [(100 + k, " ".join([f"v{k}{i}" for i in range(9)])) for k in range(5)]
    got = Counter(tuple(r) for r in jaccard_join.jaccard_components(documents(spark, rows)).collect())
    assert got == brute_components(rows, 90, 3)


@pytest.mark.parametrize("most", [None, 1])
def test_the_filter_only_saves_work(spark, monkeypatch, most):
    if most:
        monkeypatch.setattr(jaccard_join, "FILTER_MOST", most)  # too many ids for any filter
    rows = [(k, " ".join(f"w{i + k // 10}" for i in range(50))) for k in range(40)]
    got = Counter(tuple(r) for r in jaccard_join.jaccard_components(documents(spark, rows)).collect())
    assert got == brute_components(rows, 90, 3)


def test_prefixes_meet_the_condition():
    rng = np.random.default_rng(3)
    frequency = rng.random(1 << jaccard_join.SKETCH_BITS) * 3
    for _ in range(300):
        n = int(rng.integers(1, 200))
        a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2))
        k = int(rng.integers(0, max(1, len(a) // 8) + 1))
        b = np.unique(np.concatenate([a[k:], rng.integers(0, 1 << 63, int(rng.integers(0, 3))).astype(np.uint64)]))
        both = len(np.intersect1d(a, b))
        if not len(b) or 100 * both < 90 * (len(a) + len(b) - both):
            continue
        (la, pa), (lb, pb) = (jaccard_join.prefix(x, frequency, 90) for x in (a, b))
        assert len(np.intersect1d(pa, pb)) >= min(la, lb)


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, i) for i in range(1001, 1200)] + [(7, 7), (5, 4)]
    got = {r.v: r.root for r in components.connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {i: 0 for i in range(61)} | {i: 1000 for i in range(1000, 1200)}


def test_run_index_equals_brute_force():
    rng = random.Random(1)
    for _ in range(200):
        alphabet = [0, 1, 97, 98, 255][: rng.choice([1, 2, 4, 5])]
        data = bytes(rng.choice(alphabet) for _ in range(rng.randint(1, 80)))
        text = np.frombuffer(data, np.uint8)
        order = sorted(range(len(data)), key=lambda i: data[i:])
        assert run_index.suffix_order(text).tolist() == order
        source, length = run_index.matching_statistics(run_index.build(text), text)
        for k, i in enumerate(order):
            if not k:
                assert source[i] == -1 and length[i] == 0
                continue
            j = order[k - 1]
            n = next((c for c in range(len(data)) if max(i, j) + c >= len(data) or data[i + c] != data[j + c]), 0)
            assert (source[i], length[i]) == (j, n)


@pytest.mark.parametrize("few", [0, 64])
def test_common_prefixes_equal_brute_force(monkeypatch, few):
    monkeypatch.setattr(run_index, "FEW", few)
    rng = random.Random(2)
    for size in (0, 1, 7, 8, 9, 40, 700):
        part = bytes(rng.choice((0, 97, 255)) for _ in range(size // 2))
        data = part + bytes([98]) * (size % 2) + part
        a, b = (np.array([rng.randint(0, size) for _ in range(300)] + [0]) for _ in range(2))
        b[-1] = size - len(part)  # a match that goes to the end
        differ = a != b
        a, b = a[differ], b[differ]
        want = [next((k for k in range(size) if max(i, j) + k >= size or data[i + k] != data[j + k]), 0) for i, j in zip(a.tolist(), b.tolist(), strict=True)]
        assert run_index.common_length(np.frombuffer(data, np.uint8), a, b).tolist() == want


def test_long_repeats_are_ordered_in_few_sorts(monkeypatch):
    rng = random.Random(3)
    passage = bytes(rng.choice(b"abcdefghijklmnopqrstuvwxyz ,.") for _ in range(2000))
    data = b"".join(passage + bytes([k]) for k in (1, 255, 2))
    sorts, keep = [], np.argsort
    monkeypatch.setattr(np, "argsort", lambda x, *more, **named: sorts.append(len(x)) or keep(x, *more, **named))
    assert run_index.suffix_order(np.frombuffer(data, np.uint8)).tolist() == sorted(range(len(data)), key=lambda i: data[i:])
    assert len(sorts) <= 7  # by doubling from seven bytes: ten


def test_order_of_more_bytes_than_three_ranks_fit_for():
    rng = np.random.default_rng(4)
    part = rng.integers(97, 123, 700_000).astype(np.uint8)
    text = np.concatenate([part, part[:-1], part[5:], np.full(3000, 97, np.uint8)])
    assert (len(text) + 1) ** 3 >= 1 << 63
    order = run_index.suffix_order(text)
    assert np.array_equal(np.sort(order), np.arange(len(text)))
    rank = np.full(len(text) + 1, -1)
    rank[order] = np.arange(len(text))
    a, b = order[:-1], order[1:]
    assert ((text[a] < text[b]) | (text[a] == text[b]) & (rank[a + 1] < rank[b + 1])).all()


def brute_repeats(rows, least=suffix_dedup.LEAST):
    def place(row):
        text = (row[1] or "").encode()
        d = hashlib.blake2b(text, digest_size=16).digest()
        return row[0] is not None, row[0] or 0, int.from_bytes(d[:8], "big", signed=True), int.from_bytes(d[8:], "big", signed=True)

    seen, out = set(), []
    for i, text in ((i, (t or "").encode()) for i, t in sorted(rows, key=place)):
        gone = bytearray(len(text))
        for j in range(len(text) - least + 1):
            part = text[j : j + least]
            if part in seen:
                gone[j : j + least] = b"\1" * least
            seen.add(part)
        kept = bytes(c for c, g in zip(text, gone, strict=True) if not g)
        out.append((i, len(text), sum(gone), sum(map(bool, bytes(gone).split(b"\0"))), hashlib.sha256(kept).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("heavy,anchors,block", [(20_000, 200_000, 1 << 21), (2, 3, 1 << 21), (0, 50_000, 20_000), (9, 20, 6_000), (0, 50_000, 0)])
def test_repeated_strings_equal_brute_force(spark, monkeypatch, heavy, anchors, block):
    monkeypatch.setattr(suffix_dedup, "HEAVY_ANCHORS", heavy)
    monkeypatch.setattr(suffix_dedup, "OWNER_ANCHORS", anchors)
    monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", block)
    rng = random.Random(9)
    letters = "abcdefghij \n"
    passages = ["".join(rng.choice(letters) for _ in range(rng.choice([99, 100, 101, 250, 900]))) for _ in range(6)]
    rows = list(ROWS)
    for k in range(60):
        rows.append((200 + k, "".join(rng.choice([rng.choice(passages), "".join(rng.choice(letters) for _ in range(rng.randint(0, 90)))]) for _ in range(rng.randint(1, 4)))))
    got = Counter(tuple(r)[:5] for r in suffix_dedup.suffix_dedup(documents(spark, rows)).collect())
    assert got == brute_repeats(rows)


def test_rows_alike_in_different_partitions_are_kept_once(spark):
    rng = random.Random(6)
    word = "".join(rng.choice("abcdefghij ") for _ in range(400))
    rows = [(i, word) for i in (None, None, 3, 3, 3, 4)] + [(9, "short")] * 3
    docs = spark.createDataFrame(spark.sparkContext.parallelize(rows, len(rows)), "doc_id bigint, text string")
    # a broadcast join that reads each task's rows apart
    conf = {"spark.sql.shuffle.partitions": "32", "spark.sql.autoBroadcastJoinThreshold": "100m", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    was = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        got = Counter(tuple(r)[:5] for r in suffix_dedup.suffix_dedup(docs).collect())
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
    assert got == brute_repeats(rows)


def test_many_texts_under_one_id_stay_apart(spark):
    # two texts whose digests agree in 30 bits, as some two among 30,000 texts of an id do
    seen, rng = {}, random.Random(12)
    for i in range(1 << 20):
        text = f"{i} " + "".join(chr(97 + (i * k + k * k) % 26) for k in range(1, 110))
        other = seen.setdefault(suffix_dedup._digest(text.encode())[0] & ((1 << 30) - 1), text)
        if other != text:
            break
    rows = [(None, x) for x in (text, other, text)] + [(None, "".join(rng.choice("abcdef") for _ in range(150))) for _ in range(40)]
    rows += [(7, rows[5][1]), (7, rows[6][1] + "z"), (7, other)]
    got = Counter(tuple(r)[:5] for r in suffix_dedup.suffix_dedup(documents(spark, rows)).collect())
    assert got == brute_repeats(rows)


@pytest.mark.parametrize("block", [1 << 22, 0])
def test_the_smallest_id_is_no_null(spark, monkeypatch, block):
    monkeypatch.setattr(suffix_dedup, "HEAVY_ANCHORS", 0)
    monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", block)
    rng = random.Random(4)
    a, b = ("".join(rng.choice("abcdef ") for _ in range(300)) for _ in range(2))
    rows = [(-(1 << 63), a + "x"), (None, "y" + a), (0, a + b), (None, b), (-(1 << 63), b), (0, None)]
    got = Counter(tuple(r)[:5] for r in suffix_dedup.suffix_dedup(documents(spark, rows)).collect())
    assert got == brute_repeats(rows)


def test_a_varied_passage_is_settled_by_digests(spark, monkeypatch):
    # one passage with a field that differs everywhere: no two documents are alike, and all belong to one group
    monkeypatch.setattr(suffix_dedup, "HEAVY_ANCHORS", 50)
    monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", 2_000)
    rng = random.Random(5)
    head, tail = ("".join(rng.choice("abcdefgh ") for _ in range(n)) for n in (120, 180))
    rows = [(k, f"{head}{rng.getrandbits(60):020d}{tail}") for k in range(400)]
    got = Counter(tuple(r)[:5] for r in suffix_dedup.suffix_dedup(documents(spark, rows)).collect())
    assert got == brute_repeats(rows)


def test_a_shared_passage_is_settled_within_tasks(spark, monkeypatch):
    # what goes on to the joins grows with the tasks, not with the documents that share the passage
    monkeypatch.setattr(suffix_dedup, "HEAVY_ANCHORS", 50)
    held, keep = {}, suffix_dedup.saved
    monkeypatch.setattr(suffix_dedup, "saved", lambda df, name="step": held.setdefault(name, keep(df, name)))
    rng = random.Random(8)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(3000))
    rows = [(k, f"{k} {passage} {rng.getrandbits(300):x}") for k in range(300)]
    got = Counter(tuple(r)[:5] for r in suffix_dedup.suffix_dedup(documents(spark, rows)).collect())
    assert got == brute_repeats(rows)
    whole = held["fragments"].filter("bytes is not null")
    pieces = whole.select("owner", "part", "fp1", "fp2").distinct().count()
    assert whole.count() <= pieces + 300
    assert held["fragments"].count() <= pieces + 3 * 300


def test_only_heavy_fragments_get_digests(monkeypatch):
    made, keep = [], suffix_dedup._digest
    monkeypatch.setattr(suffix_dedup, "_digest", lambda text: made.append(text) or keep(text))
    rng = random.Random(13)
    texts = [bytes(rng.choice(b"abcdef ") for _ in range(n)) for n in (90, 150, 2000)]
    # (owner, part, pos) of each text; 1,990 is near its end, and 290 near enough to 130 to touch
    marks = [[(5, -1, 20)], [(6, -1, 140), (5, -1, 0)], [(6, -1, 290), (5, 0, 1000), (6, -1, 130), (6, -1, 1990), (6, -1, 700), (5, 1, 1000)]]
    mark = pa.list_(pa.struct([("pos", pa.int64()), ("owner", pa.int64()), ("part", pa.int64())]))
    columns = [pa.array([True] * 3), pa.array([1, 2, 3]), pa.array([7, 8, 9]), pa.array([0] * 3), pa.array(map(len, texts)), pa.array(map(suffix_dedup.zstandard.ZstdCompressor().compress, texts)), pa.array([1] * 3)]
    columns.append(pa.array([[{"owner": o, "part": q, "pos": p} for o, q, p in m] for m in marks], mark))
    batch = pa.RecordBatch.from_arrays(columns, ["known", "d", "tie", "lo", "n", "z", "m", "marks"])
    got = [r for some in ([batch], [batch.slice(0, 0), batch.slice(0, 1), batch.slice(1)]) for b in suffix_dedup._fragment_rows(iter(some)) for r in b.to_pylist()]
    assert all(r["bytes"] == texts[r["d"] - 1][r["start"] : r["stop"]] for r in got)
    light = Counter((r["owner"], r["d"], r["start"], r["stop"]) for r in got if r["part"] < 0)
    assert light == Counter(dict.fromkeys([(5, 1, 0, 90), (5, 2, 0, 100), (6, 2, 72, 150), (6, 3, 62, 390), (6, 3, 632, 800), (6, 3, 1922, 2000)], 2))
    heavy = [r for r in got if r["part"] >= 0]
    assert {(r["part"], min(x["start"] for x in heavy if x["part"] == r["part"]), max(x["stop"] for x in heavy if x["part"] == r["part"])) for r in heavy} == {(0, 932, 1100), (1, 932, 1100)}
    assert len(made) == len(heavy)


def test_groups_are_indexed_whole_and_few_at_a_time(monkeypatch):
    held = []
    monkeypatch.setattr(suffix_dedup, "repeated_spans", lambda fragments: held.append(fragments) or [])
    columns = [[g for g in range(400) for _ in range(2)], [-1] * 800, [True] * 800, [*range(800)], [0] * 800, [0] * 800, [0] * 800, [bytes([97 + g % 20]) * 1000 for g in range(400) for _ in range(2)]]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["owner", "part", *suffix_dedup.KEY, "start", "bytes"])
    assert not list(suffix_dedup._span_rows(iter([batch.slice(0, 333), batch.slice(333)])))
    assert [f[1] for fragments in held for f in fragments] == [*range(800)]
    assert all(len(fragments) % 2 == 0 for fragments in held)
    # an order of more suffixes costs more for each of them
    assert max(sum(len(f[-1]) for f in fragments) for fragments in held) < 140_000


def test_every_string_holds_an_anchor():
    rng = np.random.default_rng(2)
    data = rng.integers(97, 101, 100_000).astype(np.uint8)
    at = np.array([0, 50, 149, 40_000, 40_000, 100_000])
    place, _ = suffix_dedup.anchors(data, at)
    for a, b in zip(at[:-1], at[1:], strict=True):
        inside = place[(place >= a) & (place < b)] - a
        gaps = np.diff(np.concatenate([[-1], inside, [b - a - suffix_dedup.K + 1]])) if b - a >= suffix_dedup.LEAST else [0]
        assert max(gaps) <= suffix_dedup.LEAST - suffix_dedup.K + 1


def test_query_over_the_smallest_tables(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = Counter(tuple(r) for r in suffix_dedup.op2_suffix_dedup(spark, SF).collect())
    assert got == brute_repeats(rows)
    got = Counter(tuple(r) for r in jaccard_join.op4_jaccard_join(spark, SF).collect())
    assert got == brute_components(rows, 90, 3)
