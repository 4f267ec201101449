from __future__ import annotations

import datetime
import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from jobloom.llm import bpe, chat, packing, pii, syncmers, toxicity, warc

from .helpers import ROWS, SF, documents

# --- toxicity


@pytest.mark.parametrize("folder,least,recall", [("/root/testdata/sf0.01", 0.8, 0.3), ("/root/testdata/sf0.1", 0.95, 0.8)])
def test_toxicity_on_held_out_rows(spark, folder, least, recall):
    got = toxicity.op1_toxicity(spark, folder).collect()
    label = {r.doc_id: r.toxic for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    held = [(r.score, label[r.doc_id]) for r in got if r.held_out and r.doc_id in label]
    good, bad = [s for s, y in held if not y], [s for s, y in held if y]
    area = sum((b > g) + 0.5 * (b == g) for b in bad for g in good) / (len(bad) * len(good))
    assert area > least
    assert sum(s >= 0.5 for s in good) <= 0.03 * len(good)
    assert sum(s >= 0.5 for s in bad) >= recall * len(bad), (area, len(bad))


def test_fitting_in_spark_equals_fitting_in_memory(spark):
    rng = random.Random(13)
    rows = [(" ".join(rng.choice(["fine", "day", "idiot", "fool", "word", "sun"][2 * y : 4 + 2 * y]) for _ in range(rng.randint(0, 9))), y) for y in (0, 1) for _ in range(60)] + [(None, 0), (None, 0), ("odd", None)]
    model = toxicity.fit_toxicity(spark.createDataFrame(rows, "text string, label int").repartition(5))
    known = [(t, y) for t, y in rows if y is not None]
    want = toxicity.fit_arrays([t for t, _ in known], np.array([y for _, y in known]))
    assert np.array_equal(model.buckets, want.buckets) and len(want.buckets) and np.allclose(model.weights, want.weights) and abs(model.bias - want.bias) < 1e-9
    # the ratio of an n-gram, counted by hand: rows of each label that have it
    chosen = toxicity.choose(toxicity.count_buckets(iter(known)))
    bucket = chosen.buckets[0]
    have = [sum(y == label and any(bucket in x for x in toxicity.ngram_buckets(t)) for t, y in known) for label in (0, 1)]
    n = [sum(y == label for _, y in known) for label in (0, 1)]
    assert chosen.weights[0] == pytest.approx(np.log((have[1] + 1) / (n[1] + 2) / ((have[0] + 1) / (n[0] + 2))), rel=1e-4)


def test_toxicity_of_odd_rows(spark):
    model = toxicity.fit_arrays(["you idiot fool"] * 6 + ["a fine day"] * 9 + [None, ""], np.array([1] * 6 + [0] * 11))
    rows = toxicity.score_toxicity(documents(spark, [*ROWS, (50, "what an idiot fool"), (51, "a" * 3_000_000)]), model).collect()
    assert len(rows) == len(ROWS) + 2
    score = {r.doc_id: r.score for r in rows}
    assert score[50] > 0.5 > score[1] and score[5] == score[4]
    empty = toxicity.fit_toxicity(spark.createDataFrame([], "text string, label int"))
    assert not len(empty.buckets) and toxicity.score_toxicity(documents(spark), empty).filter("predicted = 1").count() == 0


def test_training_rows_are_bounded_by_rows(spark):
    docs = spark.createDataFrame([(2, f"text {k}") for k in range(50)] + [(3, None), (None, "no id")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(2, 1), (2, 1), (3, 0), (None, 1)], "doc_id bigint, toxic int")
    assert sorted(map(tuple, toxicity.training_rows(docs, labels).collect()), key=str) == [("text 0", 1), (None, 0)]


def test_n_grams_do_not_depend_on_blocks(monkeypatch):
    text = "".join(random.Random(4).choice("abcdeé ") for _ in range(5000))
    whole = set(np.concatenate(list(toxicity.ngram_buckets(text))).tolist())
    monkeypatch.setattr(toxicity, "BLOCK", 97)
    assert set(np.concatenate(list(toxicity.ngram_buckets(text))).tolist()) == whole


# --- WARC


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("*", "'clash' as payload", "'clash' as digest", "'clash' as id")


def test_warc_round_trip_in_small_ranges(spark, tmp_path):
    rng = random.Random(3)
    long = "".join(rng.choice("<>abc é") for _ in range(200_000))
    rows = [(1, "http://a/ b\n", "x" * 100), (2, None, "x" * 100), (3, "http://c/é", "x" * 99), (4, "u", "x" * 99), (5, "u", None), (6, "u", ""), (7, "u", long), (8, "u", long), (8, "u", long), (None, "u", long), (9, "u", "\x1f\x8b\x08 no member" * 20)]
    rows += [(100 + i, f"http://h/{i}", "".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 3000)))) for i in range(80)]
    warc.write_warc(pages(spark, rows), f"file://{tmp_path}/w")
    for split in (1 << 10, 5_000, 1 << 26):
        got = warc.read_warc(spark, f"file://{tmp_path}/w", split_bytes=split).collect()
        assert len(got) == len(rows) and all(r.intact for r in got)
        for r in got:
            if r.record_type == "response":
                assert hashlib.sha256(r.payload).hexdigest() == r.payload_digest and len(r.payload) == r.payload_bytes
        by_id = {}
        for r in got:
            by_id.setdefault(None if r.record_id is None else int(r.record_id), []).append((r.record_type, r.refers_to))
        assert by_id[2] == [("revisit", "1")] and by_id[4] == [("response", None)] and by_id[6] == [("response", None)]
        assert by_id[8] == [("revisit", "7")] * 2 and by_id[None] == [("response", None)]
        want = {i: (h or "").encode() for i, _, h in rows if i is not None}
        assert all(hashlib.sha256(want[int(r.record_id)]).hexdigest() == r.payload_digest for r in got if r.record_id is not None)


def test_warc_files_are_plain_gzip(spark, tmp_path):
    import gzip
    from pathlib import Path

    warc.write_warc(pages(spark, [(i, "u", f"<p>{i}</p>" * 30) for i in range(20)]), f"file://{tmp_path}/w")
    text = b"".join(gzip.decompress(p.read_bytes()) for p in Path(tmp_path, "w").glob("part-*"))
    assert text.count(b"WARC/1.1\r\n") == 20


def test_warc_ranges_are_dealt_out(spark, tmp_path):
    from pyspark.sql import functions as F

    rng = random.Random(5)
    rows = [(i, "u", "".join(rng.choice("abcdefgh ") for _ in range(2000))) for i in range(300)]
    warc.write_warc(pages(spark, rows).coalesce(1), f"file://{tmp_path}/w")
    got = warc.read_warc(spark, f"file://{tmp_path}/w", split_bytes=16_000)
    spread = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(spread) == 300 and len(spread) > 8 and max(spread) < 60


def test_warc_members_within_a_payload_are_none_of_the_archive(tmp_path):
    import zlib as z

    import pyarrow.fs as pafs

    rng = random.Random(6)

    def record(i, payload, level=4):
        head = f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:record:{i}>\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
        pack = z.compressobj(level, z.DEFLATED, 31)
        return pack.compress(head + payload + b"\r\n\r\n") + pack.flush()

    inner = b"".join(record(f"in{k}", rng.randbytes(rng.choice([10, 3000]))) for k in range(40))
    whole = [record(k, rng.randbytes(rng.choice([50, 4000, 30_000]))) for k in range(30)]
    whole[3] = record(3, rng.randbytes(500) + inner + rng.randbytes(100), level=0)
    whole[20] = record(20, inner, level=0)
    whole[29] = record(29, inner[:30_000], level=0)
    data = b"".join(whole)
    starts = [len(b"".join(whole[:k])) for k in range(30)]
    for name, content, want in (("a", data, starts), ("b", data[:-20], starts[:-1])):  # the second breaks off in its last record
        (tmp_path / name).write_bytes(content)
        with pafs.LocalFileSystem().open_input_file(str(tmp_path / name)) as f:
            for split in (700, 5_000, 1 << 20):
                found = [at for lo in range(0, len(content), split) for at, _ in warc.members(f, lo, lo + split)]
                assert found == want


def test_warc_of_no_pages(spark, tmp_path):
    warc.write_warc(pages(spark, []), f"file://{tmp_path}/w")
    assert warc.read_warc(spark, f"file://{tmp_path}/w").count() == 0


# --- chat

texts = st.lists(st.sampled_from([*"a\\<|>tdone \n#é🙂", chat.OPEN, chat.CLOSE, chat.SAY, "<|endoftext|>"]), max_size=30).map("".join)
CODEC = chat.Codec()


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "<|say|>", ""]), texts), max_size=6))
def test_chat_masks_are_exact(turns):
    codec = CODEC
    formatted, spans = chat.render(turns)
    assert chat.parse(formatted) == turns
    ids = codec.encode(formatted)
    start, end = codec.spans(ids)
    mask = chat.loss_mask(start, end, spans)
    data = formatted.encode()
    assert end[-1] == len(data) if len(ids) else not data
    said = b"".join(data[a:b] for a, b in zip(start[mask], end[mask], strict=True)).decode()
    assert chat.unescape(said) == "".join(t for r, t in turns if r == "assistant")


def test_chat_of_odd_rows(spark):
    rows = [(1, 2, "user", None), (1, 1, "assistant", "first"), (1, 1, None, "no role"), (None, 0, "user", "lost"), (None, None, "assistant", "lost too"), (2, 0, "assistant", "é" * 50_000), (2, 0, "assistant", "é" * 50_000)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").selectExpr("*", "'clash' as ids", "'clash' as mask", "'clash' as formatted")
    got = {r.conv_id: r for r in chat.read_back(chat.format_chat(df)).collect()}
    assert {k: (r.n_turns, r.loss_chars) for k, r in got.items()} == {1: (3, 5), None: (2, 8), 2: (2, 100_000)}
    assert chat.read_back(chat.format_chat(df.limit(0))).count() == 0


def test_chat_of_very_long_runs(spark):
    rows = [(i, k, role, t) for i, t in enumerate(LONG_RUNS) for k, role in enumerate(("user", "assistant"))]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    got = {r.conv_id: r for r in chat.read_back(chat.format_chat(df)).collect()}
    for i, t in enumerate(LONG_RUNS):
        assert (got[i].n_turns, got[i].loss_chars, got[i].loss_sha256) == (2, len(t), hashlib.sha256(t.encode()).hexdigest())
        assert got[i].turns_sha256 == hashlib.sha256(f"user\n{t}\nassistant\n{t}\n".encode()).hexdigest()


# --- PII

KEY = b"k"


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 10**20), st.data())
def test_permutation_and_its_inverse(size, data):
    x = data.draw(st.integers(0, size - 1))
    y = pii.permute(x, size, KEY, "t")
    assert 0 <= y < size and pii.permute(y, size, KEY, "t", inverse=True) == x


def test_permutation_is_one_to_one():
    for size in (1, 2, 3, 10, 100, 257):
        assert sorted(pii.permute(x, size, KEY, "t") for x in range(size)) == list(range(size))


VALUES = ["4111 1111 1111 1111", "4111-1111-1111-1111", "GB82 WEST 1234 5698 7654 32", "123-45-6789", "+1 (017) 555-7713", "144.137.247.239", "2021-02-28", "31.12.1999", "12/25/2001", "und.34@mail7.example.com", "04dbebab91ab85687d33eeaaf9ac699e1188f962"]


@pytest.mark.parametrize("value", VALUES)
def test_pseudonyms_keep_format_and_link(value):
    text, found = pii.pseudonymise(f"a {value}, and ({value}) b", KEY)
    (kind, new), (kind2, new2) = found
    assert new == new2 != value and kind == kind2 and text == f"a {new}, and ({new}) b"
    assert [c.isdigit() for c in new] == [c.isdigit() for c in value] or kind in ("ipv4", "secret", "email")
    assert pii.KINDS[kind][1](new, KEY, True) == value
    assert pii.pseudonymise(new, KEY)[1], "a pseudonym is valid itself"
    assert pii.pseudonymise(f"a {value}", b"other")[0] != f"a {new}"


@pytest.mark.parametrize("clean", ["4111111111111112", "2021-02-30", "300.1.1.1", "000-12-3456", "version 1.2.3", "in 1999 and 2024", "deadbeef", "a@b", "GB00 WEST 1234 5698 7654 32", "12345"])
def test_what_fails_validation_stays(clean):
    assert pii.pseudonymise(f"x {clean} y", KEY) == (f"x {clean} y", [])


CARD = "4111 1111 1111 1111"


@pytest.mark.parametrize(
    "text",
    ["{} 737", "{}-737", "{} 12/27", "{} 1", "{} 12/25/2001", "{}-12345", "737 {}", "12-{}", "order 12345 {} 12/27", "2021-02-30 {} 99", "{} {}", "{} 737 {}"]
    + [f"{{}} {n:03d}" for n in range(0, 1000, 37)],
)
@pytest.mark.parametrize("form", [CARD, CARD.replace(" ", ""), CARD.replace(" ", "-")])
def test_a_card_with_digits_around_it_is_found_and_links(text, form):
    alone = pii.pseudonymise(form, KEY)[0]
    got, found = pii.pseudonymise(f"pay {text.replace('{}', form)}, ok", KEY)
    assert alone != form and form not in got and ("card", alone) in found and got.count(alone) == text.count("{}")
    assert text.endswith("2001") or got == f"pay {text.replace('{}', alone)}, ok"


def test_what_follows_other_numbers_is_not_swallowed():
    for value, tail in (("BE68 5390 0754 7034", " THEN"), ("+44 20 7946 0951 1234", " 5678 9999"), ("123-45-6789", " 4111111111111112")):
        alone = pii.pseudonymise(value, KEY)[0]
        assert alone != value and pii.pseudonymise(f"x {value}{tail}", KEY)[0] == f"x {alone}{tail}"
    assert pii.pseudonymise("4111 1111 1111 1112 144.137.247.239", KEY)[1][0][0] == "ipv4"
    for other in ("190.137.223.204", "10.1.2.3", "12/25/2001", "123-45-6789", CARD):
        a, b = (pii.pseudonymise(x, KEY)[0] for x in ("+1 (826) 555-4081", other))
        assert pii.pseudonymise(f"+1 (826) 555-4081 {other}", KEY)[0] == f"{a} {b}"
    assert pii.pseudonymise(f"+1 {CARD}", KEY)[0] == f"+1 {pii.pseudonymise(CARD, KEY)[0]}"


def recognised(text):
    """Every valid value that stands between blanks, marks or the text's ends, found by trying all substrings."""
    edge = [i for i in range(len(text) + 1) if i in (0, len(text)) or text[i - 1] in " \n,;()" or text[i] in " \n,;()"]

    def luhn(d):
        return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0

    def valid(s):
        if re.fullmatch(r"\d{13,19}|\d{4} \d{4} \d{4} \d{4}|\d{4} \d{6} \d{5}|\d{4}-\d{4}-\d{4}-\d{4}", s):
            return luhn(re.sub(r"\D", "", s))
        if re.fullmatch(r"[A-Z]{2}\d{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)", s):
            flat = s.replace(" ", "")
            size = {"DE": 22, "GB": 22, "FR": 27, "BE": 16, "NO": 15}.get(flat[:2])
            return len(flat) == size and int("".join(str(int(c, 36)) for c in flat[4:] + flat[:4])) % 97 == 1
        if re.fullmatch(r"\d{3}-\d\d-\d{4}", s):
            return s[:3] not in ("000", "666") and s[0] != "9" and s[4:6] != "00" and s[7:] != "0000"
        if re.fullmatch(r"\d{1,3}(\.\d{1,3}){3}", s):
            return all(int(x) < 256 and str(int(x)) == x for x in s.split("."))
        for pattern, form in ((r"\d{4}-\d\d-\d\d(?:T\d\d:\d\d:\d\dZ)?", "%Y-%m-%d"), (r"\d\d\.\d\d\.\d{4}", "%d.%m.%Y"), (r"\d\d/\d\d/\d{4}", "%m/%d/%Y")):
            if re.fullmatch(pattern, s):
                try:
                    return 1900 <= datetime.datetime.strptime(s[:10], form).year < 2100
                except ValueError:
                    return False
        if re.fullmatch(r"[0-9a-f]{32,}|[0-9A-F]{32,}", s):
            return not s.isdigit() and not s.isalpha()
        return bool(re.fullmatch(r"[^\W_][\w.+%-]{0,63}@(?:[a-z0-9]+\.)+[a-z]{2,6}", s))

    return {text[a:b] for a in edge for b in edge if a < b <= a + 600 and valid(text[a:b])}


def test_no_valid_value_stays(capsys):
    rng = random.Random(21)
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))

    def made():
        def card(n=16, groups=None):
            d = digits(n - 1)
            d += pii.luhn_digit(d)
            return d if groups is None else " ".join(d[sum(groups[:i]) : sum(groups[: i + 1])] for i in range(len(groups)))

        def bank():
            country, size = rng.choice([("DE", 22), ("GB", 22), ("FR", 27), ("BE", 16), ("NO", 15)])
            body = ("WEST" if country == "GB" else "") + digits(size - 4 - 4 * (country == "GB"))
            check = 98 - int("".join(str(int(c, 36)) for c in body + country + "00")) % 97
            flat = f"{country}{check:02d}{body}"
            return flat if rng.random() < 0.5 else " ".join(flat[i : i + 4] for i in range(0, size, 4))

        day = datetime.date(rng.randint(1900, 2099), rng.randint(1, 12), rng.randint(1, 28))
        return rng.choice(
            [card(), card(groups=(4, 4, 4, 4)), card(15, (4, 6, 5)), card(rng.choice([13, 14, 19])), bank(), bank(), f"{digits(3)}-{digits(2)}-{digits(4)}",
             ".".join(str(rng.randint(0, 300)) for _ in range(4)), day.isoformat(), f"{day.isoformat()}T10:20:30Z", day.strftime("%d.%m.%Y"), day.strftime("%m/%d/%Y"), "2021-02-30",
             "".join(rng.choice("0123456789abcdef") for _ in range(rng.choice([31, 32, 40, 64, 130, 300]))), "".join(rng.choice("0123456789ABCDEF") for _ in range(rng.choice([32, 64]))),
             rng.choice(["a", "ü", "日本", "x.y+1", "und34", "é1"]) + "@" + rng.choice(["mail.de", "x1.co.uk"]), digits(rng.choice([1, 2, 3, 4, 5, 13, 16, 20])), "THIS", "word", "NO", "+49 30 1234567", "(017) 555-7713", "12/27"]
        )

    for _ in range(1500):
        text = "".join(made() + rng.choice([" ", " ", ", ", "; ", "\n", " (", ") "]) for _ in range(rng.randint(1, 6)))
        got, found = pii.pseudonymise(text, KEY)
        left = [x for x in recognised(text) if x in got]
        assert not left, (text, got, left)
        assert bool(found) == (got != text)


def test_no_address_stays_for_its_length_or_letters():
    for local in ("a" * 65, "x1" * 400, "o'brien", "a.b+c%d-e'f", "é" * 70, "1" * 200):
        text, found = pii.pseudonymise(f"to {local}@x.de, ok", KEY)
        ((kind, new),) = found
        assert kind == "email" and local not in text and text == f"to {new}@x.de, ok".replace("@x.de@x.de", "@x.de") and len(new) == len(local) + 5
        assert pii.email(new, KEY, True) == f"{local}@x.de"


def test_numbers_link_in_any_spelling():
    def digits(text):
        ((_, new),) = pii.pseudonymise(f"call {text}", KEY)[1]
        return re.sub(r"\D", "", new)

    for spellings in (["+49 30 1234567", "+49301234567", "+49-30-123-4567", "+49 (30) 1234567"], ["+420 601 123 456", "+420601123456"], ["+7 495 123 4567", "+74951234567"]):
        made = {digits(x) for x in spellings}
        assert len(made) == 1 and made.pop() not in {re.sub(r"\D", "", x) for x in spellings}
    home = [digits(x)[-10:] for x in ("+1 (555) 123-4567", "+15551234567", "(555) 123-4567", "555-123-4567", "555.123.4567")]
    assert len(set(home)) == 1 and home[0] != "5551234567"
    assert digits("+49 30 1234567")[:2] == "49" and digits("+420 601 123 456")[:3] == "420"


def test_values_in_other_digits_are_found():
    arabic = {ord(c): chr(0x660 + i) for i, c in enumerate("0123456789")}
    for value in ("4111 1111 1111 1111", "+49 30 1234567", "2021-02-28", "123-45-6789", "144.137.247.239"):
        alone = pii.pseudonymise(value, KEY)[0]
        text, found = pii.pseudonymise(f"x {value.translate(arabic)} y", KEY)
        assert alone != value and text == f"x {alone.translate(arabic)} y" and len(found) == 1
    assert pii.pseudonymise("x 4111 1111 1111 1112 y".translate(arabic), KEY)[1] == []


def test_what_is_reported_has_changed():
    for value in ("a@x.de", "ü@x.de", "日本@x.de", "1@x.de"):
        for k in range(60):
            text, found = pii.pseudonymise(value, b"%d" % k)
            assert text != value and found == [("email", text)] and pii.email(text, b"%d" % k, True) == value
    for size in (2, 3, 10, 257):
        moved = [pii.moved(x, size, KEY, "t") for x in range(size)]
        assert sorted(moved) == list(range(size)) and all(x != y for x, y in enumerate(moved))
        assert [pii.moved(y, size, KEY, "t", inverse=True) for y in moved] == list(range(size))
    # each digit of a long key depends on all of it
    one, two = (pii.secret("0a1b" * 64 + x, KEY) for x in ("c", "d"))
    assert sum(a == b for a, b in zip(one, two, strict=True)) < 40


def test_values_link_whatever_follows():
    for value, tails in (("+49 30 1234567", [", 2024", " 2024", " 1999.", "; call"]), ("2021-02-28", ["T10:00:00Z", " 10:00", ", x"]), ("BE68 5390 0754 7034", [" THIS", " THAT IS", ", x", " 12"])):
        alone = pii.pseudonymise(value, KEY)[0]
        assert all(pii.pseudonymise(value + x, KEY)[0] == alone + x for x in tails), value


def test_pii_of_odd_rows(spark):
    rows = pii.pii_pseudonyms(documents(spark, [*ROWS, (60, VALUES[0]), (61, "see " + VALUES[0])])).collect()
    by = Counter((r.doc_id, r.text) for r in rows)
    assert all(by[x] for x in ROWS) and len(rows) == len(ROWS) + 2
    a, b = (next(r for r in rows if r.doc_id == i) for i in (60, 61))
    assert b.text == "see " + a.text and a.pii == b.pii
    assert pii.pii_pseudonyms(documents(spark, [])).count() == 0


# --- packing


def check_pieces(rows, pieces, vocab_ids):
    want = Counter((i, len(x)) for i, x in zip((r[0] for r in rows), vocab_ids, strict=True))
    assert sum(p.length for p in pieces) == sum(map(len, vocab_ids))
    whole = Counter((p.doc_id, p.doc_tokens) for p in pieces if p.start == 0)
    assert whole == want
    windows = {}
    for p in pieces:
        windows.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for parts in windows.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert 0 < at <= packing.WINDOW
    return windows


def test_packing_of_odd_rows(spark):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = [*ROWS, (70, "word " * 40_000)]
    ids = [np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4") for _, t in rows]
    pieces = packing.pack_documents(documents(spark, rows)).collect()
    check_pieces(rows, pieces, ids)
    by_doc = {(i, len(x)): x for (i, _), x in zip(rows, ids, strict=True)}
    for p in pieces:
        x = by_doc[p.doc_id, p.doc_tokens]
        assert p.ids_crc32 == zlib.crc32(x[p.start : p.start + p.length].tobytes())
    assert packing.pack_documents(documents(spark, [])).count() == 0


LONG_RUNS = [" " * 1_000_000, "a" + " " * 1_000_000 + "b", "a" + "\n" * 1_000_000 + "b <|endoftext|> c", "\t" * 1_000_000 + " x", "a" + " \n" * 500_000]


def test_packing_of_very_long_runs(spark):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = list(enumerate(LONG_RUNS))
    ids = [np.array([*library.encode(t, add_special_tokens=False).ids, 0], "<u4") for _, t in rows]
    pieces = packing.pack_documents(documents(spark, rows)).collect()
    check_pieces(rows, pieces, ids)
    assert all(p.ids_crc32 == zlib.crc32(ids[p.doc_id][p.start : p.start + p.length].tobytes()) for p in pieces)


def test_packing_wastes_little(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    pieces = packing.pack_documents(docs, partitions=2).collect()
    length = Counter()
    for p in pieces:
        length[p.sequence_id] += p.length
    assert sum(map(packing.padding, length.values())) < 0.03 * sum(length.values())


def test_plan_is_optimal():
    rng = random.Random(8)
    for _ in range(40):
        at = np.unique(np.cumsum([0] + [rng.randint(1, 400) for _ in range(25)]))
        cost = np.array([0] + [rng.choice([0, 4, 24]) for _ in at[2:]] + [0])
        best = {int(at[0]): 0}
        for i, p in enumerate(at.tolist()[1:], 1):
            options = []
            for q in at.tolist()[:i]:
                if p - q <= packing.WINDOW:
                    pad = packing.WINDOW - (p - q)
                    options.append(best[q] + pad)
                    if p - q in (128, 256, 512):
                        options.append(best[q] + packing.SHORT_COST)
            best[p] = min(options) + int(cost[i])
        cuts = packing.plan(at, cost)
        total = 0
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            pad = packing.WINDOW - (b - a)
            total += min([pad] + [packing.SHORT_COST] * (b - a in (128, 256, 512))) + int(cost[at.tolist().index(b)])
        assert total == best[int(at[-1])]


def test_blocks_only_bound_memory():
    codec = packing.Codec()
    rng = random.Random(2)
    docs = [np.array([rng.randrange(50_000) for _ in range(rng.choice([1, 30, 700, 9000]))] + [0], np.uint32) for _ in range(60)]
    for block in (5_000, 1 << 19):
        packer = packing.Packer(codec.ends, block=block)
        pieces = [p for i, x in enumerate(docs) for p in packer.add(i, x)] + list(packer.flush())
        rebuilt = {}
        for p in pieces:
            assert p.start == rebuilt.get(p.doc_id, 0) and zlib.crc32(docs[p.doc_id][p.start : p.start + p.length].tobytes()) == p.ids_crc32
            rebuilt[p.doc_id] = p.start + p.length
        assert rebuilt == {i: len(x) for i, x in enumerate(docs)}


# --- BPE


def test_bpe_equals_the_library(spark):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    more = ["it's <|endoftext|>We'll ok", " <|startoftext|>", "a" * 5000, "Σας ΟΔΟΣ İ", "é x́ ́", "a b c\x0bd\x1ce", "1½² 'S 'sx I'M", "ﬁ Å K", "\n\n", "word " * 20_000]
    rows = [*ROWS, *((80 + i, t) for i, t in enumerate(more))]
    got = bpe.bpe_decode(bpe.bpe_encode(documents(spark, rows))).collect()
    want = Counter()
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want[i, np.array(ids, "<u4").tobytes(), library.decode(ids, skip_special_tokens=False)] += 1
    assert Counter((r.doc_id, bytes(r.ids), r.decoded) for r in got) == want
    assert bpe.bpe_encode(documents(spark, [])).count() == 0


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
@pytest.mark.parametrize("bits", [2, 4, 8])
def test_joins_are_repaired_exactly(monkeypatch, name, bits):
    monkeypatch.setattr(bpe, "CUT_BITS", bits)
    path = public_tokenizers.path(name)
    library, encoder = Tokenizer.from_file(path), bpe.ChunkEncoder(path)
    assert encoder.chunked and encoder.by_word == (name == "word_bpe_49k.json")
    rng = random.Random(bits)
    parts = ["'", "'re", "'ll", "s", "e", "the ", "Word", " ", "   ", "\n\n", "1", "23", "é", "e\u0301", "\u0301", "İ", "ﬁ", "Σ", "日本", "🙂", "...", "!?", "\u00a0", "a" * 30, " and again ", "<|endoftext|>"]
    shared = ["".join(rng.choice(parts) for _ in range(rng.randint(30, 200))) for _ in range(8)]
    for _ in range(250):
        text = "".join(rng.choice([rng.choice(shared), "".join(rng.choice(parts) for _ in range(rng.randint(0, 40)))]) for _ in range(rng.randint(1, 4)))
        assert encoder.encode(text) == np.array(library.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), text
    assert encoder.reused


@pytest.mark.parametrize("bits", [2, 4, 8])
def test_joins_are_exact_among_marks(monkeypatch, bits):
    monkeypatch.setattr(bpe, "CUT_BITS", bits)
    path = public_tokenizers.path("word_bpe_49k.json")
    library, encoder = Tokenizer.from_file(path), bpe.ChunkEncoder(path)
    rng = random.Random(bits)
    marks = ["\u0301", "\u0323", "\u0327", "\u0303", "\u0302", "\u0308", "\u0345", "\u093c", "\u3099"]
    parts = ["'", "'re", "'s", "s", "e", "E", "the ", "Word", " ", "\n\n", "1", "\u00e9", "\u00c9", "\u0130", "\ufb01", "\u65e5", "\u304b", "\u0915", "\u1100", "\u1161", "\u11a8", "\uac00", "\U0001f600", "...", "a" * 20, "<|endoftext|>", *marks, *marks]
    shared = ["".join(rng.choice(parts) for _ in range(rng.randint(20, 120))) for _ in range(8)]
    shared += ["".join(rng.choice(marks) for _ in range(rng.randint(1, 40))) for _ in range(20)]
    shared.append("\U0001f600\u0301\u0323\u0323\u0323\u00c9\u00c9\u0301\u0323\u0323\u00c9\u0301\u00c9\u00c9\u0301\u00c9\u0323")
    for _ in range(3400):
        text = "".join(rng.choice([rng.choice(shared), "".join(rng.choice(parts) for _ in range(rng.randint(0, 40)))]) for _ in range(rng.randint(1, 5)))
        assert encoder.encode(text) == np.array(library.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), text


def test_unknown_rules_are_left_to_the_library(tmp_path):
    import json

    spec = json.loads(Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).to_str())
    spec["pre_tokenizer"]["add_prefix_space"] = True
    (tmp_path / "other.json").write_text(json.dumps(spec))
    encoder, library = bpe.ChunkEncoder(str(tmp_path / "other.json")), Tokenizer.from_file(str(tmp_path / "other.json"))
    text = "some words, again and again. " * 60
    assert not encoder.chunked and encoder.encode(text) == np.array(library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_bpe_decodes_as_the_library_with_any_decoder(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    got = bpe.bpe_decode(bpe.bpe_encode(documents(spark), path=path), path=path).collect()
    want = Counter((i, library.decode(library.encode(t or "", add_special_tokens=False).ids, skip_special_tokens=False)) for i, t in ROWS)
    assert Counter((r.doc_id, r.decoded) for r in got) == want


def test_shared_chunks_are_encoded_once():
    encoder = bpe.ChunkEncoder(public_tokenizers.path("word_bpe_49k.json"))
    rng = random.Random(6)
    passage = " ".join("".join(rng.choice("abcdefg") for _ in range(rng.randint(1, 9))) for _ in range(2000))
    encoder.encode("some lead " + passage)
    before, known = encoder.reused, len(encoder.chunks)
    text = "another, longer lead here " + passage + " tail"
    assert encoder.encode(text) == np.array(encoder.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    assert encoder.reused - before > 0.9 * known


# --- syncmers


def test_fingerprints_of_edited_texts(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    for data, n in ((rows, 3), ([(i, t) for i, t in ROWS if i not in (3, 12)], 5), ([(1, "alone " * 30)], 2)):
        got = {r.doc_id: r for r in syncmers.compare_with_edited(documents(spark, data), partitions=n).collect()}
        order = sorted(data, key=lambda r: (r[0] is not None, r[0] or 0), reverse=True)
        if any(i is None for i, _ in data):
            continue_ids = [i for i, _ in order if i is not None]
        else:
            continue_ids = [i for i, _ in order]
        text = {i: t or "" for i, t in order}
        for k, i in enumerate(continue_ids[:-1] if len(continue_ids) < len(order) else continue_ids):
            own, after = text[i], text[continue_ids[(k + 1) % len(continue_ids)]]
            half = len(own) // 2
            edited = own[: len(own) - half] + after[:half]
            r = got[i]
            assert (r.n_chars, r.edited_sha256) == (len(own), hashlib.sha256(edited.encode()).hexdigest())
            assert r.fingerprint == syncmers.to_text(syncmers.syncmers(own)) and r.edited_fingerprint == syncmers.to_text(syncmers.syncmers(edited))
            assert r.near_next == syncmers.likeness(syncmers.syncmers(own), syncmers.syncmers(after))
    assert syncmers.compare_with_edited(documents(spark, [])).count() == 0
    assert len(syncmers.compare_with_edited(documents(spark)).collect()) == len(ROWS)


def brute_syncmers(text):
    """Positions of closed syncmers by their definition, with the hash of inner substrings alone taken from the module."""
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)

    def small(i):
        h = (points[i : i + syncmers.S].astype(object) + 1) * 0xD6E8FEB86659FD93 % (1 << 64)
        h = [x ^ (x >> 32) for x in h]
        while len(h) > 1:  # halves are joined as a polynomial is
            width = syncmers.S // len(h)
            h = [(a * pow(syncmers.P, width, 1 << 64) + b) % (1 << 64) for a, b in zip(h[::2], h[1::2], strict=True)]
        return int(syncmers.mixed(np.array(h, np.uint64))[0])

    inner = [small(i) for i in range(len(points) - syncmers.S + 1)]
    width = syncmers.K - syncmers.S
    return [i for i in range(len(points) - syncmers.K + 1) if min(inner[i : i + width + 1]) in (inner[i], inner[i + width])]


def brute_likeness(a, b):
    """Anchors by their k-mer's text, each where it stands first, that agree on one diagonal with some slack."""
    def first(text):
        found = {}
        for i in brute_syncmers(text):
            found.setdefault(text[i : i + syncmers.K], i)
        return found

    x, y = first(a), first(b)
    shifts = sorted(x[k] - y[k] for k in x.keys() & y.keys())
    best = max((sum(s <= t <= s + syncmers.SLACK for t in shifts) for s in shifts), default=0)
    share = best / (len(x) + len(y) - len(shifts))
    return 2 * share / (1 + share)


def test_syncmers_and_likeness_equal_brute_force(spark):
    rng = random.Random(17)
    rows = [(i, "".join(rng.choice("abcdefgh é") for _ in range(rng.choice([60, 300, 700])))) for i in range(6)]
    rows += [(10, rows[0][1] + " tail"), (11, rows[0][1])]
    for _, text in rows:
        assert syncmers.syncmers(text)[1].tolist() == brute_syncmers(text)
    got = {r.doc_id: r for r in syncmers.compare_with_edited(documents(spark, rows), partitions=3).collect()}
    order = sorted(rows, reverse=True)
    for (i, own), (_, after) in zip(order, [*order[1:], order[0]], strict=True):
        half = len(own) // 2
        edited = own[: len(own) - half] + after[:half]
        assert got[i].near_edited == pytest.approx(brute_likeness(own, edited)) and got[i].near_next == pytest.approx(brute_likeness(own, after))
        assert got[i].near_edited > 0.3
    plain = {r.doc_id: r for r in syncmers.fingerprints(documents(spark, rows)).collect()}
    assert all(plain[i].fingerprint == got[i].fingerprint and plain[i].text == t for i, t in rows)
    odd = syncmers.fingerprints(documents(spark)).collect()
    assert len(odd) == len(ROWS) and {r.fingerprint for r in odd if not r.text} == {""}


def test_syncmers_ignore_context_and_blocks(monkeypatch):
    rng = random.Random(7)
    text = "".join(rng.choice("abcdefghijk ") for _ in range(6000))
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    h, at = syncmers._block_syncmers(points)
    h2, at2 = syncmers._block_syncmers(points[1000:3000])
    inside = (at >= 1000) & (at <= 3000 - syncmers.K)
    assert h[inside].tolist() == h2.tolist() and (at[inside] - 1000).tolist() == at2.tolist()
    whole = syncmers.to_text(syncmers.syncmers(text))
    monkeypatch.setattr(syncmers, "BLOCK", 333)
    assert syncmers.to_text(syncmers.syncmers(text)) == whole
    assert syncmers.likeness(*[syncmers.from_text(whole)] * 2) == 1.0


@pytest.mark.parametrize("size", [1_000, 10_000, 130_000])
def test_a_passage_is_matched_in_a_text_of_any_length(size):
    rng = random.Random(8)
    passage, a, b = ("".join(rng.choice("abcdefghijk ") for _ in range(n)) for n in (500, size, size))
    a, b = a[: size // 3] + passage + a[size // 3 :], b[: size // 2] + passage + b[size // 2 :]
    x, y = syncmers.syncmers(a), syncmers.syncmers(b)
    inside = {h for h, p in zip(*(v.tolist() for v in x), strict=True) if size // 3 <= p <= size // 3 + 500 - syncmers.K}
    assert len(inside) > 40 and inside <= set(y[0].tolist())
    n = len(np.union1d(x[0], y[0]))
    assert syncmers.likeness(x, y) == pytest.approx(2 * len(inside) / (n + len(inside)), rel=0.1)
    for data in (a, "x" * size, "ab " * size, "", "short"):
        made = syncmers.syncmers(data)
        back = syncmers.from_text(syncmers.to_text(made))
        assert all(np.array_equal(*v) for v in zip(made, back, strict=True))
