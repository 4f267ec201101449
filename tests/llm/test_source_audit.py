from __future__ import annotations

import random
import re
from collections import Counter

import pytest

from jobloom.llm import radix_select, source_audit

from .helpers import ROWS


def brute(rows, least=3, top=200):
    """rows (text, lang, source) -> the audit's rows, from the definition."""
    docs = [tuple(x or "" for x in r) for r in rows]
    out = []
    for lang in {d[1] for d in docs}:
        found = [(s, [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t)]) for t, g, s in docs if g == lang]
        seen = Counter(w for _, words in found for w in set(words))
        kept = {w for w, n in seen.items() if n >= least}
        counts = {s: Counter(w for x, words in found if x == s for w in words if w in kept) for s, _ in found}
        whole = sum(counts.values(), Counter())

        def share(c):
            total = sum(c.values())
            return {w: 1 + 1_000_000_000 * (c[w] + 1) // (total + len(kept)) for w in kept}

        p, q = {s: share(c) for s, c in counts.items()}, share(whole)
        gap = lambda x, y: (x - y) ** 2 // y
        for s in counts:
            pairs = [(sum(gap(p[s][w], p[o][w]) for w in kept), o) for o in counts if o != s]
            terms = [(gap(p[s][w], q[w]), w) for w in kept if counts[s][w] and p[s][w] > q[w]]
            for part, items in (("pair", pairs), ("term", terms)):
                items.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, w, v, k + 1) for k, (v, w) in enumerate(items) if part == "pair" or k < top]
    return Counter(out)


def audited(spark, rows, **kw):
    df = spark.createDataFrame(rows, "text string, lang string, source string").selectExpr("*", "'clash' as term", "'clash' as item", "'clash' as value", "'clash' as rank", "'clash' as docs", "1 as n")
    return Counter((r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in source_audit.divergence(df, **kw).collect())


@pytest.mark.parametrize("top", [1, 7, 200])
def test_audit_equals_brute_force(spark, monkeypatch, top):
    monkeypatch.setattr(source_audit, "HELD_TERMS", 20)
    monkeypatch.setattr(source_audit, "SLICE_BYTES", 16)
    monkeypatch.setattr(source_audit, "HELD_PAIRS", 4)
    monkeypatch.setattr(radix_select, "FIRST_BYTES", 1)
    rng = random.Random(top)
    # words that share long beginnings, in equal numbers, so that ties have to be refined
    words = [*(f"common{'x' * k}" for k in range(12)), *(f"é{'ü' * k}z" for k in range(8)), "日本", "Word", "a", "B", "c1d"]
    rows = [(" ".join(rng.choice(words) for _ in range(rng.randint(0, 30))), rng.choice(["en", "de", None]), rng.choice(["s1", "s2", "s3", "é", "", None])) for _ in range(120)]
    rows += [(w, "en", "ties") for w in words for _ in range(2)] + [(t, "odd", "s") for _, t in ROWS] + [("only once", "xx", "one"), ("other", "xx", "two"), (None, "yy", "one"), ("same same", "zz", "a"), ("same", "zz", "b"), ("same", "zz", "b")]
    assert audited(spark, rows, top=top) == brute(rows, top=top)


def test_no_rows(spark):
    assert audited(spark, []) == Counter()


def test_radix_selection_equals_sorting(spark):
    rng = random.Random(9)
    rows = [(g, f"{'long shared beginning ' * rng.randint(0, 3)}{i}", rng.choice([0, 1, 5, (1 << 59) + rng.randint(0, 3), rng.randint(0, 1 << 59)])) for g in range(4) for i in range(50 * g)]
    df = spark.createDataFrame(rows, "g int, item string, value bigint")
    for k in (1, 10, 49, 50, 99, 1000):
        want = []
        for g in range(4):
            own = sorted((r for r in rows if r[0] == g), key=lambda r: (-r[2], r[1].encode()))
            want += [(*r, i + 1) for i, r in enumerate(own[:k])]
        assert sorted(tuple(r) for r in radix_select.top_k(df, ["g"], k).select("g", "item", "value", "rank").collect()) == sorted(want)


def test_shares_do_not_overflow(spark):
    from pyspark.sql import functions as F

    rows = [(10**12, 10**15, 7), (0, 0, 1), (5, 5, 1), (0, 10**15, 10**9), (123_456_789_012, 123_456_789_013, 2), (0, 0, 0)]
    got = spark.createDataFrame(rows, "n bigint, total bigint, v bigint").select("n", "total", "v", source_audit.share(F.col("n"), F.col("total"), F.col("v")).alias("p")).collect()
    assert all(r.p == 1 + 1_000_000_000 * (r.n + 1) // max(1, r.total + r.v) for r in got)


def test_rows_pass_one_exchange_on_their_way_to_the_counts(spark):
    df = spark.createDataFrame([("a b", "en", "s")], "text string, lang string, source string")
    counted = source_audit.count_terms(df).withColumn("x", source_audit.F.sum("n").over(source_audit.Window.partitionBy("lang", "term")))
    plan = counted._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
    assert "HashAggregate" not in plan[plan.index("Exchange"):]


@pytest.mark.parametrize("k", [1, 10, 200])
def test_little_more_than_k_rows_a_group_are_refined(spark, k):
    rng = random.Random(k)
    rows = [(g, str(i), int(2 ** rng.uniform(0, 59))) for g in range(3) for i in range(1000 * g + 5)]
    got = radix_select.largest(spark.createDataFrame(rows, "g int, item string, value bigint"), ["g"], k).collect()
    for g in range(3):
        own = sorted((r[2] for r in rows if r[0] == g), reverse=True)
        chosen = sorted((r.value for r in got if r.g == g), reverse=True)
        assert chosen[:k] == own[:k]
        assert len(chosen) <= k + 25


def test_pairs_of_sources_are_summed_alike_whether_held_or_passed_on(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(" ".join(rng.choice("abcdefgh") for _ in range(9)), rng.choice(["en", "de"]), rng.choice(["s1", "s2", "s3", "s4"])) for _ in range(60)]
    want = brute(rows)
    for held in (4, 9, 1 << 20):
        monkeypatch.setattr(source_audit, "HELD_PAIRS", held)
        assert audited(spark, rows) == want
