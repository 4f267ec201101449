from __future__ import annotations

from collections import Counter

import corpus_pipeline
import pytest
from jobloom.llm import packing, pii, toxicity
from jobloom.llm.common import table

from .helpers import ROWS, SF, documents
from .test_dedup import brute_components, lower


def test_stages_do_what_they_say(spark, tmp_path):
    docs = table(spark, SF, "documents")
    scores = {r.doc_id: r.predicted for r in toxicity.op1_toxicity(spark, SF).collect()}
    rows = {r.doc_id: r.text for r in docs.collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        if name != "packing":
            assert out.columns == table(spark, SF, "documents").columns
        out.write.parquet(f"file://{tmp_path}/{k}")
        docs = spark.read.parquet(f"file://{tmp_path}/{k}")
        got = docs.collect()
        if name == "toxicity":
            rows = {i: t for i, t in rows.items() if not scores[i]}
        elif name == "exact_dedup":
            keep = {}
            for i, t in rows.items():
                keep[lower(t)] = max(i, keep.get(lower(t), -1))
            rows = {i: rows[i] for i in keep.values()}
        elif name == "near_dedup":
            data = list(rows.items())
            rows = {i: rows[i] for i, _, c in brute_components(data, 80, 5) if c == i}
        elif name == "pii":
            rows = {i: pii.pseudonymise(t, pii.DEMO_KEY)[0] for i, t in rows.items()}
        if name != "packing":
            assert {r.doc_id: r.text for r in got} == rows, name
    codec = packing.Codec()
    assert Counter((r.doc_id, r.doc_tokens) for r in got if r.start == 0) == Counter((i, len(codec.encode(t or ""))) for i, t in rows.items())


def test_run_over_whole_tables(spark):
    got = corpus_pipeline.run(spark, SF)
    assert got.columns == list(packing.NAMES) and got.count() > 0


def test_odd_rows_pass_every_stage(spark):
    rows = Counter(ROWS)
    docs = documents(spark)
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        if name == "packing":
            continue
        got = Counter((r.doc_id, r.text) for r in docs.collect())
        assert docs.columns == documents(spark).columns
        if name == "exact_dedup":
            rows = {}
            for i, t in ROWS:
                rows.setdefault(lower(t), []).append(i)
            assert Counter(lower(t) for _, t in got.elements()) == Counter(list(rows))
            assert all(i == max((x for x in rows[lower(t)] if x is not None), default=None) for i, t in got)
        else:
            assert got, name
    assert {r.doc_id for r in docs.collect() if r.start == 0} >= {7, 8, 9, 11, 13, -14}


def test_stages_of_an_empty_table(spark):
    docs = documents(spark, [])
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0, name


WORDS = [f"word{i}" for i in range(40)]
T, U = " ".join(WORDS), " ".join([*WORDS[:-1], "other"])
APART = "something else that is said only once here"


@pytest.mark.parametrize(
    "rows,kept",
    [
        ([(5, T), (7, T), (7, U)], [(5, T)]),
        ([(1, T), (None, T), (None, U)], [(1, T)]),
        ([(None, T), (None, U), (None, U), (None, APART), (None, APART)], [(None, min(T, U)), (None, APART)]),
        ([(7, T), (7, T), (7, APART), (8, APART)], [(7, T), (7, APART)]),
        ([(1, ""), (1, ""), (2, None), (None, " \t"), (3, "one"), (4, "ONE")], [(1, ""), (1, ""), (2, None), (None, " \t"), (3, "one")]),
        ([], []),
    ],
)
def test_near_copies_are_decided_by_row(spark, rows, kept):
    got = corpus_pipeline.near_copies(spark, documents(spark, rows).repartition(3), SF)
    found = Counter((r.doc_id, r.text) for r in got.collect())
    if all(i is None for i, _ in rows) and rows:  # which of two texts without an id stays is up to the key
        assert sum(found.values()) == len(kept) and (None, APART) in found
    else:
        assert found == Counter(kept)
