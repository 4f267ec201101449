from __future__ import annotations

import datetime as dt

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from jobloom.functions import typed
from jobloom.functions.scalars import LOG_SUFFIX, truncated_log
from jobloom.operators import journal, processing

plain = st.none() | st.booleans() | st.integers(-typed.SAFE_INTEGER, typed.SAFE_INTEGER) | st.floats(allow_nan=False, allow_infinity=False) | st.text() | st.datetimes(timezones=st.just(dt.UTC))
values = st.recursive(plain, lambda x: st.lists(x, max_size=4) | st.dictionaries(st.text() | st.sampled_from(["$date", "$void", "$plain"]), x, max_size=3), max_leaves=12)


@given(values)
def test_values_come_back(value):
    assert typed.decoded(typed.encoded(value)) == value


def test_what_the_journal_cannot_hold_is_named():
    loop: list = []
    loop.append(loop)
    for value, path in (({"a": [1, object()]}, "result.a[1]: object"), ({"a": typed.VOID}, "result.a: _Void"), ({1: 2}, "result: key 1"), (float("nan"), "result: nan"), (2**60, "exact"), (loop, "result[0]: holds itself"), (b"x", "bytes"), ({"a": {"b": print}}, "result.a.b: builtin"), (dt.timedelta(1), "timedelta")):
        with pytest.raises(typed.NotStorable, match=path.replace("[", r"\[")):
            typed.encoded(value)
    assert typed.decoded(typed.encoded(typed.VOID)) is typed.VOID and typed.decoded(typed.encoded(None)) is None


def test_steps_keep_dates_and_voids():
    run = processing.Run("r", None, {})
    at = dt.datetime(2024, 1, 2, tzinfo=dt.UTC)
    assert run.step("a", lambda key: {"at": at}) == {"at": at} and run.step("b", lambda key: typed.VOID) is typed.VOID
    again = processing.Run("r", None, {seq: (name, result) for seq, name, result in run.new})
    assert again.step("a", None) == {"at": at} and again.step("b", None) is typed.VOID
    with pytest.raises(processing.NonSerializableStepResult):
        run.step("c", lambda key: {"x": typed.VOID})


def test_variants_tell_what_they_are(spark):
    at = dt.datetime(2024, 1, 2, 3, 4, 5, 678_901, tzinfo=dt.UTC)
    rows = [(typed.VOID, "void"), (None, "null"), (True, "boolean"), (1, "number"), (1.5, "number"), ("x", "string"), (at, "date"), ([1], "array"), ({"a": 1}, "object"), ({"$void": True}, "object"), ({"$date": "2024-01-02"}, "object"), ({}, "object")]
    df = spark.createDataFrame([(i, typed.encoded(v)) for i, (v, _) in enumerate(rows)] + [(99, None), (98, "no json")], "i int, stored string")
    value = typed.variant(F.col("stored"))
    got = {r.i: (r.kind, r.date) for r in df.select("i", typed.kind(value).alias("kind"), typed.as_date(value).alias("date")).collect()}
    assert [got[i][0] for i in range(len(rows))] == [k for _, k in rows] and got[99][0] is None and got[98][0] is None
    assert [d for _, d in got.values() if d] == [at.replace(tzinfo=None)]


def test_lines_are_cut_in_utf16_units(spark):
    def cut(text, most):
        units = text.encode("utf-16-be")
        if len(units) <= 2 * most:
            return text
        return units[: 2 * (most - len(LOG_SUFFIX))].decode("utf-16-be", "ignore") + LOG_SUFFIX

    texts = ["", "x" * 20, "x" * 21, "🙂" * 10, "🙂" * 11, "a" + "🙂" * 11, "ab" + "🙂" * 20, "é" * 40, "日本🙂" * 9]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.line for r in df.select("i", truncated_log(F.col("t"), 20).alias("line")).collect()}
    assert got == {i: cut(t, 20) for i, t in enumerate(texts)}
    assert all(len(x.encode("utf-16-be")) <= 40 for x in got.values())


def test_appended_logs_keep_the_newest(spark):
    kept = spark.createDataFrame([], "job_id string, seq bigint, message string")
    for lo in (0, 700):
        kept = journal.append_logs(kept, spark.range(lo, lo + 700).selectExpr("'a' as job_id", "id as seq", "concat('m', id) as message").union(spark.range(1).selectExpr("'b'", f"{lo}L", "repeat('y', 5000)")))
    rows = kept.collect()
    assert sorted(r.seq for r in rows if r.job_id == "a") == list(range(400, 1400)) and [len(r.message) for r in rows if r.job_id == "b"] == [4000, 4000]
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "Partial" in plan and plan.count("WindowGroupLimit") >= 2
