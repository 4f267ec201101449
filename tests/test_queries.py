from __future__ import annotations

import pytest

from jobloom.plans import registry

from .oracle import same

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(registry.ORACLES))
def test_query_equals_its_sql(spark, name):
    same(registry.QUERIES[name](spark, SF), SF, registry.ORACLES[name])


def test_every_query_without_sql_gives_rows(spark):
    for name in set(registry.QUERIES) - set(registry.ORACLES):
        assert registry.QUERIES[name](spark, SF).count() > 0


def test_claims_bound_the_work_before_the_exchange(spark):
    plan = registry.QUERIES["claim_next_per_type"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
    plan = registry.QUERIES["claim_next_topk"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_filters_reach_the_scan(spark):
    plan = registry.QUERIES["event_duration_stats"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<event_id:bigint,user_id:bigint,event_type:string,value:double>" in plan
