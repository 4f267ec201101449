from __future__ import annotations

import pytest

from jobloom.llm import registry

from ..oracle import same
from .helpers import SF


@pytest.mark.parametrize("name", list(registry.ORACLES))
def test_query_equals_its_sql(spark, name):
    same(registry.QUERIES[name](spark, SF), SF, registry.ORACLES[name])


def test_there_is_a_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES) == list(range(1, 14))
