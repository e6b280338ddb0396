"""Plan audit over every batch query of the core (sf0.001): no cartesian or
nested-loop joins, no Python of any kind, the flagship ends in a top-k."""

from __future__ import annotations

import pytest

import __spark_entry__ as E
from gleaner.plans.catalog import all_queries
from tests.conftest import SF0001

BANNED = ["CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "MapInPandas", "MapInArrow", "FlatMapGroups"]


@pytest.mark.parametrize("key", sorted(k for k in all_queries() if not k.startswith("stream_")))
def test_plan_has_no_banned_nodes(spark, key):
    df = all_queries()[key](spark, SF0001)
    plan = df._jdf.queryExecution().executedPlan().toString()
    for node in BANNED:
        assert node not in plan, f"{key}: {node}"


def test_flagship_uses_top_k_and_group_limit(spark):
    df = E.entry(spark)
    df.collect()
    final = df._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in final
    assert "WindowGroupLimit" in final
    assert "HashAggregate" in final or "SortAggregate" in final
