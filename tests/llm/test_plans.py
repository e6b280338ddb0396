"""Plans of the text preparation queries (sf0.001): no cartesian or nested-loop joins, and no
Python at all in the ones that are DataFrame operations only."""

from __future__ import annotations

import pytest

from gleaner.llm.queries import QUERIES
from tests.conftest import SF0001

NATIVE = ("op1_", "op2_", "op4_", "op8_", "op10_", "op13_")
PYTHON = ["BatchEvalPython", "ArrowEvalPython", "MapInPandas", "MapInArrow", "FlatMapGroupsInPandas", "FlatMapGroupsInArrow", "FlatMapCoGroups"]


@pytest.mark.parametrize("key", [k for k in QUERIES if k.startswith(NATIVE)])
def test_native_plan(spark, key):
    plan = QUERIES[key](spark, SF0001)._jdf.queryExecution().executedPlan().toString()
    for node in ["CartesianProduct", "BroadcastNestedLoopJoin", *PYTHON]:
        assert node not in plan, f"{key}: {node}"
