"""Every registered query against its SQL, and the shape of its plan."""

from __future__ import annotations

import os

import pytest
from compare import compare, duck

from tracelane.plans.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data here")


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    if name in ORACLES:
        got, want, df = compare(spark, con, QUERIES[name], ORACLES[name], SF)
        assert got == want
    else:
        df = QUERIES[name](spark, SF)
        df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan and "BatchEvalPython" not in plan
