"""Every registered query on the smallest tables, against its SQL where it has one."""

import os

import pytest

import __spark_entry__ as registered
from tools.check import compare, connect

SF = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(registered.queries()))
def test_query(spark, db, name):
    rows = registered.queries()[name](spark, SF)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    state, _, _, _, note = compare(
        spark, db, SF, name, lambda *_: rows, registered.oracle_sql().get(name)
    )
    assert state in ("ok", "rows-only"), note


def test_sql_only_for_registered_queries():
    assert set(registered.oracle_sql()) <= set(registered.queries())
