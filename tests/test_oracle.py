"""Every named query against its SQL counterpart in DuckDB."""

import compare
import pytest

import __spark_entry__ as entry
from lustra.plans.catalog import QUERIES
from lustra.plans.catalog_sql import ORACLES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    return compare.connect(FOLDER)


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_result(spark, connection, name):
    result = QUERIES[name](spark, FOLDER)
    assert compare.difference(result, connection, ORACLES[name]) is None
    plan = result._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
