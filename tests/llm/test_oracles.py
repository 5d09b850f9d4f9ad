"""Queries of the package against their SQL counterparts in DuckDB."""

import compare
import pytest

from lustra.llm.queries import QUERIES
from lustra.llm.queries_sql import SQL

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    return compare.connect(FOLDER)


@pytest.mark.parametrize("name", sorted(SQL.keys() & QUERIES.keys()))
def test_same_result(spark, connection, name):
    assert compare.difference(QUERIES[name](spark, FOLDER), connection, SQL[name]) is None
