"""Queries of this subpackage that SQL can express, against DuckDB on the smallest tables."""

import pytest
from oracle import connect, difference

from prosewell.llm import queries

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_agrees(spark, name):
    assert difference(queries.queries()[name](spark, DATA), connect(DATA), queries.oracle_sql()[name]) == ""
