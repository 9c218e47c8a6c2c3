"""Every query of the library against DuckDB on the smallest tables."""

import re

import pytest
from oracle import connect, difference

from prosewell.plans import catalog

DATA = "/root/testdata/sf0.001"
QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(DATA)


#: One group of rules each, under another profile of work; all of them together are run here, they run on their own with the other queries.
GROUPS = {n for n in QUERIES if re.fullmatch("lint_[a-z]_ja", n)}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - GROUPS))
def test_query_agrees(spark, con, name):
    assert name in SQL
    assert difference(QUERIES[name](spark, DATA), con, SQL[name]) == ""
