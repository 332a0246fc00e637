"""Every registered query against its SQL."""

import pytest

import __spark_entry__ as registry
from tests.conftest import TINY
from tests.oracle import connect, difference

QUERIES = registry._graph_queries()
SQL = registry._graph_sql()


@pytest.fixture(scope="module")
def con():
    return connect(TINY)


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_sql(spark, con, name):
    assert difference(QUERIES[name](spark, TINY), con, SQL[name]) is None


def test_entry(spark):
    assert registry.entry(spark).count() == 750
