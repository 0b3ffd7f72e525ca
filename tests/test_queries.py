"""Every registered query against its SQL counterpart."""

import pytest
from compare import connect, difference

import __spark_entry__ as entry
from clickloom.plans import catalog, oracles

SF = "/root/testdata/sf0.001"
SQL = oracles.oracle_sql()
QUERIES = {name: query for name, query in entry.queries().items() if name in catalog.queries()}


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


def test_entry(spark):
    assert entry.entry(spark).count() == 50


@pytest.mark.parametrize("name", list(QUERIES))
def test_matches_sql(spark, con, name):
    assert difference(QUERIES[name](spark, SF), con, SQL[name]) is None
