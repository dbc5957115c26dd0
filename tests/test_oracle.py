"""Every query with a SQL check gives the same rows as its SQL on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from signalbook.plans import catalog
from tests.compare import difference, duck, rows_of_duck, rows_of_spark

FOLDER = os.environ.get("SF_DIR", "/root/testdata/sf0.001")
QUERIES = {name: query for name, query in entry.queries().items() if name in catalog.CATALOG}
SQL = {name: sql for name, sql in entry.oracle_sql().items() if name in QUERIES}


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


def test_every_query_has_a_check_or_is_listed():
    assert set(SQL) <= set(QUERIES)
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, con, name):
    got = rows_of_spark(QUERIES[name](spark, FOLDER))
    assert not difference(got, rows_of_duck(con, SQL[name]))


def test_entry_runs(spark):
    rows = entry.entry(spark).collect()
    assert 0 < len(rows) <= 10
