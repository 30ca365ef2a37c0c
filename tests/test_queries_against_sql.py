"""Every registered query with SQL, compared at the smallest scale."""

import pytest

import __spark_entry__ as entry
from bidlens.plans import oracles, queries
from oracle_compare import TESTDATA, connect, difference

FOLDER = f"{TESTDATA}/sf0.001"
QUERIES, SQL = queries.QUERIES, oracles.ORACLES  # those of the training-data subpackage have tests of their own


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES) and len(QUERIES) - len(SQL) < 10


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, con, name):
    assert difference(QUERIES[name](spark, FOLDER).toPandas(), con.execute(SQL[name]).df()) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_gives_rows(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() == 5
