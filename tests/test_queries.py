"""Every query with a SQL twin against DuckDB on the smallest data set."""

import pytest

import __spark_entry__ as entry
from tests.compare import difference, duck
from tests.conftest import DATA

SF = f"{DATA}/sf0.001"
ORACLE = entry.oracle_sql()
QUERIES = entry.queries()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, con, name):
    assert difference(QUERIES[name](spark, SF), con, ORACLE[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_query_without_twin_keeps_every_event(spark, name):
    rows = QUERIES[name](spark, SF)
    assert rows.count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_no_twin_without_query():
    assert not set(ORACLE) - set(QUERIES)
