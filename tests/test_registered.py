"""Every registered query runs; those with SQL return the same rows as the SQL."""

import pytest

import __spark_entry__ as entry

from .compare import connect, difference
from .conftest import FOLDER

QUERIES = entry.queries()
CHECKS = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


def test_checks_belong_to_queries():
    assert set(CHECKS) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(CHECKS))
def test_same_rows_as_sql(spark, con, name):
    assert difference(QUERIES[name](spark, FOLDER), con, CHECKS[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(CHECKS)))
def test_runs(spark, name):
    df = QUERIES[name](spark, FOLDER)
    assert df.count() > 0
    assert len(set(df.columns)) == len(df.columns)


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
