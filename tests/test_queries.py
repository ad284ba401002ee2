"""Every registered query against its SQL statement on the smallest tables."""

import duckdb  # noqa: F401  (fails early where it is missing)
import pytest
from compare import connect, difference
from conftest import SMALL

import __spark_entry__ as entry_point

STATEMENTS = entry_point.oracle_sql()
QUERIES = entry_point.queries()


@pytest.fixture(scope="module")
def connection():
    return connect(SMALL)


def test_every_statement_has_its_query():
    assert set(STATEMENTS) <= set(QUERIES)


def test_entry_has_rows(spark):
    frame = entry_point.entry(spark)
    assert frame.columns[0] == "month"
    assert frame.count() == 12


@pytest.mark.parametrize("name", sorted(STATEMENTS))
def test_same_as_sql(spark, connection, name):
    found = QUERIES[name](spark, SMALL).toPandas()
    assert difference(found, connection.sql(STATEMENTS[name]).df()) is None
