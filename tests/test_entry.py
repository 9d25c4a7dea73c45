"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry
from quibble.catalog import oracles
from quibble.catalog.queries import QUERIES

sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))
from compare import compare, duckdb_connection, type_differences  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duckdb_connection(SF)


def test_every_query_has_sql():
    assert set(QUERIES) == set(oracles.oracle_sql())
    assert set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    df = entry.queries()[name](spark, SF)
    sql = entry.oracle_sql()[name]
    assert compare(df, con, sql) is None
    assert type_differences(df, con, sql) == []
