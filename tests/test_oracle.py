"""Every registered query with SQL equals DuckDB on the same parquet tables."""

import pytest

import __spark_entry__ as E
from keepwise.plans import catalog
from tests.conftest import SF_SMALL
from tests.oracle_compare import compare, duck

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_duckdb(spark, con, name):
    r = compare(spark, con, name, QUERIES[name], SQL[name], SF_SMALL)
    assert r["ok"], r
    assert not r["nested_loop"], r


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_rows_only_queries_run_without_nested_loops(spark, con, name):
    r = compare(spark, con, name, QUERIES[name], None, SF_SMALL)
    assert r["rows"] >= 1 and not r["nested_loop"], r


def test_every_query_has_a_callable():
    assert set(SQL) <= set(QUERIES) <= set(E.queries())


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns == ["customerID", "churn_probability", "risk_level", "rank"]
    assert df.count() > 0
