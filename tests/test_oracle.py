"""Every registered query against its DuckDB oracle at sf0.001 (the driver does the same at sf0.01)."""

import pytest

import __spark_entry__ as E  # noqa: E402
from conftest import SF_SMALL
from encore.plans import catalog
from oracle_check import compare, duck

QUERIES = {name: fn for name, fn in E.queries().items() if name in catalog.all_queries()}
SQL = {name: sql for name, sql in E.oracle_sql().items() if name in catalog.all_queries()}


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


def test_every_oracle_has_a_query():
    assert set(SQL) <= set(QUERIES)
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    r = compare(spark, con, name, QUERIES[name], SQL.get(name), SF_SMALL)
    assert r.get("ok") in (True, None), r
    assert r["rows"] >= 0


def test_entry(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns == ["artist_name", "hours_played", "full_play_count", "skip_count"]
