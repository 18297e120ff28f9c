"""Every training-data query with SQL against DuckDB at sf0.001; the entry point's names."""

import pytest
from conftest import SF_SMALL
from oracle_check import compare, duck

import __spark_entry__ as E
from encore.llm import queries


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_matches_sql(spark, con, name):
    r = compare(spark, con, name, E.queries()[name], queries.ORACLE_SQL[name], SF_SMALL)
    assert r.get("ok") is True, r


def test_one_query_per_operator_and_the_pipeline():
    names = set(E.queries())
    assert {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{i}" for i in range(1, 14)}
    assert "pipeline" in names
    assert set(queries.ORACLE_SQL) <= names
