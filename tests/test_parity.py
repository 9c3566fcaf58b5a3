"""Every registered query runs; those with SQL give the same rows as DuckDB."""

import pytest

import __spark_entry__ as entry
from parity import compare, connect

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con(small):
    return connect(small)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, con, small, name):
    fault = compare(spark, con, small, QUERIES[name], ORACLES[name])
    assert fault is None, fault


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, small, name):
    assert QUERIES[name](spark, small).count() > 0


def test_entry(spark):
    assert entry.entry(spark).columns == ["project", "start", "n", "first_line", "last_line", "label"]
