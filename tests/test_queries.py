"""Every registered query: equal to its SQL, or at least some rows of a stable schema."""

from __future__ import annotations

import pytest
from compare import compare, connect

import __spark_entry__ as driver

QUERIES, SQL = driver.queries(), driver.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, con, sf, name):
    assert compare(spark, con, sf, QUERIES[name], SQL[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_gives_rows(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark):
    assert {r["table"] for r in driver.entry(spark).collect()} == {"lineitem", "documents", "orders", "embeddings"}
