"""Every named query against DuckDB over the same files."""

from __future__ import annotations

import pytest

import __spark_entry__ as entries
from tests.compare import connect, difference
from tests.conftest import SF

QUERIES, SQL = entries.queries(), entries.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_answer(spark, duck, name):
    assert difference(QUERIES[name](spark, SF), duck, SQL[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL) - {"model_comparison", "train_random_forest", "cross_validate", "random_search"}))
def test_some_rows(spark, name):
    assert not QUERIES[name](spark, SF).isEmpty()


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_comparison_notices_differences(spark, duck):
    frame = spark.sql("SELECT 1L AS a, 2.0D AS b")
    assert difference(frame, duck, "SELECT CAST(1 AS BIGINT) AS a, 2e0 AS b") is None
    assert "rows differ" in difference(frame, duck, "SELECT CAST(1 AS BIGINT) AS a, 2.000001e0 AS b")
    assert "columns" in difference(frame, duck, "SELECT 1 AS a, 2e0 AS c")
    assert "rows 1 vs 2" in difference(frame, duck, "SELECT unnest([1, 1]) AS a, 2e0 AS b")
    assert "types" in difference(frame, duck, "SELECT CAST(1 AS BIGINT) AS a, CAST(2 AS DECIMAL(3,1)) AS b")


def test_entry(spark):
    rows = entries.entry(spark).collect()
    assert sum(r["customers"] for r in rows) > 100
