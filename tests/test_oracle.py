"""Every query that SQL can tell, against DuckDB on the same tables."""

from __future__ import annotations

import pytest

from quernstone import registry

from .oracle import SF_DIR, compare, connection

SQL = registry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connection()


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, con, name):
    assert compare(registry.queries()[name](spark, SF_DIR), SQL[name], con) == ""


def test_the_comparison_sees_a_difference(spark, con):
    assert compare(spark.sql("select 1 as a"), "SELECT 2 AS a", con)
    assert compare(spark.sql("select 1 as a"), "SELECT 1 AS a UNION ALL SELECT 1", con)


def test_sql_names_queries():
    assert set(SQL) <= set(registry.queries())
