"""Every registered query with SQL gives the same rows as that SQL."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry_points
import oracle

QUERIES, SQL = entry_points.queries(), entry_points.oracle_sql()


@pytest.fixture(scope="module")
def connection(folder):
    return oracle.connect(folder)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, folder, connection, name):
    assert oracle.compare(QUERIES[name](spark, folder), SQL[name], connection) is None


def test_entry_gives_a_row_per_split(spark):
    rows = {r["split"]: r for r in entry_points.entry(spark).collect()}
    assert set(rows) == {"train", "test"} and all(0 <= r["roc_auc"] <= 1 for r in rows.values())


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)
