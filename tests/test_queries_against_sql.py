"""Every registered query against its SQL, on whole tables of the smallest scale."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry_points
from coldledger.plans.oracle import ORACLE_SQL
from coldledger.plans.queries import QUERIES
from tests.compare import connect, differences

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    with connect(SF) as opened:
        yield opened


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE_SQL)
    assert set(QUERIES) <= set(entry_points.queries())
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, connection, name):
    df = entry_points.queries()[name](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert differences(df, entry_points.oracle_sql()[name], connection) == []


def test_comparison_notices_differences(spark, connection):
    df = entry_points.queries()["volume_type"](spark, SF)
    sql = entry_points.oracle_sql()["volume_type"]
    assert differences(df, sql.replace("1024", "1000"), connection)
    assert differences(df, sql.replace("AS volume_type", "AS type"), connection)
    assert differences(df, sql.replace("BIGINT", "INTEGER"), connection)
    assert differences(df, sql + " WHERE size_gb > 1000", connection)


def test_entry(spark):
    assert entry_points.entry(spark).count() > 0
