"""Registered queries against their SQL on small tables, and the shape of their plans."""

from pathlib import Path

import pytest
from compare import check, connect

import __spark_entry__ as entry
from ledgerloom.workload.queries import QUERIES

FOLDER = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no tables")


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


def test_every_query_has_sql():
    assert set(QUERIES) <= set(entry.queries())
    assert set(QUERIES) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_matches_sql(spark, con, name):
    difference, rows, _, _ = check(spark, con, FOLDER, name)
    assert difference is None
    assert rows > 0


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns[:2] == ["statement_id", "month"]
    assert df.count() > 0


@pytest.mark.parametrize("name", ["monthly_summary", "grid_ledger", "recurring_payments", "large_transactions", "grid_metadata"])
def test_plans_stay_in_the_jvm(spark, name):
    """No Python workers, no cartesian or nested-loop joins."""
    df = entry.queries()[name](spark, FOLDER)
    plan = df._jdf.queryExecution().executedPlan().toString()
    for unwanted in ("Python", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert unwanted not in plan


def test_scan_reads_only_needed_columns(spark):
    plan = entry.queries()["monthly_spending_stats"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "o_orderpriority" not in plan
    assert "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint,o_orderstatus:string,o_totalprice:double" in plan
