"""Every registered query against its SQL twin on the smallest tables, and plan checks."""

import os
import sys

import duckdb
import pytest

import __spark_entry__ as registry
from conftest import SMALL
from lapse.sources import retail

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))
import check  # noqa: E402

pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="test tables not present")


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for name in check.TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SMALL}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, con, name):
    status, note, _ = check.compare(
        spark, con, name, registry.queries()[name], registry.oracle_sql().get(name), SMALL
    )
    assert status in ("ok", "rows-only"), note


def test_every_twin_has_a_query():
    assert set(registry.oracle_sql()) <= set(registry.queries())


def test_entry_has_rows(spark):
    assert registry.entry(spark).count() > 0


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scans_read_only_what_is_needed(spark):
    text = plan(retail.purchase_gaps(spark, SMALL).select("duration", "event"))
    assert "o_totalprice" not in text and "c_acctbal" not in text
    text = plan(retail.transactions(spark, SMALL).groupBy("CustomerID").count())
    assert "l_extendedprice" not in text and "l_shipdate" not in text


def test_no_cartesian_products(spark):
    for name in ("rfm_segments", "km_by_group", "clv_payback", "shapley_values", "logrank_sweep"):
        text = plan(registry.queries()[name](spark, SMALL))
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text, name
