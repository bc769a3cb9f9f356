"""Every registered query against its SQL on the smallest given tables."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as driver
from souk.registry import compare, queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="given tables are not there")


@pytest.fixture(scope="module")
def con():
    return compare.check_engine(SF)


@pytest.mark.parametrize("key", queries.QUERIES)
def test_query_equals_its_sql(spark, con, key):
    assert compare.difference(spark, con, SF, key) is None


def test_the_comparison_notices_differences(spark, con, monkeypatch):
    key = "r20_dashboard_summary"
    sql = driver.oracle_sql()[key]
    monkeypatch.setitem(compare.Q.SQL, key, sql.replace("count(*) as total_items", "count(*) + 1 as total_items"))
    assert compare.difference(spark, con, SF, key) is not None


def test_only_file_metadata_lacks_sql():
    assert set(queries.QUERIES) - set(queries.SQL) == {"s7_table_info"}
    assert set(queries.QUERIES) <= set(driver.queries())


def test_entry_runs(spark):
    assert driver.entry(spark).count() > 0


def test_the_profile_of_the_table_is_whole(spark):
    rows = {r["column_name"]: r for r in queries.QUERIES["a23_numeric_profile_of_table"](spark, SF).collect()}
    assert set(rows) == {"item_price", "freight_value", "total_item_value", "payment_value", "total_installments"}
    assert all(r[c] is not None for r in rows.values()
               for c in ("count", "mean", "std", "min", "q25", "q50", "q75", "max"))
