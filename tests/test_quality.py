from __future__ import annotations

from datetime import datetime

import pytest

from shop import rows, shop
from souk.model import MARTS
from souk.operators.quality import Check, key_checks, key_rows, run_checks
from souk.plans import checks, quality_history
from souk.plans.warehouse import Warehouse
from souk.sources import tables


@pytest.fixture
def child(spark):
    data = [("a", 1, True, "p1"), ("a", 0, None, "p1"), (None, 7, False, "px"), ("z", None, True, None),
            ("b", 5, True, "px")]
    return spark.createDataFrame(data, "name string, score int, flag boolean, parent string")


@pytest.mark.parametrize(("check", "failures", "passed"), [
    (Check("t", "name", "not_null"), 1, False),
    (Check("t", "name", "unique"), 1, False),
    (Check("t", "parent", "unique"), 2, False),
    (Check("t", "name", "accepted_values", values=("a", "b")), 1, False),
    (Check("t", "flag", "accepted_values", values=(True, False)), 0, True),
    (Check("t", "score", "accepted_range", low=1, high=5), 2, False),
    (Check("t", "score", "accepted_range", low=0), 0, True),
    (Check("t", "name", "not_null_proportion", at_least=0.8), 1, True),
    (Check("t", "name", "not_null_proportion", at_least=0.9), 1, False),
    (Check("t", "parent", "relationship", parent="p", parent_column="id"), 2, False),
])
def test_planted_violations_are_counted(spark, child, check, failures, passed):
    parents = spark.createDataFrame([("p1",), ("p1",), (None,)], "id string")
    (r,) = rows(run_checks({"t": child, "p": parents}, [check]))
    assert (r["failures"], r["total"], r["passed"]) == (failures, 5, passed)


def test_empty_tables_pass(spark, child):
    empty = child.limit(0)
    suite = [Check("t", "name", "not_null"), Check("t", "name", "unique"),
             Check("t", "parent", "relationship", parent="t", parent_column="name")]
    assert all(r["failures"] == 0 and r["total"] == 0 and r["passed"] for r in rows(run_checks({"t": empty}, suite)))


def test_declared_suite_finds_the_planted_faults(spark, raw, tmp_path):
    assert (len(checks.staging_checks()), len(checks.mart_checks())) == (52, 123)
    warehouse = shop(spark, raw, str(tmp_path / "w"), None)
    for name in ("stg_order_items", "stg_payments", "stg_products", "stg_order_reviews", "stg_sellers",
                 "stg_category_translation"):
        warehouse.store(name)
    report = checks.quality_report(warehouse)
    checks.store_quality_report(report, str(tmp_path / "dq"))
    stored = spark.read.parquet(str(tmp_path / "dq"))
    assert stored.count() == 175
    failed = {(r["table_name"], r["column_name"], r["test"]): r["failures"] for r in rows(stored) if not r["passed"]}
    assert failed[("fact_sales", "product_key", "relationship")] == 1
    assert failed[("dim_customers", "customer_region", "accepted_values")] == 1
    assert failed[("dim_reviews", "review_score", "accepted_values")] == 1
    assert failed[("dim_orders", "days_to_delivery", "not_null_proportion")] == 1
    assert ("fact_sales", "order_item_sk", "unique") not in failed
    assert ("dim_date", "year", "accepted_range") not in failed


def test_key_checks_share_one_exchange(spark, child):
    suite = [Check("t", "name", "unique"), Check("t", "parent", "unique"), Check("p", "id", "unique"),
             Check("t", "parent", "relationship", parent="p", parent_column="id"),
             Check("t", "name", "relationship", parent="t", parent_column="parent")]
    parents = spark.createDataFrame([("p1",), ("p1",), (None,)], "id string")
    df = key_checks({"t": child, "p": parents}, suite)
    assert [(r["failures"], r["total"]) for r in df.collect()] == [(1, 5), (2, 5), (1, 3), (2, 5), (4, 5)]
    plan = df._jdf.queryExecution().sparkPlan().toString()
    executed = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert executed.count("Exchange hashpartitioning") == 2 and "SortMergeJoin" not in plan
    hot = spark.range(0, 9000, 1, 3).selectExpr("if(id % 3 = 0, 'lost', concat('k', id % 7)) as k")
    folded = key_rows({"t": hot, "p": parents}, [Check("t", "k", "relationship", parent="p", parent_column="id")])
    assert "partial_sum" in folded._jdf.queryExecution().executedPlan().toString()


def test_history_recounts_changed_periods_only(spark, tmp_path, monkeypatch):
    mart = MARTS["dim_orders"]
    w = Warehouse(spark, {}, None, str(tmp_path / "w"), "month")
    schema = "order_key string, order_status string, modified_at timestamp"
    at = lambda month: datetime(2020, month, 3)
    rows_ = [("a", "DELIVERED", at(1)), ("b", None, at(2)), ("b", "SHIPPED", at(2)), (None, "odd", at(3))]
    tables.write_mart(spark.createDataFrame(rows_, schema), w.path("dim_orders"), mart, "month")
    suite = [Check("dim_orders", "order_status", "not_null"), Check("dim_orders", "order_status", "accepted_values", ("DELIVERED", "SHIPPED")),
             Check("dim_orders", "order_key", "not_null_proportion", at_least=0.5), Check("dim_orders", "order_key", "unique")]
    path = str(tmp_path / "dq")
    brief = lambda df: [(r["column_name"], r["test"], r["failures"], r["total"], r["passed"]) for r in rows(df, "test")]
    first = brief(quality_history.record(w, suite, path, "r1", at(4)))
    assert first == brief(run_checks({"dim_orders": tables.read_mart(spark, w.path("dim_orders"))}, suite))
    tables.merge_mart(spark, w.path("dim_orders"), spark.createDataFrame([("c", None, at(3))], schema), mart, str(tmp_path / "s"), "month")
    counted = []
    real = quality_history._row_counts
    monkeypatch.setattr(quality_history, "_row_counts", lambda df, *rest: counted.append(
        sorted(r[0] for r in df.select("period").distinct().collect())) or real(df, *rest))
    second = brief(quality_history.record(w, suite, path, "r2", at(5)))
    assert counted == [["2020-03"]]
    assert second == brief(run_checks({"dim_orders": tables.read_mart(spark, w.path("dim_orders"))}, suite)) != first
    monkeypatch.setattr(quality_history.quality, "key_checks", lambda *_: pytest.fail("nothing changed"))
    assert brief(quality_history.record(w, suite, path, "r3", at(6))) == second and counted == [["2020-03"]]
    kept = quality_history.history(spark, path)
    assert {r["run_id"]: r["run_at"].month for r in kept.collect()} == {"r1": 4, "r2": 5, "r3": 6}
    assert brief(kept.filter("run_id = 'r1'")) == first


def test_seed_passes_its_checks(spark):
    from souk.sources.seeds import read_seed
    suite = [c for c in checks.mart_checks() if c.table == "state_regions"]
    got = rows(run_checks({"state_regions": read_seed(spark)}, suite))
    assert len(got) == 8 and all(r["passed"] and r["total"] == 27 for r in got)


def test_time_columns_can_be_checked(spark):
    df = spark.createDataFrame([(datetime(2020, 1, 1),), (None,)], "at timestamp")
    (r,) = rows(run_checks({"t": df}, [Check("t", "at", "not_null")]))
    assert r["failures"] == 1
