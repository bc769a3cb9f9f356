"""What the plans look like, and what happens when one key owns much of the data."""

from __future__ import annotations

import re
from datetime import datetime, timedelta

import pytest

from shop import rows, shop
from souk.model import MARTS
from souk.operators import incremental, joins
from souk.operators.dedup import keep_latest
from souk.plans import dimensions, facts, reports, staging
from souk.sources import tables

DAY = datetime(2017, 1, 1)


def plan(df, final: bool = False) -> str:
    if final:
        df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def marts(spark, tmp_path_factory):
    """Stored marts in which one customer, one seller, one product and one day own half of the rows."""
    root = tmp_path_factory.mktemp("skewed")
    n = 4000
    fact = spark.range(n).selectExpr(
        "concat('i', id) as order_item_sk",
        "concat('o', cast(id / 2 as int)) as order_key",
        "if(cast(id / 2 as int) % 2 = 0, 'hot', concat('c', cast(id / 2 as int) % 97)) as customer_key",
        "if(id % 2 = 0, 'hot', concat('p', id % 53)) as product_key",
        "if(id % 2 = 0, 'hot', concat('s', id % 31)) as seller_key",
        "if(cast(id / 2 as int) % 2 = 0, '2017-01-01', concat('2018-01-', lpad(1 + cast(id / 2 as int) % 28, 2, '0'))) as date_key",
        "if(cast(id / 2 as int) % 3 = 0, null, concat('o', cast(id / 2 as int))) as payment_key",
        "if(cast(id / 2 as int) % 5 < 4, null, concat('o', cast(id / 2 as int))) as review_key",
        "cast(id % 90 as decimal(28,9)) as item_price", "cast(id % 7 as decimal(28,9)) as freight_value",
        "cast(id % 90 + id % 7 as decimal(28,9)) as total_item_value", "1L as quantity",
        "cast(50 as decimal(38,9)) as payment_value", "2L as total_installments", "1L as payment_methods_count",
        "true as uses_credit_card", "false as uses_boleto", "false as uses_voucher", "false as uses_debit_card",
        "'CREDIT_CARD' as primary_payment_type")
    fact = fact.selectExpr("*", "cast(date_key as timestamp) as order_purchase_ts",
                           "cast(date_key as timestamp) as fact_modified_at")
    fact.persist()
    at = "timestamp'2017-01-01' as modified_at"
    frames = {
        "fact_sales": fact,
        "dim_customers": fact.selectExpr("customer_key", "'SP' as customer_state", at,
                                         "if(customer_key = 'hot', 'South', 'North') as customer_region").distinct(),
        "dim_sellers": fact.selectExpr("seller_key", "'SP' as seller_state", "'x' as seller_city", at,
                                       "if(seller_key = 'hot', 'South', 'North') as seller_region").distinct(),
        "dim_products": fact.selectExpr("product_key", at,
                                        "substr(product_key, 1, 2) as product_category_english").distinct(),
        "dim_orders": fact.selectExpr("order_key", at, "cast(substr(order_key, 2) as int) % 40 as days_to_delivery",
                                      "cast(substr(order_key, 2) as int) % 40 - 20 as delivery_vs_estimate_days",
                                      "cast(substr(order_key, 2) as int) % 40 <= 20 as is_delivered_on_time").distinct(),
        "dim_payments": fact.filter("payment_key is not null").selectExpr(
            "payment_key", at, "primary_payment_type", "total_installments", "payment_methods_count",
            "uses_credit_card", "uses_boleto", "uses_voucher").distinct(),
        "dim_reviews": fact.filter("review_key is not null").selectExpr(
            "review_key", at, "1L + length(review_key) as review_score", "length(review_key) * 9 as days_to_review").distinct(),
        "dim_date": fact.selectExpr("date_key", "cast(date_key as date) as full_date",
                                    "cast(year(date_key) as bigint) as year", "cast(month(date_key) as bigint) as month",
                                    "date_format(date_key, 'MMMM') as month_name").distinct(),
    }
    out = {}
    for name, df in frames.items():
        tables.write_mart(df, str(root / name), MARTS[name], "month")
        out[name] = tables.read_mart(spark, str(root / name))
    yield out
    fact.unpersist()


@pytest.fixture
def no_broadcast(spark):
    """Big-data conditions: nothing counts as small, and half of a small stage counts as skewed."""
    wanted = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "2k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2k",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.shuffle.partitions": "8",
    }
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_keep_latest_limits_groups_before_the_shuffle(spark):
    df = spark.createDataFrame([("k", DAY, 1)], "k string, modified_at timestamp, v int").repartition(2)
    text = plan(keep_latest(df, ["k"]))
    limits = re.findall(r"WindowGroupLimit.*(Partial|Final)", text)
    assert sorted(limits) == ["Final", "Partial"]


def test_copies_of_one_key_leave_each_task_as_one_row(spark):
    """60,000 copies of a key in 6 tasks: the shuffle carries a handful of rows."""
    df = spark.range(0, 60000, 1, 6).selectExpr(
        "if(id % 3 = 0, 'hot', concat('k', id % 10)) as k", "id as v",
        "timestamp_seconds(id) as modified_at")
    latest = keep_latest(df, ["k"])
    got = {r["k"]: r["v"] for r in rows(latest)}
    assert got["hot"] == 59997 and len(got) == 11
    text = plan(latest, final=True)
    written = re.findall(r"ShuffleQueryStage", text)
    assert written and "WindowGroupLimit" in text.split("Exchange hashpartitioning")[-1]


@pytest.mark.parametrize("name", reports.REPORTS)
def test_reports_hold_no_cross_join_udf_or_collect(marts, name):
    text = plan(reports.REPORTS[name](marts))
    for word in ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "ArrowEvalPython", "BatchEvalPython"):
        assert word not in text


@pytest.mark.parametrize("name", reports.REPORTS)
def test_big_data_plan_gives_the_same_result(spark, marts, name, no_broadcast):
    """Shuffle joins with split skewed partitions against the small-data plan."""
    report = reports.REPORTS[name]
    big = report(marts).collect()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10m")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "10m")
    assert big == report(marts).collect()


def test_year_filter_prunes_folders_and_columns(marts):
    text = plan(reports.payment_analysis(marts, year=2018))
    scan = next(line for line in text.splitlines() if "FileScan" in line and "order_item_sk" not in line
                and "payment_value" in line)
    partition_filters = re.search(r"PartitionFilters: \[(.*?)\], PushedFilters", scan).group(1)
    assert "period" in partition_filters and "2018" in partition_filters
    assert "GreaterThanOrEqual(date_key,2018)" in scan
    schema = re.search(r"ReadSchema: (.*)", scan).group(1)
    assert "seller_key" not in schema and "freight_value" not in schema


def test_item_rows_meet_no_customer_or_order_dimension(marts, no_broadcast):
    """Below every shuffle join on a big dimension there is an aggregate to its key."""
    for report in (reports.sales_by_state, reports.customer_behavior, reports.delivery_patterns,
                   reports.top_products_categories, reports.payment_analysis):
        text = plan(report(marts))
        fact = next(i for i, line in enumerate(text.splitlines()) if "FileScan" in line and "order_item_sk" in line
                    or "FileScan" in line and "total_item_value" in line)
        above = [line for line in text.splitlines()[:fact] if "SortMergeJoin" in line or "Aggregate(" in line
                 or "Exchange" in line]
        nearest = [line for line in reversed(above)]
        first_join = next((i for i, line in enumerate(nearest) if "SortMergeJoin" in line), len(nearest))
        assert any("Aggregate(" in line for line in nearest[:first_join])


def test_order_owning_a_third_of_the_items_is_split(spark, raw, tmp_path, no_broadcast):
    """The item join of the fact runs as a shuffle join whose hot partition is divided."""
    w = shop(spark, raw, str(tmp_path / "w"), None)
    lines = spark.range(0, 30000, 1, 6).selectExpr(
        "if(id % 3 = 0, 'o2', concat('o', 3 + id % 2)) as order_id", "cast(id as string) as order_item_id",
        "'p1' as product_id", "concat('s', id) as seller_id", "cast(null as string) as shipping_limit_date",
        "'1.00' as price", "'0.50' as freight_value", "timestamp'2018-01-01' as _sdc_extracted_at")
    w.raw["order_items"] = lines
    fact = w.define("fact_sales")
    assert fact.groupBy("order_key").count().filter("order_key = 'o2'").first()["count"] == 10000
    assert "skew=true" in plan(fact, final=True)


def test_customer_owning_half_of_the_orders_is_split(spark, marts, no_broadcast):
    orders = spark.range(0, 20000, 1, 4).selectExpr(
        "concat('o', id) as order_key", "if(id % 2 = 0, 'hot', concat('c', id % 97)) as customer_key",
        "'2017-01-01' as date_key", "concat('i', id) as order_item_sk", "cast(1 as decimal(28,9)) as total_item_value",
        "cast(1 as decimal(38,9)) as payment_value", "cast(1 as decimal(28,9)) as item_price",
        "cast(0 as decimal(28,9)) as freight_value", "concat('o', id) as payment_key",
        "cast(null as string) as review_key")
    report = reports.monthly_sales_trends({**marts, "fact_sales": orders})
    assert report.first()["total_orders"] == 20000
    assert "skew=true" in plan(report, final=True)


def test_lookup_is_broadcast_only_within_its_bound(spark):
    people = spark.createDataFrame([(str(i), "sp" if i % 3 else "xx") for i in range(30)], "id string, state string")
    lookup = spark.createDataFrame([("SP", "Southeast"), ("RJ", "Southeast")], "code string, region string")
    from pyspark.sql import functions as F
    small = joins.lookup_join(people, lookup, F.upper("state"), "code", "id")
    large = joins.lookup_join(people, lookup, F.upper("state"), "code", "id", max_rows=1)
    assert "BroadcastHashJoin" in plan(small)
    assert "_salt" in plan(large)
    assert rows(small) == rows(large) and len(rows(small)) == 30


def test_busy_period_is_written_by_several_tasks(spark, tmp_path):
    """Nearly all rows fall on one day; adaptive execution still spreads the write."""
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64k")
    try:
        df = spark.range(0, 20000, 1, 8).selectExpr(
            "concat('o', id) as order_key", "cast(if(id < 19900, 0, id) * 86400 as timestamp) as modified_at",
            "repeat(uuid(), 3) as pad")
        tables.write_mart(df, str(tmp_path / "t"), MARTS["dim_orders"], "day")
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    assert len(list((tmp_path / "t").glob("_version=*/period=1970-01-01/*.parquet"))) > 1
    assert tables.read_mart(spark, str(tmp_path / "t")).count() == 20000


def test_hot_child_keys_are_counted_before_the_reference_join(spark):
    child = spark.range(0, 9000, 1, 3).selectExpr("if(id % 3 = 0, 'lost', concat('k', id % 7)) as k")
    parent = spark.range(7).selectExpr("concat('k', id) as k")
    missing = joins.orphans(child, "k", parent, "k")
    assert rows(missing) == [{"key": "lost", "child_rows": 3000}]


def test_text_is_trimmed_inside_generated_code(raw):
    text = plan(staging.stg_order_items(raw("order_items", dict(order_id="o"))))
    assert "PythonUDF" not in text and "trim(" in text


def test_period_column_follows_the_day(spark, tmp_path):
    df = spark.createDataFrame([("a", DAY), ("b", DAY + timedelta(days=400)), ("c", None)],
                               "order_key string, modified_at timestamp")
    for grain, want in (("day", {"2017-01-01", "2018-02-05", "none"}), ("year", {"2017", "2018", "none"})):
        tables.write_mart(df, str(tmp_path / grain), MARTS["dim_orders"], grain)
        folders = {p.name.split("=")[1] for p in (tmp_path / grain).glob("_version=*/period=*")}
        assert folders == want


def test_changed_rows_are_found_by_a_join_on_the_key_alone(spark, no_broadcast):
    """neither side is shuffled or sorted on all its columns; NULL and NaN compare as equal."""
    columns = "k string, v int, w string, d double"
    stored = spark.createDataFrame([("a", 1, None, 1.0), ("b", 2, "x", float("nan")), ("c", 4, "q", 2.0),
                                    (None, 3, "y", 0.0)], columns)
    fresh = spark.createDataFrame([("a", 1, None, 1.0), ("b", 2, "x", float("nan")), ("c", 4, "z", 2.0),
                                   (None, 3, "y", 0.0), ("d", None, None, None)], columns)
    found = incremental.differing(fresh, stored, "k")
    assert {r["k"] for r in found.collect()} == {"c", "d", None}
    join = next(line for line in plan(found).splitlines() if "SortMergeJoin" in line)
    assert re.search(r"SortMergeJoin \[k#\d+\], \[_held_k#\d+\], LeftAnti", join)


def test_fact_rows_are_completed_after_the_shuffles(spark, raw, tmp_path, no_broadcast):
    """F10-F18: what follows from other columns is neither shuffled nor sorted; the written fact is the defined one."""
    w = shop(spark, raw, str(tmp_path / "w"), "year")
    for exchange in re.findall(r"Exchange.*", plan(w.define("fact_sales"))):
        assert "order_item_sk" not in exchange
    lines = facts.fact_lines(w["stg_order_items"], w["order_facts"])
    mart = MARTS["fact_sales"]
    arranged = facts.completed(tables.arranged(lines, mart, "year"))
    text = plan(arranged)
    assert "order_item_sk" not in text.split("REBALANCE")[-1] and "order_item_sk" in text
    wanted = rows(w.define("fact_sales"))
    assert wanted and rows(w.store("fact_sales").drop("period")) == wanted
    assert tables.read_mart(spark, w.path("fact_sales")).drop("period").columns == list(facts.FACT_COLUMNS)


def test_payments_of_an_order_meet_in_one_shuffle(spark):
    """payment types are counted without an exchange of their own; NULL is no type."""
    stamp = DAY
    paid = spark.createDataFrame([("o", 1, "A", 1, stamp), ("o", 2, "A", 1, stamp), ("o", 3, "B", 1, stamp),
                                  ("o", 4, None, 1, stamp), ("p", 1, None, 1, stamp)],
                                 "order_id string, payment_sequential long, payment_type string, payment_installments long, "
                                 "modified_at timestamp").selectExpr("*", "cast(1 as decimal(28,9)) as payment_value")
    got = dimensions.dim_payments(paid)
    assert plan(got).count("Exchange hashpartitioning") == 1
    assert {r["payment_key"]: r["payment_methods_count"] for r in got.collect()} == {"o": 2, "p": 0}
