"""Reports on the hand-made shop: against SQL over the same marts, and by hand where it matters."""

from __future__ import annotations

import inspect

import duckdb
import pytest

from shop import rows, shop
from souk import model
from souk.plans import reports, rollups
from souk.registry import checksql, reportsql
from souk.registry.compare import rows_of
from souk.registry.queries import portable

FILTERS = [{}, {"year": "2018"}, {"region": "Southeast"}]
MONEY = ("item_price", "freight_value", "total_item_value", "payment_value")


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """The shop's marts as Parquet, and an engine that sees them."""
    from souk import model as m

    def raw(entity, *data, stamp="2020-01-01 00:00:00"):
        columns = m.ENTITIES[entity].columns
        schema = ", ".join(f"{c} string" for c in (*columns, m.LOAD_STAMP))
        df = spark.createDataFrame([tuple(r.get(c) for c in columns) + (r.get("at", stamp),) for r in data], schema)
        return df.withColumn(m.LOAD_STAMP, df[m.LOAD_STAMP].cast("timestamp"))

    root = str(tmp_path_factory.mktemp("shop"))
    warehouse = shop(spark, raw, root, "month")
    marts = warehouse.build()
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for name in marts:
        fixed = ", ".join(f"cast({c} as decimal(18,2)) as {c}" for c in MONEY)
        extra = f" replace ({fixed})" if name == "fact_sales" else ""
        con.execute(f"create table {name} as select *{extra} from '{root}/{name}/**/*.parquet'")
    return warehouse, con


def in_sql(con, body: str):
    result = con.execute(f"with sale as ({checksql.CTES['sale']}) {body}")
    return rows_of([c[0] for c in result.description], result.fetchall())


@pytest.mark.parametrize("name", reports.REPORTS)
@pytest.mark.parametrize("scope", FILTERS, ids=str)
def test_report_equals_sql(stored, name, scope):
    warehouse, con = stored
    report, sql = reports.REPORTS[name], getattr(reportsql, name)
    allowed = inspect.signature(report).parameters
    if not set(scope) <= set(allowed):
        pytest.skip("the report has no such filter")
    got = portable(report(warehouse, **scope))
    year = int(scope["year"]) if "year" in scope else None
    arguments = [a for a in (year, scope.get("region")) if "year" in allowed]
    want = in_sql(con, sql(*arguments[:2 if "region" in allowed else 1]))
    assert rows_of(got.columns, got.collect()) == want


def test_spend_between_the_segments_has_none(stored):
    """One customer spends 100.50 with region and year set so that only order o1 counts."""
    warehouse, _ = stored
    january = dict(warehouse.marts())
    january["fact_sales"] = january["fact_sales"].filter("order_key = 'o1'")
    (r,) = rows(reports.customer_segmentation(january))
    assert (r["customer_segment"], r["value_segment"], r["segment_total_value"]) == ("One-Time Customer", None, 100.5)


def test_sentinels_mean_no_filter(stored):
    warehouse, _ = stored
    every = rows(reports.monthly_sales_trends(warehouse))
    assert rows(reports.monthly_sales_trends(warehouse, model.ALL_YEARS, model.ALL_REGIONS)) == every
    assert rows(reports.monthly_sales_trends(warehouse, "", "")) == every


def test_payment_is_counted_once_per_item(stored):
    """Order o2 has two items, so its payment of 320 adds 640: kept as it is."""
    warehouse, _ = stored
    by_month = {r["month_year"]: r for r in rows(reports.monthly_sales_trends(warehouse))}
    assert by_month["2017-01"]["total_payments"] == 100.5 + 640
    assert by_month["2017-01"]["total_orders"] == 2


def test_calendar_join_drops_rows_only_when_filtered(stored):
    """A fact row whose day the calendar lacks counts without a year filter and not with one."""
    warehouse, _ = stored
    marts = dict(warehouse.marts())
    marts["dim_date"] = marts["dim_date"].filter("date_key <> '2018-03-06'")
    total = lambda df: sum(r["total_orders"] for r in rows(df))
    assert total(reports.payment_analysis(marts)) == 5
    assert total(reports.payment_analysis(marts, year=2018)) == 2
    assert total(reports.payment_analysis(warehouse, year=2018)) == 3


def test_on_time_rate_counts_items_over_orders(stored):
    warehouse, _ = stored
    speed = {r["delivery_speed_category"]: r for r in rows(reports.delivery_time_distribution(warehouse))}
    assert speed["Very Fast (≤5 days)"]["on_time_rate"] == 100.0
    assert speed["Very Slow (>30 days)"]["total_items"] == 2


def test_stored_profile_serves_the_three_customer_reports(stored):
    warehouse, _ = stored
    profile = reports.customer_profile(warehouse).cache()
    for report in (reports.customer_behavior, reports.customer_segmentation, reports.customer_frequency):
        assert rows(report(warehouse, profile=profile)) == rows(report(warehouse))
    profile.unpersist()


def test_missing_segments_are_completed(stored):
    warehouse, _ = stored
    segments = reports.customer_segmentation(warehouse, year=2017)
    got = {r["original_name"]: r["value"] for r in rows(rollups.customers_per_behaviour(segments))}
    assert got == {"One-Time Customer": 1, "Regular Customer": 1, "Loyal Customer": 0}
    value = rollups.revenue_per_value_segment(segments).collect()
    assert [r["segment"] for r in value] == list(model.VALUE_SEGMENTS.values())


def test_others_row_only_when_there_is_a_rest(stored):
    warehouse, _ = stored
    categories = reports.top_products_categories(warehouse)
    names = lambda n: [r["category"] for r in rollups.category_revenue_share(categories, n).collect()]
    assert names(1)[-1] == "Others" and len(names(1)) == 2
    assert "Others" not in names(10)


def test_empty_reports_give_zero_rates(stored):
    warehouse, _ = stored
    none = reports.delivery_patterns(warehouse, year=1999)
    (r,) = rows(rollups.kpi_delivery(none))
    assert r["avg_delivery_days"] == 0 and r["overall_on_time_rate"] == 0
    two = rows(rollups.review_availability(reports.reviews_sales_correlation(warehouse, year=1999)))
    assert [(r["category"], r["items"], r["sales"]) for r in two] == [("Has Reviews", 0, 0.0), ("No Reviews", 0, 0.0)]


def test_matrix_fills_missing_pairs(stored):
    warehouse, _ = stored
    got = rollups.region_matrix(reports.sales_by_region(warehouse), model.REGIONS)
    cells = {r["customer_region"]: r for r in rows(got)}
    assert cells["Northeast"]["North"] == 600.0 and cells["Northeast"]["Central-West"] == 0.0
