"""Registered queries for rollups, single operators, maintenance, checks and files."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from datetime import datetime
from functools import reduce
from uuid import uuid4

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from souk import model
from souk.functions import measures as M
from souk.functions import scalar as S
from souk.operators import history, incremental, joins, profile, quality, ranking
from souk.operators.dedup import keep_latest
from souk.plans import checks, quality_history, reports, rollups
from souk.plans import testbed as tb
from souk.plans.testbed import TEST_REGION, TEST_REGIONS, TEST_YEAR
from souk.plans.warehouse import Warehouse
from souk.registry import checksql as Q
from souk.registry import reportsql as R
from souk.registry.queries import (
    TABLE_COLUMNS, marts, plans, query, register, scratch, shown)
from souk.sources import live, tables, text
from souk.sources.loads import RawLoads
from souk.sources.seeds import read_seed
from souk.streaming.arrivals import merge_arrivals

# --- R24: follow-on reports ----------------------------------------------------------------------

REGIONS = (*TEST_REGIONS, "Unknown")


def follow_on(key: str, build, report, body: str, sql: str) -> None:
    """A rollup of a report; `body` reads the report's SQL under the name `report`."""
    register(key, lambda spark, d: build(report(marts(spark, d))), Q.query(body, report=sql))


def _money(c: str) -> str:
    return f"cast(sum(cast({c} as decimal(18,2))) as double) as {c}"


follow_on("r24a_customer_region_totals", rollups.customer_region_totals, reports.sales_by_region,
          f"""select customer_region, {_money('total_sales')},
          cast(sum(total_orders) as bigint) as total_orders,
          cast(sum(unique_customers) as bigint) as unique_customers from report group by 1""",
          R.sales_by_region())
follow_on("r24a_seller_region_totals", rollups.seller_region_totals, reports.sales_by_region,
          f"""select seller_region, {_money('total_sales')},
          cast(sum(total_orders) as bigint) as total_orders,
          cast(sum(unique_sellers) as bigint) as unique_sellers from report group by 1""",
          R.sales_by_region())
follow_on("r24b_flow_totals", rollups.flow_totals, reports.customer_seller_flow,
          f"""select transaction_type, {_money('total_sales')},
          cast(sum(total_orders) as bigint) as total_orders from report group by 1""",
          R.customer_seller_flow())
follow_on("r24c_top_cross_region_flows", rollups.top_cross_region_flows,
          reports.customer_seller_flow,
          """select customer_region || ' → ' || seller_region as flow, total_sales, total_orders
          from report where transaction_type = 'Cross Region'
          order by total_sales desc, flow limit 10""", R.customer_seller_flow())
follow_on("r24d_region_matrix", lambda r: rollups.region_matrix(r, REGIONS),
          reports.sales_by_region,
          "select customer_region, " + ", ".join(
              f"""coalesce(sum(total_sales) filter (seller_region = '{r}'), 0) as "{r}\""""
              for r in REGIONS) + " from report group by 1", R.sales_by_region())
follow_on("r24e_states_per_region", rollups.states_per_region, reports.sales_by_state,
          "select customer_region, count(*) as state_count from report group by 1",
          R.sales_by_state())


def _completed(labels: dict[str, str], column: str, value: str) -> str:
    rows = ", ".join(f"('{k}', '{v}')" for k, v in labels.items())
    return f"""select segment, {value} as value, original_name
        from (values {rows}) as domain(original_name, segment)
        left join report on {column} = original_name group by segment, original_name"""


follow_on("r24f_customers_per_behaviour", rollups.customers_per_behaviour,
          reports.customer_segmentation,
          _completed(model.BEHAVIOUR_SEGMENTS, "customer_segment",
                     "cast(coalesce(sum(customer_count), 0) as bigint)"),
          R.customer_segmentation())
follow_on("r24g_revenue_per_value_segment", rollups.revenue_per_value_segment,
          reports.customer_segmentation,
          _completed(model.VALUE_SEGMENTS, "value_segment",
                     "cast(coalesce(sum(cast(segment_total_value as decimal(18,2))), 0) as double)"),
          R.customer_segmentation())
follow_on("r24h_retention_by_region", rollups.retention_by_region, reports.customer_behavior,
          f"""select customer_region, customer_count, repeat_customers,
          {Q.div('100 * repeat_customers', 'customer_count', 9)} as retention_rate from report""",
          R.customer_behavior())
follow_on("r24h_repeat_rate", rollups.repeat_rate, reports.customer_behavior,
          f"select {Q.div('100 * sum(repeat_customers)', 'sum(customer_count)', 9)} as repeat_rate "
          "from report", R.customer_behavior())
follow_on("r24i_most_common_frequency", rollups.most_common_frequency, reports.customer_frequency,
          "select * from report order by customer_count desc, order_count limit 1",
          R.customer_frequency())
follow_on("r24i_frequency_detail", lambda r: rollups.frequency_detail(r, 20),
          reports.customer_frequency,
          """select order_count as "Number of Orders", customer_count as "Customer Count",
          percentage_of_customers as "Percentage", avg_customer_value as "Avg Customer Value",
          total_segment_value as "Total Segment Value" from report where order_count = 20""",
          R.customer_frequency())
def all_categories(warehouse):
    return reports.top_products_categories(warehouse, None)


follow_on("r24j_category_revenue_share", lambda r: rollups.category_revenue_share(r, 3), all_categories,
          """select least(n, 4) as position, case when n <= 3 then category else 'Others' end
          as category, cast(sum(cast(total_revenue as decimal(18,2))) as double) as total_revenue
          from (select *, row_number() over (order by total_revenue desc, category) as n from report)
          group by 1, 2""", R.top_products_categories(limit=None))
follow_on("r24j_share_of_many_states",
          lambda r: ranking.top_with_others(r, "customer_state", "total_sales", 5), reports.sales_by_state,
          """select least(n, 6) as position, case when n <= 5 then customer_state else 'Others' end
          as customer_state, cast(sum(cast(total_sales as decimal(18,2))) as double) as total_sales
          from (select *, row_number() over (order by total_sales desc, customer_state) as n from report)
          group by 1, 2""", R.sales_by_state())
follow_on("r24k_top_sellers_per_region", rollups.top_sellers_per_region, reports.top_sellers,
          "select seller_region, count(*) as seller_count from report group by 1", R.top_sellers())
follow_on("r24l_specialization_by_region", rollups.specialization_by_region,
          reports.seller_product_diversity,
          f"""select seller_region, seller_count, single_category_sellers,
          {Q.div('100 * single_category_sellers', 'seller_count', 9)} as specialization_rate
          from report""", R.seller_product_diversity())
follow_on("r24m_review_availability", rollups.review_availability,
          reports.reviews_sales_correlation,
          """select 'Has Reviews' as category, cast(sum(reviews_count) as bigint) as items,
          cast(sum(cast(total_sales as decimal(18,2)))
               filter (review_category <> 'No Review') as double) as sales from report
          union all select 'No Reviews', cast(sum(no_review_count) as bigint),
          cast(sum(cast(total_sales as decimal(18,2)))
               filter (review_category = 'No Review') as double) from report""",
          R.reviews_sales_correlation())
follow_on("r24m_review_coverage", rollups.review_coverage, reports.reviews_sales_correlation,
          f"""select {Q.div('100 * sum(reviews_count)', 'sum(reviews_count + no_review_count)', 9)}
          as review_coverage from report""", R.reviews_sales_correlation())


def _weighted(c: str, digits: int, places: int) -> str:
    """Order-weighted mean of a column rounded to `places`."""
    num = f"sum(cast(cast({c} as decimal(18,{places})) * {10 ** places} as hugeint) * total_orders)"
    return f"{Q.div(num, 'sum(total_orders)', digits, places)}"


follow_on("r24n_delivery_by_route", rollups.delivery_by_route, reports.delivery_efficiency,
          f"""select delivery_type, cast(sum(total_orders) as bigint) as total_orders,
          {_weighted('avg_delivery_days', 1, 1)} as avg_delivery_days,
          {_weighted('on_time_rate', 1, 1)} as on_time_rate,
          cast(round(sum(cast(total_sales as decimal(18,2))), 1) as double) as total_sales,
          {_weighted('avg_freight_cost', 1, 2)} as avg_freight_cost
          from report group by 1""", R.delivery_efficiency())
follow_on("r24o_delivery_overall", rollups.delivery_overall, reports.delivery_patterns,
          f"""select {_weighted('avg_delivery_days', 9, 1)} as avg_delivery_days,
          {Q.div('100 * sum(on_time_deliveries)', 'sum(total_orders)', 9)} as on_time_rate
          from report""", R.delivery_patterns())


def _sum(c: str, alias: str | None = None) -> str:
    return f"cast(sum({c}) as bigint) as {alias or c}"


def _mean_of(c: str) -> str:
    return Q.div(f"sum(cast(cast({c} as decimal(18,2)) * 100 as hugeint))", f"count({c})", 9, 2)


SALES_CENTS = "sum(cast(cast(total_sales as decimal(18,2)) * 100 as hugeint))"
REVENUE_CENTS = "sum(cast(cast(total_revenue as decimal(18,2)) * 100 as hugeint))"

follow_on("r24p_kpi_sales", rollups.kpi_sales, reports.monthly_sales_trends,
          f"""select {_money('total_sales')}, {_sum('total_orders')}, {_sum('total_items')},
          {Q.div(SALES_CENTS, 'sum(total_orders)', 9, 2)} as avg_order_value from report""",
          R.monthly_sales_trends())
follow_on("r24p_kpi_categories", rollups.kpi_categories, all_categories,
          f"""select count(*) as total_categories, {_money('total_revenue')},
          {_sum('unique_products', 'total_products')}, {_sum('items_sold', 'total_items_sold')}
          from report""", R.top_products_categories(limit=None))
follow_on("r24p_kpi_geography", rollups.kpi_geography, reports.sales_by_region,
          f"""select count(distinct customer_region) as total_regions, {_money('total_sales')},
          {_sum('unique_customers', 'total_customers')}, {_sum('unique_sellers', 'total_sellers')}
          from report""", R.sales_by_region())
follow_on("r24p_kpi_customers", rollups.kpi_customers, reports.customer_behavior,
          f"""select {_sum('customer_count', 'total_customers')},
          {_sum('one_time_customers', 'total_one_time')}, {_sum('repeat_customers', 'total_repeat')},
          {_mean_of('avg_customer_lifetime_value')} as avg_lifetime_value,
          {Q.div('100 * sum(repeat_customers)', 'sum(customer_count)', 9)} as repeat_rate
          from report""", R.customer_behavior())
follow_on("r24p_kpi_payments", rollups.kpi_payments, reports.payment_analysis,
          f"""select {_sum('total_orders')}, {_money('total_sales')}, {_money('total_payments')},
          {_mean_of('avg_installments')} as avg_installments from report""", R.payment_analysis())
follow_on("r24p_kpi_sellers", rollups.kpi_sellers, reports.seller_performance,
          f"""select {_sum('unique_sellers', 'total_sellers')}, {_money('total_revenue')},
          {Q.div(REVENUE_CENTS, 'sum(unique_sellers)', 9, 2)} as avg_revenue_per_seller,
          {_sum('unique_products_sold', 'total_products')} from report""", R.seller_performance())
follow_on("r24p_kpi_reviews", rollups.kpi_reviews, reports.reviews_sales_correlation,
          f"""select {_sum('total_items')}, {_money('total_sales')},
          {_sum('reviews_count', 'total_reviews')}, {_sum('no_review_count', 'no_reviews')},
          {Q.div('100 * sum(reviews_count)', 'sum(reviews_count + no_review_count)', 9)}
          as review_coverage from report""", R.reviews_sales_correlation())
follow_on("r24p_kpi_delivery", rollups.kpi_delivery, reports.delivery_patterns,
          f"""select {_sum('total_orders')}, {_money('total_sales')},
          {_weighted('avg_delivery_days', 9, 1)} as avg_delivery_days,
          {Q.div('100 * sum(on_time_deliveries)', 'sum(total_orders)', 9)} as overall_on_time_rate
          from report""", R.delivery_patterns())


# --- S, K: files ---------------------------------------------------------------------------------

CSV_COLUMNS = {name: e.columns for name, e in model.ENTITIES.items()}


def _csv_round_trip(spark, d, name, raw):
    path = scratch(spark, d, f"csv_{name}")
    text.write_cleaned(raw.select(*CSV_COLUMNS[name]), path)
    return text.read_entity(spark, path, model.ENTITIES[name])


def _trimmed(name: str) -> str:
    columns = ", ".join(f"nullif(trim({c}), '') as {c}" for c in CSV_COLUMNS[name])
    return f"select {columns} from raw_{name}"


for _name in ("orders", "customers", "order_items", "products", "payments", "sellers",
              "product_category_name_translation"):
    register(f"s1_scan_{_name}",
             lambda spark, d, n=_name: _csv_round_trip(spark, d, n, tb.raw_tables(spark, d)[n]),
             Q.query(_trimmed(_name)))


@query("s1_s2_clean_order_reviews",
       """select review_id, order_id, nullif(review_score, '') as review_score,
       nullif(review_comment_title, '') as review_comment_title,
       review_comment_message || chr(10) || 'second "line"' as review_comment_message,
       review_creation_date, review_answer_timestamp from raw_order_reviews""")
def _(spark, d):
    """Padded headers and fields, line ends and quotes in a field, and an all-empty row each."""
    raw = tb.raw_tables(spark, d)["order_reviews"]
    names = CSV_COLUMNS["order_reviews"]
    message = F.concat("review_comment_message", F.lit('\nsecond "line"'))
    padded = raw.withColumn("review_comment_message", message).select(
        *(F.concat(F.lit("  "), F.coalesce(c, F.lit("")), F.lit("\t ")).alias(c) for c in names))
    empty = raw.select(*(F.lit(" ").alias(c) for c in names))
    path = scratch(spark, d, "csv_messy_reviews")
    (padded.union(empty).toDF(*(f" {c} " for c in names)).write.mode("overwrite")
     .options(header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False,
              ignoreTrailingWhiteSpace=False).csv(path))
    return text.read_entity(spark, path, model.ENTITIES["order_reviews"])


SELLERS = "select seller_id, seller_zip_code_prefix, nullif(seller_city, '') as seller_city, seller_state from raw_sellers"


def _write_csv(df, path: str) -> None:
    (df.write.mode("overwrite").options(header=True, quote='"', escape='"', quoteAll=True).csv(path))


@query("s1_reordered_header", SELLERS)
def _(spark, d):
    """Files with other column orders and a further column."""
    raw, path = tb.raw_tables(spark, d)["sellers"], scratch(spark, d, f"csv_orders_{uuid4().hex}")
    first = F.col("seller_id") < F.lit("5")
    _write_csv(raw.filter(first).select("seller_city", F.lit("x").alias("extra"), "seller_state", "seller_id",
                                        "seller_zip_code_prefix"), f"{path}/a")
    _write_csv(raw.filter(~first).select("seller_state", "seller_zip_code_prefix", "seller_city", "seller_id"),
               f"{path}/b")
    return text.read_entity(spark, f"{path}/*", model.ENTITIES["sellers"])


@query("s2_line_ends", """select seller_id, seller_zip_code_prefix,
       coalesce(seller_city, '') || chr(10) || 'north, "old"' as seller_city, seller_state from raw_sellers""")
def _(spark, d):
    raw, path = tb.raw_tables(spark, d)["sellers"], scratch(spark, d, f"csv_lines_{uuid4().hex}")
    city = F.concat(F.coalesce("seller_city", F.lit("")), F.lit('\nnorth, "old"'))
    _write_csv(raw.withColumn("seller_city", city).select(*CSV_COLUMNS["sellers"]), path)
    return text.read_entity(spark, path, model.ENTITIES["sellers"])


@query("s2_rejects", """select count(*) as "rows", count(*) filter (seller_state = 'NATION_1' or
       seller_state = 'NATION_2') as ragged from raw_sellers""")
def _(spark, d):
    """Rows of one state have a field too many, those of another one too few."""
    raw, path = tb.raw_tables(spark, d)["sellers"], scratch(spark, d, f"csv_ragged_{uuid4().hex}")
    line = F.concat_ws(",", "seller_id", "seller_zip_code_prefix", F.lit("town"), "seller_state")
    line = (F.when(F.col("seller_state") == "NATION_1", F.concat(line, F.lit(",more")))
            .when(F.col("seller_state") == "NATION_2", F.concat_ws(",", "seller_id", "seller_zip_code_prefix"))
            .otherwise(line))
    header = spark.range(1).select(F.lit(-1).alias("at"), F.lit(",".join(CSV_COLUMNS["sellers"])).alias("value"))
    lines = header.union(raw.select(F.lit(0).alias("at"), line.alias("value")))
    lines.repartition(1).sortWithinPartitions("at").select("value").write.text(path)  # one small file
    return text.ragged_rows(spark, path, model.ENTITIES["sellers"]).select("rows", "ragged")


@query("s3_load_stamp", "select seller_id, '2024-05-01 06:30:00' as _sdc_extracted_at from raw_sellers")
def _(spark, d):
    sellers = tb.raw_tables(spark, d)["sellers"].select("seller_id")
    return text.with_load_stamp(sellers, datetime(2024, 5, 1, 6, 30))


@query("s4_seed_scan", "select state_code, state_name, region, economic_zone from raw_regions")
def _(spark, d):
    path = scratch(spark, d, "csv_seed")
    text.export_report(tb.region_seed(spark, d), path)
    return read_seed(spark, path)


@query("s5_source_binding", "select o_orderkey, o_custkey, o_orderstatus from orders")
def _(spark, d):
    return tables.bind(spark, {"orders": f"{d}/orders.parquet"}, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus")


@query("s6_mart_scan", """select order_status, count(*) as orders, min(date_key) as first_day
       from (select order_status, strftime(order_purchase_timestamp, '%Y-%m-%d') as date_key
             from dim_orders) group by 1""")
def _(spark, d):
    return marts(spark, d)["dim_orders"].groupBy("order_status").agg(
        F.count(F.lit(1)).alias("orders"),
        F.min(S.date_key("order_purchase_timestamp")).alias("first_day"))


@query("r22_marts_present", " union all ".join(
    f"""select '{name}' as table_name, 'true' as present, (count(*) > 0)::varchar as has_rows,
        {len(model.MARTS)}::bigint as mart_tables from {name}""" for name in sorted(model.MARTS)))
def _(spark, d):
    """Is each mart in the catalogue, does it hold rows, and how many tables there are named like a mart."""
    stored = marts(spark, d).marts()
    for name, df in stored.items():
        df.createOrReplaceTempView(name)
    there = spark.createDataFrame([(n, tables.table_exists(spark, n)) for n in stored], "table_name string, present boolean")
    return (there.join(tables.validate_tables(stored), "table_name")
            .crossJoin(tables.count_mart_tables(spark, list(stored)).withColumnRenamed("table_count", "mart_tables")))  # one row


@query("s7_table_info")
def _(spark, d):
    return tables.table_info(marts(spark, d).marts())


@query("s8_scan_geolocation",
       """select customer_zip_code_prefix as geolocation_zip_code_prefix,
       trim(customer_city) as geolocation_city, upper(trim(customer_state)) as geolocation_state
       from raw_customers""")
def _(spark, d):
    places = tb.raw_tables(spark, d)["customers"].select(
        F.col("customer_zip_code_prefix").alias("geolocation_zip_code_prefix"),
        F.lit(None).cast("string").alias("geolocation_lat"),
        F.lit(None).cast("string").alias("geolocation_lng"),
        F.col("customer_city").alias("geolocation_city"),
        F.upper("customer_state").alias("geolocation_state"))
    return _csv_round_trip(spark, d, "geolocation", places).drop("geolocation_lat", "geolocation_lng")


@query("k1_raw_load", "select customer_id, customer_unique_id, customer_city from raw_customers")
def _(spark, d):
    path = scratch(spark, d, "raw_customers")
    tables.write_raw(tb.raw_tables(spark, d)["customers"], path)
    return spark.read.parquet(path).select("customer_id", "customer_unique_id", "customer_city")


@query("k2_cleaned_csv", "select seller_id, trim(seller_city) as seller_city from raw_sellers")
def _(spark, d):
    path = scratch(spark, d, "cleaned_sellers")
    sellers = tb.raw_tables(spark, d)["sellers"].select("seller_id", S.clean("seller_city").alias("seller_city"))
    text.write_cleaned(sellers, path)
    return spark.read.schema(sellers.schema).csv(path, header=True)


@query("k3_partitioned_mart", """select strftime(modified_at, '%Y-%m') as period, count(*) as orders
       from dim_orders group by 1""")
def _(spark, d):
    path = scratch(spark, d, "dim_orders_by_month")
    tables.write_mart(marts(spark, d)["dim_orders"].drop("period"), path, model.MARTS["dim_orders"], "month")
    return tables.read_mart(spark, path).groupBy(F.col("period").cast("string").alias("period")).agg(
        F.count(F.lit(1)).alias("orders"))


@query("k4_clustered_mart", f"""select seller_key, count(*) as items, {Q.total('item_price')} as price
       from fact_sales group by 1""")
def _(spark, d):
    path = scratch(spark, d, "fact_by_year")
    tables.write_mart(marts(spark, d)["fact_sales"].drop("period"), path, model.MARTS["fact_sales"], "year")
    return tables.read_mart(spark, path).groupBy("seller_key").agg(
        F.count(F.lit(1)).alias("items"), M.money_total("item_price").alias("price"))


@query("k5_report_export", """select category, unique_products, items_sold, total_revenue
       from report""", report=R.top_products_categories())
def _(spark, d):
    path = scratch(spark, d, "top_categories_csv")
    report = reports.top_products_categories(marts(spark, d)).select(
        "category", "unique_products", "items_sold", "total_revenue")
    text.export_report(report, path)
    return spark.read.schema(report.schema).csv(path, header=True)


# --- P: projection and filters ----------------------------------------------------------------------

@query("p1_p4_projection", """select order_id || '-' || order_item_id as order_item_sk,
       cast(price + freight_value as double) as total_item_value, cast(1 as bigint) as quantity, order_id, product_id
       from stg_order_items""")
def _(spark, d):
    items = plans(spark, d)["stg_order_items"].alias("i")
    wide = items.select("i.*", (F.col("price") + F.col("freight_value")).alias("total_item_value"),
                        F.lit(1).alias("quantity"),
                        S.make_key("order_id", "order_item_id").alias("order_item_sk"))
    return wide.drop("order_item_id", "seller_id", "shipping_limit_date", "price",
                     "freight_value", "modified_at")


@query("p5_not_null_filter", """select order_key, days_to_delivery from dim_orders
       where days_to_delivery is not null""")
def _(spark, d):
    return (marts(spark, d)["dim_orders"].filter(F.col("days_to_delivery").isNotNull())
            .select("order_key", "days_to_delivery"))


@query("p6_null_id_purge", """select count(product_category_name) as kept,
       count(*) - count(product_category_name) as dropped from raw_products""")
def _(spark, d):
    return incremental.purge_report(tb.raw_tables(spark, d)["products"], "product_category_name")


@query("p6_purged_rows", """select product_id, product_category_name from raw_products
       where product_category_name is not null""")
def _(spark, d):
    return incremental.purge_null_ids(tb.raw_tables(spark, d)["products"], "product_category_name").select(
        "product_id", "product_category_name")


@query("p6_purged_raw_tables", " union all ".join(
    f"select '{t}' as table_name, count({k}) as kept from raw_{t}" for t, k in model.PURGED_ON.items()))
def _(spark, d):
    raw = tb.raw_tables(spark, d)
    purged = incremental.purge_raw({name: raw[name] for name in model.PURGED_ON})
    counts = [df.agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("kept"))
              for name, df in purged.items()]
    return reduce(DataFrame.unionByName, counts)


@query("p7_sentinel_filters", "select * from report", report=R.sales_by_state())
def _(spark, d):
    return reports.sales_by_state(marts(spark, d), model.ALL_YEARS, model.ALL_REGIONS)


@query("p8_region_side", f"""select 'customer' as side, count(*) as items from sale
       where customer_region = '{TEST_REGION}' union all
       select 'seller', count(*) from sale where seller_region = '{TEST_REGION}'""")
def _(spark, d):
    m = marts(spark, d)
    by_customer = reports.reviews_sales_correlation(m, region=TEST_REGION).agg(
        F.lit("customer").alias("side"), F.sum("total_items").alias("items"))
    by_seller = reports.seller_performance(m, region=TEST_REGION).agg(
        F.lit("seller").alias("side"), F.sum("total_items").alias("items"))
    return by_customer.unionByName(by_seller)


@query("p9_p13_predicate_list", f"""select customer_state, count(*) as customers from dim_customers
       where customer_region = '{TEST_REGION}' and customer_city <> 'machinery' group by 1""")
def _(spark, d):
    wanted = [F.lit(True), F.col("customer_region") == TEST_REGION, F.col("customer_city") != "machinery"]
    return (marts(spark, d)["dim_customers"].filter(reports.conjunction(wanted))
            .groupBy("customer_state").agg(F.count(F.lit(1)).alias("customers")))


@query("p10_p11_case_buckets", """select
       case when days_to_delivery <= 5 then 'Very Fast (≤5 days)'
            when days_to_delivery <= 10 then 'Fast (6-10 days)'
            when days_to_delivery <= 20 then 'Normal (11-20 days)'
            when days_to_delivery <= 30 then 'Slow (21-30 days)' else 'Very Slow (>30 days)' end as speed,
       case when n = 1 then 'One-Time Customer' when n between 2 and 5 then 'Regular Customer'
            when n > 5 then 'Loyal Customer' end as behaviour,
       case when v <= 100 then 'Low Value' when v between 101 and 500 then 'Medium Value'
            when v > 500 then 'High Value' end as value_segment,
       count(*) as orders
       from (select days_to_delivery, cast(order_key as bigint) % 9 + 1 as n,
                    cast(order_key as bigint) % 600 + 0.5 as v from dim_orders) group by 1, 2, 3""")
def _(spark, d):
    key = F.col("order_key").cast("bigint")
    return (marts(spark, d)["dim_orders"].groupBy(
        S.delivery_speed(F.col("days_to_delivery")).alias("speed"),
        S.behaviour_segment(key % 9 + 1).alias("behaviour"),
        S.value_segment(key % 600 + F.lit(0.5)).alias("value_segment"))
        .agg(F.count(F.lit(1)).alias("orders")))


@query("p12_nullable_boolean", """select order_status, count(*) filter (is_delivered_on_time) as on_time,
       count(*) filter (not is_delivered_on_time) as late, count(*) as orders
       from dim_orders group by 1""")
def _(spark, d):
    return marts(spark, d)["dim_orders"].groupBy("order_status").agg(
        M.count_if("is_delivered_on_time").alias("on_time"),
        M.count_if(~F.col("is_delivered_on_time")).alias("late"),
        F.count(F.lit(1)).alias("orders"))


@query("p14_p15_filtered_renamed", """select review_category as "Review Category",
       total_sales as "Total Sales" from report where review_category <> 'No Review'""",
       report=R.reviews_sales_correlation())
def _(spark, d):
    report = reports.reviews_sales_correlation(marts(spark, d))
    return report.filter(F.col("review_category") != model.NO_REVIEW).select(
        F.col("review_category").alias("Review Category"), F.col("total_sales").alias("Total Sales"))


# --- J: joins ---------------------------------------------------------------------------------------

@query("j1_inner_chain", """select customer_unique_id, count(*) as items from stg_order_items
       join stg_orders using (order_id) join stg_customers using (customer_id) group by 1""")
def _(spark, d):
    w = marts(spark, d)
    orders = w["stg_orders"].select("order_id", "customer_id")
    people = w["stg_customers"].select("customer_id", "customer_unique_id")
    return (w["stg_order_items"].select("order_id").join(orders, "order_id").join(people, "customer_id")
            .groupBy("customer_unique_id").agg(F.count(F.lit(1)).alias("items")))


@query("j2_left_dims", """select cast(payment_key is null as varchar) as unpaid,
       cast(review_key is null as varchar) as unreviewed, count(*) as items from fact_sales group by 1, 2""")
def _(spark, d):
    return marts(spark, d)["fact_sales"].groupBy(
        F.col("payment_key").isNull().alias("unpaid"),
        F.col("review_key").isNull().alias("unreviewed")).agg(F.count(F.lit(1)).alias("items"))


@query("j3_case_folded_lookup", """select customer_region, customer_state_name, count(*) as customers
       from dim_customers group by 1, 2""")
def _(spark, d):
    w = marts(spark, d)
    people = w["stg_customers"].groupBy("customer_unique_id").agg(
        F.min_by("customer_state", "customer_id").alias("customer_state"))
    placed = joins.with_region(people.withColumn("customer_state", F.lower("customer_state")),
                               w["state_regions"], "customer_state", "customer", "customer_unique_id")
    return placed.groupBy("customer_region", F.upper("customer_state_name").alias("customer_state_name")
                          ).agg(F.count(F.lit(1)).alias("customers"))


@query("j3_salted_lookup", """select customer_region, count(*) as customers
       from stg_customers left join (select state_code, region as customer_region from raw_regions)
            on customer_state = state_code group by 1""")
def _(spark, d):
    """The shuffle form of the lookup join, which a lookup over its row limit takes."""
    w = marts(spark, d)
    seed = w["state_regions"].select("state_code", F.col("region").alias("customer_region"))
    joined = joins.lookup_join(w["stg_customers"], seed, F.col("customer_state"), "state_code",
                               "customer_id", max_rows=1)
    return joined.groupBy("customer_region").agg(F.count(F.lit(1)).alias("customers"))


@query("j4_trimmed_lookup", """select product_category_english, count(*) as products
       from dim_products group by 1""")
def _(spark, d):
    return marts(spark, d)["dim_products"].groupBy("product_category_english").agg(
        F.count(F.lit(1)).alias("products"))


@query("j5_star_join", f"""select year, customer_region, seller_region, product_category_english,
       count(*) as items, {Q.total('total_item_value')} as sales from sale group by 1, 2, 3, 4""")
def _(spark, d):
    m = marts(spark, d)
    return (m["fact_sales"].select("date_key", "customer_key", "seller_key", "product_key", "total_item_value")
            .join(m["dim_date"].select("date_key", "year"), "date_key")
            .join(m["dim_customers"].select("customer_key", "customer_region"), "customer_key")
            .join(m["dim_sellers"].select("seller_key", "seller_region"), "seller_key")
            .join(m["dim_products"].select("product_key", "product_category_english"), "product_key")
            .groupBy("year", "customer_region", "seller_region", "product_category_english")
            .agg(F.count(F.lit(1)).alias("items"), M.money_total("total_item_value").alias("sales")))


@query("j6_left_star_join", "select review_score, total_orders from report",
       report=R.review_score_distribution())
def _(spark, d):
    return reports.review_score_distribution(marts(spark, d)).select("review_score", "total_orders")


@query("j7_conditional_join", "select * from report", report=R.payment_analysis(TEST_YEAR))
def _(spark, d):
    return reports.payment_analysis(marts(spark, d), year=TEST_YEAR)


@query("j8_j9_order_lookup", "select review_key, days_to_review from dim_reviews")
def _(spark, d):
    return marts(spark, d)["dim_reviews"].select("review_key", "days_to_review")


@query("j10_high_water_mark", """select count(*) as newer from stg_orders
       where modified_at > (select max(modified_at) from stg_orders
                            where modified_at < timestamp '1998-07-01')""")
def _(spark, d):
    orders = marts(spark, d)["stg_orders"]
    target = orders.filter(F.col("modified_at") < F.lit("1998-07-01").cast("timestamp"))
    return incremental.newer_than(orders, target, "modified_at").agg(F.count(F.lit(1)).alias("newer"))


@query("j11_orphans", """select product_id as key, count(*) as child_rows from stg_order_items
       where product_id not in (select product_id from stg_products
                                where product_category_name is not null) group by 1""")
def _(spark, d):
    w = plans(spark, d)
    listed = w["stg_products"].filter(F.col("product_category_name").isNotNull())
    return joins.orphans(w["stg_order_items"], "product_id", listed, "product_id")


# --- A: aggregates -----------------------------------------------------------------------------------

@query("a1_a4_basic_aggregates", f"""select seller_key, count(*) as items, count(review_key) as reviewed,
       count(distinct order_key) as orders, count(distinct customer_key) as customers,
       {Q.total('item_price')} as price, {Q.avg_money('item_price')} as avg_price,
       cast(min(item_price) as double) as min_price, cast(max(item_price) as double) as max_price,
       round(stddev_samp(cast(item_price as double)), 3) as sd_price from fact_sales group by 1""")
def _(spark, d):
    return marts(spark, d)["fact_sales"].groupBy("seller_key").agg(
        F.count(F.lit(1)).alias("items"), F.count("review_key").alias("reviewed"),
        F.countDistinct("order_key").alias("orders"),
        F.countDistinct("customer_key").alias("customers"),
        M.money_total("item_price").alias("price"), M.mean("item_price").alias("avg_price"),
        F.min("item_price").alias("min_price"), F.max("item_price").alias("max_price"),
        F.round(F.stddev_samp(F.col("item_price").cast("double")), 3).alias("sd_price"))


@query("a5_any_value", "select customer_key, customer_id_original, customer_city from dim_customers")
def _(spark, d):
    return marts(spark, d)["dim_customers"].select("customer_key", "customer_id_original", "customer_city")


@query("a6_a7_payment_flags", """select payment_key, cast(uses_voucher as varchar) as uses_voucher,
       cast(uses_credit_card as varchar) as uses_credit_card, primary_payment_type from dim_payments""")
def _(spark, d):
    return marts(spark, d)["dim_payments"].select(
        "payment_key", "uses_voucher", "uses_credit_card", "primary_payment_type")


@query("a8_a10_conditional_ratio", f"""select date_key, count(*) filter (uses_voucher) as vouchers,
       {Q.pct('count(*) filter (uses_voucher)', 'count(distinct order_key)')} as rate,
       count(*) - count(review_key) as unreviewed from fact_sales group by 1""")
def _(spark, d):
    return marts(spark, d)["fact_sales"].groupBy("date_key").agg(
        M.count_if("uses_voucher").alias("vouchers"),
        M.percent(M.count_if("uses_voucher"), F.countDistinct("order_key")).alias("rate"),
        (F.count(F.lit(1)) - F.count("review_key")).alias("unreviewed"))


@query("a11_a12_computed_groups", """select coalesce(primary_payment_type, 'none') as kind,
       case when total_installments <= 3 then 'few' else 'many' end as instalments, count(*) as orders
       from dim_payments group by 1, 2""")
def _(spark, d):
    return marts(spark, d)["dim_payments"].groupBy(
        F.coalesce("primary_payment_type", F.lit("none")).alias("kind"),
        F.when(F.col("total_installments") <= 3, "few").otherwise("many").alias("instalments")).agg(
        F.count(F.lit(1)).alias("orders"))


@query("a13_distinct_dates", """select distinct strftime(order_purchase_timestamp, '%Y-%m-%d') as day
       from stg_orders""")
def _(spark, d):
    return marts(spark, d)["stg_orders"].select(S.date_key("order_purchase_timestamp").alias("day")).distinct()


@query("a14_a15_customer_profile", f"""select customer_key, count(distinct order_key) as order_count,
       {Q.total('total_item_value')} as total_spent,
       {Q.avg_money('total_item_value')} as avg_item_value from sale group by 1""")
def _(spark, d):
    return reports.customer_profile(marts(spark, d)).select(
        "customer_key", "order_count", "total_spent", "avg_item_value")


@query("a16_a20_global_weighted_mean", f"""select {Q.div('sum(days_to_delivery * n)', 'sum(n)', 1)} as days
       from (select order_key, days_to_delivery, count(*) as n from sale
             where days_to_delivery is not null group by 1, 2)""")
def _(spark, d):
    m = marts(spark, d)
    weights = m["fact_sales"].groupBy("order_key").agg(F.count(F.lit(1)).alias("n"))
    days = m["dim_orders"].filter(F.col("days_to_delivery").isNotNull()).select("order_key", "days_to_delivery")
    return weights.join(days, "order_key").agg(M.weighted_mean("days_to_delivery", "n").alias("days"))


@query("a17_share_of_total", "select order_count, percentage_of_customers from report",
       report=R.customer_frequency())
def _(spark, d):
    return reports.customer_frequency(marts(spark, d)).select("order_count", "percentage_of_customers")


@query("a23_numeric_profile_of_sample", """
       select 'l_quantity' as column_name, count(l_quantity) as "count", avg(l_quantity) as mean,
              stddev_samp(l_quantity) as std, min(l_quantity) as "min",
              quantile_cont(l_quantity, 0.25) as q25, quantile_cont(l_quantity, 0.5) as q50,
              quantile_cont(l_quantity, 0.75) as q75, max(l_quantity) as "max" from picked
       union all select 'l_tax', count(l_tax), avg(l_tax), stddev_samp(l_tax), min(l_tax),
              quantile_cont(l_tax, 0.25), quantile_cont(l_tax, 0.5), quantile_cont(l_tax, 0.75),
              max(l_tax) from picked""",
       picked="""select l_quantity, l_tax from lineitem order by l_orderkey, l_linenumber, l_partkey,
                 l_suppkey, l_extendedprice, l_quantity, l_tax limit 100""")
def _(spark, d):
    lines = tb.given_tables(spark, d)["lineitem"]
    picked = profile.sample_rows(lines, 100, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                                              "l_extendedprice", "l_quantity", "l_tax"])
    return profile.numeric_profile(picked.select("l_quantity", "l_tax"))


PROFILED = ("item_price", "freight_value", "total_item_value", "payment_value", "total_installments")


@query("a23_numeric_profile_of_table", " union all ".join(
    f"""select '{c}' as column_name, n as "count", round(m, 6) as mean, round(s, 6) as std, lo as "min",
           round(q[1], 6) as q25, round(q[2], 6) as q50, round(q[3], 6) as q75, hi as "max"
    from (select count({c}) as n, avg(cast({c} as double)) as m, stddev_samp(cast({c} as double)) as s,
          cast(min({c}) as double) as lo, cast(max({c}) as double) as hi,
          quantile_cont(cast({c} as double), [0.25, 0.5, 0.75]) as q
          from fact_sales)""" for c in PROFILED))
def _(spark, d):
    profiled = profile.numeric_profile(marts(spark, d)["fact_sales"].select(*PROFILED))
    rounded = ("mean", "std", "q25", "q50", "q75")
    return profiled.select(*(F.round(c, 6).alias(c) if c in rounded else c for c in profiled.columns))


@query("a24_value_counts", """select 'order_status' as column_name, order_status as value, count(*) as n
       from dim_orders group by order_status""")
def _(spark, d):
    return profile.value_counts(marts(spark, d)["dim_orders"], ["order_key", "order_status"])


@query("a24_distinct_counts", """select 'order_key' as column_name, count(distinct order_key) as
       distinct_values from dim_orders union all
       select 'order_status', count(distinct order_status) from dim_orders""")
def _(spark, d):
    return profile.distinct_counts(marts(spark, d)["dim_orders"], ["order_key", "order_status"])


# --- W-a..W-c, T, U: windows, top-k, set operations -----------------------------------------------------

@query("wa_keep_latest", f"select {shown('order_id order_item_id product_id modified_at')} from stg_order_items")
def _(spark, d):
    return plans(spark, d)["stg_order_items"].select("order_id", "order_item_id", "product_id", "modified_at")


@query("wb_latest_review", "select review_key, review_score, "
       f"{shown('review_creation_date')} from dim_reviews")
def _(spark, d):
    reviews = plans(spark, d)["stg_order_reviews"]
    newest = keep_latest(reviews, ["order_id"], ["review_creation_date", "review_score"], ["review_id"])
    return newest.select(F.col("order_id").alias("review_key"), "review_score", "review_creation_date")


@query("wc_percent_of_total", "select total_installments, percentage_of_orders from report",
       report=R.installment_analysis())
def _(spark, d):
    return reports.installment_analysis(marts(spark, d)).select("total_installments", "percentage_of_orders")


@query("t1_t2_top_products", f"""select product_key, {Q.total('total_item_value')} as revenue
       from fact_sales group by 1 order by revenue desc, product_key limit 15""")
def _(spark, d):
    sold = marts(spark, d)["fact_sales"].groupBy("product_key").agg(
        M.money_total("total_item_value").alias("revenue"))
    return ranking.top_n(sold, "revenue", 15, "product_key")


@query("t3_t5_resorted_head", """select category, avg_item_value from report
       order by avg_item_value desc, category limit 4""", report=R.top_products_categories())
def _(spark, d):
    report = reports.top_products_categories(marts(spark, d)).select("category", "avg_item_value")
    return ranking.top_n(report, "avg_item_value", 4, "category")


@query("t4_sample_rows", f"select {shown(TABLE_COLUMNS['dim_sellers'])} from dim_sellers "
       "order by seller_key limit 5")
def _(spark, d):
    return profile.sample_rows(marts(spark, d)["dim_sellers"], 5, ["seller_key"]).drop("period")


@query("t6_u1_states_with_others", """select least(n, 11) as position,
       case when n <= 10 then customer_state else 'Others' end as customer_state,
       cast(sum(cast(total_sales as decimal(18,2))) as double) as total_sales
       from (select *, row_number() over (order by total_sales desc, customer_state) as n from report)
       group by 1, 2""", report=R.sales_by_state())
def _(spark, d):
    return ranking.top_with_others(reports.sales_by_state(marts(spark, d)), "customer_state", "total_sales")


# --- F: scalar functions --------------------------------------------------------------------------------

@query("f1_f5_text_and_casts", """select review_id, upper(trim(title)) as title,
       try_cast(nullif(trim(score), '') as bigint) as score,
       coalesce(try_cast(nullif(trim(score), '') as bigint), 0) as score_or_0,
       coalesce(nullif(trim(title), ''), 'unknown') as title_or_unknown
       from (select review_id, '  ' || review_comment_title || ' ' as title,
                    ' ' || review_score || ' ' as score from raw_order_reviews)""")
def _(spark, d):
    raw = tb.raw_tables(spark, d)["order_reviews"].select(
        "review_id", F.concat(F.lit(" \t"), "review_comment_title", F.lit(" ")).alias("title"),
        F.concat(F.lit(" "), "review_score", F.lit("\n")).alias("score"))
    return raw.select("review_id", F.upper(S.clean("title")).alias("title"),
                      S.to_long("score").alias("score"), S.to_long("score", 0).alias("score_or_0"),
                      F.coalesce(S.filled("title"), F.lit("unknown")).alias("title_or_unknown"))


@query("f6_f17_keys", """select order_id || '-' || order_item_id || '-' || product_id as k
       from stg_order_items""")
def _(spark, d):
    return plans(spark, d)["stg_order_items"].select(S.make_key("order_id", "order_item_id", "product_id").alias("k"))


@query("f7_f12_dates", f"""select {shown(TABLE_COLUMNS['dim_date'])},
       strftime(full_date, '%Y-%m') as month_year from dim_date""")
def _(spark, d):
    return marts(spark, d)["dim_date"].withColumn("month_year", F.date_format("full_date", "yyyy-MM"))


@query("f9_day_difference", """select order_key, days_to_delivery, delivery_vs_estimate_days from dim_orders""")
def _(spark, d):
    orders = marts(spark, d)["stg_orders"]
    return orders.select(
        F.col("order_id").alias("order_key"),
        S.days_between("order_delivered_customer_date", "order_purchase_timestamp").alias("days_to_delivery"),
        S.days_between("order_delivered_customer_date", "order_estimated_delivery_date")
        .alias("delivery_vs_estimate_days"))


@query("f13_f14_rounding", """select order_item_sk,
       cast(round(item_price * 0.3333, 1) as double) as one_digit,
       cast(round(freight_value * 1.005, 2) as double) as two_digits from fact_sales""")
def _(spark, d):
    return marts(spark, d)["fact_sales"].select(
        "order_item_sk",
        M.rounded(F.col("item_price") * F.lit("0.3333").cast("decimal(5,4)"), 1).alias("one_digit"),
        M.rounded(F.col("freight_value") * F.lit("1.005").cast("decimal(4,3)")).alias("two_digits"))


@query("f15_guarded_volume", "select product_key, product_volume_cm3 from dim_products")
def _(spark, d):
    return tb.raw_tables(spark, d)["products"].select(
        F.col("product_id").alias("product_key"),
        S.positive_product("product_length_cm", "product_height_cm", "product_width_cm")
        .alias("product_volume_cm3"))


@query("f16_strict_greatest", """select order_id, case when order_delivered_customer_date is not null
       and order_delivered_carrier_date is not null then strftime(greatest(order_purchase_timestamp,
       order_delivered_carrier_date, order_delivered_customer_date, order_estimated_delivery_date),
       '%Y-%m-%d %H:%M:%S') end as latest from stg_orders""")
def _(spark, d):
    return marts(spark, d)["stg_orders"].select("order_id", S.greatest_strict(
        "order_purchase_timestamp", "order_delivered_carrier_date", "order_delivered_customer_date",
        "order_estimated_delivery_date").alias("latest"))


@query("f18_timestamp_millis", """select event_id, strftime(make_timestamp(event_id * 1000 * 60000),
       '%Y-%m-%d %H:%M:%S') as at from events""")
def _(spark, d):
    return tb.given_tables(spark, d)["events"].select(
        "event_id", F.timestamp_millis(F.col("event_id") * 60000).alias("at"))


@query("f19_text_flags", """select cast(has_comment_title as varchar) as has_comment_title,
       cast(has_comment_message as varchar) as has_comment_message, count(*) as reviews
       from dim_reviews group by 1, 2""")
def _(spark, d):
    return marts(spark, d)["dim_reviews"].groupBy("has_comment_title", "has_comment_message").agg(
        F.count(F.lit(1)).alias("reviews"))


@query("f20_like", "select seller_key from dim_sellers where seller_city like 'supplier_00%7'")
def _(spark, d):
    return marts(spark, d)["dim_sellers"].filter(F.col("seller_city").like("supplier_00%7")).select("seller_key")


@query("f22_f24_rates_and_labels", """select customer_region || ' → ' || seller_region as route,
       count(*) as items, count(*) / 1048576 as mega_items from sale group by 1""")
def _(spark, d):
    m = marts(spark, d)
    report = reports.sales_by_region(m)
    return report.select(S.arrow_label("customer_region", "seller_region").alias("route"),
                         F.col("total_items").alias("items"), S.megabytes("total_items").alias("mega_items"))


# --- W1-W5: maintenance ------------------------------------------------------------------------------------

CUT = "1998-07-01"


@query("w1_newer_than", f"""select order_id, {shown('modified_at')} from stg_orders where modified_at >
       (select max(modified_at) from stg_orders where modified_at < timestamp '{CUT}')""")
def _(spark, d):
    orders = marts(spark, d)["stg_orders"]
    target = orders.filter(F.col("modified_at") < F.lit(CUT).cast("timestamp"))
    return incremental.newer_than(orders, target, "modified_at").select("order_id", "modified_at")


@query("w2_upsert", f"""select order_key, case when modified_at < timestamp '{CUT}' then 'OLD'
       else order_status end as order_status from dim_orders""")
def _(spark, d):
    """Everything up to a year past the cut is stored as 'OLD'; the rows after the cut replace it."""
    orders = marts(spark, d)["dim_orders"].select("order_key", "order_status", "modified_at")
    stored = (orders.filter(F.col("modified_at") < F.lit("1999-07-01").cast("timestamp"))
              .withColumn("order_status", F.lit("OLD")))
    fresh = orders.filter(F.col("modified_at") >= F.lit(CUT).cast("timestamp"))
    return incremental.upsert(stored, fresh, ["order_key"]).drop("modified_at")


@query("w3_append", f"""select date_key, year from dim_date union all
       select date_key, year from dim_date where full_date < date '{CUT}'""")
def _(spark, d):
    days = marts(spark, d)["dim_date"].select("date_key", "year", "full_date")
    return incremental.append(days.filter(F.col("full_date") < F.lit(CUT)), days).drop("full_date")


@query("w4_schema_sync", f"""select order_key, order_status,
       case when modified_at >= timestamp '{CUT}' then days_to_delivery end as days_to_delivery
       from dim_orders""")
def _(spark, d):
    """The stored table has a column that is gone and lacks one that is new."""
    orders = marts(spark, d)["dim_orders"]
    stored = orders.filter(F.col("modified_at") < F.lit(CUT).cast("timestamp")).select(
        "order_key", "order_status", F.lit("x").alias("gone"))
    fresh = orders.filter(F.col("modified_at") >= F.lit(CUT).cast("timestamp")).select(
        "order_key", "order_status", F.col("days_to_delivery"))
    return incremental.upsert(stored, fresh, ["order_key"])


def _loads(raw, column: str, born: str, gone: str, changed: tuple[str, str]):
    """Two loads of a raw table, split by load stamp.

    Rows stamped from `born` on are missing in the first load and those before `gone` in the
    second; rows stamped within `changed` come back altered, stamped 90 years later.
    """
    stamp = F.col(model.LOAD_STAMP)
    altered = stamp.between(*(F.lit(t).cast("timestamp") for t in changed))
    first = raw.filter(stamp < F.lit(born).cast("timestamp"))
    second = (raw.filter(stamp >= F.lit(gone).cast("timestamp"))
              .withColumn(column, F.when(altered, F.lit("moved")).otherwise(F.col(column)))
              .withColumn(model.LOAD_STAMP, F.when(altered, stamp + F.expr("interval 90 years"))
                          .otherwise(stamp)))
    return first, second


def _scd2_sql(raw: str, key: str, column: str, born: str, gone: str, changed: tuple[str, str]) -> str:
    ts = "'%Y-%m-%d %H:%M:%S'"
    return f"""
        with v as (
            select {key}, {column}, _sdc_extracted_at as a,
                   _sdc_extracted_at + interval 90 year as b,
                   _sdc_extracted_at < timestamp '{born}' as in_first,
                   _sdc_extracted_at >= timestamp '{gone}' as in_second,
                   _sdc_extracted_at between timestamp '{changed[0]}' and timestamp '{changed[1]}'
                       as altered
            from {raw}),
        h as (
            select {key}, {column}, a as from_ts,
                   case when in_second and altered then b end as to_ts from v where in_first
            union all
            select {key}, case when altered then 'moved' else {column} end,
                   case when altered then b else a end, null
            from v where in_second and (altered or not in_first))
        select {key}, {column}, strftime(from_ts, {ts}) as dbt_valid_from,
               strftime(to_ts, {ts}) as dbt_valid_to, strftime(from_ts, {ts}) as dbt_updated_at,
               md5({key} || '|' || strftime(from_ts, {ts})) as dbt_scd_id from h"""


def _snapshot(entity: str, key: str, column: str, *split):
    def run(spark, d):
        raw = tb.raw_tables(spark, d)[entity].select(key, column, model.LOAD_STAMP)
        first, second = _loads(raw, column, *split)
        versions = history.apply_load(None, first, key, model.LOAD_STAMP)
        versions = history.apply_load(versions, second, key, model.LOAD_STAMP)
        return versions.drop(model.LOAD_STAMP)
    return run


def _stored_snapshot(entity: str, column: str, *split):
    """The same history, kept on disk by two runs of the warehouse (and a third without news)."""
    def run(spark, d):
        key = model.SNAPSHOTS[entity]
        raw = tb.raw_tables(spark, d)[entity].select(key, column, model.LOAD_STAMP)
        root = scratch(spark, d, f"snapshot_{entity}_{uuid4().hex}")
        first, second = _loads(raw, column, *split)
        for load in (first, second, second):
            stored = Warehouse(spark, {entity: load}, tb.region_seed(spark, d), root, "year").snapshot(entity)
        return stored.drop(model.LOAD_STAMP)
    return run


JANUARY = ("2001-01-28", "2001-01-04", ("2001-01-10", "2001-01-15"))
for _entity, _key, _column, _split in (
        ("customers", "customer_id", "customer_city", JANUARY),
        ("orders", "order_id", "order_status",
         ("2001-01-01", "1995-03-01", ("1997-01-01", "1998-01-01"))),
        ("sellers", "seller_id", "seller_city", JANUARY)):
    register(f"w5_snapshot_{_entity}", _snapshot(_entity, _key, _column, *_split),
             Q.query("select * from history",
                     history=_scd2_sql(f"raw_{_entity}", _key, _column, *_split)))
    register(f"w5_stored_snapshot_{_entity}", _stored_snapshot(_entity, _column, *_split),
             Q.query("select * from history",
                     history=_scd2_sql(f"raw_{_entity}", _key, _column, *_split)))


VERSIONS = """select seller_id, seller_city, n, strftime(since, '%Y-%m-%d %H:%M:%S') as dbt_valid_from,
       strftime(lead(since) over (partition by seller_id order by since), '%Y-%m-%d %H:%M:%S') as dbt_valid_to
       from (select l_suppkey::varchar as seller_id, max(l_returnflag) as seller_city, count(*)::bigint as n, l_shipdate::timestamp as since
             from lineitem group by l_suppkey, l_shipdate)"""


def _seller_versions(spark, d):
    """A seller's load with a version for every day it shipped on."""
    return tb.given_tables(spark, d)["lineitem"].groupBy(
        F.col("l_suppkey").cast("string").alias("seller_id"), F.col("l_shipdate").cast("timestamp").alias(model.LOAD_STAMP)).agg(
        F.max("l_returnflag").alias("seller_city"), F.count(F.lit(1)).alias("n"))


@query("w5_many_versions_in_a_load", VERSIONS)
def _(spark, d):
    return history.chained(_seller_versions(spark, d), "seller_id", model.LOAD_STAMP).select(
        "seller_id", "seller_city", "n", history.FROM, history.TO)


@query("w5_stored_many_versions", VERSIONS)
def _(spark, d):
    """The same versions kept on disk by two loads, those before the cut and those after it."""
    load, root = _seller_versions(spark, d), scratch(spark, d, f"versions_{uuid4().hex}")
    w = Warehouse(spark, {}, tb.region_seed(spark, d), root, "year")
    for part in (_early(load), _late(load)):
        stored = w.snapshot("sellers", part)
    return stored.select("seller_id", "seller_city", "n", history.FROM, history.TO)


def _early(df, stamp=model.LOAD_STAMP):
    return df.filter(F.col(stamp) < F.lit(CUT).cast("timestamp"))


def _late(df, stamp=model.LOAD_STAMP):
    return df.filter(F.col(stamp) >= F.lit(CUT).cast("timestamp"))


def _all(df):
    return df


def _loads_of(mart: str, entities: tuple[str, ...], keep: tuple[str, ...] = (), first=_early,
              first_kept=None, reopen: bool = False):
    """A stored mart after two refreshes and one without news.

    The first load has the rows of `entities` that `first` lets through and, of the tables it
    takes as they are, those that `first_kept` lets through; the second has all.
    """
    def run(spark, d):
        base = marts(spark, d)
        raw = tb.raw_tables(spark, d)
        root = scratch(spark, d, f"refresh_{mart}_{uuid4().hex}")
        for cut, cut_kept in ((first, first_kept or {}), (_all, {}), (_all, {})):
            w = Warehouse(spark, {e: cut(raw[e]) for e in entities}, base.regions, root, "year")
            for name in keep:
                w.adopt(name, cut_kept.get(name, _all)(base[name]))
            stored = w.refresh(mart)
        if reopen:
            stored = Warehouse(spark, {}, base.regions, root, "year")[mart]
        return stored.drop("period")
    return run


def _refresh_query(key: str, mart: str, *arguments, **options) -> None:
    register(key, _loads_of(mart, *arguments, **options),
             Q.query(f"select {shown(TABLE_COLUMNS[mart])} from {mart}"))


ORDER_SIDE = ("stg_orders", "stg_customers", "dim_payments", "dim_reviews")
for _mart, _entities, _keep in (
        ("dim_orders", ("orders",), ()),
        ("dim_payments", ("payments",), ()),
        ("dim_customers", ("customers",), ()),
        ("dim_sellers", ("sellers",), ()),
        ("dim_products", ("products", "product_category_name_translation"), ()),
        ("dim_date", ("orders",), ()),
        ("dim_reviews", ("order_reviews",), ("stg_orders",)),
        ("fact_sales", ("order_items",), ORDER_SIDE)):
    _refresh_query(f"w1_w2_refresh_{_mart}", _mart, _entities, _keep)
# Rows that come in the second load with older stamps than all of the first.
_refresh_query("w1_late_rows", "dim_orders", ("orders",), first=_late)
_refresh_query("w1_w2_refresh_fact_late_orders", "fact_sales", ("order_items",), ORDER_SIDE, first=_all,
               first_kept={"stg_orders": lambda df: _early(df, "modified_at")})
_refresh_query("w1_w2_refresh_fact_late_reviews", "fact_sales", ("order_items",), ORDER_SIDE, first=_all,
               first_kept={"dim_reviews": lambda df: df.limit(0), "dim_payments": lambda df: _early(df, "modified_at")})
_refresh_query("s6_reopened_mart", "dim_orders", ("orders",), reopen=True)


_increments: dict[tuple[str, str], Warehouse] = {}


def _by_loads(spark, d) -> Warehouse:
    """A warehouse kept up from loads: orders, payments, reviews and items in two, the later ones with older stamps
    too; customers and products in three, one of them a former version of rows that are there already."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _increments:
        raw, root = tb.raw_tables(spark, d), scratch(spark, d, f"loads_{uuid4().hex}")
        loads = RawLoads(spark, f"{root}/raw")
        w = Warehouse(spark, loads, tb.region_seed(spark, d), f"{root}/marts", "year")
        dealt = {e: F.pmod(F.xxhash64(*model.ENTITIES[e].keys), F.lit(3)) for e in tb.RAW_SQL}
        old = {"customers": "customer_city", "products": "product_category_name", "orders": "order_status"}

        def arrive(n: int, e: str) -> None:
            rows = raw[e].filter(dealt[e] == n)
            if e in old and n < 2:  # the next load's rows as they once were
                then = raw[e].filter(dealt[e] == n + 1).withColumn(old[e], F.lit("once")).withColumn(
                    model.LOAD_STAMP, F.col(model.LOAD_STAMP) - F.expr("interval 40 years"))
                rows = rows.unionByName(then)
            loads.add(e, rows, f"load{n}")

        for n in range(3):
            with ThreadPoolExecutor(len(tb.RAW_SQL)) as pool:  # loads of different entities arrive side by side
                list(pool.map(lambda e, n=n: arrive(n, e), tb.RAW_SQL))
            w.refresh_all()
        _increments[key] = w
    return _increments[key]


for _mart in TABLE_COLUMNS:
    if _mart in model.MARTS:
        register(f"w1_loads_{_mart}", lambda spark, d, name=_mart: _by_loads(spark, d)[name].drop("period"),
                 Q.query(f"select {shown(TABLE_COLUMNS[_mart])} from {_mart}"))


@query("w2_retry", f"select {shown(TABLE_COLUMNS['dim_orders'])} from dim_orders")
def _(spark, d):
    """A merge that stops after its files are written, before they are listed; then the next run."""
    raw = tb.raw_tables(spark, d)["orders"]
    root = scratch(spark, d, f"retry_{uuid4().hex}")
    seed, mart = tb.region_seed(spark, d), model.MARTS["dim_orders"]
    stored = Warehouse(spark, {"orders": _early(raw)}, seed, root, "year").refresh("dim_orders")
    rows = Warehouse(spark, {"orders": raw}, seed).define("dim_orders")
    version = live.new_version(live.opened(spark, f"{root}/dim_orders").number + 1)
    tables.arranged(incremental.differing(rows, stored, mart.key), mart, "year").write.partitionBy("period").parquet(
        f"{root}/dim_orders/{live.VERSION}={version}")
    return Warehouse(spark, {"orders": raw}, seed, root, "year").refresh("dim_orders").drop("period")


@query("w2_readers_around_a_merge", f"""select 'before' as opened, order_key, order_status from dim_orders
       where modified_at < timestamp '{CUT}' union all select 'after', order_key, order_status from dim_orders""")
def _(spark, d):
    """One reader opens the mart before a merge and reads it afterwards, another opens it after the merge."""
    raw = tb.raw_tables(spark, d)["orders"]
    root, seed = scratch(spark, d, f"readers_{uuid4().hex}"), tb.region_seed(spark, d)
    before = Warehouse(spark, {"orders": _early(raw)}, seed, root, "year").refresh("dim_orders")
    after = Warehouse(spark, {"orders": raw}, seed, root, "year").refresh("dim_orders")
    columns = ["order_key", "order_status"]
    return (before.select(F.lit("before").alias("opened"), *columns)
            .unionByName(after.select(F.lit("after").alias("opened"), *columns)))


@query("w4_changed_type", f"""select order_key, case when modified_at >= timestamp '{CUT}' or days_to_delivery % 2 = 0
       then days_to_delivery end as days_to_delivery from dim_orders""")
def _(spark, d):
    """A stored text column becomes a number: what no number is becomes NULL in the periods not touched."""
    orders = marts(spark, d)["dim_orders"]
    path, mart = scratch(spark, d, f"types_{uuid4().hex}"), model.MARTS["dim_orders"]
    days = F.col("days_to_delivery")
    before = _early(orders, "modified_at").select("order_key", "modified_at", F.when(
        days % 2 == 0, days.cast("string")).otherwise("n/a").alias("days_to_delivery"))
    fresh = _late(orders, "modified_at").select("order_key", "modified_at", days.cast("bigint").alias("days_to_delivery"))
    tables.write_mart(before, path, mart, "year")
    tables.merge_mart(spark, path, fresh, mart, f"{path}_staging", "year")
    return tables.read_mart(spark, path).select("order_key", "days_to_delivery")


@query("w2_stream_late_file", f"select {shown(TABLE_COLUMNS['dim_orders'])} from dim_orders")
def _(spark, d):
    """The file with the older stamps arrives last."""
    raw = tb.raw_tables(spark, d)["orders"]
    folder = scratch(spark, d, f"stream_{uuid4().hex}")
    w = Warehouse(spark, {"orders": raw}, tb.region_seed(spark, d), f"{folder}/marts", "year")
    for arriving in (_late(raw), _early(raw)):
        arriving.write.mode("append").parquet(f"{folder}/landing")
        merge_arrivals(w, "dim_orders", f"{folder}/landing", raw.schema, f"{folder}/seen").awaitTermination()
    return w["dim_orders"].drop("period")


@query("w2_stream_dim_orders", f"select {shown(TABLE_COLUMNS['dim_orders'])} from dim_orders")
def _(spark, d):
    """Two files of raw orders arrive one after the other and are merged as they come."""
    raw = tb.raw_tables(spark, d)["orders"]
    folder = scratch(spark, d, f"stream_{uuid4().hex}")
    w = Warehouse(spark, {"orders": raw}, tb.region_seed(spark, d), f"{folder}/marts", "year")
    early = F.col(model.LOAD_STAMP) < F.lit(CUT).cast("timestamp")
    for arriving in (raw.filter(early), raw.filter(~early)):
        arriving.write.mode("append").parquet(f"{folder}/landing")
        merge_arrivals(w, "dim_orders", f"{folder}/landing", raw.schema, f"{folder}/seen").awaitTermination()
    return w["dim_orders"].drop("period")


# --- D: data quality ------------------------------------------------------------------------------------------

DOMAINS = checks.Domains(states=tuple(f"NATION_{i}" for i in range(24)), regions=TEST_REGIONS,
                         zones=TEST_REGIONS, years=(1995, 2000))
SUITE = checks.all_checks(DOMAINS)


def _literal(v) -> str:
    return f"'{v}'" if isinstance(v, str) else str(v).lower()


def _check_sql(c) -> str:
    table = "raw_regions" if c.table == "state_regions" else c.table
    col = c.column
    if c.test == "unique":
        failures = f"(select count(*) from (select {col} from {table} where {col} is not null "
        failures += f"group by {col} having count(*) > 1))"
    elif c.test == "relationship":
        failures = (f"(select count(*) from {table} k where {col} is not null and not exists "
                    f"(select 1 from {c.parent} p where p.{c.parent_column} = k.{col}))")
    elif c.test == "accepted_values":
        failures = f"count(*) filter ({col} not in ({', '.join(map(_literal, c.values))}))"
    elif c.test == "accepted_range":
        bounds = [f"{col} < {c.low}"] * (c.low is not None) + [f"{col} > {c.high}"] * (c.high is not None)
        failures = f"count(*) filter ({' or '.join(bounds)})"
    else:
        failures = f"count(*) - count({col})"
    enough = "failures = 0" if c.at_least is None else f"total - failures >= {c.at_least} * total"
    return (f"select '{c.table}' as table_name, '{c.column}' as column_name, '{c.test}' as test, "
            f"failures, total, cast({enough} as varchar) as passed from "
            f"(select {failures} as failures, count(*) as total from {table})")


def _checked(spark, d):
    w = marts(spark, d)
    for name in {c.table for c in SUITE if c.table.startswith("stg_")}:
        if not w.is_stored(name):
            w.store(name)
    return w


def _quality(key: str, suite) -> None:
    body = "\nunion all ".join(_check_sql(c) for c in suite)
    register(key, lambda spark, d: quality.run_checks(_checked(spark, d), suite),
             Q.query(body).replace(" as (", " as materialized ("))


for _i, _test in enumerate(("not_null", "unique", "accepted_values", "accepted_range",
                            "not_null_proportion", "relationship"), 1):
    _quality(f"d{_i}_{_test}", [c for c in SUITE if c.test == _test])


def _stored_quality(spark, d):
    path = scratch(spark, d, "quality_results")
    checks.store_quality_report(checks.quality_report(_checked(spark, d), SUITE), path)
    return spark.read.parquet(path)


register("d7_stored_results", _stored_quality,
         Q.query("\nunion all ".join(_check_sql(c) for c in SUITE)).replace(" as (", " as materialized ("))


ORDER_SUITE = [c for c in SUITE if c.table == "dim_orders" and c.test != "relationship"]


@query("d7_history", "\nunion all ".join(_check_sql(c).replace("select 'dim_orders'", "select 'second' as run_id, 'dim_orders'")
                                         for c in ORDER_SUITE))
def _(spark, d):
    """Two runs around a refresh; the second recounts the periods that the refresh wrote and takes over the others."""
    raw, root = tb.raw_tables(spark, d)["orders"], scratch(spark, d, f"checked_{uuid4().hex}")
    for run, rows, day in (("first", _early(raw), 1), ("second", raw, 2)):
        w = Warehouse(spark, {"orders": rows}, tb.region_seed(spark, d), root, "year")
        w.refresh("dim_orders")
        kept = quality_history.record(w, ORDER_SUITE, f"{root}/_quality", run, datetime(2020, 1, day))
    return kept.drop("run_at")
