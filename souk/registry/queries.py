"""Registered queries: one callable per report, table and operator, with its checking SQL.

Keys start with the inventory id. Results use portable types only (text, whole numbers, doubles):
dates, times and booleans become text, decimals become doubles, on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from souk import model
from souk.operators import profile
from souk.plans import reports
from souk.plans import testbed as tb
from souk.plans.testbed import TEST_REGION, TEST_YEAR
from souk.registry import checksql as Q
from souk.registry import reportsql as R
from souk.session import work_folder
from souk.sources import tables

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def portable(df: DataFrame) -> DataFrame:
    def show(f: T.StructField) -> Column:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        elif isinstance(f.dataType, (T.DateType, T.BooleanType)):
            c = c.cast("string")
        elif isinstance(f.dataType, T.DecimalType):
            c = c.cast("double")
        elif isinstance(f.dataType, T.IntegralType):
            c = c.cast("bigint")
        return c.alias(f.name)
    return df.select(*(show(f) for f in df.schema))


def register(key: str, run: Query, sql: str | None = None) -> None:
    QUERIES[key] = lambda spark, sf_dir: portable(run(spark, sf_dir))
    if sql is not None:
        SQL[key] = sql


def query(key: str, body: str | None = None, **extra: str):
    """Decorator form; `body` is SQL over the CTEs of the checking star schema."""
    def add(run: Query) -> Query:
        register(key, run, None if body is None else Q.query(body, **extra))
        return run
    return add


def marts(spark: SparkSession, sf_dir: str):
    return tb.warehouse(spark, sf_dir)


def plans(spark: SparkSession, sf_dir: str):
    return tb.lazy_warehouse(spark, sf_dir)


def scratch(spark: SparkSession, sf_dir: str, name: str) -> str:
    return f"{work_folder(spark)}/files/{sf_dir.strip('/').replace('/', '_')}/{name}"


# --- M: staging and star schema -----------------------------------------------------------------

TIMES = {"modified_at", "order_purchase_timestamp", "order_approved_at", "order_purchase_ts",
         "order_delivered_carrier_date", "order_delivered_customer_date", "fact_modified_at",
         "order_estimated_delivery_date", "shipping_limit_date", "review_creation_date",
         "review_answer_timestamp"}
TEXTED = {"full_date", "is_weekend", "is_delivered_on_time", "has_comment_title",
          "has_comment_message", "uses_credit_card", "uses_boleto", "uses_voucher",
          "uses_debit_card"}
MONEY = {"price", "freight_value", "payment_value", "total_payment_value", "item_price",
         "total_item_value"}


def shown(columns: str) -> str:
    out = []
    for c in columns.split():
        if c in TIMES:
            out.append(f"strftime({c}, '%Y-%m-%d %H:%M:%S') as {c}")
        elif c in TEXTED:
            out.append(f"cast({c} as varchar) as {c}")
        elif c in MONEY:
            out.append(f"cast({c} as double) as {c}")
        else:
            out.append(c)
    return ", ".join(out)


TABLE_COLUMNS = {
    "stg_orders": "order_id customer_id order_status order_purchase_timestamp order_approved_at "
                  "order_delivered_carrier_date order_delivered_customer_date "
                  "order_estimated_delivery_date modified_at",
    "stg_customers": "customer_id customer_unique_id customer_city customer_state "
                     "customer_zip_prefix modified_at",
    "stg_order_items": "order_id order_item_id product_id seller_id shipping_limit_date price "
                       "freight_value modified_at",
    "stg_payments": "order_id payment_sequential payment_type payment_installments payment_value "
                    "modified_at",
    "stg_products": "product_id product_category_name product_name_length "
                    "product_description_length product_photos_qty product_weight_g "
                    "product_length_cm product_height_cm product_width_cm product_volume_cm3 "
                    "modified_at",
    "stg_order_reviews": "review_id order_id review_score review_comment_title "
                         "review_comment_message review_creation_date review_answer_timestamp "
                         "modified_at",
    "stg_sellers": "seller_id seller_zip_prefix seller_city seller_state modified_at",
    "stg_category_translation": "product_category_name product_category_name_english modified_at",
    "dim_customers": "customer_key customer_id_original customer_city customer_state "
                     "customer_zip_prefix modified_at customer_region customer_economic_zone "
                     "customer_state_name",
    "dim_sellers": "seller_key seller_city seller_state seller_zip_prefix modified_at "
                   "seller_region seller_economic_zone seller_state_name",
    "dim_products": "product_key product_category_portuguese product_weight_g product_length_cm "
                    "product_height_cm product_width_cm product_photos_qty product_name_length "
                    "product_description_length product_volume_cm3 modified_at "
                    "product_category_english",
    "dim_orders": "order_key order_status order_purchase_timestamp order_approved_at "
                  "order_delivered_carrier_date order_delivered_customer_date "
                  "order_estimated_delivery_date modified_at days_to_delivery "
                  "delivery_vs_estimate_days is_delivered_on_time",
    "dim_payments": "payment_key uses_credit_card uses_boleto uses_voucher uses_debit_card "
                    "primary_payment_type total_payment_value total_installments "
                    "payment_methods_count payment_transactions_count modified_at",
    "dim_reviews": "review_key review_score review_comment_title review_comment_message "
                   "review_creation_date modified_at has_comment_title has_comment_message "
                   "days_to_review",
    "dim_date": "date_key full_date year month month_name quarter day_of_week day_name is_weekend",
    "fact_sales": "order_item_sk order_key customer_key product_key seller_key date_key "
                  "payment_key review_key item_price freight_value total_item_value quantity "
                  "payment_value total_installments payment_methods_count uses_credit_card "
                  "uses_boleto uses_voucher uses_debit_card primary_payment_type "
                  "order_purchase_ts fact_modified_at",
}

for _i, (_table, _columns) in enumerate(TABLE_COLUMNS.items(), 1):
    register(f"m{_i:02d}_{_table}",
             lambda spark, d, t=_table: plans(spark, d).define(t),
             Q.query(f"select {shown(_columns)} from {_table}"))


# --- R1-R20: reports, whole and with both filters ------------------------------------------------

for _i, (_name, _report) in enumerate(reports.REPORTS.items(), 1):
    _sql = getattr(R, _name)
    _key = f"r{_i:02d}_{_name}"
    register(_key, lambda spark, d, f=_report: f(marts(spark, d)), Q.query(_sql()))
    _arguments = _report.__code__.co_varnames[:_report.__code__.co_argcount]
    if "region" in _arguments:
        register(f"{_key}_filtered",
                 lambda spark, d, f=_report: f(marts(spark, d), year=TEST_YEAR, region=TEST_REGION),
                 Q.query(_sql(TEST_YEAR, TEST_REGION)))
    elif "year" in _arguments:
        register(f"{_key}_filtered",
                 lambda spark, d, f=_report: f(marts(spark, d), year=TEST_YEAR),
                 Q.query(_sql(TEST_YEAR)))

register("r02_top_categories_of_10",
         lambda spark, d: reports.top_products_categories(marts(spark, d), 10),
         Q.query(R.top_products_categories(limit=10)))
register("r12_top_sellers_of_30",
         lambda spark, d: reports.top_sellers(marts(spark, d), 30, region=TEST_REGION),
         Q.query(R.top_sellers(region=TEST_REGION, limit=30)))


# --- R21-R23: validation and table information ---------------------------------------------------

@query("r21_validate_marts", " union all ".join(
    f"select '{t}' as table_name, cast(count(*) > 0 as varchar) as has_rows from {t}"
    for t in model.MARTS))
def _(spark, d):
    return tables.validate_tables(marts(spark, d).marts())


@query("r23_table_row_counts", " union all ".join(
    f"select '{t}' as table_id, count(*) as row_count from {t}" for t in model.MARTS))
def _(spark, d):
    return tables.table_info(marts(spark, d).marts()).select("table_id", "row_count")


@query("r23_sample_rows",
       f"select {shown(TABLE_COLUMNS['dim_orders'])} from dim_orders order by order_key limit 20")
def _(spark, d):
    return profile.sample_rows(marts(spark, d)["dim_orders"], 20, ["order_key"]).drop("period")
