"""The declared checks on staging, marts and the seed."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from souk import model
from souk.operators.quality import Check, run_checks


@dataclass(frozen=True)
class Domains:
    """Value sets that depend on the marketplace; the defaults are the declared ones."""

    states: tuple[str, ...] = tuple(row[0] for row in model.STATE_REGIONS)
    regions: tuple[str, ...] = model.REGIONS
    zones: tuple[str, ...] = model.ECONOMIC_ZONES
    years: tuple[int, int] = (2016, 2020)


def not_null(table: str, columns: str) -> list[Check]:
    return [Check(table, c, "not_null") for c in columns.split()]


def unique(table: str, column: str) -> list[Check]:
    return [Check(table, column, "unique")]


def accepted(table: str, columns: str, values: tuple) -> list[Check]:
    return [Check(table, c, "accepted_values", values=tuple(values)) for c in columns.split()]


def in_range(table: str, columns: str, low: float | None, high: float | None) -> list[Check]:
    return [Check(table, c, "accepted_range", low=low, high=high) for c in columns.split()]


def mostly_filled(table: str, columns: str, at_least: float) -> list[Check]:
    return [Check(table, c, "not_null_proportion", at_least=at_least) for c in columns.split()]


def refers(table: str, column: str, parent: str, parent_column: str) -> list[Check]:
    return [Check(table, column, "relationship", parent=parent, parent_column=parent_column)]


BOOL = (True, False)

# The columns, bounds and proportions below are the declared ones.


def staging_checks(d: Domains = Domains()) -> list[Check]:
    return [
        *not_null("stg_customers", "customer_id customer_unique_id customer_city customer_state "
                                   "customer_zip_prefix"),
        *unique("stg_customers", "customer_id"),
        *accepted("stg_customers", "customer_state", d.states),
        *not_null("stg_orders", "order_id customer_id order_purchase_timestamp "
                                "order_estimated_delivery_date"),
        *unique("stg_orders", "order_id"),
        *not_null("stg_order_items", "order_id order_item_id product_id seller_id "
                                     "shipping_limit_date price freight_value"),
        *refers("stg_order_items", "order_id", "stg_orders", "order_id"),
        *refers("stg_order_items", "product_id", "stg_products", "product_id"),
        *refers("stg_order_items", "seller_id", "stg_sellers", "seller_id"),
        *in_range("stg_order_items", "price", 0.01, 999999),
        *in_range("stg_order_items", "freight_value", 0, 999999),
        *not_null("stg_payments", "order_id payment_sequential payment_type payment_installments "
                                  "payment_value"),
        *refers("stg_payments", "order_id", "stg_orders", "order_id"),
        *in_range("stg_payments", "payment_sequential", 1, 999),
        *accepted("stg_payments", "payment_type", model.PAYMENT_TYPES),
        *in_range("stg_payments", "payment_installments", 0, 24),
        *in_range("stg_payments", "payment_value", 0, 15000),
        *not_null("stg_order_reviews", "review_id order_id review_score review_creation_date"),
        *refers("stg_order_reviews", "order_id", "stg_orders", "order_id"),
        *in_range("stg_order_reviews", "review_score", 1, 5),
        *not_null("stg_products", "product_id"),
        *unique("stg_products", "product_id"),
        *mostly_filled("stg_products", "product_category_name", 0.98),
        *not_null("stg_sellers", "seller_id seller_city seller_state seller_zip_prefix"),
        *unique("stg_sellers", "seller_id"),
        *accepted("stg_sellers", "seller_state", d.states),
        *not_null("stg_category_translation", "product_category_name product_category_name_english"),
        *unique("stg_category_translation", "product_category_name"),
    ]


def mart_checks(d: Domains = Domains()) -> list[Check]:
    sizes = "product_length_cm product_height_cm product_width_cm"
    counts = "product_photos_qty product_name_length product_description_length"
    return [
        *not_null("dim_customers", "customer_key customer_id_original customer_city customer_state "
                                   "customer_zip_prefix customer_region customer_economic_zone"),
        *unique("dim_customers", "customer_key"),
        *accepted("dim_customers", "customer_state", d.states),
        *accepted("dim_customers", "customer_region", d.regions),
        *accepted("dim_customers", "customer_economic_zone", d.zones),

        *not_null("dim_date", "date_key full_date year month month_name quarter day_of_week "
                              "day_name is_weekend"),
        *unique("dim_date", "date_key"),
        *in_range("dim_date", "year", *d.years),
        *in_range("dim_date", "month", 1, 12),
        *accepted("dim_date", "month_name", model.MONTHS),
        *accepted("dim_date", "quarter", (1, 2, 3, 4)),
        *in_range("dim_date", "day_of_week", 1, 7),
        *accepted("dim_date", "day_name", model.WEEKDAYS),
        *accepted("dim_date", "is_weekend", BOOL),

        *not_null("dim_products", f"product_key product_weight_g {sizes} product_volume_cm3 {counts}"),
        *unique("dim_products", "product_key"),
        *mostly_filled("dim_products", "product_category_portuguese product_category_english", 0.98),
        *in_range("dim_products", "product_weight_g", 0, 100000),
        *in_range("dim_products", sizes, 0, 1000),
        *in_range("dim_products", "product_volume_cm3", 0, 1000000000),
        *in_range("dim_products", "product_photos_qty", 0, 100),
        *in_range("dim_products", "product_name_length", 0, 1000),
        *in_range("dim_products", "product_description_length", 0, 10000),

        *not_null("dim_sellers", "seller_key seller_city seller_state seller_zip_prefix "
                                 "seller_region seller_economic_zone"),
        *unique("dim_sellers", "seller_key"),
        *accepted("dim_sellers", "seller_state", d.states),
        *accepted("dim_sellers", "seller_region", d.regions),
        *accepted("dim_sellers", "seller_economic_zone", d.zones),

        *not_null("dim_orders", "order_key order_status order_purchase_timestamp "
                                "order_estimated_delivery_date"),
        *unique("dim_orders", "order_key"),
        *accepted("dim_orders", "order_status", model.ORDER_STATUSES),
        *mostly_filled("dim_orders", "days_to_delivery is_delivered_on_time", 0.95),
        *in_range("dim_orders", "days_to_delivery", -30, 365),
        *accepted("dim_orders", "is_delivered_on_time", BOOL),

        *not_null("dim_payments", "payment_key primary_payment_type total_installments "
                                  "payment_methods_count uses_credit_card uses_boleto uses_voucher"),
        *unique("dim_payments", "payment_key"),
        *accepted("dim_payments", "primary_payment_type", model.PAYMENT_TYPES),
        *in_range("dim_payments", "total_installments", 0, None),
        *in_range("dim_payments", "payment_methods_count", 1, 10),
        *accepted("dim_payments", "uses_credit_card uses_boleto uses_voucher", BOOL),

        *not_null("dim_reviews", "review_key review_score has_comment_title has_comment_message "
                                 "review_creation_date days_to_review"),
        *accepted("dim_reviews", "review_score", (1, 2, 3, 4, 5)),
        *accepted("dim_reviews", "has_comment_title has_comment_message", BOOL),

        *not_null("fact_sales", "order_item_sk order_key customer_key product_key seller_key "
                                "date_key item_price freight_value total_item_value payment_value "
                                "quantity"),
        *unique("fact_sales", "order_item_sk"),
        *refers("fact_sales", "order_key", "dim_orders", "order_key"),
        *refers("fact_sales", "customer_key", "dim_customers", "customer_key"),
        *refers("fact_sales", "product_key", "dim_products", "product_key"),
        *refers("fact_sales", "seller_key", "dim_sellers", "seller_key"),
        *refers("fact_sales", "date_key", "dim_date", "date_key"),
        *refers("fact_sales", "payment_key", "dim_payments", "payment_key"),
        *refers("fact_sales", "review_key", "dim_reviews", "review_key"),
        *in_range("fact_sales", "item_price", 0, 15000),
        *in_range("fact_sales", "freight_value", 0, 1000),
        *in_range("fact_sales", "total_item_value", 0, 16000),
        *in_range("fact_sales", "payment_value", 0, 20000),
        *accepted("fact_sales", "quantity", (1,)),

        *not_null("state_regions", "state_code state_name region economic_zone"),
        *unique("state_regions", "state_code"),
        *accepted("state_regions", "state_code", d.states),
        *accepted("state_regions", "region", d.regions),
        *accepted("state_regions", "economic_zone", d.zones),
    ]


def all_checks(d: Domains = Domains()) -> list[Check]:
    return staging_checks(d) + mart_checks(d)


def quality_report(tables, checks: list[Check] | None = None) -> DataFrame:
    """One row per check: failures, rows looked at, passed."""
    return run_checks(tables, all_checks() if checks is None else checks)


def store_quality_report(report: DataFrame, path: str) -> None:
    """Keep the results as a Parquet table."""
    report.coalesce(1).write.mode("overwrite").parquet(path)
