"""The seven dimensions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from souk import model
from souk.functions import scalar as S
from souk.operators.dedup import keep_latest
from souk.operators.joins import lookup_join, with_region


def dim_customers(stg_customers: DataFrame, regions: DataFrame) -> DataFrame:
    """One row per person. Where a person has several ids, the lowest one gives the address."""
    address = F.struct("customer_id", "customer_city", "customer_state", "customer_zip_prefix")
    people = (stg_customers
              .groupBy(F.col("customer_unique_id").alias("customer_key"))
              .agg(F.min_by(address, "customer_id").alias("a"),
                   F.max("modified_at").alias("modified_at"))
              .select("customer_key",
                      F.col("a.customer_id").alias("customer_id_original"),
                      "a.customer_city", "a.customer_state", "a.customer_zip_prefix",
                      "modified_at"))
    return with_region(people, regions, "customer_state", "customer", "customer_key")


def dim_sellers(stg_sellers: DataFrame, regions: DataFrame) -> DataFrame:
    sellers = stg_sellers.select(F.col("seller_id").alias("seller_key"), "seller_city",
                                 "seller_state", "seller_zip_prefix", "modified_at")
    return with_region(sellers, regions, "seller_state", "seller", "seller_key")


def dim_products(stg_products: DataFrame, stg_category_translation: DataFrame) -> DataFrame:
    """Products with the English category, the original one where no translation exists."""
    products = stg_products.select(
        F.col("product_id").alias("product_key"),
        F.col("product_category_name").alias("product_category_portuguese"),
        "product_weight_g", "product_length_cm", "product_height_cm", "product_width_cm",
        "product_photos_qty", "product_name_length", "product_description_length",
        "product_volume_cm3", "modified_at")
    names = stg_category_translation.select(
        F.lower(S.clean("product_category_name")).alias("_category"),
        F.col("product_category_name_english").alias("_english"))
    folded = F.lower(S.clean("product_category_portuguese"))
    joined = lookup_join(products, names, folded, "_category", "product_key")
    return joined.select(
        *products.columns,
        F.coalesce("_english", "product_category_portuguese").alias("product_category_english"))


def dim_orders(stg_orders: DataFrame) -> DataFrame:
    """Orders with delivery time, and lateness against the estimate (positive = late)."""
    late_by = S.days_between("order_delivered_customer_date", "order_estimated_delivery_date")
    return stg_orders.select(
        F.col("order_id").alias("order_key"),
        "order_status", "order_purchase_timestamp", "order_approved_at",
        "order_delivered_carrier_date", "order_delivered_customer_date",
        "order_estimated_delivery_date", "modified_at",
        S.days_between("order_delivered_customer_date", "order_purchase_timestamp")
        .alias("days_to_delivery"),
        late_by.alias("delivery_vs_estimate_days"),
        (late_by <= 0).alias("is_delivered_on_time"))


def dim_payments(stg_payments: DataFrame) -> DataFrame:
    """One row per paid order; the first payment by sequence names the primary type."""
    of_type = F.coalesce(F.col("payment_type"), F.lit(""))
    return stg_payments.groupBy(F.col("order_id").alias("payment_key")).agg(
        *(F.bool_or(of_type == t).alias(flag) for flag, t in model.PAYMENT_FLAGS.items()),
        F.min_by("payment_type", "payment_sequential").alias("primary_payment_type"),
        F.sum("payment_value").cast("decimal(38,9)").alias("total_payment_value"),
        F.sum("payment_installments").alias("total_installments"),
        F.size(F.collect_set("payment_type")).cast("bigint").alias("payment_methods_count"),  # no second shuffle for the types
        F.count(F.lit(1)).alias("payment_transactions_count"),
        F.max("modified_at").alias("modified_at"))


def dim_reviews(stg_order_reviews: DataFrame, stg_orders: DataFrame) -> DataFrame:
    """The newest review of each order, with the days since purchase."""
    newest = keep_latest(
        stg_order_reviews.select("order_id", "review_id", "review_score", "review_comment_title",
                                 "review_comment_message", "review_creation_date", "modified_at"),
        ["order_id"], ["review_creation_date", "review_score"], ["review_id"])
    bought = stg_orders.select("order_id", "order_purchase_timestamp")
    return newest.join(bought, "order_id", "left").select(
        F.col("order_id").alias("review_key"),
        "review_score", "review_comment_title", "review_comment_message",
        "review_creation_date", "modified_at",
        S.has_text("review_comment_title").alias("has_comment_title"),
        S.has_text("review_comment_message").alias("has_comment_message"),
        S.days_between("review_creation_date", "order_purchase_timestamp").alias("days_to_review"))


def dim_date(stg_orders: DataFrame) -> DataFrame:
    """Every day with a purchase."""
    days = (stg_orders.select(F.to_date("order_purchase_timestamp").alias("full_date"))
            .filter(F.col("full_date").isNotNull()).distinct())
    weekday = F.dayofweek("full_date")
    return days.select(
        S.date_key("full_date").alias("date_key"),
        "full_date",
        F.year("full_date").cast("bigint").alias("year"),
        F.month("full_date").cast("bigint").alias("month"),
        F.date_format("full_date", "MMMM").alias("month_name"),
        F.quarter("full_date").cast("bigint").alias("quarter"),
        weekday.cast("bigint").alias("day_of_week"),
        F.date_format("full_date", "EEEE").alias("day_name"),
        weekday.isin(1, 7).alias("is_weekend"))
