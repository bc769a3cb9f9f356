"""Staging: raw text tables to typed rows, newest version of each key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from souk import model
from souk.functions import scalar as S
from souk.operators.dedup import keep_latest


def _stamp() -> Column:
    return F.col(model.LOAD_STAMP).cast("timestamp").alias("modified_at")


def stg_orders(raw: DataFrame) -> DataFrame:
    times = ("order_purchase_timestamp", "order_approved_at", "order_delivered_carrier_date",
             "order_delivered_customer_date", "order_estimated_delivery_date")
    typed = raw.select(
        S.clean("order_id").alias("order_id"),
        S.clean("customer_id").alias("customer_id"),
        F.upper(S.clean("order_status")).alias("order_status"),
        *(S.to_timestamp(t).alias(t) for t in times),
        _stamp())
    return keep_latest(typed, ["order_id"])


def stg_customers(raw: DataFrame) -> DataFrame:
    typed = raw.select(
        "customer_id",
        "customer_unique_id",
        F.lower(S.clean("customer_city")).alias("customer_city"),
        F.upper(S.clean("customer_state")).alias("customer_state"),
        S.clean("customer_zip_code_prefix").alias("customer_zip_prefix"),
        _stamp())
    return keep_latest(typed, ["customer_id"])


def stg_order_items(raw: DataFrame) -> DataFrame:
    typed = raw.filter(F.col("order_id").isNotNull()).select(
        S.clean("order_id").alias("order_id"),
        S.to_long("order_item_id").alias("order_item_id"),
        S.clean("product_id").alias("product_id"),
        S.clean("seller_id").alias("seller_id"),
        S.to_timestamp("shipping_limit_date").alias("shipping_limit_date"),
        S.to_money("price").alias("price"),
        S.to_money("freight_value").alias("freight_value"),
        _stamp())
    return keep_latest(typed, ["order_id", "order_item_id"])


def stg_payments(raw: DataFrame) -> DataFrame:
    typed = raw.select(
        S.clean("order_id").alias("order_id"),
        S.to_long("payment_sequential", 1).alias("payment_sequential"),
        F.upper(S.clean("payment_type")).alias("payment_type"),
        S.to_long("payment_installments", 0).alias("payment_installments"),
        S.to_money("payment_value", 0).alias("payment_value"),
        _stamp())
    return keep_latest(typed, ["order_id", "payment_sequential"])


def stg_products(raw: DataFrame) -> DataFrame:
    sizes = ("product_length_cm", "product_height_cm", "product_width_cm")
    typed = raw.select(
        S.clean("product_id").alias("product_id"),
        S.clean("product_category_name").alias("product_category_name"),
        S.to_long("product_name_lenght", 0).alias("product_name_length"),
        S.to_long("product_description_lenght", 0).alias("product_description_length"),
        S.to_long("product_photos_qty", 0).alias("product_photos_qty"),
        *(S.to_double(c, 0.0).alias(c) for c in ("product_weight_g", *sizes)),
        S.positive_product(*sizes).alias("product_volume_cm3"),
        _stamp())
    return keep_latest(typed, ["product_id"])


def stg_order_reviews(raw: DataFrame) -> DataFrame:
    texts = ("review_comment_title", "review_comment_message")
    typed = raw.select(
        S.clean("review_id").alias("review_id"),
        S.clean("order_id").alias("order_id"),
        S.to_long("review_score", 0).alias("review_score"),
        *(S.clean(c).alias(c) for c in texts),
        *(S.to_timestamp(c).alias(c) for c in ("review_creation_date", "review_answer_timestamp")),
        _stamp())
    return keep_latest(typed, ["review_id", "order_id"])


def stg_sellers(raw: DataFrame) -> DataFrame:
    typed = raw.select(
        "seller_id",
        S.clean("seller_zip_code_prefix").alias("seller_zip_prefix"),
        F.lower(S.clean("seller_city")).alias("seller_city"),
        F.upper(S.clean("seller_state")).alias("seller_state"),
        _stamp())
    return keep_latest(typed, ["seller_id"])


def stg_category_translation(raw: DataFrame) -> DataFrame:
    typed = raw.select("product_category_name", "product_category_name_english", _stamp())
    return keep_latest(typed, ["product_category_name"])


# Staging table -> (builder, raw entity it reads).
STAGING = {
    "stg_orders": (stg_orders, "orders"),
    "stg_customers": (stg_customers, "customers"),
    "stg_order_items": (stg_order_items, "order_items"),
    "stg_payments": (stg_payments, "payments"),
    "stg_products": (stg_products, "products"),
    "stg_order_reviews": (stg_order_reviews, "order_reviews"),
    "stg_sellers": (stg_sellers, "sellers"),
    "stg_category_translation": (stg_category_translation, "product_category_name_translation"),
}
