"""The order-item fact."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from souk import model
from souk.functions import scalar as S


def order_facts(stg_orders: DataFrame, stg_customers: DataFrame, dim_payments: DataFrame,
                dim_reviews: DataFrame) -> DataFrame:
    """Everything a fact row takes from its order, one row per order.

    Joined here, at order grain, instead of onto the items: the items then meet one frame in
    one join, and payments and reviews share the order id partitioning. The warehouse stores
    this table: read from files it enters the item join through a shuffle of its own, which is
    what lets adaptive execution split an order that owns a large part of the items.
    """
    orders = stg_orders.select(
        "order_id", "customer_id", F.col("order_purchase_timestamp").alias("order_purchase_ts")
    ).filter(F.col("customer_id").isNotNull() & F.col("order_purchase_ts").isNotNull())
    buyers = stg_customers.select(
        "customer_id", F.col("customer_unique_id").alias("customer_key")
    ).filter(F.col("customer_key").isNotNull())
    paid = dim_payments.select(
        "payment_key", "total_payment_value", "total_installments", "payment_methods_count",
        "uses_credit_card", "uses_boleto", "uses_voucher", "uses_debit_card",
        "primary_payment_type")
    reviewed = dim_reviews.select("review_key")
    none = F.lit(False)
    return (orders.join(buyers, "customer_id")
            .join(paid, F.col("order_id") == F.col("payment_key"), "left")
            .join(reviewed, F.col("order_id") == F.col("review_key"), "left")
            .select(
                F.col("order_id").alias("order_key"),
                "customer_key",
                S.date_key("order_purchase_ts").alias("date_key"),
                "payment_key",
                "review_key",
                F.coalesce("total_payment_value", F.lit(0).cast("decimal(38,9)")).alias("payment_value"),
                F.coalesce("total_installments", F.lit(1).cast("bigint")).alias("total_installments"),
                F.coalesce("payment_methods_count", F.lit(1).cast("bigint")).alias("payment_methods_count"),
                F.coalesce("uses_credit_card", none).alias("uses_credit_card"),
                F.coalesce("uses_boleto", none).alias("uses_boleto"),
                F.coalesce("uses_voucher", none).alias("uses_voucher"),
                F.coalesce("uses_debit_card", none).alias("uses_debit_card"),
                F.coalesce("primary_payment_type", F.lit(model.UNKNOWN_PAYMENT)).alias("primary_payment_type"),
                "order_purchase_ts"))


def fact_lines(stg_order_items: DataFrame, orders: DataFrame) -> DataFrame:
    """Order items of a known order and customer, without the columns that follow from others of the row.

    What `completed` adds is left out while rows are shuffled and sorted: for the join, and for the write.
    """
    items = stg_order_items.filter(
        F.col("order_id").isNotNull() & F.col("product_id").isNotNull()
        & F.col("seller_id").isNotNull()
    ).select(
        F.col("order_id").alias("order_key"),
        "order_item_id",
        F.col("product_id").alias("product_key"),
        F.col("seller_id").alias("seller_key"),
        F.col("price").alias("item_price"),
        "freight_value",
        F.col("modified_at").alias("fact_modified_at"))
    order_side = orders.select(
        F.col("payment_key").isNotNull().alias("_paid"), F.col("review_key").isNotNull().alias("_reviewed"),
        *(c for c in orders.columns if c not in {"payment_key", "review_key", "date_key"}))
    return items.join(order_side, "order_key")


def completed(lines: DataFrame) -> DataFrame:
    """Fact rows: the lines with the columns that follow from them."""
    of_order = F.col("order_key")
    follow = {
        "order_item_sk": S.make_key("order_key", "order_item_id"),
        "date_key": S.date_key("order_purchase_ts"),
        "payment_key": F.when(F.col("_paid"), of_order),
        "review_key": F.when(F.col("_reviewed"), of_order),
        "total_item_value": (F.col("item_price") + F.col("freight_value")).cast("decimal(28,9)"),
        "quantity": F.lit(1).cast("bigint"),
    }
    rest = [c for c in lines.columns if c not in {"order_item_id", "_paid", "_reviewed", *FACT_COLUMNS}]
    return lines.select(*(follow[c].alias(c) if c in follow else F.col(c) for c in FACT_COLUMNS), *rest)


def fact_sales(stg_order_items: DataFrame, orders: DataFrame) -> DataFrame:
    """One row per order item of a known order and customer."""
    return completed(fact_lines(stg_order_items, orders))


FACT_COLUMNS = (
    "order_item_sk", "order_key", "customer_key", "product_key", "seller_key", "date_key",
    "payment_key", "review_key", "item_price", "freight_value", "total_item_value", "quantity",
    "payment_value", "total_installments", "payment_methods_count", "uses_credit_card",
    "uses_boleto", "uses_voucher", "uses_debit_card", "primary_payment_type",
    "order_purchase_ts", "fact_modified_at")
