"""Business reports over the star schema.

Each report is a function (marts, filters) -> DataFrame. Two rules shape the plans:

* Sales are first summed to the grain a report needs, usually the order, and only then joined.
  A dimension therefore meets one row per order, customer, product or seller instead of one per
  item, and a key that owns a large part of the sales is already folded by the map tasks.
* An order has one customer, one date, one payment and one review row. Once the sales are at
  order grain, "distinct orders" is a row count, which spares a second copy of the data.

Joins carry no hints, apart from the calendar: Spark broadcasts a side by its measured size
and splits skewed partitions otherwise.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from souk import model
from souk.functions import measures as M
from souk.functions import scalar as S
from souk.operators import ranking

Marts = Mapping[str, DataFrame]


@dataclass(frozen=True)
class Scope:
    """Optional year and region filter."""

    year: int | None = None
    region: str | None = None

    @classmethod
    def of(cls, year: int | str | None = None, region: str | None = None) -> Scope:
        """The "all" sentinels and empty values mean no filter."""
        return cls(
            None if year in (None, "", model.ALL_YEARS) else int(year),
            None if region in (None, "", model.ALL_REGIONS) else region)


def conjunction(predicates: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, predicates, F.lit(True))


def _sales_of_year(marts: Marts, scope: Scope) -> DataFrame:
    """Fact rows of the scope's year, by way of the calendar.

    The year also bounds the date key and the storage period, which prunes files and folders
    before the calendar join; both bounds follow from the join, so they drop nothing else.
    """
    fact = marts["fact_sales"]
    if scope.year is None:
        return fact
    first, after = f"{scope.year:04d}", f"{scope.year + 1:04d}"
    within = [F.col("date_key") >= first, F.col("date_key") < after]
    if "period" in fact.columns:
        within += [F.col("period").cast("string") >= first, F.col("period").cast("string") < after]
    days = marts["dim_date"].filter(F.col("year") == scope.year).select("date_key")
    return fact.filter(conjunction(within)).join(F.broadcast(days), "date_key", "left_semi")


def _calendar(marts: Marts, *columns: str) -> DataFrame:
    """Calendar rows: at most one per day, so always small enough to broadcast."""
    return F.broadcast(marts["dim_date"].select("date_key", *columns))


def _customers(marts: Marts, scope: Scope, *columns: str) -> DataFrame:
    customers = marts["dim_customers"]
    if scope.region is not None:
        customers = customers.filter(F.col("customer_region") == scope.region)
    return customers.select("customer_key", *columns)


def _sellers(marts: Marts, scope: Scope, *columns: str) -> DataFrame:
    sellers = marts["dim_sellers"].filter(F.col("seller_region").isNotNull())
    if scope.region is not None:
        sellers = sellers.filter(F.col("seller_region") == scope.region)
    return sellers.select("seller_key", *columns)


def _sums() -> list[Column]:
    return [
        F.count("order_item_sk").alias("items"),
        F.count(F.lit(1)).alias("fact_rows"),
        F.count("total_item_value").alias("valued"),
        F.sum("total_item_value").alias("sales"),
        F.sum("payment_value").alias("payments"),
        F.count("payment_value").alias("paid_rows"),
        F.sum("freight_value").alias("freight"),
        F.count("freight_value").alias("freighted"),
        F.sum("item_price").alias("price"),
        F.bool_or(F.col("payment_key").isNotNull()).alias("is_paid"),
        F.bool_or(F.col("review_key").isNotNull()).alias("is_reviewed"),
    ]


def _at_grain(sales: DataFrame, *keys: str) -> DataFrame:
    """Sales summed per key combination. Sums a report does not use are pruned."""
    return sales.groupBy(*keys).agg(*_sums())


def _resum(*names: str) -> list[Column]:
    return [F.sum(n).alias(n) for n in names]


def _orders(marts: Marts, scope: Scope) -> DataFrame:
    """Sales per order, restricted to the scope's year and customer region.

    The payment and review key of an order are its order key, or NULL without one; the flags
    is_paid and is_reviewed say which. Grouping by the order key alone leaves the rows placed
    for the join to those dimensions, which then needs no further shuffle of the sales.
    """
    sales = _sales_of_year(marts, scope)
    if scope.region is None:
        return _at_grain(sales, "order_key")
    orders = _at_grain(sales, "order_key", "customer_key")
    return orders.join(_customers(marts, scope), "customer_key", "left_semi")


# --- sales ------------------------------------------------------------------------------------


def monthly_sales_trends(marts: Marts, year=None, region=None) -> DataFrame:
    scope = Scope.of(year, region)
    orders = _at_grain(_sales_of_year(marts, scope), "order_key", "customer_key", "date_key")
    known = orders.join(_customers(marts, scope), "customer_key", "left_semi")
    daily = known.groupBy("date_key").agg(
        F.count(F.lit(1)).alias("orders"), *_resum("items", "sales", "payments"))
    dated = daily.join(_calendar(marts, "full_date", "year", "month", "month_name"), "date_key")
    return (dated.groupBy("year", "month", "month_name").agg(
        F.date_format(F.min("full_date"), "yyyy-MM").alias("month_year"),
        F.sum("orders").alias("total_orders"),
        F.sum("items").alias("total_items"),
        M.money_total("sales").alias("total_sales"),
        M.money_total("payments").alias("total_payments"),
        M.ratio(F.sum("sales"), F.sum("orders")).alias("avg_order_value"),
        M.ratio(F.sum("payments"), F.sum("orders")).alias("avg_payment_value"))
        .select("month_year", "year", "month", "month_name", "total_orders", "total_items",
                "total_sales", "total_payments", "avg_order_value", "avg_payment_value")
        .orderBy("year", "month"))


def top_products_categories(marts: Marts, limit: int | None = 20, year=None, region=None) -> DataFrame:
    """Totals of all categories need a limit of None. Products are unique in their dimension, so sales per product make the product count."""
    scope = Scope.of(year, region)
    sales = _sales_of_year(marts, scope)
    if scope.region is not None:
        sales = sales.join(_customers(marts, scope), "customer_key", "left_semi")
    categories = (marts["dim_products"].filter(F.col("product_category_english").isNotNull())
                  .select("product_key", F.col("product_category_english").alias("category")))
    report = _at_grain(sales, "product_key").join(categories, "product_key").groupBy("category").agg(
        F.count(F.lit(1)).alias("unique_products"),
        F.sum("items").alias("items_sold"),
        M.money_total("sales").alias("total_revenue"),
        M.ratio(F.sum("sales"), F.sum("valued")).alias("avg_item_value"),
        M.money_total("freight").alias("total_freight"),
        M.money_total("price").alias("total_item_price"))
    return ranking.top_n(report, "total_revenue", limit, "category")


# --- geography --------------------------------------------------------------------------------


def _region_sales(marts: Marts, scope: Scope) -> DataFrame:
    """Sales per order and seller with both regions."""
    pairs = _at_grain(_sales_of_year(marts, scope), "order_key", "customer_key", "seller_key")
    return (pairs.join(_customers(marts, scope, "customer_region"), "customer_key")
            .join(_sellers(marts, Scope(), "seller_region"), "seller_key")
            .filter(F.col("customer_region").isNotNull()))


def sales_by_region(marts: Marts, year=None) -> DataFrame:
    return (_region_sales(marts, Scope.of(year)).groupBy("customer_region", "seller_region").agg(
        F.countDistinct("order_key").alias("total_orders"),
        F.sum("items").alias("total_items"),
        M.money_total("sales").alias("total_sales"),
        M.ratio(F.sum("sales"), F.sum("valued")).alias("avg_order_value"),
        F.countDistinct("customer_key").alias("unique_customers"),
        F.countDistinct("seller_key").alias("unique_sellers"))
        .orderBy(F.desc("total_sales"), "customer_region", "seller_region"))


def sales_by_state(marts: Marts, year=None, region=None) -> DataFrame:
    scope = Scope.of(year, region)
    per_customer = (_at_grain(_sales_of_year(marts, scope), "customer_key", "order_key")
                    .groupBy("customer_key").agg(F.count(F.lit(1)).alias("orders"),
                                                 *_resum("items", "valued", "sales")))
    places = (_customers(marts, scope, "customer_state", "customer_region")
              .filter(F.col("customer_state").isNotNull()))
    return (per_customer.join(places, "customer_key").groupBy("customer_state", "customer_region")
            .agg(F.sum("orders").alias("total_orders"),
                 F.sum("items").alias("total_items"),
                 M.money_total("sales").alias("total_sales"),
                 M.ratio(F.sum("sales"), F.sum("valued")).alias("avg_order_value"),
                 F.count(F.lit(1)).alias("unique_customers"))
            .orderBy(F.desc("total_sales"), "customer_state", "customer_region"))


def customer_seller_flow(marts: Marts, year=None) -> DataFrame:
    flow = _region_sales(marts, Scope.of(year)).groupBy(
        S.transaction_type("customer_region", "seller_region").alias("transaction_type"),
        "customer_region", "seller_region")
    return (flow.agg(
        F.countDistinct("order_key").alias("total_orders"),
        M.money_total("sales").alias("total_sales"),
        F.countDistinct("customer_key").alias("unique_customers"),
        F.countDistinct("seller_key").alias("unique_sellers"))
        .orderBy(F.desc("total_sales"), "customer_region", "seller_region"))


# --- customers --------------------------------------------------------------------------------


def customer_profile(marts: Marts, year=None, region=None) -> DataFrame:
    """Sales per customer: orders, items, spend, first and last day.

    The three customer reports derive from it; give it to them when it has been stored once.
    """
    scope = Scope.of(year, region)
    orders = _at_grain(_sales_of_year(marts, scope), "order_key", "customer_key", "date_key")
    dated = orders.join(_calendar(marts, "full_date"), "date_key")
    per_customer = dated.groupBy("customer_key").agg(
        F.count(F.lit(1)).alias("order_count"),
        F.count("sales").alias("valued_orders"),
        F.min("full_date").alias("first_day"),
        F.max("full_date").alias("last_day"),
        *_resum("valued", "sales"))
    return per_customer.join(_customers(marts, scope, "customer_region"), "customer_key").select(
        "customer_key", "customer_region", "order_count",
        F.round("sales", 2).alias("total_spent"),
        F.round(M.quotient("sales", "valued_orders"), 2).alias("avg_order_total"),
        F.round(M.quotient("sales", "valued"), 2).alias("avg_item_value"),
        F.datediff("last_day", "first_day").cast("bigint").alias("lifetime_days"))


def customer_behavior(marts: Marts, year=None, region=None,
                      profile: DataFrame | None = None) -> DataFrame:
    profile = customer_profile(marts, year, region) if profile is None else profile
    return (profile.groupBy("customer_region").agg(
        F.count(F.lit(1)).alias("customer_count"),
        M.mean("order_count", 1).alias("avg_orders_per_customer"),
        M.mean("total_spent").alias("avg_customer_lifetime_value"),
        M.mean("avg_order_total").alias("avg_order_value"),
        M.mean("lifetime_days", 1).alias("avg_customer_lifetime_days"),
        M.count_if(F.col("order_count") == 1).alias("one_time_customers"),
        M.count_if(F.col("order_count") > 1).alias("repeat_customers"))
        .orderBy(F.desc("avg_customer_lifetime_value"), "customer_region"))


def customer_segmentation(marts: Marts, year=None, region=None,
                          profile: DataFrame | None = None) -> DataFrame:
    profile = customer_profile(marts, year, region) if profile is None else profile
    return (profile.groupBy(
        S.behaviour_segment(F.col("order_count")).alias("customer_segment"),
        S.value_segment(F.col("total_spent")).alias("value_segment")).agg(
        F.count(F.lit(1)).alias("customer_count"),
        M.mean("order_count", 1).alias("avg_orders"),
        M.mean("total_spent").alias("avg_lifetime_value"),
        M.mean("avg_item_value").alias("avg_order_value"),
        M.mean("lifetime_days", 1).alias("avg_lifetime_days"),
        M.money_total("total_spent").alias("segment_total_value"))
        .orderBy(F.desc("segment_total_value"), "customer_segment", "value_segment"))


def customer_frequency(marts: Marts, year=None, region=None,
                       profile: DataFrame | None = None) -> DataFrame:
    profile = customer_profile(marts, year, region) if profile is None else profile
    counted = profile.groupBy("order_count").agg(
        F.count(F.lit(1)).alias("customer_count"),
        M.mean("total_spent").alias("avg_customer_value"),
        M.money_total("total_spent").alias("total_segment_value"))
    return (counted.withColumn("percentage_of_customers", ranking.share_of_total("customer_count"))
            .orderBy("order_count"))


# --- payments ---------------------------------------------------------------------------------


def _paid_orders(marts: Marts, scope: Scope, *columns: str) -> DataFrame:
    """Sales per paid order with its payment attributes (p_...)."""
    kinds = marts["dim_payments"].select("payment_key", *(F.col(c).alias(f"p_{c}") for c in columns))
    orders = _orders(marts, scope).filter("is_paid")
    return orders.join(kinds, F.col("order_key") == F.col("payment_key"))


def _item_mean(value: str, weight: str, digits: int = 1) -> Column:
    """Mean over fact rows of an order-level number, NULL values left out."""
    present = F.when(F.col(value).isNotNull(), F.col(weight))
    return M.ratio(F.sum(F.col(value) * F.col(weight)), F.sum(present), digits)


def payment_analysis(marts: Marts, year=None, region=None) -> DataFrame:
    orders = _paid_orders(marts, Scope.of(year, region), "primary_payment_type",
                          "total_installments", "payment_methods_count", "uses_credit_card",
                          "uses_boleto", "uses_voucher")
    return (orders.groupBy(F.col("p_primary_payment_type").alias("primary_payment_type")).agg(
        F.count(F.lit(1)).alias("total_orders"),
        M.money_total("sales").alias("total_sales"),
        M.ratio(F.sum("sales"), F.sum("valued")).alias("avg_order_value"),
        _item_mean("p_total_installments", "fact_rows").alias("avg_installments"),
        M.count_if("p_uses_credit_card", "fact_rows").alias("credit_card_orders"),
        M.count_if("p_uses_boleto", "fact_rows").alias("boleto_orders"),
        M.count_if("p_uses_voucher", "fact_rows").alias("voucher_orders"),
        M.money_total("payments").alias("total_payments"),
        _item_mean("p_payment_methods_count", "fact_rows").alias("avg_payment_methods_count"))
        .orderBy(F.desc("total_sales"), "primary_payment_type"))


def installment_analysis(marts: Marts, year=None, region=None) -> DataFrame:
    orders = _paid_orders(marts, Scope.of(year, region), "total_installments")
    counted = orders.groupBy(F.col("p_total_installments").alias("total_installments")).agg(
        F.count(F.lit(1)).alias("order_count"),
        M.money_total("sales").alias("total_sales"),
        M.ratio(F.sum("sales"), F.sum("valued")).alias("avg_order_value"),
        M.money_total("payments").alias("total_payments"),
        M.ratio(F.sum("payments"), F.sum("paid_rows")).alias("avg_payment_value"),
        F.sum("fact_rows").alias("_rows"))
    return (counted.withColumn("percentage_of_orders", ranking.share_of_total("_rows"))
            .drop("_rows").orderBy("total_installments"))


# --- sellers ----------------------------------------------------------------------------------


def seller_performance(marts: Marts, year=None, region=None) -> DataFrame:
    scope = Scope.of(year, region)
    sales = _sales_of_year(marts, scope).select(
        "seller_key", "order_key", "product_key", "order_item_sk", "total_item_value", "freight_value")
    placed = sales.join(_sellers(marts, scope, "seller_region"), "seller_key")
    return (placed.groupBy("seller_region").agg(
        F.countDistinct("seller_key").alias("unique_sellers"),
        F.countDistinct("order_key").alias("total_orders"),
        F.count("order_item_sk").alias("total_items"),
        M.money_total("total_item_value").alias("total_revenue"),
        M.mean("total_item_value").alias("avg_item_value"),
        M.ratio(F.sum("total_item_value"), F.countDistinct("seller_key")).alias("revenue_per_seller"),
        F.countDistinct("product_key").alias("unique_products_sold"),
        M.mean("freight_value").alias("avg_freight_value"),
        M.money_total("freight_value").alias("total_freight_revenue"))
        .orderBy(F.desc("total_revenue"), "seller_region"))


def top_sellers(marts: Marts, limit: int = 20, year=None, region=None) -> DataFrame:
    """Sales are summed per seller before the seller's address is looked up."""
    scope = Scope.of(year, region)
    sales = _sales_of_year(marts, scope)
    if scope.region is not None:
        sales = sales.join(_sellers(marts, scope), "seller_key", "left_semi")
    per_seller = sales.groupBy("seller_key").agg(
        F.countDistinct("order_key").alias("total_orders"),
        F.count("order_item_sk").alias("total_items"),
        M.money_total("total_item_value").alias("total_revenue"),
        M.mean("total_item_value").alias("avg_item_value"),
        F.countDistinct("product_key").alias("unique_products_sold"),
        M.money_total("freight_value").alias("total_freight_revenue"),
        F.countDistinct("customer_key").alias("unique_customers_served"))
    report = per_seller.join(
        _sellers(marts, scope, "seller_region", "seller_state", "seller_city"), "seller_key")
    return ranking.top_n(report, "total_revenue", limit, "seller_key")


def seller_product_diversity(marts: Marts, year=None, region=None) -> DataFrame:
    scope = Scope.of(year, region)
    pairs = _at_grain(_sales_of_year(marts, scope), "seller_key", "product_key")
    categories = (marts["dim_products"].select("product_key", "product_category_english")
                  .filter(F.col("product_category_english").isNotNull()))
    per_seller = pairs.join(categories, "product_key").groupBy("seller_key").agg(
        F.countDistinct("product_category_english").alias("category_count"),
        F.count(F.lit(1)).alias("product_count"),
        F.round(F.sum("sales"), 2).alias("revenue"))
    placed = per_seller.join(_sellers(marts, scope, "seller_region"), "seller_key")
    return (placed.groupBy("seller_region").agg(
        F.count(F.lit(1)).alias("seller_count"),
        M.mean("category_count", 1).alias("avg_categories_per_seller"),
        M.mean("product_count", 1).alias("avg_products_per_seller"),
        M.mean("revenue").alias("avg_revenue_per_seller"),
        M.count_if(F.col("category_count") == 1).alias("single_category_sellers"),
        M.count_if(F.col("category_count") > 3).alias("diverse_sellers"))
        .orderBy(F.desc("avg_revenue_per_seller"), "seller_region"))


# --- reviews ----------------------------------------------------------------------------------


def _reviewed_orders(marts: Marts, scope: Scope, how: str, *columns: str) -> DataFrame:
    """Sales per order with its review columns (r_...); unreviewed orders stay spread by order key."""
    reviews = marts["dim_reviews"].select("review_key", *(F.col(c).alias(f"r_{c}") for c in columns))
    matches = (F.col("order_key") == F.col("review_key")) & F.col("is_reviewed")
    return _orders(marts, scope).join(reviews, matches, how)


def reviews_sales_correlation(marts: Marts, year=None, region=None) -> DataFrame:
    orders = _reviewed_orders(marts, Scope.of(year, region), "left", "review_score")
    scored = F.coalesce("r_review_score", F.lit(0).cast("bigint"))
    reviewed = F.col("review_key").isNotNull()
    category = S.review_category(F.col("review_key"), F.col("r_review_score"))
    return (orders.groupBy(category.alias("review_category")).agg(
        F.sum("items").alias("total_items"),
        M.money_total("sales").alias("total_sales"),
        M.ratio(F.sum("sales"), F.sum("valued")).alias("avg_item_value"),
        M.ratio(F.sum(scored * F.col("fact_rows")), F.sum("fact_rows"), 1).alias("avg_review_score"),
        M.count_if(reviewed, "fact_rows").alias("reviews_count"),
        M.count_if(~reviewed, "fact_rows").alias("no_review_count"),
        F.count(F.lit(1)).alias("total_orders"))
        .orderBy(F.desc("total_sales"), "review_category"))


def review_score_distribution(marts: Marts, year=None, region=None) -> DataFrame:
    orders = _reviewed_orders(marts, Scope.of(year, region), "left", "review_score")
    counted = orders.groupBy(
        F.coalesce("r_review_score", F.lit(0).cast("bigint")).alias("review_score")).agg(
        F.sum("items").alias("total_items"),
        M.money_total("sales").alias("total_sales"),
        M.ratio(F.sum("sales"), F.sum("valued")).alias("avg_item_value"),
        F.count(F.lit(1)).alias("total_orders"),
        M.count_if(F.col("review_key").isNotNull(), "fact_rows").alias("actual_reviews"))
    return (counted.withColumn("percentage_of_items", ranking.share_of_total("total_items"))
            .orderBy("review_score"))


def review_timing_analysis(marts: Marts, year=None, region=None) -> DataFrame:
    orders = (_reviewed_orders(marts, Scope.of(year, region), "inner", "days_to_review", "review_score")
              .filter(F.col("r_days_to_review").isNotNull())
              .join(marts["dim_orders"].select("order_key"), "order_key", "left_semi"))
    return (orders.groupBy(S.review_timing(F.col("r_days_to_review")).alias("timing_category")).agg(
        F.sum("fact_rows").alias("review_count"),
        _item_mean("r_review_score", "fact_rows").alias("avg_review_score"),
        M.money_total("sales").alias("total_sales"),
        M.ratio(F.sum("sales"), F.sum("valued")).alias("avg_item_value"),
        _item_mean("r_days_to_review", "fact_rows").alias("avg_days_to_review"))
        .orderBy("avg_days_to_review", "timing_category"))


# --- delivery ---------------------------------------------------------------------------------


def _delivered(marts: Marts, scope: Scope, *keys: str) -> DataFrame:
    """Sales per order (and further keys) of delivered orders with the delivery numbers.

    Without further keys the order key alone groups and its one customer is carried along, so
    the join to the orders needs no second shuffle and finds its input already sorted.
    """
    sales = _sales_of_year(marts, scope)
    if keys:
        orders = _at_grain(sales, "order_key", "customer_key", *keys)
    else:
        orders = sales.groupBy("order_key").agg(F.any_value("customer_key").alias("customer_key"), *_sums())
    times = (marts["dim_orders"].filter(F.col("days_to_delivery").isNotNull())
             .select("order_key", F.col("days_to_delivery").cast("bigint").alias("days"),
                     F.col("delivery_vs_estimate_days").cast("bigint").alias("late_by"),
                     F.col("is_delivered_on_time").alias("on_time")))
    return orders.join(times, "order_key")


def _delivery_sums() -> list[Column]:
    """Additive delivery numbers, weighted by fact rows."""
    rows = F.col("fact_rows")
    return [
        F.count(F.lit(1)).alias("orders"),
        F.sum("items").alias("items"),
        F.sum("sales").alias("sales"),
        F.sum("freight").alias("freight"),
        F.sum("freighted").alias("freighted"),
        F.sum("fact_rows").alias("fact_rows"),
        F.sum(F.col("days") * rows).alias("days"),
        F.sum(F.col("days") * F.col("days") * rows).alias("days_squared"),
        F.min("days").alias("min_days"),
        F.max("days").alias("max_days"),
        F.sum(F.col("late_by") * rows).alias("late_by"),
        F.sum(F.when(F.col("late_by").isNotNull(), rows)).alias("late_rows"),
        M.count_if("on_time", rows).alias("on_time"),
        M.count_if(~F.col("on_time"), rows).alias("late"),
    ]


def delivery_patterns(marts: Marts, year=None, region=None) -> DataFrame:
    """Delivery numbers are summed per customer before the region is looked up."""
    scope = Scope.of(year, region)
    per_customer = _delivered(marts, scope).groupBy("customer_key").agg(*_delivery_sums())
    placed = per_customer.join(_customers(marts, scope, "customer_region"), "customer_key")
    spread = M.stddev_from_sums(F.sum("fact_rows"), F.sum("days"), F.sum("days_squared"))
    return (placed.groupBy("customer_region").agg(
        F.sum("orders").alias("total_orders"),
        F.sum("items").alias("total_items"),
        M.money_total("sales").alias("total_sales"),
        M.ratio(F.sum("days"), F.sum("fact_rows"), 1).alias("avg_delivery_days"),
        M.ratio(F.sum("late_by"), F.sum("late_rows"), 1).alias("avg_delivery_vs_estimate"),
        F.sum("on_time").alias("on_time_deliveries"),
        F.sum("late").alias("late_deliveries"),
        M.percent(F.sum("on_time"), F.sum("orders")).alias("on_time_delivery_rate"),
        F.min("min_days").cast("double").alias("min_delivery_days"),
        F.max("max_days").cast("double").alias("max_delivery_days"),
        F.round(spread, 1).alias("delivery_days_stddev"))
        .orderBy("avg_delivery_days", "customer_region"))


def delivery_time_distribution(marts: Marts, year=None, region=None) -> DataFrame:
    scope = Scope.of(year, region)
    category = S.delivery_speed(F.col("days")).alias("delivery_speed_category")
    per_customer = _delivered(marts, scope).groupBy(category, "customer_key").agg(*_delivery_sums())
    known = per_customer.join(_customers(marts, scope), "customer_key", "left_semi")
    return (known.groupBy("delivery_speed_category").agg(
        F.sum("orders").alias("total_orders"),
        F.sum("items").alias("total_items"),
        M.money_total("sales").alias("total_sales"),
        M.ratio(F.sum("days"), F.sum("fact_rows"), 1).alias("avg_days_in_category"),
        F.sum("on_time").alias("on_time_orders"),
        M.percent(F.sum("on_time"), F.sum("orders")).alias("on_time_rate"),
        M.ratio(F.sum("late_by"), F.sum("late_rows"), 1).alias("avg_vs_estimate"))
        .orderBy("avg_days_in_category", "delivery_speed_category"))


def delivery_efficiency(marts: Marts, year=None, region=None) -> DataFrame:
    """An order counts once per pair of regions, also when several sellers of a region serve it."""
    scope = Scope.of(year, region)
    placed = (_delivered(marts, scope, "seller_key")
              .join(_sellers(marts, Scope(), "seller_region"), "seller_key"))
    per_order = placed.groupBy("order_key", "customer_key", "seller_region",
                               "days", "late_by", "on_time").agg(
        *_resum("items", "fact_rows", "sales", "freight", "freighted"))
    per_customer = per_order.groupBy("customer_key", "seller_region").agg(*_delivery_sums())
    return (per_customer.join(_customers(marts, scope, "customer_region"), "customer_key")
            .groupBy("customer_region", "seller_region",
                     S.transaction_type("customer_region", "seller_region").alias("delivery_type"))
            .agg(F.sum("orders").alias("total_orders"),
                 M.ratio(F.sum("days"), F.sum("fact_rows"), 1).alias("avg_delivery_days"),
                 M.ratio(F.sum("late_by"), F.sum("late_rows"), 1).alias("avg_vs_estimate"),
                 M.percent(F.sum("on_time"), F.sum("orders")).alias("on_time_rate"),
                 M.money_total("sales").alias("total_sales"),
                 M.ratio(F.sum("freight"), F.sum("freighted")).alias("avg_freight_cost"))
            .orderBy("avg_delivery_days", "customer_region", "seller_region"))


# --- overview ---------------------------------------------------------------------------------


def dashboard_summary(marts: Marts) -> DataFrame:
    return marts["fact_sales"].agg(
        F.countDistinct("order_key").alias("total_orders"),
        F.count("order_item_sk").alias("total_items"),
        M.money_total("total_item_value").alias("total_sales"),
        M.mean("total_item_value").alias("avg_order_value"),
        F.countDistinct("customer_key").alias("unique_customers"),
        F.countDistinct("seller_key").alias("unique_sellers"),
        F.countDistinct("product_key").alias("unique_products"))


REPORTS = {
    "monthly_sales_trends": monthly_sales_trends,
    "top_products_categories": top_products_categories,
    "sales_by_region": sales_by_region,
    "sales_by_state": sales_by_state,
    "customer_seller_flow": customer_seller_flow,
    "customer_behavior": customer_behavior,
    "customer_segmentation": customer_segmentation,
    "customer_frequency": customer_frequency,
    "payment_analysis": payment_analysis,
    "installment_analysis": installment_analysis,
    "seller_performance": seller_performance,
    "top_sellers": top_sellers,
    "seller_product_diversity": seller_product_diversity,
    "reviews_sales_correlation": reviews_sales_correlation,
    "review_score_distribution": review_score_distribution,
    "review_timing_analysis": review_timing_analysis,
    "delivery_patterns": delivery_patterns,
    "delivery_time_distribution": delivery_time_distribution,
    "delivery_efficiency": delivery_efficiency,
    "dashboard_summary": dashboard_summary,
}
