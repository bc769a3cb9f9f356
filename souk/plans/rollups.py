"""Follow-on reports computed from finished reports.

Distinct counts of several groups are added up as they are, so a customer who buys in two groups
counts twice; these frames hold one row per group, so everything here is small.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from souk import model
from souk.functions import measures as M
from souk.functions import scalar as S
from souk.operators import ranking


def _money(c: str):
    """Sum of an already rounded money column, free of floating-point drift."""
    return F.sum(F.col(c).cast("decimal(28,2)"))


def totals_by(report: DataFrame, key: str, money: Sequence[str], counts: Sequence[str]) -> DataFrame:
    return report.groupBy(key).agg(
        *(_money(c).cast("double").alias(c) for c in money),
        *(F.sum(c).alias(c) for c in counts)).orderBy(key)


def group_sizes(report: DataFrame, key: str, name: str) -> DataFrame:
    return report.groupBy(key).agg(F.count(F.lit(1)).alias(name)).orderBy(key)


def customer_region_totals(regional: DataFrame) -> DataFrame:
    return totals_by(regional, "customer_region", ["total_sales"], ["total_orders", "unique_customers"])


def seller_region_totals(regional: DataFrame) -> DataFrame:
    return totals_by(regional, "seller_region", ["total_sales"], ["total_orders", "unique_sellers"])


def flow_totals(flow: DataFrame) -> DataFrame:
    return totals_by(flow, "transaction_type", ["total_sales"], ["total_orders"])


def top_cross_region_flows(flow: DataFrame, n: int = 10) -> DataFrame:
    cross = flow.filter(F.col("transaction_type") == model.CROSS_REGION)
    labelled = cross.select(S.arrow_label("customer_region", "seller_region").alias("flow"),
                            "total_sales", "total_orders")
    return ranking.top_n(labelled, "total_sales", n, "flow")


def region_matrix(regional: DataFrame, seller_regions: Sequence[str] | None = None) -> DataFrame:
    """Sales by customer region (rows) and seller region (columns), 0 where none."""
    grouped = regional.groupBy("customer_region").pivot(
        "seller_region", list(seller_regions) if seller_regions is not None else None)
    return grouped.agg(F.sum("total_sales")).na.fill(0.0).orderBy("customer_region")


def states_per_region(states: DataFrame) -> DataFrame:
    return group_sizes(states, "customer_region", "state_count")


def customers_per_behaviour(segments: DataFrame) -> DataFrame:
    summed = totals_by(segments, "customer_segment", [], ["customer_count"])
    return ranking.complete_domain(summed, "customer_segment", model.BEHAVIOUR_SEGMENTS, "customer_count")


def revenue_per_value_segment(segments: DataFrame) -> DataFrame:
    summed = totals_by(segments, "value_segment", ["segment_total_value"], [])
    return ranking.complete_domain(summed, "value_segment", model.VALUE_SEGMENTS, "segment_total_value")


def retention_by_region(behavior: DataFrame) -> DataFrame:
    rate = M.quotient(F.col("repeat_customers") * 100, "customer_count").cast("double")
    return (behavior.select("customer_region", "customer_count", "repeat_customers",
                            rate.alias("retention_rate"))
            .orderBy(F.desc("retention_rate"), "customer_region"))


def repeat_rate(behavior: DataFrame) -> DataFrame:
    return behavior.agg(M.safe_share(F.sum("repeat_customers") * 100, F.sum("customer_count"))
                        .alias("repeat_rate"))


def most_common_frequency(frequency: DataFrame) -> DataFrame:
    """The row of the order count most customers have (the lowest one on a tie)."""
    best = F.max_by(F.struct(*frequency.columns), F.struct("customer_count", -F.col("order_count")))
    return frequency.agg(best.alias("row")).select("row.*")


def frequency_detail(frequency: DataFrame, order_count: int) -> DataFrame:
    return frequency.filter(F.col("order_count") == order_count).select(
        F.col("order_count").alias("Number of Orders"),
        F.col("customer_count").alias("Customer Count"),
        F.col("percentage_of_customers").alias("Percentage"),
        F.col("avg_customer_value").alias("Avg Customer Value"),
        F.col("total_segment_value").alias("Total Segment Value"))


def category_revenue_share(categories: DataFrame, n: int = 10) -> DataFrame:
    """Shares of all revenue if the report has all categories; of those it was cut to otherwise."""
    return ranking.top_with_others(categories, "category", "total_revenue", n)


def top_sellers_per_region(sellers: DataFrame) -> DataFrame:
    return group_sizes(sellers, "seller_region", "seller_count")


def specialization_by_region(diversity: DataFrame) -> DataFrame:
    rate = M.quotient(F.col("single_category_sellers") * 100, "seller_count").cast("double")
    return (diversity.select("seller_region", "seller_count", "single_category_sellers",
                             rate.alias("specialization_rate"))
            .orderBy(F.desc("specialization_rate"), "seller_region"))


def review_availability(reviews: DataFrame) -> DataFrame:
    """Items and sales with and without a review: always two rows."""
    labels = dict(zip(model.REVIEW_AVAILABILITY, ("reviews_count", "no_review_count"), strict=True))
    without = F.col("review_category") == model.NO_REVIEW
    none = F.lit(0).cast("decimal(38,2)")
    sums = reviews.agg(
        *(F.coalesce(F.sum(c), F.lit(0).cast("bigint")).alias(c) for c in labels.values()),
        *(F.coalesce(F.sum(F.when(hit, F.col("total_sales").cast("decimal(28,2)"))), none)
          .cast("double").alias(f"{c}_sales")
          for c, hit in zip(labels.values(), (~without, without), strict=True)))
    return sums.select(F.inline(F.array(*(
        F.struct(F.lit(k).alias("category"), F.col(c).alias("items"),
                 F.col(f"{c}_sales").alias("sales")) for k, c in labels.items()))))


def review_coverage(reviews: DataFrame) -> DataFrame:
    with_review, without = F.sum("reviews_count"), F.sum("no_review_count")
    return reviews.agg(M.safe_share(with_review * 100, with_review + without).alias("review_coverage"))


def delivery_by_route(efficiency: DataFrame) -> DataFrame:
    """Order-weighted means per same/cross region."""
    return efficiency.groupBy("delivery_type").agg(
        F.sum("total_orders").alias("total_orders"),
        M.weighted_mean("avg_delivery_days", "total_orders").alias("avg_delivery_days"),
        M.weighted_mean("on_time_rate", "total_orders").alias("on_time_rate"),
        M.rounded(_money("total_sales"), 1).alias("total_sales"),
        M.weighted_mean("avg_freight_cost", "total_orders").alias("avg_freight_cost"),
    ).orderBy("delivery_type")


def delivery_overall(patterns: DataFrame) -> DataFrame:
    return patterns.agg(
        M.weighted_mean("avg_delivery_days", "total_orders", None).alias("avg_delivery_days"),
        M.safe_share(F.sum("on_time_deliveries") * 100, F.sum("total_orders")).alias("on_time_rate"))


# --- key figures per report page ----------------------------------------------------------------


def _sum_of(report_column: str):
    return F.sum(report_column).alias(report_column)


def _mean_of_groups(c: str):
    """Unweighted mean of the group values."""
    return M.quotient(F.sum(F.col(c).cast("decimal(28,9)")), F.count(c)).cast("double")


def kpi_sales(monthly: DataFrame) -> DataFrame:
    return monthly.agg(
        _money("total_sales").cast("double").alias("total_sales"),
        _sum_of("total_orders"), _sum_of("total_items"),
        M.safe_share(_money("total_sales"), F.sum("total_orders")).alias("avg_order_value"))


def kpi_categories(categories: DataFrame) -> DataFrame:
    """Totals over the report's rows: give it all categories for totals of the whole."""
    return categories.agg(
        F.count(F.lit(1)).alias("total_categories"),
        _money("total_revenue").cast("double").alias("total_revenue"),
        F.sum("unique_products").alias("total_products"),
        F.sum("items_sold").alias("total_items_sold"))


def kpi_geography(regional: DataFrame) -> DataFrame:
    return regional.agg(
        F.countDistinct("customer_region").alias("total_regions"),
        _money("total_sales").cast("double").alias("total_sales"),
        F.sum("unique_customers").alias("total_customers"),
        F.sum("unique_sellers").alias("total_sellers"))


def kpi_customers(behavior: DataFrame) -> DataFrame:
    return behavior.agg(
        F.sum("customer_count").alias("total_customers"),
        F.sum("one_time_customers").alias("total_one_time"),
        F.sum("repeat_customers").alias("total_repeat"),
        _mean_of_groups("avg_customer_lifetime_value").alias("avg_lifetime_value"),
        M.safe_share(F.sum("repeat_customers") * 100, F.sum("customer_count")).alias("repeat_rate"))


def kpi_payments(payments: DataFrame) -> DataFrame:
    return payments.agg(
        _sum_of("total_orders"),
        _money("total_sales").cast("double").alias("total_sales"),
        _money("total_payments").cast("double").alias("total_payments"),
        _mean_of_groups("avg_installments").alias("avg_installments"))


def kpi_sellers(sellers: DataFrame) -> DataFrame:
    return sellers.agg(
        F.sum("unique_sellers").alias("total_sellers"),
        _money("total_revenue").cast("double").alias("total_revenue"),
        M.safe_share(_money("total_revenue"), F.sum("unique_sellers")).alias("avg_revenue_per_seller"),
        F.sum("unique_products_sold").alias("total_products"))


def kpi_reviews(reviews: DataFrame) -> DataFrame:
    with_review, without = F.sum("reviews_count"), F.sum("no_review_count")
    return reviews.agg(
        _sum_of("total_items"),
        _money("total_sales").cast("double").alias("total_sales"),
        with_review.alias("total_reviews"), without.alias("no_reviews"),
        M.safe_share(with_review * 100, with_review + without).alias("review_coverage"))


def kpi_delivery(patterns: DataFrame) -> DataFrame:
    return patterns.agg(
        _sum_of("total_orders"),
        _money("total_sales").cast("double").alias("total_sales"),
        M.weighted_mean("avg_delivery_days", "total_orders", None).alias("avg_delivery_days"),
        M.safe_share(F.sum("on_time_deliveries") * 100, F.sum("total_orders"))
        .alias("overall_on_time_rate"))
