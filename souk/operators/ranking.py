"""Top-n, remainder rows, shares of a total and domain completion on finished reports."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from souk import model
from souk.functions import measures


def top_n(df: DataFrame, metric: str, n: int | None, *tie_breakers: str) -> DataFrame:
    """The n rows highest on `metric` (planned as a per-task top-n and one merge); None: all."""
    ordered = df.orderBy(F.desc_nulls_last(metric), *tie_breakers)
    return ordered if n is None else ordered.limit(n)


def top_with_others(df: DataFrame, label: str, measure: str, n: int = 10,
                    others: str = model.OTHERS) -> DataFrame:
    """The n largest rows and one row with the sum of the rest, if there is a rest.

    `df` is a finished report of a few dozen rows, so the unpartitioned rank is cheap.
    """
    ranked = df.withColumn("_rank", F.row_number().over(
        Window.orderBy(F.desc_nulls_last(measure), F.col(label))))
    kept = F.col("_rank") <= n
    return (ranked
            .groupBy(F.when(kept, F.col("_rank")).otherwise(n + 1).alias("position"),
                     F.when(kept, F.col(label)).otherwise(others).alias(label))
            .agg(measures.rounded(F.sum(F.col(measure).cast("decimal(28,2)"))).alias(measure))
            .orderBy("position"))


def share_of_total(count: str, digits: int = 1):
    """Percent of the column's total over a grouped report.

    The window has one partition, which holds one row per group: per review score, instalment
    sum or order count (N orders have fewer than sqrt(2N) different counts per customer).
    """
    return measures.percent(count, F.sum(count).over(Window.partitionBy()), digits)


def complete_domain(df: DataFrame, key: str, labels: Mapping[str, str], measure: str) -> DataFrame:
    """One row per label of the domain, measure 0 where the report has no such row."""
    spark = df.sparkSession
    domain = spark.createDataFrame(
        [(i, k, v) for i, (k, v) in enumerate(labels.items())],
        f"position int, {key} string, segment string")
    found = df.select(key, measure)
    zero = F.lit(0).cast(df.schema[measure].dataType)
    return (domain.join(found, key, "left")
            .select("segment", F.coalesce(measure, zero).alias("value"),
                    F.col(key).alias("original_name"), "position")
            .orderBy("position").drop("position"))
