"""Joins with a stated size rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from souk import model

LOOKUP_ROWS = 50_000
SALTS = 32


def lookup_join(
    df: DataFrame,
    lookup: DataFrame,
    key: Column,
    lookup_key: str,
    spread_by: str,
    max_rows: int = LOOKUP_ROWS,
) -> DataFrame:
    """Left join to a reference table that is unique on `lookup_key`.

    The lookup is broadcast only if it is counted to be small: few distinct codes make a
    shuffle join badly skewed. A larger one is joined on (key, salt): it is repeated once per
    salt, and rows of a popular code spread over all salts by the hash of `spread_by`.
    """
    if lookup.limit(max_rows + 1).count() <= max_rows:
        return df.join(F.broadcast(lookup), key == lookup[lookup_key], "left").drop(lookup[lookup_key])
    salted = df.withColumn("_code", key).withColumn(
        "_salt", F.pmod(F.xxhash64(spread_by), F.lit(SALTS)).cast("int"))
    copies = (lookup.withColumnRenamed(lookup_key, "_code")
              .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))))
    return salted.join(copies, ["_code", "_salt"], "left").drop("_code", "_salt")


def with_region(df: DataFrame, regions: DataFrame, state: str, prefix: str, key: str) -> DataFrame:
    """Region, economic zone and display name of a state, 'Unknown' where the seed has none."""
    seed = regions.select(
        F.upper("state_code").alias("_state_code"),
        F.col("region").alias("_region"),
        F.col("economic_zone").alias("_zone"),
        F.col("state_name").alias("_name"),
    )
    unknown = F.lit(model.UNKNOWN_REGION)
    joined = lookup_join(df, seed, F.upper(state), "_state_code", key)
    return joined.select(
        *df.columns,
        F.coalesce("_region", unknown).alias(f"{prefix}_region"),
        F.coalesce("_zone", unknown).alias(f"{prefix}_economic_zone"),
        F.coalesce("_name", F.col(state)).alias(f"{prefix}_state_name"),
    )


def with_parent_flag(child: DataFrame, child_key: str, parent: DataFrame,
                     parent_key: str) -> DataFrame:
    """(key, child_rows, known): every child key with its row count; `known` is NULL for orphans.

    Child rows are counted per key before the join, so a popular key is one row per map task.
    """
    counted = child.groupBy(F.col(child_key).alias("key")).agg(
        F.count(F.lit(1)).alias("child_rows"))
    known = parent.select(F.col(parent_key).alias("key")).distinct().withColumn("known", F.lit(True))
    return counted.join(known, "key", "left")


def orphans(child: DataFrame, child_key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Non-null child keys without a parent, with the number of rows that carry them."""
    flagged = with_parent_flag(child, child_key, parent, parent_key)
    return flagged.filter(F.col("key").isNotNull() & F.col("known").isNull()).drop("known")
