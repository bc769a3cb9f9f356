"""Seed tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from souk import model


def read_seed(spark: SparkSession, path: str | None = None) -> DataFrame:
    """State to region lookup with its declared types; without a path the built-in 27 rows."""
    if path is None:
        return spark.createDataFrame(list(model.STATE_REGIONS), model.SEED_SCHEMA)
    return spark.read.schema(model.SEED_SCHEMA).csv(path, header=True)
