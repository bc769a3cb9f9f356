"""Keep-latest de-duplication."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_latest(
    df: DataFrame,
    keys: Sequence[str],
    latest: Sequence[str] = ("modified_at",),
    tie_breakers: Sequence[str] | None = None,
) -> DataFrame:
    """One row per key: newest on `latest`, ties settled by the remaining columns.

    The rank filter is planned as a group limit on both sides of the shuffle, so every map task
    forwards at most one row per key and a key with very many copies does not burden one reducer.
    """
    if tie_breakers is None:
        tie_breakers = [c for c in df.columns if c not in {*keys, *latest}]
    order: list[Column] = [F.col(c).desc_nulls_last() for c in latest]
    order += [F.col(c).asc_nulls_first() for c in tie_breakers]
    ranked = df.withColumn("rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.filter(F.col("rn") == 1).drop("rn")
