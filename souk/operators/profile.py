"""Table exploration: samples, numeric profile, value counts."""

from __future__ import annotations

from collections.abc import Sequence
from uuid import uuid4

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from souk.session import work_folder

SAMPLE_ROWS = range(5, 101)
MAX_CATEGORIES = 20
SPARE = 4  # a sketch may be wrong by less than this factor
QUARTILES = (0.25, 0.5, 0.75)


def sample_rows(df: DataFrame, n: int = 5, order_by: list[str] | None = None) -> DataFrame:
    """The first n rows; with `order_by` always the same ones."""
    if n not in SAMPLE_ROWS:
        raise ValueError(f"sample size must lie in {SAMPLE_ROWS.start}..{SAMPLE_ROWS.stop - 1}")
    return (df.orderBy(*order_by) if order_by else df).limit(n)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]


def numeric_profile(df: DataFrame) -> DataFrame:
    """Count, mean, std, min, quartiles and max of every numeric column, one row each.

    Quartiles are exact and interpolated, for samples and whole tables alike; see `quantiles`.
    """
    columns = numeric_columns(df)
    stats = {"count": F.count, "mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}
    wide = df.agg(*(f(F.col(c).cast("double")).alias(f"{c}__{s}")
                    for c in columns for s, f in stats.items()))
    rows = [F.struct(F.lit(c).alias("column_name"),
                     *(F.col(f"{c}__{s}").alias(s) for s in stats)) for c in columns]
    found = quantiles(df, columns, QUARTILES).groupBy("column_name").agg(*(
        F.max(F.when(F.col("q") == q, F.col("quantile"))).alias(f"q{round(q * 100)}") for q in QUARTILES))
    return (wide.select(F.inline(F.array(*rows))).join(F.broadcast(found), "column_name", "left")
            .select("column_name", "count", "mean", "std", "min", "q25", "q50", "q75", "max"))


def quantiles(df: DataFrame, columns: list[str], shares: Sequence[float]) -> DataFrame:
    """(column_name, q, quantile): exact quantiles of numeric columns, interpolated between ranks.

    Values are counted first, so that a value with a third of all rows is one row; the counts are
    sorted over all tasks by range. The totals of the ranges, a few rows for each task, say in which
    range a rank falls and what lies before it. Only there ranks are summed up, range by range.
    """
    spark = df.sparkSession
    pairs = F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("value"))
                      for c in columns))
    counts = (df.select(F.inline(pairs)).filter(F.col("value").isNotNull())
              .groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n")))
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = f"{work_folder(spark)}/quantiles/{uuid4().hex}"
    (counts.repartitionByRange(ranges, "column_name", "value")
     .withColumn("part", F.spark_partition_id()).write.parquet(path))
    ranged = spark.read.schema("column_name string, value double, n long, part int").parquet(path)
    totals = ranged.groupBy("column_name", "part").agg(F.sum("n").alias("n")).collect()
    before, wanted = [], []
    for column in columns:
        seen = 0
        parts = sorted((r["part"], r["n"]) for r in totals if r["column_name"] == column)
        total = sum(n for _, n in parts)
        ranks = {}
        for q in shares if total else ():
            at = q * (total - 1)
            low = int(at)
            ranks[q] = {low: 1 - (at - low)} | ({low + 1: at - low} if at > low else {})
        for part, n in parts:
            before.append((column, part, seen))
            wanted += [(column, part, q, rank, weight) for q, own in ranks.items()
                       for rank, weight in own.items() if seen <= rank < seen + n]
            seen += n
    wanted = spark.createDataFrame(wanted, "column_name string, part int, q double, rank long, weight double")
    before = spark.createDataFrame(before, "column_name string, part int, before long")
    keys = ["column_name", "part"]
    here = (ranged.join(F.broadcast(wanted.select(*keys).distinct()), keys, "left_semi")
            .join(F.broadcast(before), keys))
    up_to = F.col("before") + F.sum("n").over(Window.partitionBy(*keys).orderBy("value"))
    here = here.withColumn("up_to", up_to)
    hit = here.join(F.broadcast(wanted), keys).filter(
        (F.col("rank") < F.col("up_to")) & (F.col("rank") >= F.col("up_to") - F.col("n")))
    return hit.groupBy("column_name", "q").agg(F.sum(F.col("value") * F.col("weight")).alias("quantile"))


def _values(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, value, n) of all columns in one scan; map tasks fold equal values before the shuffle."""
    pairs = F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(c).alias("value")) for c in columns))
    return (df.select(F.inline(pairs)).filter(F.col("value").isNotNull())
            .groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n")))


def narrow_columns(df: DataFrame, columns: list[str]) -> list[str]:
    """Columns that a sketch does not rule out: estimated at no more than SPARE times the categories looked for.

    One scan that sends a sketch per column and task; no value is shuffled. At so few values the sketch is exact
    but for hash collisions, far from a factor of SPARE.
    """
    if not columns:
        return []
    sketches = [F.hll_sketch_estimate(F.hll_sketch_agg(c)).alias(f"n{i}") for i, c in enumerate(columns)]
    found = df.agg(*sketches).first()
    return [c for i, c in enumerate(columns) if (found[f"n{i}"] or 0) <= SPARE * MAX_CATEGORIES]


def value_counts(df: DataFrame, columns: list[str] | None = None, first: int | None = None) -> DataFrame:
    """Counts per value of the text columns that have at most 20 distinct values.

    `first` takes only so many columns, as the sample page does. A sketch drops columns of far more values, such as
    unique ids, before any value is shuffled; the others are counted exactly, all in one scan.
    """
    columns = narrow_columns(df, columns or text_columns(df)[:first])
    if not columns:
        return df.sparkSession.createDataFrame([], "column_name string, value string, n long")
    counts = _values(df, columns)
    narrow = (counts.groupBy("column_name").agg(F.count(F.lit(1)).alias("_values"))
              .filter(F.col("_values") <= MAX_CATEGORIES))
    return (counts.join(F.broadcast(narrow.drop("_values")), "column_name", "left_semi")
            .orderBy("column_name", F.desc("n"), "value"))


def distinct_counts(df: DataFrame, columns: list[str] | None = None, first: int | None = None) -> DataFrame:
    """Number of distinct values per text column, all or the `first` so many, in one scan."""
    columns = columns or text_columns(df)[:first]
    names = df.sparkSession.createDataFrame([(c,) for c in columns], "column_name string")
    counted = _values(df, columns).groupBy("column_name").agg(F.count(F.lit(1)).alias("distinct_values"))
    return names.join(F.broadcast(counted), "column_name", "left").select(  # a row per column
        "column_name", F.coalesce("distinct_values", F.lit(0).cast("bigint")).alias("distinct_values"))
