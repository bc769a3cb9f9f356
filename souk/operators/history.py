"""SCD-2 history by the timestamp strategy: every version a load holds, each ended by its successor.

Versions are linked without a window over a key: they are sorted by key and stamp over ranges, each range links its
own neighbours, and the first version of a range ends the last one of the range before it when both belong to one key.
A key with millions of versions is spread over ranges like any other rows.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from souk.operators.dedup import keep_latest
from souk.session import compact, work_folder

FROM, TO, UPDATED, VERSION = "dbt_valid_from", "dbt_valid_to", "dbt_updated_at", "dbt_scd_id"


def _version_id(key: str, updated_at: str):
    return F.md5(F.concat_ws("|", F.col(key).cast("string"), F.col(updated_at).cast("string")))


def chained(load: DataFrame, key: str, updated_at: str, folder: str | None = None, ranges: int | None = None) -> DataFrame:
    """One version per key and stamp, valid until the next stamp of the key; the newest is open.

    Rows with key and stamp alike are one version, chosen by their other columns; a version without stamp comes first.
    The sorted ranges are written to `folder` (else to the work folder) before they are linked, as two readings of a
    range exchange need not cut at the same places.
    """
    spark = load.sparkSession
    folder = folder or f"{work_folder(spark)}/history/{uuid4().hex}"
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    versions = keep_latest(load, [key, updated_at], [])
    arranged = versions.repartitionByRange(ranges, key, updated_at).withColumn("_range", F.spark_partition_id())
    compact(arranged).parquet(folder)
    stored = spark.read.schema(arranged.schema).parquet(folder)
    inside = Window.partitionBy("_range", key).orderBy(F.col(updated_at).asc_nulls_first())
    linked = stored.withColumn("_next", F.lead(updated_at).over(inside))
    heads = stored.groupBy(F.col(key).alias("_key"), F.col("_range").alias("_at")).agg(F.min(updated_at).alias("_head"))
    across = Window.partitionBy("_key").orderBy("_at")  # a row for each range the key lies in
    follow = heads.withColumn("_follow", F.lead("_head").over(across)).filter(F.col("_follow").isNotNull())
    # Two ranges share one key at most: fewer rows than ranges.
    joined = linked.join(F.broadcast(follow), F.col(key).eqNullSafe(F.col("_key")) & (F.col("_range") == F.col("_at")), "left")
    stamp = F.col(updated_at)
    return joined.select(
        *load.columns,
        _version_id(key, updated_at).alias(VERSION),
        stamp.alias(UPDATED),
        stamp.alias(FROM),
        F.coalesce("_next", "_follow").cast("timestamp").alias(TO),
    )


def changed_versions(history: DataFrame, load: DataFrame, key: str, updated_at: str,
                     folder: str | None = None) -> tuple[DataFrame, DataFrame]:
    """New versions a load brings, and the open versions that the first of them closes.

    A row is new when its stamp is newer than that of its key's open version; the history before that is not
    touched. Closed versions are not read; the open side has one row per key.
    """
    current = history.filter(F.col(TO).isNull())
    open_since = current.select(F.col(key).alias("_key"), F.col(UPDATED).alias("_open_since"))
    newer = F.col("_open_since").isNull() | (F.col(updated_at) > F.col("_open_since"))
    incoming = load.join(open_since, F.col(key) == F.col("_key"), "left").filter(newer).select(*load.columns)
    fresh = chained(incoming, key, updated_at, folder)
    # Every stamp of the incoming rows is in the ranges that `chained` wrote: the load is not joined a second time.
    successors = fresh.groupBy(F.col(key).alias("_key")).agg(F.min(updated_at).alias("_closed_at"))
    ended = (current.join(successors, F.col(key) == F.col("_key")).withColumn(TO, F.col("_closed_at"))
             .select(*history.columns))
    return fresh, ended


def apply_load(history: DataFrame | None, load: DataFrame, key: str, updated_at: str,
               folder: str | None = None) -> DataFrame:
    """History after a load. Keys absent from the load stay open."""
    if history is None:
        return chained(load, key, updated_at, folder)
    fresh, ended = changed_versions(history, load, key, updated_at, folder)
    closed = history.filter(F.col(TO).isNotNull())
    still_open = history.filter(F.col(TO).isNull()).join(ended.select(key), key, "left_anti")
    return (closed.unionByName(still_open.select(*history.columns)).unionByName(ended)
            .unionByName(fresh, allowMissingColumns=True))
