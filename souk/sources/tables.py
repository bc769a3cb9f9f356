"""Table binding, mart writes, metadata scan and existence checks."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from souk.model import Mart
from souk.operators.incremental import compared, sync_columns, synced
from souk.session import compact
from souk.sources import live

PERIOD = "period"
BATCH = 2 * 1024**3  # stored bytes of the periods that one job of a merge rewrites, unless one period has more
GRAINS = {"day": "yyyy-MM-dd", "month": "yyyy-MM", "year": "yyyy"}


def bind(spark: SparkSession, places: Mapping[str, str], table: str) -> DataFrame:
    """A logical table: its name is looked up to a Parquet path or a catalogue table."""
    place = places[table]
    return spark.read.parquet(place) if "/" in place else spark.table(place)


def write_raw(df: DataFrame, path: str) -> None:
    """Replace a raw table with this load."""
    df.write.mode("overwrite").parquet(path)


def period_of(mart: Mart, grain: str) -> Column:
    return F.coalesce(F.date_format(mart.day_column, GRAINS[grain]), F.lit("none"))


def arranged(df: DataFrame, mart: Mart, grain: str | None) -> DataFrame:
    """Rows with their period column, balanced over write tasks and sorted by cluster key.

    The rebalance lets adaptive execution split a period that holds much of the data over many
    files and merge small ones, so neither a busy day nor a thousand quiet ones hurts.
    """
    keys = list(mart.cluster_by)
    if not is_partitioned(mart, grain):
        return df.hint("rebalance").sortWithinPartitions(*keys)
    return (df.withColumn(PERIOD, period_of(mart, grain)).hint("rebalance", F.col(PERIOD))
            .sortWithinPartitions(PERIOD, *keys))


def write_mart(df: DataFrame, path: str, mart: Mart, grain: str | None = "day",
               finish: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """Full write of a mart, partitioned on the period of its day column; readers see it when it is whole.

    `finish` turns arranged rows to the mart's, row by row and with any further columns kept: what it adds is
    neither shuffled nor sorted.
    """
    spark = df.sparkSession
    before = live.opened(spark, path) or live.Live()
    version, written = _write_version(df, path, mart, grain, before.number + 1, finish)
    layout = (finish(df) if finish else df).schema
    live.publish(spark, path, before.replaced(list(before.held), version, written, layout))
    live.expire(spark, path)


def _write_version(df: DataFrame, path: str, mart: Mart, grain: str | None, number: int,
                   finish: Callable[[DataFrame], DataFrame] | None = None,
                   begun: str | None = None) -> tuple[str, list[str | None]]:
    """Rows in a version folder that no list names yet (one begun before, with other periods), and all periods in it."""
    spark, version = df.sparkSession, begun or live.new_version(number)
    folder = f"{path}/{live.VERSION}={version}"
    rows = arranged(df, mart, grain)
    rows = finish(rows) if finish else rows
    if not is_partitioned(mart, grain):
        compact(rows).parquet(folder)
        return version, [None]
    compact(rows).mode("append" if begun else "error").partitionBy(PERIOD).parquet(folder)
    return version, [n.partition("=")[2] for n in live.names_in(spark, folder) if n.startswith(f"{PERIOD}=")]


def read_mart(spark: SparkSession, path: str, schema: T.StructType | None = None,
              partitioned: bool = True) -> DataFrame:
    """Mart rows as they are now; later merges do not change what this frame reads.

    The period column stays: filters on it skip whole directories. With a schema, files written in
    another layout are read as they were written and turned to it: columns they lack are NULL, columns that are
    gone are left out, a value that does not fit a column's new type is NULL.
    """
    now = live.opened(spark, path)
    if now is None:
        raise FileNotFoundError(f"nothing is stored in {path}")
    wanted = T.StructType([f for f in schema or now.schema() if f.name != PERIOD])
    inside = [T.StructField(live.VERSION, T.StringType())]
    inside += [T.StructField(PERIOD, T.StringType())] if partitioned else []
    parts = []
    for layout, places in now.by_layout():
        held = T.StructType([f for f in layout if f.name != PERIOD])
        alike = {(f.name, f.dataType) for f in wanted} >= {(f.name, f.dataType) for f in held if f.name in wanted.names}
        rows = (spark.read.option("basePath", path).schema(T.StructType([*(wanted if alike else held), *inside]))
                .parquet(*(live.folder(path, p, v, PERIOD) for p, v in places)).drop(live.VERSION))
        parts.append(rows if alike else _in_layout(rows, wanted, partitioned))
    if not parts:
        return spark.createDataFrame([], T.StructType([*wanted, *inside[1:]]))
    return reduce(DataFrame.unionByName, parts)


def _in_layout(rows: DataFrame, wanted: T.StructType, partitioned: bool) -> DataFrame:
    period = [F.col(PERIOD)] if partitioned else []
    return rows.select(*synced(rows.schema, wanted), *period)


def is_partitioned(mart: Mart, grain: str | None) -> bool:
    return grain is not None and mart.day_column is not None


def merge_mart(spark: SparkSession, path: str, source: DataFrame, mart: Mart, staging: str,
               grain: str | None = "day") -> None:
    """Upsert `source` into a stored mart, rewriting only the periods that change.

    The new rows are written to `staging` first, a folder of this merge alone: they are used three times, and
    once their size is known a small increment is broadcast instead of shuffling the stored rows. Without
    rows nothing is written.
    """
    rows = staged(source, f"{staging}/rows")
    if not rows.isEmpty():
        replace_rows(spark, path, rows, rows.select(mart.key), mart, grain)
    delete(spark, staging)


def staged(df: DataFrame, path: str) -> DataFrame:
    """A table written to a folder and read back: the shuffles behind it are of no more use."""
    compact(df).mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def renew_mart(spark: SparkSession, path: str, fresh: DataFrame, mart: Mart, staging: str, grain: str | None = "day") -> None:
    """Bring a stored mart to `fresh`, all rows it should have now; rows of keys that `fresh` lacks stay.

    Three steps with files between them, so that the shuffles of one are gone before the next begins: the fresh
    rows are written, keys and digests of both sides are compared, the periods with news are written from the fresh
    rows. A digest only decides whether a period has news. Without news nothing is written.
    """
    partitioned = is_partitioned(mart, grain)
    place = period_of(mart, grain) if partitioned else F.lit(None).cast("string")
    try:
        rows = staged(fresh, f"{staging}/rows")
        before = live.opened(spark, path)
        stored = read_mart(spark, path, rows.schema, partitioned)
        was = stored if partitioned else stored.withColumn(PERIOD, F.lit(None).cast("string"))
        found = staged(compared(rows.withColumn(PERIOD, place), was, mart.key, PERIOD), f"{staging}/found")
        news = found.filter(~F.col("gone")).select("now", "was").distinct().collect()  # by calendar period, whatever the data volume
        if not news:
            return
        if partitioned:
            touched = sorted({p for r in news for p in r if p is not None})
            rows, stored = rows.filter(place.isin(touched)), stored.filter(F.col(PERIOD).isin(touched)).drop(PERIOD)
        else:
            touched = [None]
        kept = stored.join(found.filter("gone").select(F.col("key").alias(mart.key)), mart.key, "left_semi")
        kept = kept.unionByName(stored.filter(F.col(mart.key).isNull()))  # without a key no row takes the place of another
        version, written = _write_version(rows.unionByName(kept), path, mart, grain, before.number + 1)
        live.publish(spark, path, before.replaced(touched, version, written, rows.schema))
        live.expire(spark, path)
    finally:
        delete(spark, staging)


def replace_rows(spark: SparkSession, path: str, rows: DataFrame, keys: DataFrame, mart: Mart, grain: str | None = "day",
                 periods: list[str] | None = None) -> None:
    """Take `rows` in place of all stored rows whose key is among `keys` (one column, named as stored).

    `periods` names those that may hold such a row, beside those that `rows` lie in. If it is not known, those that do
    are found by a scan of the key column alone. Other periods are neither read nor written, and to a period that was
    found to hold none its rows are added: what it has stays where it lies. The merged periods go to a new version
    folder, in jobs over a bounded part of the stored rows, as a job's shuffles stay until its end. Then the list of
    live folders is replaced: readers see the merge whole or not at all, a writer that stops changes nothing.
    """
    before = live.opened(spark, path)
    stored = read_mart(spark, path, rows.schema, is_partitioned(mart, grain))
    key, = keys.columns

    def merged(stored: DataFrame, rows: DataFrame) -> DataFrame:
        return sync_columns(stored.join(keys, key, "left_anti"), rows).unionByName(rows)
    if not is_partitioned(mart, grain):
        version, written = _write_version(merged(stored, rows), path, mart, grain, before.number + 1)
        live.publish(spark, path, before.replaced([None], version, written, rows.schema))
        live.expire(spark, path)
        return
    added: set[str] = set()
    coming = [r[0] for r in rows.select(period_of(mart, grain)).distinct().collect()]
    if periods is None:
        holders = stored.select(key, PERIOD).join(keys, key, "left_semi").select(PERIOD).distinct()
        periods = [r[0] for r in holders.collect()]  # one value per calendar period, whatever the data volume
        added = {p for p in coming if p not in periods and _takes_more(before, p, rows.schema)}
    rewritten = sorted({*periods, *coming} - added)
    if not rewritten and not added:
        return
    version, written = None, []
    for batch in _batches(spark, path, before, rewritten, added):
        old = stored.filter(F.col(PERIOD).isin([p for p in batch if p not in added])).drop(PERIOD)
        new = rows if len(batch) == len(rewritten) + len(added) else rows.filter(period_of(mart, grain).isin(batch))
        both = new if added.issuperset(batch) else merged(old, new)
        version, written = _write_version(both, path, mart, grain, before.number + 1, None, version)
    live.publish(spark, path, before.replaced(rewritten, version, written, rows.schema))
    live.expire(spark, path)


def _takes_more(now: live.Live, period: str, layout: T.StructType) -> bool:
    """Whether rows can be added to a period: it is new, or has few layers, all of this layout."""
    if period not in now.held:
        return True
    columns = [(f.name, f.dataType) for f in layout]
    held = [T.StructType.fromJson(json.loads(now.layouts[v])) for v in live.layers(now.held[period])]
    return len(held) < live.LAYERS and all([(f.name, f.dataType) for f in h if f.name != PERIOD] == columns for h in held)


def _batches(spark: SparkSession, path: str, now: live.Live, rewritten: list[str], added: set[str]) -> list[list[str]]:
    """The periods in groups, of which the stored rows of those to rewrite take BATCH bytes at most, or one period more."""
    batches, full = [sorted(added)], 0
    for p in rewritten:
        size = sum(live.bytes_in(spark, live.folder(path, p, v, PERIOD)) for v in live.layers(now.held[p])) if p in now.held else 0
        if full and full + size > BATCH:
            batches.append([])
            full = 0
        batches[-1].append(p)
        full += size
    return batches


def delete(spark: SparkSession, path: str) -> None:
    live.delete(spark, path)


def is_complete(spark: SparkSession, path: str) -> bool:
    """A full write has ended here: a list of live folders, or the mark that Spark leaves last."""
    return live.opened(spark, path) is not None or "_SUCCESS" in live.names_in(spark, path)


def table_info(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Row count, bytes, first and last file time of every table, by name.

    Reads no data column: rows are counted from the Parquet footers, files from their metadata.
    """
    parts = []
    for name, df in tables.items():
        per_file = (df.groupBy(F.col("_metadata.file_path").alias("file"))
                    .agg(F.count(F.lit(1)).alias("rows"),
                         F.max("_metadata.file_size").alias("bytes"),
                         F.max("_metadata.file_modification_time").alias("changed")))
        parts.append(per_file.agg(
            F.lit(name).alias("table_id"),
            F.coalesce(F.sum("rows"), F.lit(0)).alias("row_count"),
            F.coalesce(F.sum("bytes"), F.lit(0)).alias("size_bytes"),
            (F.coalesce(F.sum("bytes"), F.lit(0)) / F.lit(1024 * 1024)).alias("size_mb"),
            F.min("changed").alias("created"),
            F.max("changed").alias("last_modified")))
    return reduce(DataFrame.unionByName, parts).orderBy("table_id")


def table_exists(spark: SparkSession, name: str) -> bool:
    return spark.catalog.tableExists(name)


def count_mart_tables(spark: SparkSession, names: list[str] | None = None) -> DataFrame:
    """Number of tables named like a dimension or a fact ('_' matches any one character)."""
    names = [t.name for t in spark.catalog.listTables()] if names is None else names
    listed = spark.createDataFrame([(n,) for n in names], "table_id string")
    match = F.col("table_id").like("dim_%") | F.col("table_id").like("fact_%")
    return listed.filter(match).agg(F.count(F.lit(1)).alias("table_count"))


def validate_tables(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Which tables are non-empty; reads at most one row of each."""
    parts = [df.select(F.lit(name).alias("table_name")).limit(1)
             .groupBy().agg(F.lit(name).alias("table_name"),
                            (F.count(F.lit(1)) > 0).alias("has_rows"))
             for name, df in tables.items()]
    return reduce(DataFrame.unionByName, parts).orderBy("table_name")
