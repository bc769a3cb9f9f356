"""Results of quality checks kept over runs, recounting only what changed since the last one.

Checks that look at one row at a time are counted per period of a stored table, and these counts add up. A run takes
over the counts of periods whose live folder is still the one counted before, and counts the others. Checks of keys need
all rows of a key together: they are repeated when one of their tables changed, else their results are taken over.
A run is listed last, in a numbered file; one that stops before that is not there.
"""

from __future__ import annotations

import json
from collections.abc import Mapping
from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from souk.model import MARTS
from souk.operators import quality
from souk.operators.quality import Check
from souk.plans.warehouse import Warehouse
from souk.sources import live, tables

COUNTS = "table_name string, column_name string, test string, place int, period string, failures bigint, total bigint"
RESULTS = "table_name string, column_name string, test string, place int, failures bigint, total bigint, passed boolean"


def _last(spark: SparkSession, path: str) -> tuple[int, dict]:
    number, text = live.latest_text(spark, f"{path}/_runs")
    return number, json.loads(text) if text else {"held": {}}


def _held(warehouse: Warehouse, names: set[str]) -> dict[str, dict[str, str]]:
    """Of each stored mart the version that holds each period."""
    return {n: {p or "": v for p, v in live.opened(warehouse.spark, warehouse.path(n)).held.items()}
            for n in names if n in MARTS and warehouse.is_stored(n)}


def _row_counts(df: DataFrame, own: list[tuple[int, Check]], by_period: bool) -> DataFrame:
    """Failures and rows per check and period, in one pass."""
    period = F.col(tables.PERIOD) if by_period else F.lit("")
    counted = df.groupBy(period.alias("period")).agg(
        F.count(F.lit(1)).alias("total"), *(quality.failing_rows(c).alias(f"f{i}") for i, c in own))
    rows = [F.struct(F.lit(c.table).alias("table_name"), F.lit(c.column).alias("column_name"), F.lit(c.test).alias("test"),
                     F.lit(i).alias("place"), "period", F.col(f"f{i}").alias("failures"), "total") for i, c in own]
    return counted.select(F.inline(F.array(*rows)))


def record(warehouse: Warehouse, checks: list[Check], path: str, run: str, at: datetime) -> DataFrame:
    """Check the stored marts, keep the results under this run's id and time, and return them."""
    spark = warehouse.spark
    number, last = _last(spark, path)
    warehouse.forget()  # its tables as they are now
    held = _held(warehouse, {c.table for c in checks} | {c.parent for c in checks if c.parent})
    listed = [[c.table, c.column, c.test, repr(c)] for c in checks]
    before = last["held"] if last.get("checks") == listed else {}  # other checks: all is counted anew
    counts = _periods(warehouse, checks, held, before, f"{path}/counts/run={last.get('run')}")
    counts.write.mode("overwrite").parquet(f"{path}/counts/run={run}")
    counts = spark.read.schema(COUNTS).parquet(f"{path}/counts/run={run}")
    results = _results(warehouse, checks, counts, held, before, f"{path}/results/run={last.get('run')}")
    results = results.withColumns({"run_id": F.lit(run), "run_at": F.lit(at).cast("timestamp_ntz").cast("timestamp")})
    results.coalesce(1).write.mode("overwrite").parquet(f"{path}/results/run={run}")
    live.put_text(spark, f"{path}/_runs", number + 1, json.dumps({"run": run, "held": held, "checks": listed}))
    return history(spark, path).filter(F.col("run_id") == run)


def _periods(warehouse: Warehouse, checks: list[Check], held: Mapping, before: Mapping, last_counts: str) -> DataFrame:
    spark, parts, kept = warehouse.spark, [], []
    for name in dict.fromkeys(c.table for c in checks):
        own = [(i, c) for i, c in enumerate(checks) if c.table == name and c.test in quality.ROW_TESTS]
        if not own:
            continue
        if name not in held:
            parts.append(_row_counts(warehouse[name], own, False))
            continue
        now, then = held[name], before.get(name, {})
        changed = sorted(p for p in now if then.get(p) != now[p])
        kept += [(name, p) for p in now if then.get(p) == now[p]]
        if changed:
            partitioned = tables.is_partitioned(MARTS[name], warehouse.grain)
            df = tables.read_mart(spark, warehouse.path(name), None, partitioned)
            parts.append(_row_counts(df.filter(F.col(tables.PERIOD).isin(changed)) if partitioned else df, own, partitioned))
    if kept:  # as many as there are tables and periods
        same = spark.createDataFrame(kept, "table_name string, period string")
        parts.append(spark.read.schema(COUNTS).parquet(last_counts).join(F.broadcast(same), ["table_name", "period"], "left_semi"))
    wanted = [x.split()[0] for x in COUNTS.split(", ")]
    return reduce(DataFrame.unionByName, [p.select(*wanted) for p in parts]) if parts else spark.createDataFrame([], COUNTS)


def _results(warehouse: Warehouse, checks: list[Check], counts: DataFrame, held: Mapping, before: Mapping,
             last_results: str) -> DataFrame:
    spark, none = warehouse.spark, F.lit(0).cast("bigint")
    by_row = [(i, c) for i, c in enumerate(checks) if c.test in quality.ROW_TESTS]
    meta = spark.createDataFrame([(i, c.table, c.column, c.test, c.at_least) for i, c in by_row],
                                 "place int, table_name string, column_name string, test string, at_least double")
    summed = counts.groupBy("place").agg(F.sum("failures").alias("failures"), F.sum("total").alias("total"))
    met = meta.join(F.broadcast(summed), "place", "left").withColumns(  # a row per check
        {"failures": F.coalesce("failures", none), "total": F.coalesce("total", none)})
    passed = F.when(F.col("at_least").isNull(), F.col("failures") == 0).otherwise(
        F.col("total") - F.col("failures") >= F.col("at_least") * F.col("total"))
    parts = [met.withColumn("passed", passed)]
    by_key = [(i, c) for i, c in enumerate(checks) if c.test in quality.KEY_TESTS]
    settled = [(i, c) for i, c in by_key
               if all(n in held and before.get(n) == held[n] for n in {c.table, c.parent or c.table})]
    again = [(i, c) for i, c in by_key if (i, c) not in settled]
    if again:
        parts.append(quality.key_checks(warehouse, [c for _, c in again], [i for i, _ in again]))
    if settled:
        parts.append(spark.read.schema(RESULTS).parquet(last_results).filter(F.col("place").isin([i for i, _ in settled])))
    wanted = [x.split()[0] for x in RESULTS.split(", ")]
    return reduce(DataFrame.unionByName, [p.select(*wanted) for p in parts])


def history(spark: SparkSession, path: str) -> DataFrame:
    """Results of all listed runs: run_id, run_at, and the columns of a report."""
    runs = [json.loads(live.read_text(spark, f"{path}/_runs/{n}"))["run"] for n in live.names_in(spark, f"{path}/_runs")
            if n.endswith(".json")]
    schema = f"{RESULTS}, run_id string, run_at timestamp"
    if not runs:
        return spark.createDataFrame([], schema).drop("place")
    return spark.read.schema(schema).parquet(*(f"{path}/results/run={r}" for r in runs)).drop("place")
