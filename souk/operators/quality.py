"""Declarative data-quality checks.

Checks that look at one row at a time run together in a single pass over their table; all checks of
uniqueness and references share one shuffle. Every result has the same columns.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Check:
    """One declared test on a column. `values`, `low`/`high`, `at_least`, `parent` are its arguments."""

    table: str
    column: str
    test: str
    values: tuple = ()
    low: float | None = None
    high: float | None = None
    at_least: float | None = None
    parent: str | None = None
    parent_column: str | None = None


ROW_TESTS = ("not_null", "accepted_values", "accepted_range", "not_null_proportion")


def _failing(check: Check) -> Column:
    c = F.col(check.column)
    if check.test in ("not_null", "not_null_proportion"):
        return c.isNull()
    if check.test == "accepted_values":
        return ~c.isin(*check.values)
    bounds = []
    if check.low is not None:
        bounds.append(c < F.lit(check.low))
    if check.high is not None:
        bounds.append(c > F.lit(check.high))
    return reduce(lambda a, b: a | b, bounds)


def _result(check: Check, failures: Column, total: Column) -> Column:
    passed = failures == 0
    if check.at_least is not None:
        passed = (total - failures) >= F.lit(check.at_least) * total
    return F.struct(
        F.lit(check.table).alias("table_name"),
        F.lit(check.column).alias("column_name"),
        F.lit(check.test).alias("test"),
        failures.cast("bigint").alias("failures"),
        total.cast("bigint").alias("total"),
        passed.alias("passed"),
    )


def failing_rows(check: Check) -> Column:
    return F.count(F.when(_failing(check), 1))


def row_checks(df: DataFrame, checks: Iterable[Check]) -> DataFrame:
    checks = list(checks)
    counted = df.agg(
        F.count(F.lit(1)).alias("total"),
        *(failing_rows(c).alias(f"f{i}") for i, c in enumerate(checks)))
    results = [_result(c, F.col(f"f{i}"), F.col("total")) for i, c in enumerate(checks)]
    return counted.select(F.inline(F.array(*results)))


KEY_TESTS = ("unique", "relationship")


def key_rows(tables: Mapping[str, DataFrame], checks: list[Check]) -> DataFrame:
    """(check, key, child, parent): rows that carry a key, folded; `check` is the place in the list.

    Each table is read once, whatever the number of its checks. Map tasks fold the rows of a key before the one
    shuffle, so a key with very many rows is one row per task.
    """
    roles: dict[str, list[tuple[int, str, int, int]]] = {}
    for i, c in enumerate(checks):
        roles.setdefault(c.table, []).append((i, c.column, 1, 0))
        if c.test == "relationship":
            roles.setdefault(c.parent, []).append((i, c.parent_column, 0, 1))
    parts = []
    for table, own in roles.items():
        rows = [F.struct(F.lit(i).alias("check"), F.col(column).cast("string").alias("key"),
                         F.lit(child).alias("child"), F.lit(parent).alias("parent")) for i, column, child, parent in own]
        parts.append(tables[table].select(F.inline(F.array(*rows))))
    return reduce(DataFrame.unionByName, parts).groupBy("check", "key").agg(
        F.sum("child").alias("child"), F.sum("parent").alias("parent"))


def key_checks(tables: Mapping[str, DataFrame], checks: Iterable[Check], places: list[int] | None = None) -> DataFrame:
    """Uniqueness and references of all tables together: a shuffle by check and key, then one of a row per check.

    Failures of uniqueness are the non-null values that occur more than once, those of a reference the child rows
    whose key the parent lacks. The total counts all rows, those without a key included. With `places` a
    column of them comes along.
    """
    checks = list(checks)
    named = F.col("key").isNotNull()
    references = [i for i, c in enumerate(checks) if c.test == "relationship"]
    failing = (F.when(F.col("check").isin(references), F.when(named & (F.col("parent") == 0), F.col("child")))
               .when(named & (F.col("child") > 1), 1))
    counted = key_rows(tables, checks).groupBy("check").agg(F.sum(failing).alias("failures"), F.sum("child").alias("total"))
    meta = counted.sparkSession.createDataFrame(
        [(i, c.table, c.column, c.test, (places or range(len(checks)))[i]) for i, c in enumerate(checks)],
        "check int, table_name string, column_name string, test string, place int")
    none = F.lit(0).cast("bigint")
    met = meta.join(F.broadcast(counted), "check", "left")  # a row per check
    failures = F.coalesce("failures", none)
    return met.select("table_name", "column_name", "test", *(["place"] if places else []), failures.alias("failures"),
                      F.coalesce("total", none).alias("total"), (failures == 0).alias("passed"))


def run_checks(tables: Mapping[str, DataFrame], checks: Iterable[Check]) -> DataFrame:
    """All results as one frame: (table_name, column_name, test, failures, total, passed)."""
    checks = list(checks)
    parts = []
    for table in dict.fromkeys(c.table for c in checks):
        by_row = [c for c in checks if c.table == table and c.test in ROW_TESTS]
        if by_row:
            parts.append(row_checks(tables[table], by_row))
    by_key = [c for c in checks if c.test in KEY_TESTS]
    if by_key:
        parts.append(key_checks(tables, by_key))
    return reduce(DataFrame.unionByName, parts)
