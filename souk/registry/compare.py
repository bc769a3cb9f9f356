"""Run registered queries against their checking SQL and report the differences."""

from __future__ import annotations

import math
import sys
import time

from pyspark.sql import SparkSession

from souk.registry import operators  # noqa: F401  (registers its queries)
from souk.registry import queries as Q

GIVEN = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def _cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, int):
        return float(v)
    return round(v, 6) if isinstance(v, float) else v


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return (sorted(names),
            sorted((tuple(_cell(r[i]) for i in order) for r in rows), key=repr))


def check_engine(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in GIVEN:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def difference(spark: SparkSession, con, sf_dir: str, key: str) -> str | None:
    """None if both sides agree, else a short description."""
    df = Q.QUERIES[key](spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    if key not in Q.SQL:
        return None
    result = con.execute(Q.SQL[key])
    names = [c[0] for c in result.description]
    want = rows_of(names, result.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} != {want[0]}"
    if len(got[1]) != len(want[1]):
        return f"rows {len(got[1])} != {len(want[1])}"
    for g, w in zip(got[1], want[1], strict=True):
        if g != w:
            return f"{got[0]}\n  spark {g}\n  check {w}"
    return None


def main(sf_dir: str, *prefixes: str) -> int:
    from souk.session import build_session

    spark = build_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8",
                                                "spark.driver.memory": "8g",
                                                "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = check_engine(sf_dir)
    bad = 0
    for key in Q.QUERIES:
        if prefixes and not key.startswith(prefixes):
            continue
        started = time.time()
        try:
            diff = difference(spark, con, sf_dir, key)
        except Exception as e:  # shown, and counted as a failure
            diff = f"{type(e).__name__}: {str(e)[:1500]}"
        bad += diff is not None
        mark = "ok  " if diff is None else "FAIL"
        print(f"{mark} {time.time() - started:6.2f}s {key} {'' if key in Q.SQL else '(rows only)'}"
              + (f"\n  {diff}" if diff else ""), flush=True)
    print(f"{bad} failing")
    return bad


if __name__ == "__main__":
    sys.exit(min(main(*sys.argv[1:]), 1))
