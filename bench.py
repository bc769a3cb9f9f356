"""Benchmark: build the star schema from the given tables, then run every report.

Prints one JSON line. Each report runs once to warm up and then RUNS times; its median counts.
The build is timed once, cold, as it happens in a daily run.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from souk.plans import testbed
from souk.plans.reports import REPORTS
from souk.session import build_session

RUNS = 3


def timed(action) -> float:
    started = time.perf_counter()
    action()
    return time.perf_counter() - started


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus,
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m",
        "spark.driver.memory": "12g",
        "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    warehouse = testbed.warehouse(spark, sf_dir)

    seconds = {"build_star_schema": timed(warehouse.build)}
    for name, report in REPORTS.items():
        run = lambda: report(warehouse).collect()  # noqa: E731, B023
        run()
        seconds[name] = statistics.median(timed(run) for _ in range(RUNS))
    print(json.dumps({
        "metric": "star schema build plus reports, total seconds",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": {k: round(v, 3) for k, v in seconds.items()},
        "sf": sf_dir.rsplit("sf", 1)[-1].strip("/"),
        "cpus": int(cpus),
        "spark": spark.version,
    }))
    spark.stop()


if __name__ == "__main__":
    sys.exit(main())
