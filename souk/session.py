"""Session settings and the shared work folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import threading
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, DataFrameWriter, SparkSession

# Settings the jobs are written for. Sizes suit a cluster; adaptive execution shrinks small runs.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    # Call sites per column expression cost more driver time than planning a report.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


MEGABYTE = 1024 * 1024


def settings_for(input_bytes: int, cores: int) -> dict[str, str]:
    """Scan and shuffle sizes for a run over this much stored data.

    Splits grow from 128 MB to 1 GB so that a very large scan stays near 200,000 tasks. Shuffles
    start with one partition per 256 MB, between the core count and 50,000 (beyond that the
    shuffle index of every map task becomes the cost); adaptive execution merges what is small
    and splits what is skewed. With 50,000 partitions a shuffle of 15 TB has 300 MB per task.
    """
    split = min(max(128 * MEGABYTE, input_bytes // 200_000), 1024 * MEGABYTE)
    partitions = min(max(cores, input_bytes // (256 * MEGABYTE)), 50_000)
    return {
        "spark.sql.files.maxPartitionBytes": str(split),
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": f"{256 if partitions == 50_000 else 128}m",
    }


def build_session(app: str = "souk", master: str | None = None, **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, "spark.ui.enabled": "false", **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_letting_go: dict[str, tuple[int, str | None]] = {}  # application -> blocks that are open, the setting before the first
_lock = threading.Lock()


@contextmanager
def shuffles_let_go(spark: SparkSession) -> Iterator[None]:
    """Within the block the shuffle files of a query are deleted as soon as it has ended.

    They would stay until the driver's collector happens to find the query's plan: a run of many writes would
    hold the shuffles of all of them at once. Blocks may lie inside others and in several threads.
    """
    app = spark.sparkContext.applicationId
    with _lock:
        blocks, before = _letting_go.get(app, (0, None))
        if not blocks:
            before = spark.conf.get(SHUFFLE_CLEANUP, None)
            spark.conf.set(SHUFFLE_CLEANUP, "true")
        _letting_go[app] = blocks + 1, before
    try:
        yield
    finally:
        with _lock:
            blocks, before = _letting_go.pop(app)
            if blocks > 1:
                _letting_go[app] = blocks - 1, before
            elif before is None:
                spark.conf.unset(SHUFFLE_CLEANUP)
            else:
                spark.conf.set(SHUFFLE_CLEANUP, before)


def compact(df: DataFrame) -> DataFrameWriter:
    """A writer whose Parquet files take about a third less room than by default."""
    return df.write.option("compression", "zstd")


_local_folders: dict[str, str] = {}


def work_folder(spark: SparkSession) -> str:
    """Folder for written intermediate tables of this application.

    It lies in the shared folder the cluster names in spark.checkpoint.dir. Only a local session
    without that setting gets a temporary folder, removed when the process ends.
    """
    context = spark.sparkContext
    shared = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return f"{shared.rstrip('/')}/souk/{context.applicationId}"
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    if context.applicationId not in _local_folders:
        folder = tempfile.mkdtemp(prefix="souk-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        _local_folders[context.applicationId] = folder
    return _local_folders[context.applicationId]
