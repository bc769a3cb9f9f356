"""Helpers of the text operators: written intermediate tables, Arrow columns, choice of rows."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import time
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from souk.session import work_folder

# Operators' own columns start with two underscores; columns of their inputs must not.


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder in the shared folder of the cluster."""
    return f"{work_folder(spark)}/llm/{name}-{uuid.uuid4().hex[:12]}"


def settle(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Write a table to the shared folder and read it back; its lineage ends there.

    Executors lost later cost nothing but the tasks then running. The shuffle files behind the
    written table are of no more use: the driver's collector is asked to let go of them.
    """
    spark = df.sparkSession
    path = new_folder(spark, name)
    (df.write.partitionBy(partition_by) if partition_by else df.write).parquet(path)
    for _ in range(2):  # the first run lets go of the finished plan, the second of its shuffles
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)
    out = spark.read.schema(df.schema).parquet(path)
    out._settled_at = path
    return out


def release(df: DataFrame) -> None:
    """Delete the files of a settled table that nothing will read again."""
    jvm = df.sparkSession.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(df._settled_at)
    path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_shipped: set[str] = set()


def map_arrow(df: DataFrame, run: Callable, schema: T.StructType | str) -> DataFrame:
    """mapInArrow by a function of this package, which Python workers are first given."""
    context = df.sparkSession.sparkContext
    if context.applicationId not in _shipped:
        package = Path(__file__).resolve().parents[1]
        folder = tempfile.mkdtemp(prefix="souk-")  # on the driver, which serves it to all executors
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        archive = f"{folder}/souk.zip"
        with zipfile.ZipFile(archive, "w") as out:
            for file in sorted(package.rglob("*.py")):
                out.write(file, file.relative_to(package.parent))
        context.addPyFile(archive)
        _shipped.add(context.applicationId)
    return df.mapInArrow(run, schema)


def spread(df: DataFrame) -> int:
    """Shuffle partitions of the session, for exchanges whose number of tasks must not shrink."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def map_batches(df: DataFrame, each: Callable[[pa.RecordBatch], pa.RecordBatch | None],
                schema: T.StructType | str) -> DataFrame:
    """mapInArrow by a function of one batch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = each(batch)
                if out is not None:
                    yield out
    return map_arrow(df, run, schema)


def utf8(column: pa.Array) -> list[bytes]:
    """Texts as bytes; null is empty."""
    return [x or b"" for x in column.cast(pa.binary() if pa.types.is_string(column.type)
                                          else pa.large_binary()).to_pylist()]


def strings(column: pa.Array) -> list[str]:
    """Texts; null is empty."""
    return [x or "" for x in column.to_pylist()]


def slices(batch: pa.RecordBatch, column: str, size: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Runs of rows with some `size` bytes of text together: a batch's texts are not all Python objects at once."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends, begin = np.cumsum(sizes, dtype=np.int64), 0
    while begin < len(ends):
        before = ends[begin - 1] if begin else 0
        end = int(np.searchsorted(ends, before + size)) + 1
        yield batch.slice(begin, end - begin)
        begin = end


def in_parts(texts: list, each: Callable[[list], np.ndarray], size: int = 8 << 20) -> np.ndarray:
    """Apply to runs of texts of some `size` characters together, so that memory stays bounded."""
    out, part, held = [], [], 0
    for text in texts:
        part.append(text)
        held += len(text)
        if held >= size:
            out.append(each(part))
            part, held = [], 0
    if part:
        out.append(each(part))
    return np.concatenate(out)


def signed(values: np.ndarray) -> np.ndarray:
    """Unsigned 64-bit numbers as Spark's long."""
    return np.ascontiguousarray(values, np.uint64).view(np.int64)


def add_columns(batch: pa.RecordBatch, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [*batch.columns, *(c if isinstance(c, pa.Array) else pa.array(c) for c in columns.values())],
        names=[*batch.schema.names, *columns])


def extended(df: DataFrame, **types: str) -> T.StructType:
    """The schema with further columns."""
    out = T.StructType(list(df.schema.fields))
    for name, kind in types.items():
        out = out.add(name, T._parse_datatype_string(kind))
    return out


def same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def one_of_each(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key, the least by the other columns; folded before its shuffle."""
    rest = [c for c in df.columns if c not in keys]
    least = F.min(F.struct(F.to_json(F.struct(*(F.col(f"`{c}`") for c in order))),
                           *(F.col(f"`{c}`") for c in rest))).alias("__row")
    folded = df.groupBy(*(F.col(f"`{c}`") for c in keys)).agg(least)
    return folded.select(*(F.col(f"`{c}`") if c in keys else F.col(f"__row.`{c}`").alias(c)
                           for c in df.columns))


def keep_listed(docs: DataFrame, listed: DataFrame, key: str, text: str) -> DataFrame:
    """The rows of `docs` that `listed` names by key and hash of the text, once each.

    `listed`: __id (null allowed), __th long, __n rows of `docs` that carry both.
    """
    columns = docs.columns
    tagged = docs.withColumn("__th", text_hash(F.col(f"`{text}`")))
    found = (tagged.join(listed, same(F.col(f"`{key}`"), F.col("__id"))
                         & (tagged["__th"] == listed["__th"]), "inner")
             .drop(listed["__th"]))
    if listed.where("__n > 1").isEmpty():
        return found.select(*(F.col(f"`{c}`") for c in columns))
    found = settle(found, "kept")
    single = found.where("__n = 1").select(*(F.col(f"`{c}`") for c in columns))
    several = found.where("__n > 1").drop("__id", "__n")
    several = one_of_each(several, [key, "__th"], [c for c in columns if c not in (key, text)])
    return single.unionByName(several.select(*(F.col(f"`{c}`") for c in columns)))


def text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))
