"""Merge newly arrived raw files into a stored mart.

The daily increment in Structured Streaming terms: the checkpoint remembers which files were
merged, and each micro-batch is upserted on its key where it is not older than the stored row. No mark
stands in the way of a file that comes late, and a batch repeated after a failure gives the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from souk.plans.warehouse import ROW_BY_ROW, Warehouse


def merge_arrivals(warehouse: Warehouse, mart: str, landing: str, schema: T.StructType,
                   checkpoint: str) -> StreamingQuery:
    """Start a run over the raw Parquet files in `landing` that no earlier run has merged.

    It ends when they are all merged. Marts that aggregate raw rows need all rows of a key, not
    only the arriving ones; refresh them with `Warehouse.refresh`.
    """
    if mart not in ROW_BY_ROW:
        raise ValueError(f"{mart} does not follow its raw rows one by one")
    stream = warehouse.spark.readStream.schema(schema).parquet(landing)

    def merge(batch: DataFrame, _: int) -> None:
        warehouse.merge_rows(mart, batch)

    return (stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())
