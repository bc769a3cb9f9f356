"""Raw tables kept load by load: each load of an entity is a folder that never changes."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from souk import model
from souk.session import compact, shuffles_let_go
from souk.sources import live

LOAD = "load"


def raw_schema(entity: str) -> T.StructType:
    return T.StructType([*model.ENTITIES[entity].schema, T.StructField(model.LOAD_STAMP, T.TimestampType())])


class RawLoads(Mapping[str, DataFrame]):
    """Raw entities under a root folder, by name; reading one reads all its loads.

    A load carries an id of its own, which says nothing about the stamps of its rows: what has been merged is a
    set of ids, so rows that come late or carry the stamp of an earlier load are still new.
    """

    def __init__(self, spark: SparkSession, root: str, schemas: Mapping[str, T.StructType] | None = None) -> None:
        self.spark, self.root = spark, root
        self.schemas = dict(schemas or {name: raw_schema(name) for name in model.ENTITIES})

    def __iter__(self) -> Iterator[str]:
        return iter(self.schemas)

    def __len__(self) -> int:
        return len(self.schemas)

    def __getitem__(self, entity: str) -> DataFrame:
        return self.only(entity, self.loads(entity))

    def add(self, entity: str, rows: DataFrame, load: str) -> bool:
        """Keep a load; False if one of this id is there already, as when a job is repeated."""
        if load in self.loads(entity):
            return False
        aside = f"{self.root}/_arriving/{uuid4().hex}"
        columns = [f.name for f in self.schemas[entity]]
        with shuffles_let_go(self.spark):
            compact(rows.select(*columns)).parquet(aside)
        where, fs = live.place(self.spark, f"{self.root}/{entity}")
        fs.mkdirs(where)
        live.rename_new(self.spark, aside, f"{self.root}/{entity}/{LOAD}={load}")
        return True

    def loads(self, entity: str) -> list[str]:
        """Ids of the loads at hand, from the names of their folders."""
        names = live.names_in(self.spark, f"{self.root}/{entity}")
        return [n.partition("=")[2] for n in names if n.startswith(f"{LOAD}=")]

    def only(self, entity: str, loads: Sequence[str]) -> DataFrame:
        """Rows of some loads; the folders of others are not listed."""
        schema = self.schemas[entity]
        if not loads:
            return self.spark.createDataFrame([], schema)
        base = f"{self.root}/{entity}"
        with_load = T.StructType([*schema, T.StructField(LOAD, T.StringType())])
        return (self.spark.read.option("basePath", base).schema(with_load)
                .parquet(*(f"{base}/{LOAD}={x}" for x in loads)).drop(LOAD))
