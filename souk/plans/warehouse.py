"""The warehouse: raw tables -> staging -> star schema, stored table by table."""

from __future__ import annotations

from collections import ChainMap
from collections.abc import Iterator, Mapping
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from souk import model
from souk.model import MARTS, Mart
from souk.operators import history, incremental
from souk.plans import dimensions, facts, increments
from souk.plans.staging import STAGING
from souk.session import shuffles_let_go
from souk.sources import tables
from souk.sources.loads import RawLoads

# Marts in the order their inputs allow; the tables of a step do not depend on each other.
STEPS = (
    ("stg_orders", "stg_customers", "dim_payments", "dim_sellers", "dim_products"),
    ("dim_reviews", "dim_customers", "dim_orders", "dim_date"),
    ("order_facts",),
    ("fact_sales",),
)

# Intermediate tables that are stored: staging with several consumers, and the order side of the
# fact. Other staging tables are computed where they are used.
STORED = ("stg_orders", "stg_customers", "order_facts")

# Mart -> staging table it follows row by row, so that arriving rows alone can be merged.
ROW_BY_ROW = {"dim_orders": "stg_orders", "dim_products": "stg_products",
              "dim_sellers": "stg_sellers", "fact_sales": "stg_order_items"}


class Warehouse(Mapping[str, DataFrame]):
    """Tables by name. With a root folder marts are read from there; looking one up writes nothing.

    `build`, `refresh` and `store` write. A mart that was never written raises LookupError, unless
    `fill` asks for it to be written on first use.
    """

    def __init__(self, spark: SparkSession, raw: Mapping[str, DataFrame], regions: DataFrame,
                 root: str | None = None, grain: str | None = "day", fill: bool = False) -> None:
        self.spark, self.raw, self.regions = spark, raw, regions
        self.root, self.grain, self.fill = root, grain, fill
        self._frames: dict[str, DataFrame] = {}
        self._given: dict[str, DataFrame] = {}

    def __iter__(self) -> Iterator[str]:
        yield from STAGING
        yield from MARTS
        yield "state_regions"

    def __len__(self) -> int:
        return len(STAGING) + len(MARTS) + 1

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._frames:
            self._frames[name] = self._stored(name)
        return self._frames[name]

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def _stored(self, name: str) -> DataFrame:
        if self.root is not None and isinstance(self.raw, RawLoads) and name in STAGING:
            return self.state(name).drop(tables.PERIOD, increments.KEY)
        kept = name in MARTS or (name in STORED and not isinstance(self.raw, RawLoads))
        if self.root is None or not kept:
            return self.define(name)
        if self.is_stored(name):
            return self._opened(name)
        if not self.fill:
            raise LookupError(f"{name} is not in {self.root}; build the warehouse first")
        return self.store(name)

    def _opened(self, name: str) -> DataFrame:
        """A stored table as its plan describes it: files older than a column give NULL for it."""
        plans = Warehouse(self.spark, self.raw, self.regions)
        try:
            schema = plans.define(name).schema
        except KeyError:  # opened without its raw tables: as the files have it
            schema = None
        if name in MARTS:
            return self._read(MARTS[name], schema)
        reader = self.spark.read if schema is None else self.spark.read.schema(schema)
        return reader.parquet(self.path(name))

    def is_stored(self, name: str) -> bool:
        return self.root is not None and tables.is_complete(self.spark, self.path(name))

    def store(self, name: str) -> DataFrame:
        """Write a table and read it back from there, whatever its kind."""
        with shuffles_let_go(self.spark):
            if name in MARTS:
                return self._use(name, self._read(MARTS[name], self._write_whole(name, self)))
            return self._use(name, tables.staged(self.define(name), self.path(name)))

    def _write_whole(self, name: str, inputs: Mapping[str, DataFrame], staging: str | None = None) -> T.StructType:
        """Full write of a mart over these inputs; its columns. The fact's rows are completed as they are written.

        With a staging folder the shuffles that define the fact are gone before those that arrange it begin.
        """
        frame, finish = self.define(name, inputs), None
        rows = frame
        if name == "fact_sales":
            rows, finish = facts.fact_lines(inputs["stg_order_items"], inputs["order_facts"]), facts.completed
            rows = rows if staging is None else tables.staged(rows, staging)
        tables.write_mart(rows, self.path(name), MARTS[name], self.grain, finish)
        return frame.schema

    def _read(self, mart: Mart, schema: T.StructType | None) -> DataFrame:
        return tables.read_mart(self.spark, self.path(mart.name), schema,
                                tables.is_partitioned(mart, self.grain))

    def define(self, name: str, inputs: Mapping[str, DataFrame] | None = None) -> DataFrame:
        """The plan of a table over other tables of this warehouse (or over given inputs)."""
        t = inputs if inputs is not None else self
        if name in STAGING:
            build, entity = STAGING[name]
            return build(self.raw[entity])
        if name == "state_regions":
            return self.regions
        if name == "dim_customers":
            return dimensions.dim_customers(t["stg_customers"], self.regions)
        if name == "dim_sellers":
            return dimensions.dim_sellers(t["stg_sellers"], self.regions)
        if name == "dim_products":
            return dimensions.dim_products(t["stg_products"], t["stg_category_translation"])
        if name == "dim_reviews":
            return dimensions.dim_reviews(t["stg_order_reviews"], t["stg_orders"])
        if name == "order_facts":
            return facts.order_facts(t["stg_orders"], t["stg_customers"], t["dim_payments"],
                                     t["dim_reviews"])
        if name == "fact_sales":
            return facts.fact_sales(t["stg_order_items"], t["order_facts"])
        source = {"dim_orders": "stg_orders", "dim_payments": "stg_payments", "dim_date": "stg_orders"}
        return getattr(dimensions, name)(t[source[name]])

    def build(self, threads: int = 4) -> dict[str, DataFrame]:
        """Write every mart. Jobs of one step run side by side, so short stages share the cluster."""
        with ThreadPoolExecutor(threads) as pool:
            for step in STEPS:
                list(pool.map(self.store, step))
        return self.marts()

    def build_from(self, raw: Mapping[str, DataFrame]) -> None:
        """Write every mart and the state of every staging table from these raw rows."""
        plans = Warehouse(self.spark, raw, self.regions, self.root, self.grain)

        def keep_state(name: str) -> None:
            mart = increments.state_mart(name)
            tables.write_mart(increments.with_key(plans.define(name), name), self.path(mart.name), mart, self.grain)
            plans.adopt(name, self.state(name).drop(tables.PERIOD, increments.KEY))
        with ThreadPoolExecutor(increments.THREADS) as pool:
            list(pool.map(keep_state, increments.longest_first(STAGING)))
            for step in STEPS:
                list(pool.map(plans.store, [name for name in step if name not in STAGING]))
        tables.delete(self.spark, self.path("order_facts"))  # increments make the part they need

    def state(self, name: str) -> DataFrame:
        """The present row of every key of a staging table, as the last increment left it."""
        mart = increments.state_mart(name)
        return tables.read_mart(self.spark, self.path(mart.name), None, tables.is_partitioned(mart, self.grain))

    def forget(self) -> None:
        """Look stored tables up anew."""
        self._frames = dict(self._given)

    def opened_mart(self, name: str, schema: T.StructType) -> DataFrame:
        return self._read(MARTS[name], schema)

    def merge_into(self, name: str, rows: DataFrame) -> None:
        self._merge(MARTS[name], rows)

    def marts(self) -> dict[str, DataFrame]:
        return {name: self[name] for name in MARTS}

    @contextmanager
    def _inputs(self) -> Iterator[Run]:
        """Tables to define marts over as the raw tables now are.

        Marts are the stored ones, brought up before those that need them. Intermediate tables are
        written to a folder of this run alone, which is deleted at its end.
        """
        run = Run(self, f"{self.root}/_runs/{uuid4().hex}")
        try:
            yield run
        finally:
            tables.delete(self.spark, run.folder)

    def refresh(self, name: str) -> DataFrame:
        """Bring a stored mart to what its raw tables now give; the first run is a full build.

        What is written is found by comparing rows, not stamps: a row that came late, carries the
        stamp of an earlier one, or changed because of another table (an order's payment, review,
        customer or date) is merged like any other, and without news no file changes. So that a
        fact's order keeps one customer, day, payment and review, all its items change together.
        Over raw loads nothing is compared: the loads not merged so far bring all marts up together.
        """
        if isinstance(self.raw, RawLoads):
            self.refresh_all()
            return self[name]
        with shuffles_let_go(self.spark), self._inputs() as inputs:
            return self._refresh(name, inputs)

    def _refresh(self, name: str, inputs: Run) -> DataFrame:
        mart, staging = MARTS[name], f"{inputs.folder}/staging/{name}"
        if not self.is_stored(name):
            columns = self._write_whole(name, inputs, staging)
            tables.delete(self.spark, staging)
            return self._use(name, self._read(mart, columns))
        fresh = self.define(name, inputs)
        tables.renew_mart(self.spark, self.path(name), fresh, mart, staging, self.grain)
        return self._use(name, self._read(mart, fresh.schema))

    def _merge(self, mart: Mart, rows: DataFrame) -> None:
        tables.merge_mart(self.spark, self.path(mart.name), rows, mart,
                          f"{self.root}/_staging/{mart.name}-{uuid4().hex}", self.grain)

    def merge_rows(self, name: str, raw: DataFrame) -> DataFrame:
        """Merge arriving raw rows into a stored mart that follows them one by one.

        A row enters if its key is new or it is not older than the stored row of its key, whatever
        else has been merged before.
        """
        table, mart, path = ROW_BY_ROW[name], MARTS[name], self.path(name)
        rows = self.define(name, ChainMap({table: STAGING[table][0](raw)}, self._given, self))
        if not self.is_stored(name):
            tables.write_mart(rows, path, mart, self.grain)
        else:
            self._merge(mart, incremental.not_older(rows, self._read(mart, rows.schema), mart.key, mart.stamp))
        return self._use(name, self._read(mart, rows.schema))

    def adopt(self, name: str, frame: DataFrame) -> DataFrame:
        """Use this frame for a table from now on, also in refreshes."""
        self._given[name] = frame
        return self._use(name, frame)

    def _use(self, name: str, frame: DataFrame) -> DataFrame:
        self._frames[name] = frame
        return frame

    def snapshot(self, entity: str, load: DataFrame | None = None) -> DataFrame:
        """Bring the stored SCD-2 history of a raw table up to date with its rows, or with those of one load.

        The history is partitioned by the period a version was closed in, open versions apart.
        A run merges new and just closed versions on the version id: it rewrites the open
        versions and the periods that gain closed ones, and repeating it changes nothing. Every stamp of
        a key is a version of its own; rows older than the open version of their key are not taken up.
        """
        name = f"{entity}_snapshot"
        path, key, load = self.path(name), model.SNAPSHOTS[entity], self.raw[entity] if load is None else load
        mart = Mart(name, history.VERSION, history.TO, (key,), None)
        grain = self.grain or "year"
        folder = f"{self.root}/_runs/{name}-{uuid4().hex}"
        with shuffles_let_go(self.spark):
            self._take_up(load, path, mart, grain, folder)
        return self._use(name, tables.read_mart(self.spark, path).drop(tables.PERIOD))

    def _take_up(self, load: DataFrame, path: str, mart: Mart, grain: str, folder: str) -> None:
        key, = mart.cluster_by
        try:
            if not tables.is_complete(self.spark, path):
                tables.write_mart(history.chained(load, key, model.LOAD_STAMP, f"{folder}/ranges"), path, mart, grain)
            else:
                stored = tables.read_mart(self.spark, path).drop(tables.PERIOD)
                fresh, ended = history.changed_versions(stored, load, key, model.LOAD_STAMP, f"{folder}/ranges")
                rows = fresh.unionByName(incremental.sync_columns(ended, fresh))
                tables.merge_mart(self.spark, path, rows, mart, f"{folder}/merge", grain)
        finally:
            tables.delete(self.spark, folder)

    def refresh_all(self) -> None:
        """A daily run: histories of the raw tables, then every mart. Raw loads merged before are not read."""
        with shuffles_let_go(self.spark):
            if isinstance(self.raw, RawLoads):
                increments.refresh(self)
                return
            for entity in model.SNAPSHOTS:
                self.snapshot(entity)
            with self._inputs() as inputs:
                for name in MARTS:
                    self._refresh(name, inputs)


class Run(dict):
    """Inputs of one refresh, by name, made when they are first asked for."""

    def __init__(self, warehouse: Warehouse, folder: str) -> None:
        super().__init__()
        self.warehouse, self.folder = warehouse, folder

    def __missing__(self, name: str) -> DataFrame:
        w = self.warehouse
        if name in w._given:
            return w._given[name]
        if name in MARTS:  # refreshed earlier in this run, or as stored
            return w[name]
        frame = w.define(name, self)
        if name in STORED:
            frame = tables.staged(frame, f"{self.folder}/{name}")
        self[name] = frame
        return frame


def from_raw_tables(spark: SparkSession, places: Mapping[str, str], root: str,
                    seed_path: str | None = None, grain: str | None = "day") -> Warehouse:
    """A warehouse over bound raw tables, the way a daily run opens it."""
    from souk.sources.seeds import read_seed

    raw = {e: tables.bind(spark, places, e) for e in model.ENTITIES if e in places}
    return Warehouse(spark, raw, read_seed(spark, seed_path), root, grain)
