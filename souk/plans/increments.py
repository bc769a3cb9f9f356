"""Increments from new loads alone: what is new finds the keys it touches, and only those are rebuilt.

The warehouse keeps the present row of every staging key (its state) and the set of loads merged per raw entity. A
run reads the loads not in that set, compares them with the state rows of their keys, and gets the changed staging
rows. These name the marts' rows to rebuild, through the joins: an order for its payments, reviews, items and day; a
customer for all orders placed under it and for the person; a translation for the products of its category. Each
such row is defined anew over the state as it will be, restricted to the touched keys, and takes the place of what
the mart holds for these keys, rows that are no longer defined included. The calendar alone only grows.

Marts are merged first, then the states, then the list of merged loads. A run that stops anywhere is simply run
again: what it has merged is either found unchanged or merged once more with the same result. Histories
read the loads alone, so they are taken up beside all that.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator, Mapping
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from functools import reduce
from typing import TYPE_CHECKING
from uuid import uuid4

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from souk import model
from souk.functions import scalar as S
from souk.model import MARTS, Mart
from souk.operators import incremental
from souk.plans import dimensions, facts
from souk.plans.staging import STAGING
from souk.session import compact
from souk.sources import live, tables
from souk.sources.loads import RawLoads

if TYPE_CHECKING:
    from souk.plans.warehouse import Warehouse

# Staging table -> the key its newest row is kept on.
STATE_KEYS = {
    "stg_orders": ("order_id",),
    "stg_customers": ("customer_id",),
    "stg_order_items": ("order_id", "order_item_id"),
    "stg_payments": ("order_id", "payment_sequential"),
    "stg_products": ("product_id",),
    "stg_order_reviews": ("review_id", "order_id"),
    "stg_sellers": ("seller_id",),
    "stg_category_translation": ("product_category_name",),
}
KEY = "_key"
THREADS = 8

# The tables of most work, first in line wherever jobs run side by side: begun last, they would run alone at the end.
LONGEST = ("fact_sales", "stg_order_items", "stg_orders", "stg_payments", "stg_order_reviews")


def longest_first(names: Iterable[str]) -> list[str]:
    return sorted(names, key=lambda n: LONGEST.index(n) if n in LONGEST else len(LONGEST))


def state_mart(name: str) -> Mart:
    return Mart(f"_state/{name}", KEY, "modified_at", STATE_KEYS[name])


def with_key(df: DataFrame, name: str) -> DataFrame:
    """The staging key as one text that tells NULL from empty."""
    return df.withColumn(KEY, F.to_json(F.struct(*STATE_KEYS[name])))


def matching(df: DataFrame, keys: DataFrame, column: str | Column | None = None) -> DataFrame:
    """Rows whose column (by default the one of the keys' name) is among the keys."""
    name, = keys.columns
    wanted = keys.select(F.col(name).alias("_wanted")).distinct()
    own = F.col(column or name) if not isinstance(column, Column) else column
    return df.join(wanted, own == F.col("_wanted"), "left_semi")


def one_column(name: str, *parts: tuple[DataFrame | None, str]) -> DataFrame | None:
    """Keys from several tables under one name, without NULL; None if no table is there."""
    found = [df.select(F.col(c).alias(name)).filter(F.col(name).isNotNull()) for df, c in parts if df is not None]
    return reduce(DataFrame.union, found).distinct() if found else None


class Ledger:
    """The loads merged so far, per raw entity: a numbered file per run."""

    def __init__(self, warehouse: Warehouse) -> None:
        self.spark, self.folder = warehouse.spark, f"{warehouse.root}/_merged"
        self.number, text = live.latest_text(self.spark, self.folder)
        self.merged: dict[str, list[str]] | None = None if text is None else json.loads(text)

    def missing(self, raw: RawLoads) -> dict[str, list[str]]:
        merged = self.merged or {}
        there = {entity: raw.loads(entity) for entity in raw}
        return {e: new for e, ids in there.items() if (new := [x for x in ids if x not in set(merged.get(e, ()))])}

    def add(self, new: Mapping[str, list[str]]) -> None:
        merged = {e: sorted({*(self.merged or {}).get(e, ()), *new.get(e, ())}) for e in {*(self.merged or {}), *new}}
        live.put_text(self.spark, self.folder, self.number + 1, json.dumps(merged))


class Increment:
    """One run over new loads: changed staging rows, and the marts' rows they touch."""

    def __init__(self, warehouse: Warehouse, new: Mapping[str, list[str]], folder: str) -> None:
        self.w, self.new, self.folder = warehouse, new, folder
        self.changed: dict[str, DataFrame] = {}   # staging rows as they become, with their key
        self.before: dict[str, DataFrame] = {}    # the state rows they replace
        self._touched: dict[str, DataFrame] = {}

    def keep(self, name: str, df: DataFrame) -> DataFrame:
        path = f"{self.folder}/{name}"
        compact(df).parquet(path)
        return self.w.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        """Delete what was kept and no step will read again."""
        tables.delete(self.w.spark, f"{self.folder}/{name}")

    def _side_by_side(self, each: Callable[[str], None], names: Iterable[str]) -> None:
        """Short jobs on different tables share the cluster."""
        with ThreadPoolExecutor(THREADS) as pool:
            list(pool.map(each, longest_first(names)))

    def find_changes(self) -> None:
        self._side_by_side(self._find_changes, [n for n, (_, entity) in STAGING.items() if entity in self.new])

    def _find_changes(self, name: str) -> None:
        build, entity = STAGING[name]
        fresh = self.keep(f"fresh/{name}", with_key(build(self.w.raw.only(entity, self.new[entity])), name))
        ties = [c for c in fresh.columns if c not in {KEY, "modified_at", *STATE_KEYS[name]}]
        held = matching(self.state(name), fresh.select(KEY))
        changed = self.keep(f"changed/{name}", incremental.superseding(fresh, held, KEY, "modified_at", ties))
        self.drop(f"fresh/{name}")
        if not changed.isEmpty():
            self.before[name] = matching(self.state(name), changed.select(KEY))
            self.changed[name] = changed

    def state(self, name: str) -> DataFrame:
        return self.w.state(name)

    def after(self, name: str, keys: DataFrame | None = None, column: str | Column | None = None) -> DataFrame:
        """State rows as they will be, of these keys only (or all, for small tables)."""
        pick = (lambda df: df) if keys is None else (lambda df: matching(df, keys, column))
        rows = pick(self.state(name).drop(tables.PERIOD))
        if name in self.changed:
            changed = self.changed[name]
            rows = rows.join(changed.select(KEY), KEY, "left_anti").select(*changed.columns).unionByName(pick(changed))
        return rows.drop(KEY)

    def touched(self, name: str) -> DataFrame | None:
        """Keys of a mart's rows that may have changed; None if none can."""
        if name not in self._touched:
            keys = self._find_touched(name)
            if keys is not None:
                keys = self.keep(f"touched/{name}", keys)
                keys = None if keys.isEmpty() else keys
            self._touched[name] = keys
        return self._touched[name]

    def _find_touched(self, name: str) -> DataFrame | None:
        new, old = self.changed.get, self.before.get
        if name == "dim_orders":
            return one_column("order_key", (new("stg_orders"), "order_id"))
        if name == "dim_sellers":
            return one_column("seller_key", (new("stg_sellers"), "seller_id"))
        if name == "dim_payments":
            return one_column("payment_key", (new("stg_payments"), "order_id"))
        if name == "dim_customers":
            return one_column("customer_key", (new("stg_customers"), "customer_unique_id"),
                              (old("stg_customers"), "customer_unique_id"))
        if name == "dim_reviews":
            reviewed = None
            if new("stg_orders") is not None:
                reviewed = self.after("stg_order_reviews", new("stg_orders").select("order_id"))
            return one_column("review_key", (new("stg_order_reviews"), "order_id"), (reviewed, "order_id"))
        if name == "dim_products":
            renamed = one_column("_category", (new("stg_category_translation"), "product_category_name"))
            if renamed is not None:
                folded = renamed.select(F.lower(S.clean("_category")).alias("_category"))
                renamed = self.after("stg_products", folded, F.lower(S.clean("product_category_name")))
            return one_column("product_key", (new("stg_products"), "product_id"), (renamed, "product_id"))
        if name == "fact_sales":
            moved = None
            if new("stg_customers") is not None:
                moved = self.after("stg_orders", new("stg_customers").select("customer_id"))
            return one_column("order_key", *((new(t), "order_id") for t in (
                "stg_orders", "stg_order_items", "stg_payments", "stg_order_reviews")), (moved, "order_id"))
        return None

    def rows_of(self, name: str) -> DataFrame:
        """A mart's rows of its touched keys, as its plan defines them over the coming state."""
        keys, w = self.touched(name), self.w
        if name == "dim_orders":
            return dimensions.dim_orders(self.after("stg_orders", keys, "order_id"))
        if name == "dim_sellers":
            return dimensions.dim_sellers(self.after("stg_sellers", keys, "seller_id"), w.regions)
        if name == "dim_payments":
            return dimensions.dim_payments(self.after("stg_payments", keys, "order_id"))
        if name == "dim_customers":
            return dimensions.dim_customers(self.after("stg_customers", keys, "customer_unique_id"), w.regions)
        if name == "dim_reviews":
            return dimensions.dim_reviews(self.after("stg_order_reviews", keys, "order_id"),
                                          self.after("stg_orders", keys, "order_id"))
        if name == "dim_products":
            return dimensions.dim_products(self.after("stg_products", keys, "product_id"),
                                           self.after("stg_category_translation"))
        orders = self.keep("fact/orders", self.after("stg_orders", keys, "order_id"))
        customers = self.after("stg_customers", orders.select("customer_id"))
        payments = dimensions.dim_payments(self.after("stg_payments", keys, "order_id"))
        reviews = dimensions.dim_reviews(self.after("stg_order_reviews", keys, "order_id"), orders)
        order_side = self.keep("fact/order_side", facts.order_facts(orders, customers, payments, reviews))
        return facts.fact_sales(self.after("stg_order_items", keys, "order_id"), order_side)

    def fact_periods(self) -> list[str] | None:
        """Periods that can hold a touched order's items: those of its day so far."""
        mart = MARTS["fact_sales"]
        if not tables.is_partitioned(mart, self.w.grain):
            return None
        orders = matching(self.state("stg_orders"), self.touched("fact_sales"), "order_id")
        days = orders.select(F.col("order_purchase_timestamp").alias(mart.day_column)).filter(F.col(mart.day_column).isNotNull())
        return [r[0] for r in days.select(tables.period_of(mart, self.w.grain)).distinct().collect()]

    def merge_marts(self) -> None:
        self._side_by_side(self._merge_mart, MARTS)

    def _merge_mart(self, name: str) -> None:
        mart = MARTS[name]
        if name == "dim_date":
            if "stg_orders" in self.changed:
                days = dimensions.dim_date(self.changed["stg_orders"])
                self.w.merge_into(name, incremental.differing(days, self.w.opened_mart(name, days.schema), mart.key))
        elif self.touched(name) is not None:
            rows = self.keep(f"rows/{name}", self.rows_of(name))
            if name == "fact_sales":
                self.drop("fact")
            periods = self.fact_periods() if name == "fact_sales" else None
            tables.replace_rows(self.w.spark, self.w.path(name), rows, self.touched(name), mart, self.w.grain, periods)
            self.drop(f"rows/{name}")

    def merge_states(self) -> None:
        self._side_by_side(self._merge_state, list(self.changed))

    def _merge_state(self, name: str) -> None:
        mart, changed = state_mart(name), self.changed[name]
        tables.replace_rows(self.w.spark, self.w.path(mart.name), changed, changed.select(KEY), mart, self.w.grain)


def build(warehouse: Warehouse) -> None:
    """Write all marts, the states they rest on and the list of loads that are in them."""
    ledger = Ledger(warehouse)
    there = {entity: warehouse.raw.loads(entity) for entity in warehouse.raw}  # loads that come meanwhile are left for later
    warehouse.forget()
    with beside(lambda: snapshots(warehouse, there)):
        warehouse.build_from({entity: warehouse.raw.only(entity, ids) for entity, ids in there.items()})
    ledger.add(there)


@contextmanager
def beside(work: Callable[[], None]) -> Iterator[None]:
    """Do this work while the block runs; leave when both have ended, with the error of either."""
    with ThreadPoolExecutor(1) as pool:
        running = pool.submit(work)
        yield
        running.result()


def snapshots(warehouse: Warehouse, loads: Mapping[str, list[str]]) -> None:
    """Histories take up the loads one after the other, as they would have day by day; entities run side by side."""
    def follow(entity: str) -> None:
        for load in loads.get(entity, ()):
            warehouse.snapshot(entity, warehouse.raw.only(entity, [load]))
    with ThreadPoolExecutor(THREADS) as pool:
        list(pool.map(follow, model.SNAPSHOTS))


def refresh(warehouse: Warehouse) -> dict[str, list[str]]:
    """Merge the loads that are new; returns them. Without news nothing is written."""
    ledger = Ledger(warehouse)
    if ledger.merged is None:
        build(warehouse)
        return Ledger(warehouse).merged
    new = ledger.missing(warehouse.raw)
    if new:
        folder = f"{warehouse.root}/_runs/{uuid4().hex}"
        try:
            run = Increment(warehouse, new, folder)
            with beside(lambda: snapshots(warehouse, new)):
                run.find_changes()
                run.merge_marts()
                run.merge_states()
        finally:
            tables.delete(warehouse.spark, folder)
        ledger.add(new)
        warehouse.forget()
    return new
