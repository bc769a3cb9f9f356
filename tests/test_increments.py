"""Increments from new loads: equal to a full build, reading new loads and touched periods only."""

from __future__ import annotations

import random
import shutil
import threading

import pytest
from pyspark.sql import functions as F
from shop import raw_rows, raw_shop, rows

from souk import model
from souk.model import MARTS
from souk.operators import history
from souk.plans import increments
from souk.plans.warehouse import Warehouse
from souk.sources import live, tables
from souk.sources.loads import RawLoads
from souk.sources.seeds import read_seed

LATE = "2018-12-01 00:00:00"


def content(df):
    return rows(df.drop("period"))


def assert_as_a_full_build(spark, w, raw):
    full = Warehouse(spark, {e: raw[e] for e in raw}, read_seed(spark))
    for name in MARTS:
        if name == "dim_date":  # only grows
            assert {r["date_key"] for r in full[name].collect()} <= {r["date_key"] for r in w[name].collect()}
        else:
            assert content(w[name]) == content(full[name]), name


def opened(spark, tmp_path):
    raw = RawLoads(spark, str(tmp_path / "raw"))
    return raw, Warehouse(spark, raw, read_seed(spark), str(tmp_path / "w"), "month")


def files(root):
    return {str(p): p.stat().st_mtime_ns for p in root.rglob("*") if p.is_file()}


def test_loads_are_kept_once(spark, raw, tmp_path):
    loads = RawLoads(spark, str(tmp_path / "raw"))
    first = raw("sellers", dict(seller_id="s1"))
    assert loads.loads("sellers") == [] and loads["sellers"].count() == 0
    assert loads.add("sellers", first, "2020-01-01") and loads.add("sellers", raw("sellers", dict(seller_id="s2")), "b")
    assert not loads.add("sellers", first, "2020-01-01")
    assert loads.loads("sellers") == ["2020-01-01", "b"] and loads["sellers"].count() == 2
    only = loads.only("sellers", ["b"])
    assert [r["seller_id"] for r in only.collect()] == ["s2"]
    assert all("load=b" in f for f in only.inputFiles()) and only.columns == loads["sellers"].columns


@pytest.fixture(scope="module")
def first_load(spark, tmp_path_factory):
    """A warehouse with one load merged: its folder, to be copied."""
    folder = tmp_path_factory.mktemp("first")
    loads, w = opened(spark, folder)
    for entity, df in raw_shop(raw_rows(spark)).items():
        loads.add(entity, df, "first")
    w.refresh_all()
    return folder


@pytest.fixture
def copied(spark, first_load, tmp_path):
    shutil.copytree(first_load, tmp_path, dirs_exist_ok=True)
    return opened(spark, tmp_path)


def test_loads_in_any_order_equal_a_full_build(spark, raw, tmp_path):
    """Each row of the shop comes with one of two loads, whatever its stamp."""
    rng = random.Random(1)
    loads, w = opened(spark, tmp_path)
    parts = {}
    for entity, df in raw_shop(raw).items():
        got = df.collect()
        dealt = [rng.randrange(2) for _ in got]
        parts[entity] = [[r for r, n in zip(got, dealt) if n == k] for k in range(2)], df.schema
    for k in range(2):
        for entity, (dealt, schema) in parts.items():
            if dealt[k]:
                loads.add(entity, spark.createDataFrame(dealt[k], schema), f"load{k}")
        w.refresh_all()
    assert_as_a_full_build(spark, w, loads)


CASES = {
    "a late payment": ("payments", dict(order_id="o1", payment_sequential="2", payment_type="voucher",
                                        payment_installments="1", payment_value="1.00")),
    "an older version changes nothing": ("orders", dict(order_id="o1", customer_id="c1", order_status="created",
                                                        order_purchase_timestamp="2019-01-01 00:00:00", at="1990-01-01 00:00:00")),
    "an order moves to another month and customer": (
        "orders", dict(order_id="o2", customer_id="c3", order_status="shipped", order_purchase_timestamp="2018-06-06 10:00:00")),
    "an order loses its customer": ("orders", dict(order_id="o4", order_status="shipped", order_purchase_timestamp="2018-02-01 09:00:00")),
    "a customer becomes another person": ("customers", dict(customer_id="c1", customer_unique_id="u9", customer_state="RJ")),
    "a product's category is renamed": ("product_category_name_translation", dict(
        product_category_name="cama", product_category_name_english="bedding")),
    "a newer review": ("order_reviews", dict(review_id="r99", order_id="o3", review_score="1",
                                             review_creation_date="2019-01-01 00:00:00")),
    "an item of an order not known yet": ("order_items", dict(order_id="o77", order_item_id="1", product_id="p1",
                                                              seller_id="s1", price="5", freight_value="1")),
}


def test_changes_of_every_kind(spark, raw, tmp_path, copied):
    loads, w = copied
    for n, (entity, row) in enumerate(CASES.values()):
        loads.add(entity, raw(entity, row, stamp=LATE), f"next{n}")
    before = {name: tables.read_mart(spark, w.path(name)) for name in MARTS}
    counted = {name: df.count() for name, df in before.items()}
    w.refresh_all()
    assert_as_a_full_build(spark, w, loads)
    assert {name: df.count() for name, df in before.items()} == counted  # readers of the old version
    files_then = files(tmp_path / "w")
    w.refresh_all()
    assert files(tmp_path / "w") == files_then
    reopened = Warehouse(spark, RawLoads(spark, loads.root), read_seed(spark), w.root, "month")
    assert content(reopened["fact_sales"]) == content(w["fact_sales"])
    history = tables.read_mart(spark, w.path("customers_snapshot"))
    assert history.filter("customer_id = 'c1'").count() == 2 and history.filter("customer_id = 'c2'").count() == 1
    assert content(reopened["stg_orders"]) == content(Warehouse(spark, dict(loads), read_seed(spark))["stg_orders"])


def test_only_new_loads_and_touched_periods_are_read(spark, raw, copied, monkeypatch):
    loads, w = copied
    held = {name: dict(live.opened(spark, w.path(name)).held) for name in MARTS}
    loads.add("payments", raw("payments", CASES["a late payment"][1], stamp=LATE), "second")
    asked, plans = [], {}
    only, version = RawLoads.only, tables._write_version
    formatted = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    monkeypatch.setattr(RawLoads, "only", lambda self, entity, ids: asked.append((entity, list(ids))) or only(self, entity, ids))
    monkeypatch.setattr(tables, "_write_version", lambda df, path, *rest: plans.update(
        {path.rpartition("/")[2]: df._jdf.queryExecution().explainString(formatted)}) or version(df, path, *rest))
    w.refresh_all()
    assert asked == [("payments", ["second"])]
    assert set(plans) == {"dim_payments", "fact_sales", "stg_payments"}
    filters = [x for x in plans["fact_sales"].splitlines() if x.startswith("PartitionFilters: ") and "period" in x]
    assert len(filters) == 1 and "2017-01" in filters[0] and "2018" not in filters[0]
    now = {name: dict(live.opened(spark, w.path(name)).held) for name in MARTS}
    assert {n for n in MARTS if now[n] != held[n]} == {"dim_payments", "fact_sales"}
    assert {p for p in now["fact_sales"] if now["fact_sales"][p] != held["fact_sales"][p]} == {"2017-01"}


def test_a_run_that_stops_is_run_again(spark, raw, copied, monkeypatch):
    """It stops at its fourth table; another load comes before the next run."""
    loads, w = copied
    for n, (entity, row) in enumerate(CASES.values()):
        loads.add(entity, raw(entity, row, stamp=LATE), f"next{n}")
    calls, replace = [], tables.replace_rows

    def failing(*arguments):
        calls.append(1)
        if len(calls) == 4:
            raise OSError("stopped")
        return replace(*arguments)
    with monkeypatch.context() as patched:
        patched.setattr(tables, "replace_rows", failing)
        with pytest.raises(OSError):
            w.refresh_all()
    loads.add("payments", raw("payments", dict(order_id="o3", payment_sequential="1", payment_type="boleto",
                                               payment_installments="1", payment_value="9"), stamp=LATE), "third")
    w.refresh_all()
    assert_as_a_full_build(spark, w, loads)
    assert increments.Ledger(w).missing(loads) == {}


def test_histories_of_several_entities_run_side_by_side():
    """F1-F8: no entity waits for another; the loads of one are taken in order."""
    class Raw:
        def only(self, entity, loads):
            return loads[0]

    class Stored:
        raw, met, taken = Raw(), threading.Barrier(len(model.SNAPSHOTS)), []

        def snapshot(self, entity, load):
            self.met.wait(10)
            self.taken.append((entity, load))

    stored = Stored()
    increments.snapshots(stored, {entity: ["a", "b"] for entity in model.SNAPSHOTS})
    for entity in model.SNAPSHOTS:
        assert [load for e, load in stored.taken if e == entity] == ["a", "b"]


def _refreshed(monkeypatch, merge_marts, take_up):
    """`increments.refresh` around these two steps; the entries it added to the list of merged loads."""
    added = []

    class Ledger:
        def __init__(self, warehouse):
            self.merged = {}

        def missing(self, raw):
            return {"orders": ["a"]}

        def add(self, new):
            added.append(new)

    class Run:
        def __init__(self, *arguments):
            self.find_changes = self.merge_states = lambda: None
            self.merge_marts = merge_marts

    class Stored:
        spark = raw = None
        root = "nowhere"

        def forget(self):
            pass

    monkeypatch.setattr(increments, "Ledger", Ledger)
    monkeypatch.setattr(increments, "Increment", Run)
    monkeypatch.setattr(increments, "snapshots", lambda warehouse, new: take_up())
    monkeypatch.setattr(tables, "delete", lambda *arguments: None)
    try:
        increments.refresh(Stored())
    except OSError:
        pass
    return added


def test_histories_are_taken_up_beside_the_marts(monkeypatch):
    """F2-F7: neither waits for the other; loads count as merged only when both have ended well."""
    met = threading.Barrier(2)
    wait = lambda: met.wait(10)

    def stop():
        raise OSError("stopped")
    assert _refreshed(monkeypatch, wait, wait) == [{"orders": ["a"]}]
    assert _refreshed(monkeypatch, lambda: None, stop) == []
    assert _refreshed(monkeypatch, stop, lambda: None) == []


def test_the_longest_tables_come_first():
    """F2-F7: a table begun last would run alone at the end."""
    order = increments.longest_first(MARTS)
    assert order[0] == "fact_sales" and sorted(order) == sorted(MARTS)


def test_a_load_is_joined_with_the_open_versions_once(spark, tmp_path):
    """F2-F7: the versions that end are found from the new ones, which are written already."""
    first = spark.createDataFrame([("a", "x"), ("b", "x")], "k string, city string").withColumn("at", F.lit("2020-01-01").cast("timestamp"))
    spark.createDataFrame([("a", 2021), ("a", 2022), ("b", 2019), ("c", 2023), (None, 2023)], "k string, y int").selectExpr(
        "k", "'y' as city", "make_timestamp(y, 1, 1, 0, 0, 0) as at").write.parquet(str(tmp_path / "one_load"))
    load = spark.read.parquet(str(tmp_path / "one_load"))
    held = history.chained(first, "k", "at", str(tmp_path / "held"))
    fresh, ended = history.changed_versions(held, load, "k", "at", str(tmp_path / "ranges"))
    assert "one_load" not in ended._jdf.queryExecution().toString()
    assert [(r["k"], str(r[history.TO])) for r in ended.collect()] == [("a", "2021-01-01 00:00:00")]
    assert sorted((str(r["k"]), r["at"].year) for r in fresh.collect()) == [("None", 2023), ("a", 2021), ("a", 2022), ("c", 2023)]
