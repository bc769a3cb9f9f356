"""Upsert, history and incremental refresh: invariants and equality with a full rebuild."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from shop import raw_shop, rows
from souk import model
from souk.model import MARTS, Mart
from souk.operators import history, incremental
from souk.plans.warehouse import Warehouse
from souk.sources import live, tables
from souk.sources.seeds import read_seed

DAY = datetime(2020, 1, 1)
relaxed = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
keyed = st.dictionaries(st.integers(0, 9), st.integers(0, 5), max_size=10)


def frame(spark, content: dict):
    return spark.createDataFrame(list(content.items()), "k int, v int")


@relaxed
@given(old=keyed, new=keyed)
def test_upsert_is_a_dictionary_update(spark, old, new):
    target, source = frame(spark, old), frame(spark, new)
    once = incremental.upsert(target, source, ["k"])
    assert {r["k"]: r["v"] for r in rows(once)} == old | new
    assert rows(incremental.upsert(once, source, ["k"])) == rows(once)


def test_upsert_follows_the_new_layout(spark):
    target = spark.createDataFrame([(1, "x", 5)], "k int, gone string, v int")
    source = spark.createDataFrame([(2, 7, "n")], "k int, v long, fresh string")
    merged = incremental.upsert(target, source, ["k"])
    assert merged.columns == ["k", "v", "fresh"]
    assert rows(merged) == [{"k": 1, "v": 5, "fresh": None}, {"k": 2, "v": 7, "fresh": "n"}]


def test_newer_than_an_empty_target_takes_everything(spark):
    df = spark.createDataFrame([(1, DAY), (2, DAY + timedelta(days=1))], "k int, at timestamp")
    assert incremental.newer_than(df, None, "at").count() == 2
    assert incremental.newer_than(df, df.limit(0), "at").count() == 2
    assert [r["k"] for r in rows(incremental.newer_than(df, df.filter("k = 1"), "at"))] == [2]


def test_every_stamp_of_a_load_is_a_version(spark, tmp_path):
    schema = "k string, v string, at timestamp"
    day = lambda n: DAY + timedelta(days=n)
    first = spark.createDataFrame([("a", "1", day(0)), ("a", "2", day(5)), ("a", "2", day(5)), ("b", "1", day(1)), (None, "x", day(2)),
                                   (None, "y", day(3))], schema)
    second = spark.createDataFrame([("a", "late", day(2)), ("a", "3", day(6)), ("a", "4", day(8)), ("a", "5", day(9)),
                                    ("c", "1", day(7)), ("c", "2", day(8))], schema)
    got = history.apply_load(history.apply_load(None, first, "k", "at"), second, "k", "at")
    spans = [(r["k"], r["v"], (r[history.FROM] - DAY).days, r[history.TO] and (r[history.TO] - DAY).days) for r in got.collect()]
    assert sorted(spans, key=str) == sorted([
        ("a", "1", 0, 5), ("a", "2", 5, 6), ("a", "3", 6, 8), ("a", "4", 8, 9), ("a", "5", 9, None), ("b", "1", 1, None),
        (None, "x", 2, 3), (None, "y", 3, None), ("c", "1", 7, 8), ("c", "2", 8, None)], key=str)
    w = Warehouse(spark, {}, read_seed(spark), str(tmp_path / "w"), "month")
    named = ["customer_id", "customer_city", model.LOAD_STAMP]
    for load in (first, second, second):
        stored = w.snapshot("customers", load.filter("k is not null").toDF(*named))
    assert stored.count() == 8 and stored.filter(f"{history.TO} is null").count() == 3


def test_a_hot_key_lies_in_many_ranges(spark, tmp_path):
    """Nearly all versions belong to one key: each range links its own, and no task has them all."""
    load = spark.range(0, 5000, 1, 4).selectExpr(
        "if(id % 50 = 0, concat('k', id % 7), 'hot') as k", "cast(id as string) as v", "timestamp_seconds(id * 60) as at")
    got = history.chained(load, "k", "at", str(tmp_path / "ranges"), ranges=6)
    parts = spark.read.parquet(str(tmp_path / "ranges")).groupBy("_range").count().collect()
    assert len(parts) == 6 and max(r["count"] for r in parts) < 2000
    load.createOrReplaceTempView("load_of_versions")
    want = spark.sql("select k, v, at, lead(at) over (partition by k order by at) as until from load_of_versions")
    assert got.select("k", "v", "at", history.TO).exceptAll(want).count() == 0 and got.count() == 5000


loads = st.lists(st.dictionaries(st.integers(0, 5), st.integers(0, 3), max_size=6), min_size=1, max_size=4)


@relaxed
@given(loads=loads)
def test_history_invariants(spark, loads):
    """One open version per key ever seen, versions in order and without overlap."""
    versions, newest = None, {}
    for content in loads:
        load = spark.createDataFrame(
            [(k, f"v{s}", DAY + timedelta(days=s)) for k, s in content.items()], "k int, v string, at timestamp")
        versions = history.apply_load(versions, load, "k", "at")
        versions = spark.createDataFrame(versions.collect(), versions.schema)
        for k, s in content.items():
            newest[k] = max(s, newest.get(k, -1))
    per_key = {}
    for r in versions.collect():
        per_key.setdefault(r["k"], []).append((r[history.FROM], r[history.TO]))
    assert set(per_key) == set(newest)
    for k, spans in per_key.items():
        spans.sort()
        assert [to for _, to in spans].count(None) == 1 and spans[-1][1] is None
        assert spans[-1][0] == DAY + timedelta(days=newest[k])
        for (_, to), (start, _) in zip(spans, spans[1:], strict=False):
            assert to == start


def test_unchanged_and_vanished_keys_stay_open(spark):
    schema = "k string, v string, at timestamp"
    first = spark.createDataFrame([("same", "a", DAY), ("gone", "a", DAY), ("moved", "a", DAY)], schema)
    second = spark.createDataFrame([("same", "ignored", DAY), ("moved", "b", DAY + timedelta(days=1)),
                                    ("new", "c", DAY)], schema)
    got = history.apply_load(history.apply_load(None, first, "k", "at"), second, "k", "at")
    state = {(r["k"], r["v"]): r[history.TO] for r in rows(got)}
    assert state == {("same", "a"): None, ("gone", "a"): None, ("new", "c"): None,
                     ("moved", "a"): DAY + timedelta(days=1), ("moved", "b"): None}
    assert got.select(history.VERSION).distinct().count() == 5


@pytest.mark.parametrize("grain", [None, "day", "month"])
def test_merge_on_disk_moves_rows_between_periods(spark, tmp_path, grain):
    mart = Mart("t", "k", "modified_at", ("k",))
    schema = "k string, v int, modified_at timestamp"
    path, staging = str(tmp_path / "t"), str(tmp_path / "staged")
    stored = [("a", 1, DAY), ("b", 1, DAY), ("c", 1, DAY + timedelta(days=40)), ("d", 1, None)]
    tables.write_mart(spark.createDataFrame(stored, schema), path, mart, grain)
    fresh = [("b", 2, DAY + timedelta(days=90)), ("c", 2, DAY + timedelta(days=90)), ("e", 2, DAY)]
    for _ in range(2):
        tables.merge_mart(spark, path, spark.createDataFrame(fresh, schema), mart, staging, grain)
        got = tables.read_mart(spark, path)
        assert {r["k"]: r["v"] for r in got.collect()} == {"a": 1, "b": 2, "c": 2, "d": 1, "e": 2}
        assert got.count() == 5


def test_merge_leaves_other_periods_alone(spark, tmp_path):
    mart = Mart("t", "k", "modified_at", ("k",))
    schema = "k string, v int, modified_at timestamp"
    path = tmp_path / "t"
    tables.write_mart(spark.createDataFrame([("a", 1, DAY), ("b", 1, DAY + timedelta(days=40))], schema),
                      str(path), mart, "month")
    before = {p: p.stat().st_mtime_ns for p in path.rglob("period=*/*.parquet")}
    tables.merge_mart(spark, str(path), spark.createDataFrame([("b", 2, DAY + timedelta(days=41))], schema),
                      mart, str(tmp_path / "staged"), "month")
    after = {p: p.stat().st_mtime_ns for p in path.rglob("period=*/*.parquet")}
    assert before.items() < after.items()
    assert {p.parent.name for p in after.keys() - before.keys()} == {"period=2020-02"}
    held = live.opened(spark, str(path)).held
    assert sorted(held) == ["2020-01", "2020-02"] and held["2020-01"] < held["2020-02"]


def test_merge_syncs_columns_of_untouched_periods(spark, tmp_path):
    mart = Mart("t", "k", "modified_at", ("k",))
    path = str(tmp_path / "t")
    old = spark.createDataFrame([("a", 1, DAY), ("b", 1, DAY + timedelta(days=40))],
                                "k string, gone int, modified_at timestamp")
    tables.write_mart(old, path, mart, "month")
    new = spark.createDataFrame([("b", 2.5, DAY + timedelta(days=41))], "k string, fresh double, modified_at timestamp")
    tables.merge_mart(spark, path, new, mart, str(tmp_path / "staged"), "month")
    got = tables.read_mart(spark, path, new.schema).select("k", "fresh", "period")
    assert rows(got) == [{"k": "a", "fresh": None, "period": "2020-01"}, {"k": "b", "fresh": 2.5, "period": "2020-02"}]


def _content(df):
    return rows(df.drop("period"))


def test_refresh_in_two_loads_equals_a_full_build(spark, raw, tmp_path):
    """The second load brings later orders, a second payment and a newer address."""
    everything = raw_shop(raw)
    first = {name: df.filter(df[model.LOAD_STAMP] < datetime(2018, 1, 1)) for name, df in everything.items()}
    more = dict(everything)
    late = "2018-12-01 00:00:00"
    more["payments"] = everything["payments"].union(raw(
        "payments", dict(order_id="o1", payment_sequential="2", payment_type="voucher",
                         payment_installments="1", payment_value="1.00"), stamp=late))
    more["customers"] = everything["customers"].union(raw(
        "customers", dict(customer_id="c1", customer_unique_id="u1", customer_state="RJ",
                          customer_city="Moved", customer_zip_code_prefix="9"), stamp=late))
    root = str(tmp_path / "w")
    Warehouse(spark, first, read_seed(spark), root, "month").refresh_all()
    Warehouse(spark, more, read_seed(spark), root, "month").refresh_all()
    Warehouse(spark, more, read_seed(spark), root, "month").refresh_all()
    full = Warehouse(spark, more, read_seed(spark))
    for name in MARTS:
        assert _content(tables.read_mart(spark, f"{root}/{name}")) == _content(full[name]), name
    orders = tables.read_mart(spark, f"{root}/orders_snapshot")
    assert orders.count() == 6 and orders.filter(f"{history.TO} is not null").count() == 0
    people = rows(tables.read_mart(spark, f"{root}/customers_snapshot"), "customer_id", history.FROM)
    assert [(r["customer_id"], r["customer_state"], r[history.TO] is None) for r in people[:2]] == [
        ("c1", "SP", False), ("c1", "RJ", True)]
    paid = {r["payment_key"]: r for r in rows(tables.read_mart(spark, f"{root}/dim_payments"))}
    assert paid["o1"]["payment_transactions_count"] == 2 and paid["o1"]["uses_credit_card"]


def _files(root):
    return {str(p): p.stat().st_mtime_ns for p in root.rglob("*") if p.is_file()}


def test_no_news_and_reopening_change_no_file(spark, raw, tmp_path):
    from souk.plans import reports
    everything, root = raw_shop(raw), tmp_path / "w"
    Warehouse(spark, everything, read_seed(spark), str(root), "month").refresh_all()
    before = _files(root)
    Warehouse(spark, everything, read_seed(spark), str(root), "month").refresh_all()
    reopened = Warehouse(spark, {}, read_seed(spark), str(root), "month")
    assert reports.monthly_sales_trends(reopened).count() > 0
    assert _files(root) == before
    with pytest.raises(LookupError):
        Warehouse(spark, everything, read_seed(spark), str(tmp_path / "none"))["dim_orders"]


def test_late_payments_and_reviews_reach_the_fact(spark, raw, tmp_path):
    everything, root = raw_shop(raw), str(tmp_path / "w")
    first = {n: df.limit(0) if n in ("payments", "order_reviews") else df for n, df in everything.items()}
    first["orders"] = everything["orders"].filter("order_id <> 'o2'")
    for load in (first, everything):
        Warehouse(spark, load, read_seed(spark), root, "month").refresh_all()
    full = Warehouse(spark, everything, read_seed(spark))
    for name in MARTS:
        assert _content(tables.read_mart(spark, f"{root}/{name}")) == _content(full[name]), name


@pytest.mark.parametrize("stop", ["put_text", "rename_new"])
@pytest.mark.parametrize("grain", [None, "month"])
def test_a_merge_that_stops_changes_nothing(spark, tmp_path, monkeypatch, stop, grain):
    mart = Mart("t", "k", "modified_at", ("k",))
    schema, path = "k string, v int, modified_at timestamp", str(tmp_path / "t")
    stored = [("a", 1, DAY), ("b", 1, DAY), ("c", 1, DAY + timedelta(days=40))]
    tables.write_mart(spark.createDataFrame(stored, schema), path, mart, grain)
    fresh = spark.createDataFrame([("c", 2, DAY), ("d", 2, DAY + timedelta(days=70))], schema)
    content = lambda: sorted((r["k"], r["v"]) for r in tables.read_mart(spark, path).collect())

    def fail(*_):
        raise OSError("stopped")
    with monkeypatch.context() as patched:
        patched.setattr(live, stop, fail)
        with pytest.raises(OSError):
            tables.merge_mart(spark, path, fresh, mart, str(tmp_path / "s1"), grain)
    assert content() == [("a", 1), ("b", 1), ("c", 1)]
    tables.merge_mart(spark, path, fresh, mart, str(tmp_path / "s1"), grain)
    tables.merge_mart(spark, path, spark.createDataFrame([("e", 3, DAY)], schema), mart, str(tmp_path / "s2"), grain)
    assert content() == [("a", 1), ("b", 1), ("c", 2), ("d", 2), ("e", 3)]


@pytest.mark.parametrize("grain", [None, "month"])
def test_readers_see_a_merge_whole_or_not_at_all(spark, tmp_path, grain):
    mart = Mart("t", "k", "modified_at", ("k",))
    schema, path = "k string, v int, modified_at timestamp", str(tmp_path / "t")
    tables.write_mart(spark.createDataFrame([("a", 0, DAY), ("b", 0, DAY)], schema), path, mart, grain)
    opened = [tables.read_mart(spark, path)]
    for n in range(1, 4):
        tables.merge_mart(spark, path, spark.createDataFrame([("a", n, DAY + timedelta(days=40 * n))], schema), mart,
                          str(tmp_path / "s"), grain)
        opened.append(tables.read_mart(spark, path))
    tables.write_mart(spark.createDataFrame([("z", 9, DAY)], schema), path, mart, grain)  # also a full write
    for n, frame in enumerate(opened):
        assert sorted((r["k"], r["v"]) for r in frame.collect()) == [("a", n), ("b", 0)]
    assert [r["k"] for r in tables.read_mart(spark, path).collect()] == ["z"]


def test_old_versions_expire_and_two_writers_do_not_mix(spark, tmp_path):
    mart = Mart("t", "k", "modified_at", ("k",))
    schema, path = "k string, v int, modified_at timestamp", str(tmp_path / "t")
    tables.write_mart(spark.createDataFrame([("a", 0, DAY), ("b", 0, DAY + timedelta(days=40))], schema), path, mart, "month")
    overtaken = live.opened(spark, path)
    for n in range(1, 5):
        tables.merge_mart(spark, path, spark.createDataFrame([("a", n, DAY)], schema), mart, str(tmp_path / "s"), "month")
    with pytest.raises(live.OvertakenError):
        live.publish(spark, path, overtaken.replaced([], "x", [], spark.createDataFrame([], schema).schema))
    live.expire(spark, path, keep=2)
    periods = sorted(str(p.relative_to(tmp_path / "t")).split("/")[1] for p in (tmp_path / "t").glob("_version=*/period=*"))
    assert periods == ["period=2020-01", "period=2020-01", "period=2020-02"]
    assert {r["k"]: r["v"] for r in tables.read_mart(spark, path).collect()} == {"a": 4, "b": 0}


def test_a_changed_column_type_is_synced(spark, tmp_path):
    """Text to number and back; a value that is no number becomes NULL; touched periods are written anew."""
    mart = Mart("t", "k", "modified_at", ("k",))
    path, staging = str(tmp_path / "t"), str(tmp_path / "s")
    later = DAY + timedelta(days=40)
    as_text = spark.createDataFrame([("a", "1", DAY), ("b", "x", DAY), ("c", "7", later)], "k string, v string, modified_at timestamp")
    tables.write_mart(as_text, path, mart, "month")
    numbers = spark.createDataFrame([("c", 8, later)], "k string, v bigint, modified_at timestamp")
    tables.merge_mart(spark, path, numbers, mart, staging, "month")
    assert {r["k"]: r["v"] for r in tables.read_mart(spark, path).collect()} == {"a": 1, "b": None, "c": 8}
    assert {len(x[1]) for x in live.opened(spark, path).by_layout()} == {1}
    back = spark.createDataFrame([("d", "text", later)], "k string, v string, modified_at timestamp")
    tables.merge_mart(spark, path, back, mart, staging, "month")
    assert {r["k"]: r["v"] for r in tables.read_mart(spark, path).collect()} == {"a": "1", "b": "x", "c": "8", "d": "text"}
    assert len(live.opened(spark, path).by_layout()) == 1  # both periods are text again


def test_purge_reports_what_it_drops(spark):
    df = spark.createDataFrame([("a",), (None,), ("b",)], "id string")
    assert rows(incremental.purge_null_ids(df, "id")) == [{"id": "a"}, {"id": "b"}]
    assert rows(incremental.purge_report(df, "id")) == [{"kept": 2, "dropped": 1}]
    sellers = df.withColumnRenamed("id", "seller_id")
    purged = incremental.purge_raw({"sellers": sellers, "payments": sellers})
    assert (purged["sellers"].count(), purged["payments"].count()) == (2, 3)


def test_stream_merges_each_file_once(spark, raw, tmp_path):
    from souk.streaming.arrivals import merge_arrivals
    landing, seen = str(tmp_path / "landing"), str(tmp_path / "seen")
    w = Warehouse(spark, {}, read_seed(spark), str(tmp_path / "w"), "month")
    arrivals = [
        raw("sellers", dict(seller_id="s1", seller_state="SP", at="2020-01-01 00:00:00"),
            dict(seller_id="s2", seller_state="RJ", at="2020-01-01 00:00:00")),
        raw("sellers", dict(seller_id="s1", seller_state="BA", at="2020-03-01 00:00:00"),
            dict(seller_id="s3", seller_state="SP", at="2020-03-01 00:00:00")),
    ]
    for batch in arrivals:
        batch.write.mode("append").parquet(landing)
        for _ in range(2):
            merge_arrivals(w, "dim_sellers", landing, batch.schema, seen).awaitTermination()
    got = {r["seller_key"]: r["seller_region"] for r in rows(w["dim_sellers"])}
    assert got == {"s1": "Northeast", "s2": "Southeast", "s3": "Southeast"}
    with pytest.raises(ValueError):
        merge_arrivals(w, "dim_payments", landing, arrivals[0].schema, seen)


def test_stream_takes_late_and_equal_stamped_rows(spark, raw, tmp_path):
    from souk.streaming.arrivals import merge_arrivals
    landing, seen = str(tmp_path / "landing"), str(tmp_path / "seen")
    w = Warehouse(spark, {}, read_seed(spark), str(tmp_path / "w"), "month")
    march, february = "2020-03-01 00:00:00", "2020-02-01 00:00:00"
    for batch in (raw("sellers", dict(seller_id="s1", seller_state="SP", at=march)),
                  raw("sellers", dict(seller_id="s2", seller_state="RJ", at=february),
                      dict(seller_id="s3", seller_state="BA", at=march),
                      dict(seller_id="s1", seller_state="RS", at=february))):
        batch.write.mode("append").parquet(landing)
        merge_arrivals(w, "dim_sellers", landing, batch.schema, seen).awaitTermination()
    assert {r["seller_key"]: r["seller_state"] for r in rows(w["dim_sellers"])} == {"s1": "SP", "s2": "RJ", "s3": "BA"}
