"""F1-F11: what refreshes hold on disk: shuffles, files of a run, versions."""

from __future__ import annotations

import random
import re
import time
from datetime import datetime, timedelta

import pytest
from shop import raw_rows, raw_shop, rows

from souk.model import Mart
from souk.operators import incremental
from souk.operators.dedup import keep_latest
from souk.plans import increments
from souk.plans.warehouse import Warehouse
from souk.session import SHUFFLE_CLEANUP, shuffles_let_go
from souk.sources import live, tables
from souk.sources.loads import RawLoads
from souk.sources.seeds import read_seed

DAY = datetime(2020, 1, 1)
MART = Mart("t", "k", "at", ("k",))
SCHEMA = "k string, a string, b string, at timestamp"


def day(n):
    return DAY + timedelta(days=n)


def shuffle_files(spark):
    found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {name for n in range(found.size()) if (name := found.apply(n).getName()).startswith("shuffle_")}


def files(root):
    return {str(p): p.stat().st_mtime_ns for p in root.rglob("*") if p.is_file()}


def test_shuffles_go_with_the_query_that_made_them(spark, raw, tmp_path):
    before = shuffle_files(spark)
    w = Warehouse(spark, raw_shop(raw), read_seed(spark), str(tmp_path), "month")
    w.refresh("dim_payments")
    for _ in range(50):
        if not (left := shuffle_files(spark) - before):
            break
        time.sleep(0.2)
    assert not left
    assert spark.conf.get(SHUFFLE_CLEANUP, None) is None


def test_blocks_inside_others_end_with_the_outermost(spark):
    spark.conf.set(SHUFFLE_CLEANUP, "false")
    try:
        with shuffles_let_go(spark):
            with pytest.raises(OSError), shuffles_let_go(spark):
                raise OSError
            assert spark.conf.get(SHUFFLE_CLEANUP) == "true"
        assert spark.conf.get(SHUFFLE_CLEANUP) == "false"
    finally:
        spark.conf.unset(SHUFFLE_CLEANUP)


@pytest.mark.parametrize("grain", ["month", None])
def test_a_mart_is_renewed_from_all_its_rows(spark, tmp_path, grain):
    path = tmp_path / "t"
    old = [("same", "x", None, day(0)), ("swapped", None, "x", day(0)), ("moved", "x", "x", day(1)), ("gone", "x", "x", day(1)),
           ("far", "x", "x", day(200))]
    tables.write_mart(spark.createDataFrame(old, SCHEMA), str(path), MART, grain)

    def renew(*fresh):
        tables.renew_mart(spark, str(path), spark.createDataFrame(fresh, SCHEMA), MART, str(tmp_path / "staging"), grain)
        return {r["k"]: (r["a"], r["b"], r["at"]) for r in tables.read_mart(spark, str(path), None, grain is not None).collect()}
    held = files(path)
    assert renew(*old[:3]) == renew(*old) == {k: tuple(rest) for k, *rest in old}
    assert files(path) == held and not (tmp_path / "staging").exists()
    fresh = [old[0], ("swapped", "x", None, day(0)), ("moved", "x", "x", day(40)), ("new", None, None, day(2)), old[4]]
    assert renew(*fresh) == {k: tuple(rest) for k, *rest in (*fresh, old[3])}
    if grain:
        now = live.opened(spark, str(path)).held
        assert now["2020-07"] < now["2020-01"] == now["2020-02"]


def test_rows_without_a_key_take_no_ones_place(spark, tmp_path):
    path = str(tmp_path / "t")
    row = spark.createDataFrame([(None, "x", None, day(0))], SCHEMA)
    tables.write_mart(row, path, MART, "month")
    tables.renew_mart(spark, path, row, MART, str(tmp_path / "s"), "month")
    assert [r["a"] for r in tables.read_mart(spark, path).collect()] == ["x", "x"]


def test_rows_are_compared_by_key_and_digest(spark):
    fresh = spark.createDataFrame([("k", "a", "b", day(0), "p")], SCHEMA + ", period string")
    plan = incremental.compared(fresh, fresh, "k", "period")
    formatted = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    text = plan._jdf.queryExecution().explainString(formatted)
    moved = [set(re.findall(r"(\w+)#\d+", columns)) for columns in re.findall(r"\) Exchange\nInput \[\d+\]: \[(.*)\]", text)]
    assert {"_new", "_now", "_is"} in moved and {"_old", "_was", "_held"} in moved
    assert not any(columns & {"a", "b", "at"} for columns in moved)
    assert plan.collect() == []


def test_superseding_rows_are_those_keep_latest_would_take(spark):
    rng = random.Random(3)

    def table(keys):
        some = lambda: rng.choice([None, "x", "y"])
        return spark.createDataFrame([(k, some(), some(), rng.choice([None, day(0), day(1)])) for k in keys], SCHEMA).cache()
    held, fresh = table([f"k{n}" for n in range(200)]), table([f"k{n}" for n in range(100, 320)])
    newest = keep_latest(held.unionByName(fresh), ["k"], ["at"])
    expected = rows(incremental.differing(newest, held, "k"))
    assert rows(incremental.superseding(fresh, held, "k", "at", ["a", "b"])) == expected and len(expected) > 130


@pytest.fixture
def loaded(spark, tmp_path):
    """A warehouse with one load merged."""
    loads = RawLoads(spark, str(tmp_path / "raw"))
    for entity, df in raw_shop(raw_rows(spark)).items():
        loads.add(entity, df, "first")
    w = Warehouse(spark, loads, read_seed(spark), str(tmp_path / "w"), "month")
    w.refresh_all()
    return loads, w


def test_files_of_a_run_go_when_they_were_used(spark, raw, loaded, monkeypatch):
    loads, w = loaded
    loads.add("payments", raw("payments", dict(order_id="o3", payment_sequential="1", payment_value="2")), "second")
    seen, merge_states = {}, increments.Increment.merge_states
    monkeypatch.setattr(increments.Increment, "merge_states", lambda run: seen.update(
        {kind: live.names_in(spark, f"{run.folder}/{kind}") for kind in live.names_in(spark, run.folder)}) or merge_states(run))
    w.refresh_all()
    assert {kind for kind, names in seen.items() if names} == {"changed", "touched"}


def test_rows_of_new_keys_are_added_to_what_a_period_holds(spark, raw, loaded):
    loads, w = loaded
    path = w.path("_state/stg_payments")
    stamps = {"2017-01": "2017-01-05 00:00:00", "2018-02": "2018-02-05 00:00:00"}
    held = dict(live.opened(spark, path).held)
    assert set(stamps) <= set(held)
    for n, (key, stamp) in enumerate((("n1", stamps["2017-01"]), ("n2", stamps["2017-01"]), ("o4", stamps["2018-02"]))):
        loads.add("payments", raw("payments", dict(order_id=key, payment_sequential="1", payment_type="voucher"), stamp=stamp), f"l{n}")
        w.refresh_all()
    now = live.opened(spark, path).held
    assert live.layers(now["2017-01"])[0] == held["2017-01"] and len(live.layers(now["2017-01"])) == 3
    assert {p for p in now if now[p] != held.get(p)} == {"2017-01", "2018-02"}
    full = Warehouse(spark, dict(loads), read_seed(spark))
    assert rows(w["stg_payments"]) == rows(full["stg_payments"])
    assert rows(w["dim_payments"].drop("period")) == rows(full["dim_payments"])


def test_layers_are_rewritten_together_when_they_are_many(spark, tmp_path):
    path, schema = str(tmp_path / "t"), "k string, n int, at timestamp"
    assert live.LAYERS == 8
    tables.write_mart(spark.createDataFrame([("k0", 0, DAY)], schema), path, MART, "month")
    counts = []
    for n in range(1, live.LAYERS + 3):
        columns = schema if n < 5 else schema + ", more int"  # added in another layout
        row = (f"k{n}", n, DAY) if n < 5 else (f"k{n}", n, DAY, n)
        tables.merge_mart(spark, path, spark.createDataFrame([row], columns), MART, str(tmp_path / "s"), "month")
        counts.append(len(live.layers(live.opened(spark, path).held["2020-01"])))
        assert sorted((r["k"], r["n"]) for r in tables.read_mart(spark, path).collect()) == sorted((f"k{i}", i) for i in range(n + 1))
    assert counts == [2, 3, 4, 5, 1, 2, 3, 4, 5, 6]  # another layout begins anew
    old = [(r["k"], r["more"]) for r in tables.read_mart(spark, path).filter("n in (1, 7)").orderBy("n").collect()]
    assert old == [("k1", None), ("k7", 7)]


def test_a_merge_of_many_bytes_is_done_in_batches(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    stored = [(f"k{n}", "old", None, day(31 * n)) for n in range(6)]
    tables.write_mart(spark.createDataFrame(stored, SCHEMA), path, MART, "month")
    monkeypatch.setattr(tables, "BATCH", 1)
    written, version = [], tables._write_version
    monkeypatch.setattr(tables, "_write_version", lambda df, *rest: written.append(df.count()) or version(df, *rest))
    fresh = [("k0", "new", None, day(0)), ("k1", "new", None, day(62)), ("k9", "new", None, day(155)), ("k8", "new", None, day(400))]
    tables.merge_mart(spark, path, spark.createDataFrame(fresh, SCHEMA), MART, str(tmp_path / "s"), "month")
    got = {r["k"]: (r["a"], r["at"]) for r in tables.read_mart(spark, path).collect()}
    assert got == {k: (a, at) for k, a, _, at in (*stored, *fresh)}
    assert len(written) > 1 and sum(written) < 9 and live.opened(spark, path).number == 2
