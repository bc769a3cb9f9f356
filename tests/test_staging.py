from __future__ import annotations

from datetime import datetime
from decimal import Decimal

from shop import rows
from souk.operators.dedup import keep_latest
from souk.plans import staging


def test_bad_numbers_become_null_or_default(raw):
    texts = ["", "abc", "12.0", " 12 ", None, "\t7\n"]
    items = raw("order_items", *(dict(order_id=f"o{i}", order_item_id=t, price=t) for i, t in enumerate(texts)))
    got = {r["order_id"]: (r["order_item_id"], r["price"]) for r in rows(staging.stg_order_items(items))}
    assert [got[f"o{i}"][0] for i in range(6)] == [None, None, None, 12, None, 7]
    assert [got[f"o{i}"][1] for i in range(6)] == [
        None, None, Decimal("12.000000000"), Decimal("12.000000000"), None, Decimal("7.000000000")]
    paid = raw("payments", *(dict(order_id=f"o{i}", payment_sequential=t, payment_installments=t, payment_value=t)
                             for i, t in enumerate(texts)))
    got = {r["order_id"]: r for r in rows(staging.stg_payments(paid))}
    assert [got[f"o{i}"]["payment_sequential"] for i in range(6)] == [1, 1, 1, 12, 1, 7]
    assert [got[f"o{i}"]["payment_installments"] for i in range(6)] == [0, 0, 0, 12, 0, 7]
    assert got["o1"]["payment_value"] == 0


def test_text_is_trimmed_and_folded(raw):
    df = staging.stg_customers(raw("customers", dict(
        customer_id="c", customer_unique_id="u", customer_city="\tSão Paulo\n", customer_state=" sp\t")))
    (r,) = rows(df)
    assert (r["customer_city"], r["customer_state"]) == ("são paulo", "SP")


def test_order_items_without_order_id_are_dropped(raw):
    df = staging.stg_order_items(raw("order_items", dict(order_item_id="1"), dict(order_id="o", order_item_id="1")))
    assert [r["order_id"] for r in rows(df)] == ["o"]


def test_volume_needs_three_positive_numbers(raw):
    sizes = [("2", "3", "4"), ("2", "0", "4"), ("2", "", "4"), ("2", "x", "4"), ("2", None, "4"), ("-1", "3", "4")]
    df = staging.stg_products(raw("products", *(
        dict(product_id=str(i), product_length_cm=a, product_height_cm=b, product_width_cm=c)
        for i, (a, b, c) in enumerate(sizes))))
    assert [r["product_volume_cm3"] for r in rows(df, "product_id")] == [24.0, 0, 0, 0, 0, 0]
    assert rows(df, "product_id")[3]["product_height_cm"] == 0.0


def test_latest_version_wins_and_ties_are_settled(raw):
    df = raw("orders",
             dict(order_id="a", order_status="old", at="2020-01-01 00:00:00"),
             dict(order_id="a", order_status="new", at="2020-01-02 00:00:00"),
             dict(order_id="b", order_status="y", at="2020-01-01 00:00:00"),
             dict(order_id="b", order_status="x", at="2020-01-01 00:00:00"))
    for shuffled in (df, df.orderBy("order_status"), df.repartition(3)):
        got = {r["order_id"]: r["order_status"] for r in rows(staging.stg_orders(shuffled))}
        assert got == {"a": "NEW", "b": "X"}


def test_null_times_rank_last(spark):
    df = spark.createDataFrame([("k", None, 1), ("k", datetime(2020, 1, 1), 2)], "k string, modified_at timestamp, v int")
    assert [r["v"] for r in rows(keep_latest(df, ["k"]))] == [2]


def test_review_score_defaults_to_zero(raw):
    df = staging.stg_order_reviews(raw("order_reviews", dict(review_id="r", order_id="o", review_score=" "),
                                       dict(review_id="s", order_id="o", review_score="4")))
    assert [r["review_score"] for r in rows(df, "review_id")] == [0, 4]
