from __future__ import annotations

from decimal import Decimal

from shop import rows, shop


def by(df, key):
    return {r[key]: r for r in rows(df)}


def test_one_row_per_person_with_region(spark, raw):
    got = by(shop(spark, raw)["dim_customers"], "customer_key")
    assert set(got) == {"u1", "u2", "u3"}
    assert (got["u1"]["customer_id_original"], got["u1"]["customer_city"]) == ("c1", "city c1")
    assert [got[u]["customer_region"] for u in ("u1", "u2", "u3")] == ["Southeast", "Northeast", "Unknown"]
    assert got["u3"]["customer_state_name"] == "XX"


def test_products_translate_or_keep_their_category(spark, raw):
    got = by(shop(spark, raw)["dim_products"], "product_key")
    assert [got[p]["product_category_english"] for p in ("p1", "p2", "p3", "p4")] == [
        "health_beauty", "bed", "sem_traducao", None]


def test_delivery_numbers_and_unknowns(spark, raw):
    got = by(shop(spark, raw)["dim_orders"], "order_key")
    assert (got["o1"]["days_to_delivery"], got["o1"]["delivery_vs_estimate_days"]) == (4, -6)
    assert got["o1"]["is_delivered_on_time"] is True
    assert got["o2"]["is_delivered_on_time"] is False
    assert got["o5"]["is_delivered_on_time"] is True
    assert got["o3"]["is_delivered_on_time"] is None and got["o3"]["days_to_delivery"] is None


def test_payments_per_order(spark, raw):
    got = by(shop(spark, raw)["dim_payments"], "payment_key")
    assert "o3" not in got
    two = got["o2"]
    assert (two["uses_boleto"], two["uses_voucher"], two["uses_credit_card"]) == (True, True, False)
    assert (two["total_payment_value"], two["payment_methods_count"]) == (Decimal("320.000000000"), 2)
    assert got["o5"]["primary_payment_type"] == "NOT_DEFINED"


def test_reviews_per_order(spark, raw):
    got = by(shop(spark, raw)["dim_reviews"], "review_key")
    assert set(got) == {"o1", "o2", "o4", "o5", "o6"}
    assert got["o1"]["days_to_review"] == 5 and got["o2"]["days_to_review"] == 89
    assert got["o1"]["has_comment_title"] is False and got["o1"]["has_comment_message"] is True


def test_newest_review_of_an_order_wins(spark, raw):
    from souk.plans import dimensions, staging
    reviews = staging.stg_order_reviews(raw(
        "order_reviews",
        dict(review_id="a", order_id="o", review_score="1", review_creation_date="2020-01-01"),
        dict(review_id="b", order_id="o", review_score="2", review_creation_date="2020-01-02"),
        dict(review_id="c", order_id="o", review_score="4", review_creation_date="2020-01-02"),
        dict(review_id="d", order_id="o", review_score="5")))
    orders = staging.stg_orders(raw("orders", dict(order_id="x")))
    (r,) = rows(dimensions.dim_reviews(reviews, orders))
    assert r["review_score"] == 4 and r["days_to_review"] is None


def test_calendar_holds_purchase_days_only(spark, raw):
    got = by(shop(spark, raw)["dim_date"], "date_key")
    assert set(got) == {"2017-01-10", "2017-01-31", "2017-02-01", "2018-02-01", "2018-03-05", "2018-03-06"}
    day = got["2017-01-31"]
    assert (day["month_name"], day["quarter"], day["day_of_week"], day["day_name"], day["is_weekend"]) == (
        "January", 1, 3, "Tuesday", False)


def test_fact_rows_and_defaults(spark, raw):
    got = by(shop(spark, raw)["fact_sales"], "order_item_sk")
    assert set(got) == {"o1-1", "o2-1", "o2-2", "o3-1", "o4-1", "o4-2", "o5-1", "o6-1"}
    unpaid = got["o3-1"]
    assert unpaid["payment_key"] is None and unpaid["review_key"] is None
    assert (unpaid["payment_value"], unpaid["total_installments"], unpaid["payment_methods_count"],
            unpaid["primary_payment_type"], unpaid["uses_voucher"]) == (0, 1, 1, "unknown", False)
    assert got["o2-1"]["customer_key"] == "u1" and got["o2-1"]["date_key"] == "2017-01-31"
    assert got["o2-2"]["total_item_value"] == Decimal("215.000000000")
    assert got["o2-2"]["payment_value"] == Decimal("320.000000000")


def test_items_of_unknown_orders_or_customers_are_dropped(spark, raw):
    w = shop(spark, raw)
    w.raw["order_items"] = w.raw["order_items"].union(raw("order_items", dict(
        order_id="ghost", order_item_id="1", product_id="p1", seller_id="s1")))
    w.raw["customers"] = w.raw["customers"].filter("customer_id <> 'c4'")
    keys = {r["order_key"] for r in rows(w["fact_sales"])}
    assert keys == {"o1", "o2", "o3", "o4", "o6"}
