"""A small hand-made marketplace with every special case the reports distinguish."""

from __future__ import annotations

from souk import model
from souk.plans.warehouse import Warehouse
from souk.sources.seeds import read_seed

# order, customer, purchase, delivered, estimate, [(product, seller, price, freight)], payments, review
ORDERS = [
    ("o1", "c1", "2017-01-10 10:00:00", "2017-01-14 08:00:00", "2017-01-20", [("p1", "s1", "90.00", "10.50")],
     [("1", "credit_card", "3", "100.50")], ("5", "2017-01-15")),
    ("o2", "c2", "2017-01-31 23:30:00", "2017-02-20 08:00:00", "2017-02-10",
     [("p1", "s1", "100.00", "5.00"), ("p2", "s2", "200.00", "15.00")],
     [("1", "boleto", "1", "300.00"), ("2", "voucher", "1", "20.00")], ("2", "2017-04-30")),
    ("o3", "c3", "2017-02-01 00:10:00", None, "2017-02-20", [("p3", "s3", "600.00", "0.00")], [], None),
    ("o4", "c3", "2018-02-01 09:00:00", "2018-03-15 09:00:00", "2018-02-20",
     [("p2", "s1", "40.00", "2.00"), ("p2", "s1", "40.00", "2.00")],
     [("1", "debit_card", "1", "84.00")], ("3", "2018-02-20")),
    ("o5", "c4", "2018-03-05 12:00:00", "2018-03-10 12:00:00", "2018-03-10", [("p4", "s2", "10.00", "1.00")],
     [("2", "voucher", "1", "6.00"), ("1", "not_defined", "0", "5.00")], ("", "2018-03-11")),
    ("o6", "c1", "2018-03-06 12:00:00", "2018-03-30 12:00:00", "2018-04-10", [("p9", "s1", "20.00", "1.00")],
     [("1", "credit_card", "10", "21.00")], ("4", "2018-06-30")),
]
# customer id, person, state (XX is no Brazilian state); c1 and c2 are one person
CUSTOMERS = [("c1", "u1", "SP"), ("c2", "u1", "sp "), ("c3", "u2", "BA"), ("c4", "u3", "XX")]
SELLERS = [("s1", "SP"), ("s2", "RS"), ("s3", "am")]
PRODUCTS = [("p1", "beleza_saude", "10", "20", "30"), ("p2", "Cama", "10", "", "30"),
            ("p3", "sem_traducao", "1.5", "2", "4"), ("p4", None, "0", "5", "5")]
TRANSLATIONS = [(" Beleza_Saude ", "health_beauty"), ("cama", "bed")]


def raw_shop(raw):
    orders, items, payments, reviews = [], [], [], []
    for key, customer, bought, got, due, lines, paid, review in ORDERS:
        orders.append(dict(order_id=key, customer_id=customer, order_status=" delivered " if got else "created",
                           order_purchase_timestamp=bought, order_delivered_customer_date=got,
                           order_estimated_delivery_date=due, at=bought))
        items += [dict(order_id=f" {key}", order_item_id=str(n), product_id=p, seller_id=s, price=price,
                       freight_value=freight, shipping_limit_date=due, at=bought)
                  for n, (p, s, price, freight) in enumerate(lines, 1)]
        payments += [dict(order_id=key, payment_sequential=n, payment_type=kind, payment_installments=i,
                          payment_value=v, at=bought) for n, kind, i, v in paid]
        if review:
            reviews.append(dict(review_id=f"r{key}", order_id=key, review_score=review[0],
                                review_comment_title="", review_comment_message=f"about {key}",
                                review_creation_date=review[1], at=bought))
    at = "2017-01-01 00:00:00"
    return {
        "orders": raw("orders", *orders),
        "order_items": raw("order_items", *items),
        "payments": raw("payments", *payments),
        "order_reviews": raw("order_reviews", *reviews),
        "customers": raw("customers", *(dict(customer_id=c, customer_unique_id=u, customer_state=s,
                                             customer_city=f" City {c}", customer_zip_code_prefix="01",
                                             at=at) for c, u, s in CUSTOMERS)),
        "sellers": raw("sellers", *(dict(seller_id=s, seller_state=st, seller_city="X",
                                         seller_zip_code_prefix="02", at=at) for s, st in SELLERS)),
        "products": raw("products", *(dict(product_id=p, product_category_name=c, product_length_cm=a,
                                           product_height_cm=b, product_width_cm=w, at=at)
                                      for p, c, a, b, w in PRODUCTS)),
        "product_category_name_translation": raw(
            "product_category_name_translation",
            *(dict(product_category_name=a, product_category_name_english=b, at=at) for a, b in TRANSLATIONS)),
    }


def shop(spark, raw, root=None, grain=None):
    tables = raw_shop(raw)
    assert set(tables) | {"geolocation"} == set(model.ENTITIES)
    return Warehouse(spark, tables, read_seed(spark), root, grain, fill=True)


def raw_rows(spark):
    """Builder of raw text rows of an entity: missing fields are NULL, the stamp is a text time."""
    def build(entity: str, *rows: dict, stamp: str = "2020-01-01 00:00:00"):
        columns = model.ENTITIES[entity].columns
        schema = ", ".join(f"{c} string" for c in (*columns, model.LOAD_STAMP))
        data = [tuple(r.get(c) for c in columns) + (r.get("at", stamp),) for r in rows]
        df = spark.createDataFrame(data, schema)
        return df.withColumn(model.LOAD_STAMP, df[model.LOAD_STAMP].cast("timestamp"))
    return build


def rows(df, *order):
    """Rows as dicts, sorted."""
    data = [r.asDict() for r in df.collect()]
    return sorted(data, key=lambda r: tuple(repr(r[c]) for c in (order or df.columns)))
