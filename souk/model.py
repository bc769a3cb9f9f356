"""Data model: raw entities, types, mart layout and fixed value domains."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

# Money follows NUMERIC semantics (9 fractional digits); 28 leaves headroom for sums.
MONEY = T.DecimalType(28, 9)
MONEY_SUM = T.DecimalType(38, 9)
COUNT = T.DecimalType(20, 0)

LOAD_STAMP = "_sdc_extracted_at"


@dataclass(frozen=True)
class Entity:
    """A raw text table: its columns and the key it is delivered on."""

    name: str
    keys: tuple[str, ...]
    columns: tuple[str, ...]
    free_text: bool = False  # has fields written by customers

    @property
    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(c, T.StringType()) for c in self.columns])


def _entity(name: str, keys: str, columns: str, free_text: bool = False) -> Entity:
    return Entity(name, tuple(keys.split()), tuple(columns.split()), free_text)


# The raw entities, their keys and columns ("lenght" is the source's spelling).
ENTITIES = {
    e.name: e
    for e in (
        _entity("orders", "order_id",
                "order_id customer_id order_status order_purchase_timestamp order_approved_at "
                "order_delivered_carrier_date order_delivered_customer_date "
                "order_estimated_delivery_date"),
        _entity("customers", "customer_id",
                "customer_id customer_unique_id customer_zip_code_prefix customer_city "
                "customer_state"),
        _entity("order_items", "order_id order_item_id",
                "order_id order_item_id product_id seller_id shipping_limit_date price "
                "freight_value"),
        _entity("products", "product_id",
                "product_id product_category_name product_name_lenght "
                "product_description_lenght product_photos_qty product_weight_g "
                "product_length_cm product_height_cm product_width_cm"),
        _entity("payments", "order_id payment_sequential",
                "order_id payment_sequential payment_type payment_installments payment_value"),
        _entity("order_reviews", "review_id",
                "review_id order_id review_score review_comment_title review_comment_message "
                "review_creation_date review_answer_timestamp", free_text=True),
        _entity("sellers", "seller_id",
                "seller_id seller_zip_code_prefix seller_city seller_state"),
        _entity("product_category_name_translation", "product_category_name",
                "product_category_name product_category_name_english"),
        _entity("geolocation", "geolocation_zip_code_prefix",
                "geolocation_zip_code_prefix geolocation_lat geolocation_lng geolocation_city "
                "geolocation_state"),
    )
}

# Raw tables whose history is kept, and the key of each.
SNAPSHOTS = {"customers": "customer_id", "orders": "order_id", "sellers": "seller_id"}

# Raw tables that can be purged of rows without an id, and that id.
PURGED_ON = {
    "customers": "customer_id",
    "order_items": "order_id",
    "orders": "order_id",
    "products": "product_id",
    "sellers": "seller_id",
}

SEED_SCHEMA = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("state_code", "state_name", "region", "economic_zone")]
)

# State code, state name, region, economic zone.
STATE_REGIONS = (
    ("AC", "Acre", "North", "Amazon"),
    ("AL", "Alagoas", "Northeast", "Northeast"),
    ("AM", "Amazonas", "North", "Amazon"),
    ("AP", "Amapá", "North", "Amazon"),
    ("BA", "Bahia", "Northeast", "Northeast"),
    ("CE", "Ceará", "Northeast", "Northeast"),
    ("DF", "Distrito Federal", "Central-West", "Central"),
    ("ES", "Espírito Santo", "Southeast", "Southeast"),
    ("GO", "Goiás", "Central-West", "Central"),
    ("MA", "Maranhão", "Northeast", "Northeast"),
    ("MG", "Minas Gerais", "Southeast", "Southeast"),
    ("MS", "Mato Grosso do Sul", "Central-West", "Central"),
    ("MT", "Mato Grosso", "Central-West", "Central"),
    ("PA", "Pará", "North", "Amazon"),
    ("PB", "Paraíba", "Northeast", "Northeast"),
    ("PE", "Pernambuco", "Northeast", "Northeast"),
    ("PI", "Piauí", "Northeast", "Northeast"),
    ("PR", "Paraná", "South", "South"),
    ("RJ", "Rio de Janeiro", "Southeast", "Southeast"),
    ("RN", "Rio Grande do Norte", "Northeast", "Northeast"),
    ("RO", "Rondônia", "North", "Amazon"),
    ("RR", "Roraima", "North", "Amazon"),
    ("RS", "Rio Grande do Sul", "South", "South"),
    ("SC", "Santa Catarina", "South", "South"),
    ("SE", "Sergipe", "Northeast", "Northeast"),
    ("SP", "São Paulo", "Southeast", "Southeast"),
    ("TO", "Tocantins", "North", "Amazon"),
)

# Domains the quality checks assert.
REGIONS = ("North", "Northeast", "Southeast", "South", "Central-West")
ECONOMIC_ZONES = ("Amazon", "Northeast", "Southeast", "South", "Central")
PAYMENT_TYPES = ("CREDIT_CARD", "BOLETO", "VOUCHER", "DEBIT_CARD", "NOT_DEFINED")
ORDER_STATUSES = ("DELIVERED", "SHIPPED", "CANCELED", "UNAVAILABLE", "INVOICED", "PROCESSING",
                  "APPROVED", "CREATED")
MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September",
          "October", "November", "December")
WEEKDAYS = ("Sunday", "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday")

# Report labels and the bounds of the buckets they name.
ALL_YEARS, ALL_REGIONS = "All Years", "All Regions"
UNKNOWN_REGION, UNKNOWN_PAYMENT = "Unknown", "unknown"
SAME_REGION, CROSS_REGION = "Same Region", "Cross Region"
BEHAVIOUR_SEGMENTS = {
    "One-Time Customer": "One-Time Customer (1 order)",
    "Regular Customer": "Regular Customer (2-5 orders)",
    "Loyal Customer": "Loyal Customer (6+ orders)",
}
REGULAR_ORDERS = (2, 5)
VALUE_SEGMENTS = {
    "Low Value": "Low Value (≤$100 spend)",
    "Medium Value": "Medium Value ($101-$500 spend)",
    "High Value": "High Value ($500+ spend)",
}
LOW_VALUE_MAX, MEDIUM_VALUE = 100, (101, 500)
NO_REVIEW = "No Review"
REVIEW_LABELS = {"positive": "Positive (4-5)", "neutral": "Neutral (3)", "negative": "Negative (1-2)"}
REVIEW_TIMING = ((7, "Quick (≤7 days)"), (30, "Normal (8-30 days)"), (90, "Delayed (31-90 days)"))
REVIEW_TIMING_ABOVE = "Very Late (>90 days)"
DELIVERY_SPEED = ((5, "Very Fast (≤5 days)"), (10, "Fast (6-10 days)"), (20, "Normal (11-20 days)"),
                  (30, "Slow (21-30 days)"))
DELIVERY_SPEED_ABOVE = "Very Slow (>30 days)"
OTHERS = "Others"
REVIEW_AVAILABILITY = ("Has Reviews", "No Reviews")

# Payment flag -> the (upper-cased) payment type it stands for.
PAYMENT_FLAGS = {
    "uses_credit_card": "CREDIT_CARD",
    "uses_boleto": "BOLETO",
    "uses_voucher": "VOUCHER",
    "uses_debit_card": "DEBIT_CARD",
}


@dataclass(frozen=True)
class Mart:
    """Physical layout of a mart: merge key, day column it is partitioned on, cluster keys."""

    name: str
    key: str
    day_column: str | None
    cluster_by: tuple[str, ...]
    stamp: str | None = "modified_at"


MARTS = {
    m.name: m
    for m in (
        Mart("dim_customers", "customer_key", "modified_at", ("customer_key",)),
        Mart("dim_sellers", "seller_key", "modified_at", ("seller_key",)),
        Mart("dim_products", "product_key", "modified_at", ("product_key",)),
        Mart("dim_orders", "order_key", "modified_at", ("order_key",)),
        Mart("dim_payments", "payment_key", "modified_at", ("payment_key",)),
        Mart("dim_reviews", "review_key", "modified_at", ("review_key",)),
        Mart("dim_date", "date_key", None, ("date_key",), None),
        Mart("fact_sales", "order_item_sk", "order_purchase_ts",
             ("order_key", "customer_key", "product_key", "seller_key"), "fact_modified_at"),
    )
}
