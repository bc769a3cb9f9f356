"""Adapter: the given order/line-item tables presented as the marketplace's raw text tables.

The SELECT statements are plain SQL that Spark and the checking engine both accept, so each
side derives the same raw rows and everything after them is computed independently.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from souk.plans.warehouse import Warehouse
from souk.session import work_folder

SOURCES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

# Regions of the given tables; one nation is left out of the seed and becomes 'Unknown'.
TEST_REGIONS = ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")
TEST_YEAR, TEST_REGION = 1997, "ASIA"

RAW_SQL = {
    "orders": """
        select cast(o_orderkey as string) as order_id,
               cast(o_custkey as string) as customer_id,
               case o_orderstatus when 'F' then ' delivered ' when 'O' then 'shipped'
                    else 'processing' end as order_status,
               cast(o_orderdate as string) as order_purchase_timestamp,
               cast(o_orderdate as string) as order_approved_at,
               case when o_orderstatus = 'F' then cast(cast(cast(o_orderdate as date)
                    + cast(1 + o_orderkey % 5 as int) as timestamp) as string)
                    end as order_delivered_carrier_date,
               case when o_orderstatus = 'F' then cast(cast(cast(o_orderdate as date)
                    + cast(1 + o_orderkey % 40 as int) as timestamp) as string)
                    end as order_delivered_customer_date,
               cast(cast(cast(o_orderdate as date) + 20 as timestamp) as string)
                    as order_estimated_delivery_date,
               cast(o_orderdate as timestamp) as _sdc_extracted_at
        from {orders}""",
    "customers": """
        select cast(c_custkey as string) as customer_id,
               cast(c_custkey - c_custkey % 2 as string) as customer_unique_id,
               cast(10000 + c_custkey % 500 as string) as customer_zip_code_prefix,
               ' ' || c_mktsegment as customer_city,
               lower(n_name) || ' ' as customer_state,
               cast(date '2001-01-01' + cast(c_custkey % 30 as int) as timestamp)
                   as _sdc_extracted_at
        from {customer} join {nation} on c_nationkey = n_nationkey""",
    "sellers": """
        select cast(s_suppkey as string) as seller_id,
               cast(20000 + s_suppkey % 500 as string) as seller_zip_code_prefix,
               s_name as seller_city,
               n_name as seller_state,
               cast(date '2001-01-01' + cast(s_suppkey % 30 as int) as timestamp)
                   as _sdc_extracted_at
        from {supplier} join {nation} on s_nationkey = n_nationkey""",
    "products": """
        select cast(p_partkey as string) as product_id,
               case when p_partkey % 97 <> 0 then p_type end as product_category_name,
               cast(length(p_name) as string) as product_name_lenght,
               case when p_size % 10 <> 0 then cast(p_size * 20 as string) else '' end
                   as product_description_lenght,
               cast(p_size % 5 as string) as product_photos_qty,
               cast(p_size as string) as product_weight_g,
               cast(p_size as string) as product_length_cm,
               cast(p_size % 7 as string) as product_height_cm,
               cast(p_size % 11 as string) as product_width_cm,
               cast(date '2001-01-01' + cast(p_partkey % 30 as int) as timestamp)
                   as _sdc_extracted_at
        from {part}""",
    "product_category_name_translation": """
        select distinct ' ' || lower(p_type) as product_category_name,
               lower(p_type) || '_goods' as product_category_name_english,
               cast(date '2001-01-01' as timestamp) as _sdc_extracted_at
        from {part} where p_type <> 'PROMO'""",
    "order_items": """
        select cast(l_orderkey as string) as order_id,
               cast(l_linenumber as string) as order_item_id,
               cast(l_partkey as string) as product_id,
               cast(l_suppkey as string) as seller_id,
               cast(l_shipdate as string) as shipping_limit_date,
               cast(cast(l_extendedprice as decimal(18,2)) as string) as price,
               cast(cast(round(cast(l_extendedprice as decimal(18,2))
                    * cast(l_tax as decimal(18,2)), 2) as decimal(18,2)) as string) as freight_value,
               cast(l_shipdate as timestamp) as _sdc_extracted_at
        from {lineitem}""",
    "payments": """
        select cast(o_orderkey as string) as order_id,
               '1' as payment_sequential,
               case substring(o_orderpriority, 1, 1) when '1' then 'credit_card'
                    when '2' then 'boleto' when '3' then 'voucher' when '5' then 'debit_card'
                    else 'not_defined' end as payment_type,
               cast(1 + o_orderkey % 12 as string) as payment_installments,
               cast(cast(o_totalprice as decimal(18,2)) as string) as payment_value,
               cast(o_orderdate as timestamp) as _sdc_extracted_at
        from {orders} where o_orderkey % 50 <> 0
        union all
        select cast(o_orderkey as string), '2', ' voucher ', '', '10.00',
               cast(o_orderdate as timestamp)
        from {orders} where o_orderkey % 10 = 1""",
    "order_reviews": """
        select 'r' || cast(event_id as string) as review_id,
               cast(o_orderkey as string) as order_id,
               case when event_id % 50 <> 7 then cast(1 + event_id % 5 as string) else '' end
                   as review_score,
               case when event_id % 3 = 1 then '' when event_id % 3 = 2 then event_type end
                   as review_comment_title,
               case when event_id % 4 <> 0 then props end as review_comment_message,
               cast(cast(cast(o_orderdate as date) + cast(event_id % 120 as int) as timestamp)
                    as string) as review_creation_date,
               cast(cast(cast(o_orderdate as date) + cast(event_id % 120 + 3 as int) as timestamp)
                    as string) as review_answer_timestamp,
               cast(cast(o_orderdate as date) + cast(event_id % 120 as int) as timestamp)
                   as _sdc_extracted_at
        from {events} join {orders} on o_orderkey = event_id - event_id % 2
        where event_type <> 'error'""",
}

REGIONS_SQL = """
    select n_name as state_code, n_name as state_name, r_name as region, r_name as economic_zone
    from {nation} join {region} on n_regionkey = r_regionkey
    where n_name <> 'NATION_7'"""


class _Given(dict):
    """Given tables, opened on first use."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        super().__init__()
        self.spark, self.sf_dir = spark, sf_dir

    def __missing__(self, name: str) -> DataFrame:
        self[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self[name]


class _Raw(dict):
    """Raw entities over the given tables, planned on first use."""

    def __init__(self, given: _Given) -> None:
        super().__init__()
        self.given = given

    def __missing__(self, name: str) -> DataFrame:
        self[name] = _over(RAW_SQL[name], self.given)
        return self[name]


def _over(sql: str, given: _Given) -> DataFrame:
    used = {name: given[name] for name in SOURCES if "{" + name + "}" in sql}
    return given.spark.sql(sql, **used)


_inputs: dict[tuple[str, str], tuple[_Given, _Raw, DataFrame]] = {}
_warehouses: dict[tuple[str, str], Warehouse] = {}


def _opened(spark: SparkSession, sf_dir: str) -> tuple[_Given, _Raw, DataFrame]:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _inputs:
        given = _Given(spark, sf_dir)
        _inputs[key] = (given, _Raw(given), _over(REGIONS_SQL, given))
    return _inputs[key]


def given_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return _opened(spark, sf_dir)[0]


def raw_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return _opened(spark, sf_dir)[1]


def region_seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _opened(spark, sf_dir)[2]


def warehouse(spark: SparkSession, sf_dir: str) -> Warehouse:
    """Stored warehouse over the given tables, one per application and folder.

    Small test tables are partitioned by year; a day of them would be a handful of rows.
    """
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _warehouses:
        root = f"{work_folder(spark)}/marts/{len(_warehouses)}"
        _warehouses[key] = Warehouse(spark, raw_tables(spark, sf_dir), region_seed(spark, sf_dir),
                                     root, grain="year", fill=True)
    return _warehouses[key]


def lazy_warehouse(spark: SparkSession, sf_dir: str) -> Warehouse:
    """The same tables as plans only, nothing stored."""
    return Warehouse(spark, raw_tables(spark, sf_dir), region_seed(spark, sf_dir))
