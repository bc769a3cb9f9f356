"""Building blocks of the checking SQL: raw rows, staging, star schema, exact rounding.

Written separately from the Spark plans: item-grain joins and plain distinct counts throughout.
"""

from __future__ import annotations

import re

from souk.plans.testbed import RAW_SQL, REGIONS_SQL

GIVEN = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def _plain(sql: str) -> str:
    for name in GIVEN:
        sql = sql.replace("{" + name + "}", name)
    return sql


def div(num: str, den: str, digits: int, scale: int = 0) -> str:
    """num / 10^scale / den, half away from zero at 9 digits and then at `digits`, as a double.

    Integer arithmetic, because this engine divides decimals in floating point.
    """
    n, d = f"cast({num} as hugeint)", f"cast({den} as hugeint)"
    nano = f"((2 * abs({n}) * {10 ** (9 - scale)} + {d}) // (2 * {d}))"
    step = 10 ** (9 - digits)
    return (f"(sign({n}) * cast(({nano} + {step // 2}) // {step} as double) / {10 ** digits})")


def total(x: str) -> str:
    return f"cast(sum({x}) as double)"


def cents(x: str) -> str:
    return f"sum(cast(({x}) * 100 as hugeint))"


def avg_money(x: str) -> str:
    return div(cents(x), f"count({x})", 2, 2)


def avg_int(x: str, digits: int = 1) -> str:
    return div(f"sum({x})", f"count({x})", digits)


def pct(num: str, den: str) -> str:
    return div(f"100 * ({num})", den, 1)


def newest(keys: str, order: str) -> str:
    return f"qualify row_number() over (partition by {keys} order by {order}) = 1"


CTES: dict[str, str] = {f"raw_{name}": _plain(sql) for name, sql in RAW_SQL.items()}
CTES["raw_regions"] = _plain(REGIONS_SQL)

CTES["stg_orders"] = f"""
    select trim(order_id) as order_id, trim(customer_id) as customer_id,
           upper(trim(order_status)) as order_status,
           try_cast(order_purchase_timestamp as timestamp) as order_purchase_timestamp,
           try_cast(order_approved_at as timestamp) as order_approved_at,
           try_cast(order_delivered_carrier_date as timestamp) as order_delivered_carrier_date,
           try_cast(order_delivered_customer_date as timestamp) as order_delivered_customer_date,
           try_cast(order_estimated_delivery_date as timestamp) as order_estimated_delivery_date,
           _sdc_extracted_at as modified_at
    from raw_orders {newest('order_id', '_sdc_extracted_at desc')}"""
CTES["stg_customers"] = f"""
    select customer_id, customer_unique_id, lower(trim(customer_city)) as customer_city,
           upper(trim(customer_state)) as customer_state,
           trim(customer_zip_code_prefix) as customer_zip_prefix, _sdc_extracted_at as modified_at
    from raw_customers {newest('customer_id', '_sdc_extracted_at desc')}"""
CTES["stg_order_items"] = f"""
    select order_id, cast(order_item_id as bigint) as order_item_id, product_id, seller_id,
           cast(shipping_limit_date as timestamp) as shipping_limit_date,
           cast(price as decimal(18,2)) as price, cast(freight_value as decimal(18,2)) as freight_value,
           _sdc_extracted_at as modified_at
    from raw_order_items
    {newest('order_id, order_item_id', '''_sdc_extracted_at desc, product_id, seller_id,
        cast(price as decimal(18,2)), cast(freight_value as decimal(18,2))''')}"""
CTES["stg_payments"] = """
    select order_id, cast(payment_sequential as bigint) as payment_sequential,
           upper(trim(payment_type)) as payment_type,
           coalesce(try_cast(nullif(payment_installments, '') as bigint), 0) as payment_installments,
           coalesce(cast(payment_value as decimal(18,2)), 0) as payment_value,
           _sdc_extracted_at as modified_at
    from raw_payments"""
CTES["stg_products"] = """
    select product_id, product_category_name,
           coalesce(cast(nullif(product_name_lenght, '') as bigint), 0) as product_name_length,
           coalesce(cast(nullif(product_description_lenght, '') as bigint), 0)
               as product_description_length,
           coalesce(cast(nullif(product_photos_qty, '') as bigint), 0) as product_photos_qty,
           cast(product_weight_g as double) as product_weight_g,
           cast(product_length_cm as double) as product_length_cm,
           cast(product_height_cm as double) as product_height_cm,
           cast(product_width_cm as double) as product_width_cm,
           case when least(cast(product_length_cm as int), cast(product_height_cm as int),
                           cast(product_width_cm as int)) > 0
                then cast(cast(product_length_cm as int) * cast(product_height_cm as int)
                          * cast(product_width_cm as int) as double)
                else 0 end as product_volume_cm3,
           _sdc_extracted_at as modified_at
    from raw_products"""
CTES["stg_order_reviews"] = """
    select review_id, order_id,
           coalesce(cast(nullif(review_score, '') as bigint), 0) as review_score,
           trim(review_comment_title) as review_comment_title,
           trim(review_comment_message) as review_comment_message,
           cast(review_creation_date as timestamp) as review_creation_date,
           cast(review_answer_timestamp as timestamp) as review_answer_timestamp,
           _sdc_extracted_at as modified_at
    from raw_order_reviews"""
CTES["stg_sellers"] = """
    select seller_id, trim(seller_zip_code_prefix) as seller_zip_prefix,
           lower(trim(seller_city)) as seller_city, upper(trim(seller_state)) as seller_state,
           _sdc_extracted_at as modified_at
    from raw_sellers"""
CTES["stg_category_translation"] = """
    select product_category_name, product_category_name_english, _sdc_extracted_at as modified_at
    from raw_product_category_name_translation"""

CTES["dim_customers"] = """
    select p.*, coalesce(region, 'Unknown') as customer_region,
           coalesce(economic_zone, 'Unknown') as customer_economic_zone,
           coalesce(state_name, customer_state) as customer_state_name
    from (select customer_unique_id as customer_key, min(customer_id) as customer_id_original,
                 arg_min(customer_city, customer_id) as customer_city,
                 arg_min(customer_state, customer_id) as customer_state,
                 arg_min(customer_zip_prefix, customer_id) as customer_zip_prefix,
                 max(modified_at) as modified_at
          from stg_customers group by all) p
    left join raw_regions on customer_state = state_code"""
CTES["dim_sellers"] = """
    select seller_id as seller_key, seller_city, seller_state, seller_zip_prefix, modified_at,
           coalesce(region, 'Unknown') as seller_region,
           coalesce(economic_zone, 'Unknown') as seller_economic_zone,
           coalesce(state_name, seller_state) as seller_state_name
    from stg_sellers left join raw_regions on seller_state = state_code"""
CTES["dim_products"] = """
    select product_id as product_key, p.product_category_name as product_category_portuguese,
           product_weight_g, product_length_cm, product_height_cm, product_width_cm,
           product_photos_qty, product_name_length, product_description_length,
           product_volume_cm3, p.modified_at,
           coalesce(product_category_name_english, p.product_category_name)
               as product_category_english
    from stg_products p left join stg_category_translation t
         on lower(p.product_category_name) = trim(t.product_category_name)"""
CTES["dim_orders"] = """
    select order_id as order_key, order_status, order_purchase_timestamp, order_approved_at,
           order_delivered_carrier_date, order_delivered_customer_date,
           order_estimated_delivery_date, modified_at,
           date_diff('day', cast(order_purchase_timestamp as date),
                     cast(order_delivered_customer_date as date)) as days_to_delivery,
           date_diff('day', cast(order_estimated_delivery_date as date),
                     cast(order_delivered_customer_date as date)) as delivery_vs_estimate_days,
           cast(order_delivered_customer_date as date)
               <= cast(order_estimated_delivery_date as date) as is_delivered_on_time
    from stg_orders"""
CTES["dim_payments"] = """
    select order_id as payment_key,
           count(*) filter (payment_type = 'CREDIT_CARD') > 0 as uses_credit_card,
           count(*) filter (payment_type = 'BOLETO') > 0 as uses_boleto,
           count(*) filter (payment_type = 'VOUCHER') > 0 as uses_voucher,
           count(*) filter (payment_type = 'DEBIT_CARD') > 0 as uses_debit_card,
           arg_min(payment_type, payment_sequential) as primary_payment_type,
           sum(payment_value) as total_payment_value,
           cast(sum(payment_installments) as bigint) as total_installments,
           count(distinct payment_type) as payment_methods_count,
           count(*) as payment_transactions_count, max(modified_at) as modified_at
    from stg_payments group by order_id"""
CTES["dim_reviews"] = f"""
    select r.order_id as review_key, review_score, review_comment_title, review_comment_message,
           review_creation_date, r.modified_at,
           coalesce(length(review_comment_title), 0) > 0 as has_comment_title,
           coalesce(length(review_comment_message), 0) > 0 as has_comment_message,
           date_diff('day', cast(order_purchase_timestamp as date),
                     cast(review_creation_date as date)) as days_to_review
    from (select * from stg_order_reviews
          {newest('order_id', 'review_creation_date desc, review_score desc, review_id')}) r
    left join stg_orders o on o.order_id = r.order_id"""
CTES["dim_date"] = """
    select strftime(full_date, '%Y-%m-%d') as date_key, full_date,
           year(full_date) as year, month(full_date) as month, monthname(full_date) as month_name,
           quarter(full_date) as quarter, dayofweek(full_date) + 1 as day_of_week,
           dayname(full_date) as day_name, dayofweek(full_date) in (0, 6) as is_weekend
    from (select distinct cast(order_purchase_timestamp as date) as full_date from stg_orders)"""
CTES["fact_sales"] = """
    select i.order_id || '-' || order_item_id as order_item_sk, i.order_id as order_key,
           customer_unique_id as customer_key, product_id as product_key, seller_id as seller_key,
           strftime(order_purchase_timestamp, '%Y-%m-%d') as date_key, payment_key, review_key,
           price as item_price, freight_value, price + freight_value as total_item_value,
           cast(1 as bigint) as quantity, coalesce(total_payment_value, 0) as payment_value,
           coalesce(total_installments, 1) as total_installments,
           coalesce(payment_methods_count, 1) as payment_methods_count,
           coalesce(uses_credit_card, false) as uses_credit_card,
           coalesce(uses_boleto, false) as uses_boleto,
           coalesce(uses_voucher, false) as uses_voucher,
           coalesce(uses_debit_card, false) as uses_debit_card,
           coalesce(primary_payment_type, 'unknown') as primary_payment_type,
           order_purchase_timestamp as order_purchase_ts, i.modified_at as fact_modified_at
    from stg_order_items i join stg_orders o using (order_id) join stg_customers using (customer_id)
    left join dim_payments on payment_key = order_id left join dim_reviews on review_key = order_id"""
# Every fact row beside all of its dimensions: what the reports read.
CTES["sale"] = """
    select f.order_item_sk, f.order_key, f.customer_key, f.product_key, f.seller_key, f.date_key,
           f.payment_key, f.review_key, f.item_price, f.freight_value, f.total_item_value,
           f.payment_value, c.customer_region, c.customer_state, s.seller_region, s.seller_state,
           s.seller_city, p.product_category_english, d.full_date, d.year, d.month, d.month_name,
           o.days_to_delivery, o.delivery_vs_estimate_days, o.is_delivered_on_time,
           y.primary_payment_type, y.total_installments, y.payment_methods_count,
           y.uses_credit_card, y.uses_boleto, y.uses_voucher, r.review_score, r.days_to_review
    from fact_sales f
    join dim_customers c on c.customer_key = f.customer_key
    join dim_sellers s on s.seller_key = f.seller_key
    left join dim_products p on p.product_key = f.product_key
    join dim_date d on d.date_key = f.date_key
    join dim_orders o on o.order_key = f.order_key
    left join dim_payments y on y.payment_key = f.payment_key
    left join dim_reviews r on r.review_key = f.review_key"""


def query(body: str, **extra: str) -> str:
    """`body` with the CTEs it needs, directly or indirectly, in dependency order."""
    known = {**CTES, **extra}
    ordered: dict[str, str] = {}

    def need(sql: str) -> None:
        for name in known:
            if name not in ordered and re.search(rf"\b{name}\b", sql):
                need_sql = known[name]
                if need_sql is not sql:
                    need(need_sql)
                    ordered[name] = need_sql

    need(body)
    ctes = ",\n".join(f"{name} as ({sql})" for name, sql in ordered.items())
    return f"with {ctes}\n{body}" if ctes else body
