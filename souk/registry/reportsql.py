"""Checking SQL of the reports R1-R20."""

from __future__ import annotations

from souk.registry.checksql import avg_int, avg_money, cents, div, pct, total

V = "total_item_value"


def where(year: int | None = None, region: str | None = None, column: str = "customer_region",
          *more: str) -> str:
    terms = list(more)
    if year is not None:
        terms.append(f"year = {year}")
    if region is not None:
        terms.append(f"{column} = '{region}'")
    return "where " + " and ".join(terms) if terms else ""


ROUTE = "case when customer_region = seller_region then 'Same Region' else 'Cross Region' end"
ON_TIME = "count(*) filter (is_delivered_on_time)"
ORDERS = "count(distinct order_key)"


def monthly_sales_trends(year=None, region=None):
    return f"""select strftime(min(full_date), '%Y-%m') as month_year, year, month, month_name,
        {ORDERS} as total_orders, count(*) as total_items, {total(V)} as total_sales,
        {total('payment_value')} as total_payments,
        {div(cents(V), ORDERS, 2, 2)} as avg_order_value,
        {div(cents('payment_value'), ORDERS, 2, 2)} as avg_payment_value
        from sale {where(year, region)} group by year, month, month_name"""


def top_products_categories(year=None, region=None, limit=20):
    return f"""select product_category_english as category,
        count(distinct product_key) as unique_products, count(*) as items_sold,
        {total(V)} as total_revenue, {avg_money(V)} as avg_item_value,
        {total('freight_value')} as total_freight, {total('item_price')} as total_item_price
        from sale {where(year, region, 'customer_region', 'product_category_english is not null')}
        group by 1 order by total_revenue desc, category {'' if limit is None else f'limit {limit}'}"""


def sales_by_region(year=None):
    return f"""select customer_region, seller_region, {ORDERS} as total_orders,
        count(*) as total_items, {total(V)} as total_sales, {avg_money(V)} as avg_order_value,
        count(distinct customer_key) as unique_customers, count(distinct seller_key) as unique_sellers
        from sale {where(year)} group by customer_region, seller_region"""


def sales_by_state(year=None, region=None):
    return f"""select customer_state, customer_region, {ORDERS} as total_orders,
        count(*) as total_items, {total(V)} as total_sales, {avg_money(V)} as avg_order_value,
        count(distinct customer_key) as unique_customers
        from sale {where(year, region)} group by customer_state, customer_region"""


def customer_seller_flow(year=None):
    return f"""select {ROUTE} as transaction_type, customer_region, seller_region,
        {ORDERS} as total_orders, {total(V)} as total_sales,
        count(distinct customer_key) as unique_customers, count(distinct seller_key) as unique_sellers
        from sale {where(year)} group by all"""


def _buyers(year, region):
    """Per customer: orders, spend, mean order total, mean item value, days between first and last."""
    return f"""(select customer_key, customer_region, count(*) as orders,
        cast(sum(value) as decimal(18,2)) as spent,
        cast({div(cents('value'), 'count(*)', 2, 2)} as decimal(18,2)) as per_order,
        cast({div(cents('value'), 'sum(n)', 2, 2)} as decimal(18,2)) as per_item,
        date_diff('day', min(full_date), max(full_date)) as lifetime
        from (select order_key, customer_key, customer_region, full_date, count(*) as n,
                     cast(sum({V}) as decimal(18,2)) as value
              from sale {where(year, region)} group by all)
        group by customer_key, customer_region)"""


def customer_behavior(year=None, region=None):
    return f"""select customer_region, count(*) as customer_count,
        {avg_int('orders')} as avg_orders_per_customer,
        {avg_money('spent')} as avg_customer_lifetime_value,
        {avg_money('per_order')} as avg_order_value,
        {avg_int('lifetime')} as avg_customer_lifetime_days,
        count(*) filter (orders = 1) as one_time_customers,
        count(*) filter (orders > 1) as repeat_customers
        from {_buyers(year, region)} group by customer_region"""


def customer_segmentation(year=None, region=None):
    return f"""select case when orders = 1 then 'One-Time Customer' when orders <= 5
            then 'Regular Customer' else 'Loyal Customer' end as customer_segment,
        case when spent <= 100 then 'Low Value' when spent between 101 and 500 then 'Medium Value'
            when spent > 500 then 'High Value' end as value_segment,
        count(*) as customer_count, {avg_int('orders')} as avg_orders,
        {avg_money('spent')} as avg_lifetime_value, {avg_money('per_item')} as avg_order_value,
        {avg_int('lifetime')} as avg_lifetime_days, {total('spent')} as segment_total_value
        from {_buyers(year, region)} group by 1, 2"""


def customer_frequency(year=None, region=None):
    return f"""select orders as order_count, count(*) as customer_count,
        {avg_money('spent')} as avg_customer_value, {total('spent')} as total_segment_value,
        {pct('count(*)', 'sum(count(*)) over ()')} as percentage_of_customers
        from {_buyers(year, region)} group by orders"""


def payment_analysis(year=None, region=None):
    return f"""select primary_payment_type, {ORDERS} as total_orders, {total(V)} as total_sales,
        {avg_money(V)} as avg_order_value, {avg_int('total_installments')} as avg_installments,
        count(*) filter (uses_credit_card) as credit_card_orders,
        count(*) filter (uses_boleto) as boleto_orders,
        count(*) filter (uses_voucher) as voucher_orders,
        {total('payment_value')} as total_payments,
        {avg_int('payment_methods_count')} as avg_payment_methods_count
        from sale {where(year, region, 'customer_region', 'payment_key is not null')}
        group by primary_payment_type"""


def installment_analysis(year=None, region=None):
    return f"""select total_installments, {ORDERS} as order_count, {total(V)} as total_sales,
        {avg_money(V)} as avg_order_value, {total('payment_value')} as total_payments,
        {avg_money('payment_value')} as avg_payment_value,
        {pct('count(*)', 'sum(count(*)) over ()')} as percentage_of_orders
        from sale {where(year, region, 'customer_region', 'payment_key is not null')}
        group by total_installments"""


def seller_performance(year=None, region=None):
    return f"""select seller_region, count(distinct seller_key) as unique_sellers,
        {ORDERS} as total_orders, count(*) as total_items, {total(V)} as total_revenue,
        {avg_money(V)} as avg_item_value,
        {div(cents(V), 'count(distinct seller_key)', 2, 2)} as revenue_per_seller,
        count(distinct product_key) as unique_products_sold,
        {avg_money('freight_value')} as avg_freight_value,
        {total('freight_value')} as total_freight_revenue
        from sale {where(year, region, 'seller_region')} group by seller_region"""


def top_sellers(year=None, region=None, limit=20):
    return f"""select seller_key, seller_region, seller_state, seller_city, {ORDERS} as total_orders,
        count(*) as total_items, {total(V)} as total_revenue, {avg_money(V)} as avg_item_value,
        count(distinct product_key) as unique_products_sold,
        {total('freight_value')} as total_freight_revenue,
        count(distinct customer_key) as unique_customers_served
        from sale {where(year, region, 'seller_region')}
        group by seller_key, seller_region, seller_state, seller_city
        order by total_revenue desc, seller_key limit {limit}"""


def seller_product_diversity(year=None, region=None):
    return f"""select seller_region, count(*) as seller_count,
        {avg_int('categories')} as avg_categories_per_seller,
        {avg_int('products')} as avg_products_per_seller,
        {avg_money('revenue')} as avg_revenue_per_seller,
        count(*) filter (categories = 1) as single_category_sellers,
        count(*) filter (categories > 3) as diverse_sellers
        from (select seller_region, seller_key, count(distinct product_category_english) as categories,
                     count(distinct product_key) as products, cast(sum({V}) as decimal(18,2)) as revenue
              from sale {where(year, region, 'seller_region', 'product_category_english is not null')}
              group by seller_region, seller_key) group by seller_region"""


def reviews_sales_correlation(year=None, region=None):
    return f"""select case when review_key is null then 'No Review' when review_score >= 4
            then 'Positive (4-5)' when review_score = 3 then 'Neutral (3)'
            else 'Negative (1-2)' end as review_category,
        count(*) as total_items, {total(V)} as total_sales, {avg_money(V)} as avg_item_value,
        {avg_int('coalesce(review_score, 0)')} as avg_review_score,
        count(review_key) as reviews_count, count(*) - count(review_key) as no_review_count,
        {ORDERS} as total_orders
        from sale {where(year, region)} group by 1"""


def review_score_distribution(year=None, region=None):
    return f"""select score as review_score, count(*) as total_items, {total(V)} as total_sales,
        {avg_money(V)} as avg_item_value, {ORDERS} as total_orders,
        count(review_key) as actual_reviews,
        {pct('count(*)', 'sum(count(*)) over ()')} as percentage_of_items
        from (select *, coalesce(review_score, 0) as score from sale {where(year, region)})
        group by score"""


def review_timing_analysis(year=None, region=None):
    return f"""select case when days_to_review <= 7 then 'Quick (≤7 days)'
            when days_to_review <= 30 then 'Normal (8-30 days)'
            when days_to_review <= 90 then 'Delayed (31-90 days)'
            else 'Very Late (>90 days)' end as timing_category,
        count(*) as review_count, {avg_int('review_score')} as avg_review_score,
        {total(V)} as total_sales, {avg_money(V)} as avg_item_value,
        {avg_int('days_to_review')} as avg_days_to_review
        from sale {where(year, region, 'customer_region', 'days_to_review is not null')} group by 1"""


def delivery_patterns(year=None, region=None):
    return f"""select customer_region, {ORDERS} as total_orders, count(*) as total_items,
        {total(V)} as total_sales, {avg_int('days_to_delivery')} as avg_delivery_days,
        {avg_int('delivery_vs_estimate_days')} as avg_delivery_vs_estimate,
        {ON_TIME} as on_time_deliveries,
        count(*) filter (not is_delivered_on_time) as late_deliveries,
        {pct(ON_TIME, ORDERS)} as on_time_delivery_rate,
        cast(min(days_to_delivery) as double) as min_delivery_days,
        cast(max(days_to_delivery) as double) as max_delivery_days,
        round(stddev_samp(days_to_delivery), 1) as delivery_days_stddev
        from sale {where(year, region, 'customer_region', 'days_to_delivery is not null')}
        group by customer_region"""


def delivery_time_distribution(year=None, region=None):
    return f"""select case when days_to_delivery <= 5 then 'Very Fast (≤5 days)'
            when days_to_delivery <= 10 then 'Fast (6-10 days)'
            when days_to_delivery <= 20 then 'Normal (11-20 days)'
            when days_to_delivery <= 30 then 'Slow (21-30 days)'
            else 'Very Slow (>30 days)' end as delivery_speed_category,
        {ORDERS} as total_orders, count(*) as total_items, {total(V)} as total_sales,
        {avg_int('days_to_delivery')} as avg_days_in_category, {ON_TIME} as on_time_orders,
        {pct(ON_TIME, ORDERS)} as on_time_rate,
        {avg_int('delivery_vs_estimate_days')} as avg_vs_estimate
        from sale {where(year, region, 'customer_region', 'days_to_delivery is not null')} group by 1"""


def delivery_efficiency(year=None, region=None):
    return f"""select customer_region, seller_region, {ROUTE} as delivery_type,
        {ORDERS} as total_orders, {avg_int('days_to_delivery')} as avg_delivery_days,
        {avg_int('delivery_vs_estimate_days')} as avg_vs_estimate,
        {pct(ON_TIME, ORDERS)} as on_time_rate, {total(V)} as total_sales,
        {avg_money('freight_value')} as avg_freight_cost
        from sale {where(year, region, 'customer_region', 'days_to_delivery is not null')} group by all"""


def dashboard_summary():
    return f"""select {ORDERS} as total_orders, count(*) as total_items, {total(V)} as total_sales,
        {avg_money(V)} as avg_order_value, count(distinct customer_key) as unique_customers,
        count(distinct seller_key) as unique_sellers, count(distinct product_key) as unique_products
        from fact_sales"""
