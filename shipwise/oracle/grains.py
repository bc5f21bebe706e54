"""Shared CTEs of the oracle queries, one per grain of the ``m_*`` tables."""

from __future__ import annotations

US_PER_DAY = "86400000000.0e0"

#: One row an order with its durations in microseconds; a duration is NULL while one of its dates is missing.
TRIPS = """trips AS (
    SELECT order_id, customer_id, order_status, order_estimated_delivery_date IS NOT NULL AS has_promise,
           order_delivered_carrier_date IS NOT NULL AS has_carrier,
           date_diff('microsecond', order_estimated_delivery_date, order_delivered_customer_date) AS slip_us,
           date_diff('microsecond', order_purchase_timestamp, order_delivered_carrier_date) AS handover_us,
           date_diff('microsecond', order_delivered_carrier_date, order_delivered_customer_date) AS transit_us,
           date_diff('microsecond', order_purchase_timestamp, order_delivered_customer_date) AS trip_us,
           date_diff('microsecond', order_purchase_timestamp, order_estimated_delivery_date) AS promise_us
    FROM m_orders)"""
ROUNDED_SLIP = f"CAST(round(slip_us / {US_PER_DAY}) AS BIGINT)"

#: One row a product, under its English category name where there is one.
CATALOGUE = """catalogue AS (
    SELECT * EXCLUDE (product_category_name, product_category_name_english),
           coalesce(product_category_name_english, product_category_name) AS category
    FROM m_products LEFT JOIN m_category_translation USING (product_category_name))"""
#: One row an item with its product.
GOODS = f"{CATALOGUE}, goods AS (SELECT * FROM m_order_items JOIN catalogue USING (product_id))"
#: One row an item with the place it is sent from.
DISPATCHED = """dispatched AS (
    SELECT order_id, seller_id, seller_city AS from_city, seller_state AS from_state
    FROM m_sellers JOIN m_order_items USING (seller_id))"""
