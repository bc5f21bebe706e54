"""DuckDB SQL that derives the nine tables from the driver's star schema.

Every oracle query is ``STAR_CTE + <analysis SQL>``; the analysis SQL reads the
CTE names below (prefixed ``m_`` so they do not collide with the driver's
``orders``/``customer`` views). Formulas are those of FIXTURES.md §2 and of
``shipwise.sources.star``.
"""

from __future__ import annotations


def H(ts: str, n: str) -> str:
    """``ts`` plus ``n`` hours."""
    return f"({ts} + to_hours(CAST({n} AS BIGINT)))"


_P = H("o.o_orderdate", "o.o_orderkey * 13 % 24")
_C = H(_P, "6 + o.o_orderkey * 101 % 200")
_X = ("CASE WHEN c.c_nationkey % 5 = 0 THEN 240 WHEN o.o_orderkey % 173 = 3 THEN 1500 "
      "WHEN o.o_orderkey % 11 = 0 THEN 700 ELSE 0 END")
_STATUS = ("CASE WHEN o.o_orderstatus = 'O' AND o.o_orderkey % 10 = 0 THEN 'canceled' "
           "WHEN o.o_orderstatus = 'P' AND o.o_orderkey % 7 = 0 THEN 'shipped' ELSE 'delivered' END")

STAR_CTE = f"""
WITH
m_customers AS (
  SELECT CAST(c.c_custkey AS VARCHAR) AS customer_id,
         CAST(CASE WHEN c.c_custkey % 33 = 1 THEN c.c_custkey - 1 ELSE c.c_custkey END AS VARCHAR) AS customer_unique_id,
         CAST(10000 + c.c_custkey % 900 AS VARCHAR) AS customer_zip_code_prefix,
         'city_' || CAST(c.c_custkey % 40 AS VARCHAR) AS customer_city,
         n.n_name AS customer_state
  FROM customer c LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey),
m_sellers AS (
  SELECT CAST(s.s_suppkey AS VARCHAR) AS seller_id,
         CAST(20000 + s.s_suppkey % 900 AS VARCHAR) AS seller_zip_code_prefix,
         'city_' || CAST(s.s_suppkey % 40 AS VARCHAR) AS seller_city,
         n.n_name AS seller_state
  FROM supplier s LEFT JOIN nation n ON s.s_nationkey = n.n_nationkey),
m_products AS (
  SELECT CAST(p_partkey AS VARCHAR) AS product_id,
         CASE WHEN p_partkey % 61 = 0 THEN NULL ELSE p_brand END AS product_category_name,
         CAST(length(p_name) AS INTEGER) AS product_name_lenght,
         CAST(p_size * 10 AS INTEGER) AS product_description_lenght,
         CAST(1 + p_partkey % 6 AS INTEGER) AS product_photos_qty,
         CAST(CASE WHEN p_partkey % 50 = 7 THEN NULL ELSE p_size * p_size * 5 END AS INTEGER) AS product_weight_g,
         CAST(10 + p_size AS INTEGER) AS product_length_cm,
         CAST(CASE WHEN p_partkey % 43 = 2 THEN NULL ELSE 2 + p_size % 20 END AS INTEGER) AS product_height_cm,
         CAST(8 + p_size % 25 AS INTEGER) AS product_width_cm
  FROM part),
m_category_translation AS (
  SELECT DISTINCT p_brand AS product_category_name, lower(p_brand) AS product_category_name_english
  FROM part WHERE p_brand NOT IN ('Brand#3', 'Brand#7')),
m_orders_full AS (
  SELECT o.o_orderkey AS k, o.o_totalprice, o.o_orderdate,
         CAST(o.o_orderkey AS VARCHAR) AS order_id,
         CAST(o.o_custkey AS VARCHAR) AS customer_id,
         {_STATUS} AS order_status,
         {_P} AS order_purchase_timestamp,
         {H(_P, "1")} AS order_approved_at,
         CASE WHEN o.o_orderkey % 40 = 1 THEN NULL ELSE {_C} END AS order_delivered_carrier_date,
         CASE WHEN o.o_orderkey % 29 = 0 OR ({_STATUS}) = 'shipped'
                   OR (({_STATUS}) = 'canceled' AND o.o_orderkey % 70 <> 0) THEN NULL
              ELSE {H(_C, "24 + o.o_orderkey * 59 % 241 + " + _X)} END AS order_delivered_customer_date,
         CASE WHEN o.o_orderkey % 97 = 5 THEN NULL
              ELSE {H("o.o_orderdate", "24 * (8 + o.o_orderkey * 37 % 35 + c.c_nationkey % 5)")} END
              AS order_estimated_delivery_date
  FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey),
m_orders AS (
  SELECT order_id, customer_id, order_status, order_purchase_timestamp, order_approved_at,
         order_delivered_carrier_date, order_delivered_customer_date, order_estimated_delivery_date
  FROM m_orders_full),
m_order_items AS (
  SELECT CAST(l.l_orderkey AS VARCHAR) AS order_id,
         CAST(row_number() OVER (PARTITION BY l.l_orderkey ORDER BY l.l_linenumber, l.l_partkey, l.l_suppkey,
              l.l_extendedprice, l.l_quantity, l.l_shipdate, l.l_discount, l.l_tax, l.l_returnflag,
              l.l_linestatus) AS INTEGER) AS order_item_id,
         CAST(l.l_partkey AS VARCHAR) AS product_id,
         CAST(l.l_suppkey AS VARCHAR) AS seller_id,
         {H("o.o_orderdate", "72")} AS shipping_limit_date,
         CAST(l.l_extendedprice AS DOUBLE) AS price,
         CAST(l.l_quantity * 0.5e0 AS DOUBLE) AS freight_value
  FROM lineitem l LEFT JOIN orders o ON l.l_orderkey = o.o_orderkey),
m_order_payments AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS order_id, CAST(1 AS INTEGER) AS payment_sequential,
         CASE WHEN o_orderkey % 4 = 0 THEN 'boleto' WHEN o_orderkey % 4 = 1 THEN 'voucher' ELSE 'credit_card' END
           AS payment_type,
         CAST(1 + o_orderkey % 10 AS INTEGER) AS payment_installments,
         CAST(o_totalprice AS DOUBLE) AS payment_value
  FROM orders
  UNION ALL
  SELECT CAST(o_orderkey AS VARCHAR), CAST(2 AS INTEGER), 'voucher', CAST(1 AS INTEGER), 10.0e0
  FROM orders WHERE o_orderkey % 9 = 0),
m_order_reviews AS (
  SELECT CAST(k AS VARCHAR) AS review_id, order_id,
         CAST(CASE WHEN order_delivered_customer_date > order_estimated_delivery_date THEN 1 + k % 3
                   WHEN k % 10 < 3 THEN 5 - k % 3 ELSE 5 END AS INTEGER) AS review_score,
         CASE WHEN k % 8 = 0 THEN 'title' END AS review_comment_title,
         CASE WHEN k % 5 < 3 THEN NULL ELSE 'comment on order ' || order_id END AS review_comment_message,
         {H("order_purchase_timestamp", "600")} AS review_creation_date,
         {H("order_purchase_timestamp", "648")} AS review_answer_timestamp
  FROM m_orders_full WHERE k % 20 <> 3)
"""


def q(body: str) -> str:
    """Prefix an analysis over the ``m_*`` tables with the mapping CTEs."""
    body = body.strip()
    if body.upper().startswith("WITH "):
        body = ", " + body[5:]
    else:
        body = "\n" + body
    return STAR_CTE + body
