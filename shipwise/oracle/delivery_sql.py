"""Oracle SQL for the delivery analyses (K11-K22), over the ``m_*`` tables.

Every query reads the shared grains of ``oracle.grains``: trips (one row an
order), goods and dispatched (one row an item). Rows multiply as SURVEY §2.11
asks for; nothing is reduced before a join, unlike in the operators.
"""

from __future__ import annotations

from ..operators import delivery as d
from .duck import q
from .grains import DISPATCHED, GOODS, ROUNDED_SLIP, TRIPS, US_PER_DAY
from .sql import AVG_DAYS, AVG_INT, CASE_LE, PCT, R

#: orders with both dates, with their rounded delay
DATED = f"{TRIPS}, dated AS (SELECT *, {ROUNDED_SLIP} AS delay_days FROM trips WHERE slip_us IS NOT NULL)"
DELAY_BUCKET = CASE_LE("delay_days", d.DELAY_CUTS, d.DELAY_LABELS)


def share(cond: str, digits: int) -> str:
    """Share of the rows of a group that meet a condition, in percent."""
    return PCT(f"count(*) FILTER (WHERE {cond})", "count(*)", digits)


def worst(body: str, least: int, ties: str, k: int | None = None) -> str:
    """Groups of at least ``least`` rows by descending mean delay."""
    return f"""SELECT * FROM ({body}) WHERE orders >= {least}
        ORDER BY avg_delay DESC, orders DESC, {ties}{f' LIMIT {k}' if k else ''}"""


def sqls() -> dict[str, str]:
    slip, late = R(AVG_DAYS("slip_us"), 1), share("slip_us > 0", 1)
    return {
        "k11_delay_histogram": q(f"""WITH {DATED}
            SELECT delay_days, count(*) AS cnt FROM dated GROUP BY ALL ORDER BY delay_days"""),
        "k12_delay_mean": q(f"""WITH {DATED}
            SELECT count(*) AS orders, {R(AVG_INT('delay_days'), 1)} AS mean_delay_days FROM dated"""),
        "k13_delay_buckets": q(f"""WITH {DATED},
            arrivals AS (SELECT count(order_delivered_customer_date) AS n FROM m_orders)
            SELECT {DELAY_BUCKET} AS delay_bucket, count(*) AS cnt, {PCT('count(*)', 'any_value(n)', 1)} AS pct
            FROM dated, arrivals GROUP BY delay_bucket ORDER BY delay_bucket"""),
        "k14_delay_bucket_reviews": q(f"""WITH {DATED},
            scores AS (SELECT {DELAY_BUCKET} AS delay_bucket, review_score
                       FROM m_order_reviews JOIN dated USING (order_id))
            SELECT delay_bucket, count(*) AS reviews, {R(AVG_INT('review_score'), 2)} AS avg_score,
                   {share('review_score = 1', 1)} AS pct_1star, {share('review_score = 5', 1)} AS pct_5star
            FROM scores GROUP BY ALL ORDER BY delay_bucket"""),
        "k15_status_distribution": q(f"""
            SELECT order_status, cnt, {PCT('cnt', 'sum(cnt) OVER ()', 1)} AS pct
            FROM (SELECT order_status, count(*) AS cnt FROM m_orders GROUP BY ALL)
            ORDER BY cnt DESC, order_status"""),
        "k16_cancel_rate_by_promise": q(f"""WITH {TRIPS},
            promises AS (SELECT round(promise_us / {US_PER_DAY}) AS days, order_status = 'canceled' AS gone
                         FROM trips WHERE has_promise)
            SELECT {CASE_LE('days', d.PROMISE_CUTS, d.PROMISE_LABELS)} AS estimated_delivery_bucket,
                   count(*) AS total_orders, count(*) FILTER (WHERE gone) AS canceled,
                   {share('gone', 2)} AS cancel_rate_pct
            FROM promises GROUP BY estimated_delivery_bucket ORDER BY estimated_delivery_bucket"""),
        "k17_delay_cause_split": q(f"""WITH {DATED},
            legs AS (SELECT {CASE_LE('delay_days', d.CAUSE_CUTS, d.CAUSE_LABELS)} AS delay_bucket,
                            handover_us, transit_us, trip_us FROM dated WHERE transit_us IS NOT NULL)
            SELECT delay_bucket, count(*) AS cnt, {R(AVG_DAYS('handover_us'), 1)} AS avg_seller_days,
                   {R(AVG_DAYS('transit_us'), 1)} AS avg_transit_days, {R(AVG_DAYS('trip_us'), 1)} AS avg_total_days
            FROM legs GROUP BY ALL ORDER BY delay_bucket"""),
        "k18_delay_by_customer_state": q(f"WITH {DATED} " + worst(f"""
            SELECT customer_state, count(*) AS orders, {slip} AS avg_delay, {late} AS late_pct
            FROM m_customers JOIN dated USING (customer_id) GROUP BY customer_state""", 100, "customer_state")),
        "k19_slowest_lanes": q(f"WITH {DATED}, {DISPATCHED} " + worst(f"""
            SELECT from_state, customer_state AS to_state, count(*) AS orders, {slip} AS avg_delay,
                   {R(AVG_DAYS('trip_us'), 1)} AS avg_total_days
            FROM dispatched JOIN dated USING (order_id) JOIN m_customers USING (customer_id)
            GROUP BY from_state, to_state""", 50, "from_state, to_state", 10)),
        "k20_slowest_categories": q(f"WITH {DATED}, {GOODS} " + worst(f"""
            SELECT category, count(*) AS orders, {slip} AS avg_delay,
                   {R(AVG_INT('product_weight_g'), 0)} AS avg_weight_g, {R(AVG_INT('review_score'), 2)} AS avg_review
            FROM goods JOIN dated USING (order_id) LEFT JOIN m_order_reviews USING (order_id)
            GROUP BY category""", 50, "category NULLS FIRST", 10)),
        "k21_delay_by_weight": q(f"""WITH {DATED}, {GOODS},
            weighed AS (SELECT {CASE_LE('product_weight_g', d.WEIGHT_CUTS, d.WEIGHT_LABELS)} AS weight_bucket, slip_us
                        FROM goods JOIN dated USING (order_id) WHERE product_weight_g IS NOT NULL)
            SELECT weight_bucket, count(*) AS orders, {slip} AS avg_delay, {late} AS late_pct
            FROM weighed GROUP BY ALL ORDER BY weight_bucket"""),
        "k22_chronic_late_sellers": q(f"WITH {DATED}, {DISPATCHED} " + worst(f"""
            SELECT seller_id, any_value(from_city) AS seller_city, any_value(from_state) AS seller_state,
                   count(*) AS orders, {slip} AS avg_delay, {late} AS late_pct,
                   {R(AVG_DAYS('handover_us'), 1)} AS avg_seller_days, {R(AVG_INT('review_score'), 2)} AS avg_review
            FROM dispatched JOIN dated USING (order_id) LEFT JOIN m_order_reviews USING (order_id)
            WHERE transit_us IS NOT NULL GROUP BY seller_id""", 30, "seller_id", 10)),
    }
