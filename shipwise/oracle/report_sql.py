"""Oracle SQL for the report analyses."""

from __future__ import annotations

from ..operators import report as rp
from .duck import q
from .grains import DISPATCHED, GOODS, ROUNDED_SLIP, TRIPS
from .sql import AVG_DAYS, AVG_INT, CASE_LE, CW, DIV, PCT, PCT_WHEN, R

def sqls() -> dict[str, str]:
    early_case = (f"CASE WHEN delay_days <= {rp.EARLY_CUTS[0]} THEN '{rp.EARLY_LABELS[0]}' "
                  f"WHEN delay_days <= {rp.EARLY_CUTS[1]} THEN '{rp.EARLY_LABELS[1]}' "
                  f"WHEN delay_days <= {rp.EARLY_CUTS[2]} THEN '{rp.EARLY_LABELS[2]}' "
                  f"WHEN delay_days <= {rp.EARLY_CUTS[3]} THEN '{rp.EARLY_LABELS[3]}' END")
    lanes = f"""{TRIPS}, {DISPATCHED}, lanes AS (
        SELECT from_state AS seller_state, customer_state, count(*) AS n, CAST(sum(transit_us) AS BIGINT) AS t,
               count(*) FILTER (WHERE slip_us > 0) AS l
        FROM dispatched JOIN trips USING (order_id) JOIN m_customers USING (customer_id)
        WHERE slip_us IS NOT NULL AND transit_us IS NOT NULL GROUP BY seller_state, customer_state)"""
    disp_cat, disp_state = (f"""
        SELECT {key}, count(*) AS orders, {R(AVG_DAYS('handover_us'), 2)} AS avg_dispatch_days
        FROM {rows} WHERE has_carrier GROUP BY {key} HAVING orders >= 50"""
        for key, rows in (("category", "goods JOIN trips USING (order_id)"),
                          ("customer_state", "m_customers JOIN trips USING (customer_id)")))
    return {
        "r1_early_late_share": q(f"""WITH {TRIPS}
            SELECT count(*) AS orders, {PCT_WHEN('delay_days <= -1', 1)} AS early_pct,
                   {PCT_WHEN('delay_days > -1 AND delay_days <= 1', 1)} AS on_time_pct,
                   {PCT_WHEN('delay_days > 1', 1)} AS late_pct,
                   {R(AVG_INT('delay_days'), 1)} AS mean_delay_days
            FROM (SELECT {ROUNDED_SLIP} AS delay_days FROM trips WHERE slip_us IS NOT NULL)"""),
        "r2_review_by_late_tail": q(f"""WITH {TRIPS}
            SELECT {CASE_LE('delay_days', rp.TAIL_CUTS, rp.TAIL_LABELS)} AS delay_bucket, count(*) AS reviews,
                   {R(AVG_INT('review_score'), 2)} AS avg_score,
                   {PCT_WHEN('review_score = 1', 1)} AS pct_1star,
                   {PCT_WHEN('review_score = 5', 1)} AS pct_5star
            FROM (SELECT {ROUNDED_SLIP} AS delay_days, review_score
                  FROM m_order_reviews JOIN trips USING (order_id) WHERE slip_us IS NOT NULL)
            GROUP BY 1 ORDER BY 1"""),
        "r3_review_coverage": q(f"""
            SELECT count(*) AS orders,
                   count(*) FILTER (WHERE EXISTS (SELECT 1 FROM m_order_reviews r WHERE r.order_id = o.order_id))
                     AS reviewed_orders,
                   {PCT('count(*) FILTER (WHERE EXISTS (SELECT 1 FROM m_order_reviews r WHERE r.order_id = o.order_id))', 'count(*)', 1)}
                     AS coverage_pct
            FROM m_orders o WHERE order_delivered_customer_date IS NOT NULL"""),
        "r4_comment_rate_by_score": q(f"""
            SELECT review_score, count(*) AS reviews, {CW('review_comment_message IS NOT NULL')} AS with_comment,
                   {PCT_WHEN('review_comment_message IS NOT NULL', 1)} AS comment_pct
            FROM m_order_reviews GROUP BY review_score ORDER BY review_score"""),
        "r5_cancellation_summary": q(f"""
            SELECT count(*) AS orders, {CW("order_status = 'canceled'")} AS canceled,
                   {PCT_WHEN("order_status = 'canceled'", 2)} AS canceled_pct,
                   {CW("order_status = 'canceled' AND order_delivered_customer_date IS NOT NULL")}
                     AS canceled_after_delivery
            FROM m_orders"""),
        "r6_repeat_purchase": q(f"""
            WITH per_order AS (
              SELECT o.order_id, c.customer_unique_id,
                     (SELECT count(*) FROM m_order_reviews r WHERE r.order_id = o.order_id) AS nr,
                     (SELECT count(review_score) FROM m_order_reviews r WHERE r.order_id = o.order_id) AS ns,
                     (SELECT sum(review_score) FROM m_order_reviews r WHERE r.order_id = o.order_id) AS ss
              FROM m_orders o JOIN m_customers c ON o.customer_id = c.customer_id),
            per_buyer AS (
              SELECT customer_unique_id, count(*) AS n_orders, sum(nr) AS nr, sum(ns) AS ns, sum(ss) AS ss
              FROM per_order GROUP BY customer_unique_id),
            g AS (
              SELECT CASE WHEN n_orders >= 2 THEN 'repeat' ELSE 'single' END AS buyer_type,
                     count(*) AS buyers, CAST(sum(n_orders) AS BIGINT) AS orders,
                     CAST(coalesce(sum(nr), 0) AS BIGINT) AS reviews,
                     {R(DIV('CAST(sum(ss) AS BIGINT)', 'sum(ns)'), 2)} AS avg_review
              FROM per_buyer GROUP BY 1)
            SELECT buyer_type, buyers, {PCT('buyers', '(SELECT sum(buyers) FROM g)', 1)} AS buyer_pct,
                   orders, reviews, avg_review
            FROM g ORDER BY buyer_type"""),
        "r7_dispatch_days_by_category": q(f"WITH {TRIPS}, {GOODS} {disp_cat} ORDER BY avg_dispatch_days DESC, category NULLS FIRST"),
        "r8_dispatch_days_by_customer_state": q(f"WITH {TRIPS} {disp_state} ORDER BY avg_dispatch_days DESC, customer_state NULLS FIRST"),
        "r7_r8_dispatch_spread": q(f"""
            WITH {TRIPS}, {GOODS}, a AS ({disp_cat}), b AS ({disp_state})
            SELECT 'category' AS grouping, count(*) AS groups, min(avg_dispatch_days) AS min_days,
                   max(avg_dispatch_days) AS max_days,
                   {R('max(avg_dispatch_days) - min(avg_dispatch_days)', 2)} AS spread_days FROM a
            UNION ALL
            SELECT 'customer_state', count(*), min(avg_dispatch_days), max(avg_dispatch_days),
                   {R('max(avg_dispatch_days) - min(avg_dispatch_days)', 2)} FROM b"""),
        "r9_slow_sellers_vs_category": q(f"""
            WITH {TRIPS}, {GOODS},
            rows_ AS (SELECT seller_id, category, handover_us AS us
                      FROM goods JOIN trips USING (order_id) WHERE has_carrier),
            sc AS (SELECT seller_id, category, count(*) AS n, CAST(sum(us) AS BIGINT) AS s
                   FROM rows_ GROUP BY seller_id, category),
            cc AS (SELECT category, count(*) AS n, CAST(sum(us) AS BIGINT) AS s FROM rows_ GROUP BY category)
            SELECT sc.seller_id, sc.category, sc.n AS orders,
                   {R(f"{DIV('sc.s', 'sc.n')} / 86400000000.0e0", 1)} AS seller_dispatch_days,
                   {R(f"{DIV('cc.s', 'cc.n')} / 86400000000.0e0", 1)} AS category_dispatch_days,
                   {R(f"{DIV('sc.s', 'sc.n')} / 86400000000.0e0 - {DIV('cc.s', 'cc.n')} / 86400000000.0e0", 1)}
                     AS excess_days
            FROM sc JOIN cc ON sc.category IS NOT DISTINCT FROM cc.category
            WHERE sc.n >= 30
            ORDER BY excess_days DESC, orders DESC, seller_id, category NULLS FIRST LIMIT 10"""),
        "r10_lanes_from_origin": q(f"""
            WITH {lanes},
            top AS (SELECT seller_state FROM lanes GROUP BY seller_state
                    ORDER BY sum(n) DESC, seller_state LIMIT 1)
            SELECT l.seller_state AS from_state, l.customer_state AS to_state, l.n AS orders,
                   {R(f"{DIV('l.t', 'l.n')} / 86400000000.0e0", 1)} AS avg_transit_days,
                   {PCT('l.l', 'l.n', 1)} AS late_pct
            FROM lanes l JOIN top ON l.seller_state = top.seller_state
            ORDER BY avg_transit_days, to_state"""),
        "r11_late_by_destination_across_origins": q(f"""
            WITH {lanes},
            p AS (SELECT customer_state, CAST(l AS DOUBLE) * 100.0e0 / CAST(n AS DOUBLE) AS p FROM lanes WHERE n >= 30)
            SELECT customer_state AS to_state, count(*) AS origins, {R('min(p)', 1)} AS min_late_pct,
                   {R('avg(p)', 1)} AS avg_late_pct, {R('max(p)', 1)} AS max_late_pct
            FROM p GROUP BY customer_state ORDER BY min_late_pct DESC, to_state"""),
        "r12_early_breakdown": q(f"""WITH {TRIPS}
            SELECT early_bucket, count(*) AS orders,
                   {R(AVG_DAYS('handover_us'), 1)} AS avg_seller_days, {R(AVG_DAYS('transit_us'), 1)} AS avg_transit_days,
                   {R(AVG_DAYS('promise_us'), 1)} AS avg_promised_days, {R(AVG_DAYS('trip_us'), 1)} AS avg_actual_days
            FROM (SELECT *, {early_case} AS early_bucket
                  FROM (SELECT *, {ROUNDED_SLIP} AS delay_days FROM trips WHERE transit_us IS NOT NULL))
            WHERE early_bucket IS NOT NULL GROUP BY 1 ORDER BY 1"""),
        "r13_over_promise_by_state": q(_over_sql("customer_state", "m_customers JOIN trips USING (customer_id)")),
        "r14_over_promise_by_category": q(_over_sql("category", "goods JOIN trips USING (order_id)")),
    }


def _over_sql(key: str, rows: str) -> str:
    pr = f"{DIV('CAST(sum(promise_us) AS BIGINT)', 'count(*)')} / 86400000000.0e0"
    ac = f"{DIV('CAST(sum(trip_us) AS BIGINT)', 'count(*)')} / 86400000000.0e0"
    return f"""WITH {TRIPS}, {GOODS}
        SELECT {key}, count(*) AS orders, {PCT_WHEN('delay_days <= -15', 1)} AS early_pct,
               {R(pr, 1)} AS avg_promised_days, {R(ac, 1)} AS avg_actual_days,
               {R(f'{pr} - {ac}', 1)} AS over_days
        FROM (SELECT *, {ROUNDED_SLIP} AS delay_days FROM {rows} WHERE slip_us IS NOT NULL)
        GROUP BY {key} ORDER BY early_pct DESC, {key} NULLS FIRST"""
