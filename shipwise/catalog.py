"""Registry of named queries: Spark callables and their DuckDB oracles.

Every callable takes ``(spark, sf_dir)``, derives the nine tables from the
driver's star schema and runs one analysis over the whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .operators import checks as ck
from .operators import delivery as dl
from .operators import explore as ex
from .operators import model_reports as mr
from .operators import report as rp
from .sources.star import star_tables
from .tables import Tables

Query = Callable[[SparkSession, str], DataFrame]


def _on_tables(fn: Callable[[Tables], DataFrame]) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(star_tables(spark, sf_dir))
    run.__name__ = getattr(fn, "__name__", "query")
    run.__doc__ = fn.__doc__
    return run


def table_queries() -> dict[str, Callable[[Tables], DataFrame]]:
    """Name -> operator over a ``Tables`` bundle."""
    out: dict[str, Callable[[Tables], DataFrame]] = {
        "a4_row_counts": ck.row_counts,
        "a5_key_violations": ck.key_violations,
        "a6_orphan_rows": ck.orphan_rows,
        "k1_status_counts": ex.status_counts,
        "k2_payment_mix": ex.payment_mix,
        "k3_top_categories_by_revenue": ex.top_categories_by_revenue,
        "k4_lowest_rated_categories": ex.lowest_rated_categories,
        "k5_late_vs_on_time_reviews": ex.late_vs_on_time_reviews,
        "k6_monthly_revenue": ex.monthly_revenue,
        "k7_spend_by_state": ex.spend_by_state,
        "k9_pick_story_order": ex.pick_story_order,
        "k10_order_story": ex.order_story,
        "k10_one_order_story": ex.one_order_story,
        "k11_delay_histogram": dl.delay_histogram,
        "k12_delay_mean": dl.delay_mean,
        "k13_delay_buckets": dl.delay_buckets,
        "k14_delay_bucket_reviews": dl.delay_bucket_reviews,
        "k15_status_distribution": dl.status_distribution,
        "k16_cancel_rate_by_promise": dl.cancel_rate_by_promise,
        "k17_delay_cause_split": dl.delay_cause_split,
        "k18_delay_by_customer_state": dl.delay_by_customer_state,
        "k19_slowest_lanes": dl.slowest_lanes,
        "k20_slowest_categories": dl.slowest_categories,
        "k21_delay_by_weight": dl.delay_by_weight,
        "k22_chronic_late_sellers": dl.chronic_late_sellers,
        "r1_early_late_share": rp.early_late_share,
        "r2_review_by_late_tail": rp.review_by_late_tail,
        "r3_review_coverage": rp.review_coverage,
        "r4_comment_rate_by_score": rp.comment_rate_by_score,
        "r5_cancellation_summary": rp.cancellation_summary,
        "r6_repeat_purchase": rp.repeat_purchase,
        "r7_dispatch_days_by_category": rp.dispatch_days_by_category,
        "r8_dispatch_days_by_customer_state": rp.dispatch_days_by_customer_state,
        "r7_r8_dispatch_spread": rp.dispatch_spread,
        "r9_slow_sellers_vs_category": rp.slow_sellers_vs_category,
        "r10_lanes_from_origin": rp.lanes_from_origin,
        "r11_late_by_destination_across_origins": rp.late_by_destination_across_origins,
        "r12_early_breakdown": rp.early_breakdown,
        "r13_over_promise_by_state": rp.over_promise_by_state,
        "r14_over_promise_by_category": rp.over_promise_by_category,
    }
    out.update(mr.queries())
    out.update(mr.boosted_queries())
    for name in ("customers", "orders", "order_items", "products", "category_translation",
                 "order_payments", "order_reviews", "sellers"):
        out[f"a11_preview_{name}"] = _preview(name)
    return out


def _preview(name: str) -> Callable[[Tables], DataFrame]:
    def fn(t: Tables) -> DataFrame:
        return ex.previews(t, [name])[name]
    fn.__name__ = f"preview_{name}"
    fn.__doc__ = f"A11: preview of {name} in key order."
    return fn


def queries() -> dict[str, Query]:
    return {name: _on_tables(fn) for name, fn in table_queries().items()}


def oracle_sql() -> dict[str, str]:
    from .oracle import delivery_sql, explore_sql, model_sql, report_sql
    out: dict[str, str] = {}
    out.update(model_sql.sqls())
    out.update(report_sql.sqls())
    out.update(explore_sql.sqls())
    out.update(delivery_sql.sqls())
    return out
