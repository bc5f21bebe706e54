"""Delivery-delay analyses (K11-K22): how early or late orders arrive against
the promised date, and where the delay comes from.

Conventions (SURVEY §2.11): ``delay`` is delivered minus estimated in days;
``delay_days`` is that value rounded half away from zero; "ND" means delivered
and estimated dates are both present. Counts named ``orders`` count joined
rows (items, or items times reviews), as the source queries do.

Plan shape. Wherever the source joins a fan-out table only to count rows or
average over them (reviews per order, items per product), the fan-out side is
first reduced to one row per join key (count, sums) and the join is made on
that: the result equals the multiplied join, but no row explosion is shuffled
and a hot key arrives pre-aggregated. Dimension lookups (products, sellers,
customers) are joined after reducing the fact side to one row per dimension
key, so the dimension join moves one row per key instead of one per item.
Broadcasting is left to Spark's size checks (static stats and AQE at run time).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import (
    avg_days, avg_int, bucket, count_when, is_late, micros_between, pct, rnd,
    whole_days, MICROS_PER_DAY,
)
from ..tables import Tables

# Delay bucket cut-offs (rounded days) and labels, K13/K14.
DELAY_CUTS = (-15, -7, -1, 1, 7, 14)
DELAY_LABELS = (
    "A. 15+ days early",
    "B. 7-14 days early",
    "C. 1-6 days early",
    "D. on time (+-1 day)",
    "E. 1-7 days late",
    "F. 7-14 days late",
    "G. 15+ days late",
)
# Promised-duration buckets (rounded days), K16.
PROMISE_CUTS = (7, 14, 21, 30)
PROMISE_LABELS = ("A. <=7 days", "B. 8-14 days", "C. 15-21 days", "D. 22-30 days", "E. 31+ days")
# Delay buckets of the cause split, K17.
CAUSE_CUTS = (-7, -1, 1, 7)
CAUSE_LABELS = ("A. 7+ days early", "B. 1-6 days early", "C. on time (+-1 day)",
                "D. 1-7 days late", "E. 7+ days late")
# Product weight buckets in grams, K21.
WEIGHT_CUTS = (500, 2000, 5000, 10000)
WEIGHT_LABELS = ("A. <=500g", "B. 500g-2kg", "C. 2-5kg", "D. 5-10kg", "E. 10kg+")

DELIVERED = "order_delivered_customer_date"
ESTIMATED = "order_estimated_delivery_date"
CARRIER = "order_delivered_carrier_date"
PURCHASE = "order_purchase_timestamp"


def order_facts(orders: DataFrame) -> DataFrame:
    """Orders with every duration the analyses use, in microseconds."""
    return orders.select(
        "order_id", "customer_id", "order_status", PURCHASE, CARRIER, DELIVERED, ESTIMATED,
        micros_between(DELIVERED, ESTIMATED).alias("delay_us"),
        whole_days(DELIVERED, ESTIMATED).alias("delay_days"),
        micros_between(CARRIER, PURCHASE).alias("seller_us"),
        micros_between(DELIVERED, CARRIER).alias("transit_us"),
        micros_between(DELIVERED, PURCHASE).alias("total_us"),
        micros_between(ESTIMATED, PURCHASE).alias("promised_us"),
        is_late(DELIVERED, ESTIMATED).alias("late"),
    )


def delivered_and_promised(df: DataFrame, *extra: str) -> DataFrame:
    """Keep rows whose delivered and estimated dates (and ``extra``) are present."""
    cond = F.col(DELIVERED).isNotNull() & F.col(ESTIMATED).isNotNull()
    for c in extra:
        cond = cond & F.col(c).isNotNull()
    return df.filter(cond)


def nd_orders(t: Tables, *extra: str) -> DataFrame:
    return delivered_and_promised(order_facts(t.orders), *extra)


def delay_bucket(c: str | Column = "delay_days") -> Column:
    return bucket(c, DELAY_CUTS, DELAY_LABELS)


def review_totals(reviews: DataFrame) -> DataFrame:
    """One row per order: review rows, scored rows, score sum, 1- and 5-star rows."""
    s = F.col("review_score")
    return reviews.groupBy("order_id").agg(
        F.count(F.lit(1)).alias("n_reviews"),
        F.count(s).alias("n_scored"),
        F.sum(s.cast("bigint")).alias("score_sum"),
        count_when(s == 1).alias("n_1star"),
        count_when(s == 5).alias("n_5star"),
    )


def _ratio(num: Column, den: Column) -> Column:
    return F.try_divide(num.cast("double"), den.cast("double"))


# ------------------------------------------------------------------ K11-K13
def delay_histogram(t: Tables) -> DataFrame:
    """Orders per rounded delay day, ascending."""
    return (nd_orders(t).groupBy("delay_days").agg(F.count(F.lit(1)).alias("cnt"))
            .orderBy("delay_days"))


def delay_mean(t: Tables) -> DataFrame:
    """Number of ND orders and the mean of their rounded delay (one row)."""
    return nd_orders(t).agg(
        F.count(F.lit(1)).alias("orders"),
        rnd(avg_int("delay_days"), 1).alias("mean_delay_days"))


def delay_buckets(t: Tables) -> DataFrame:
    """ND orders per delay bucket; ``pct`` is over all orders with a
    delivered date (the estimate is not required in the denominator).

    One pass: delivered orders are grouped by bucket, with orders lacking an
    estimate in a NULL group; the denominator is the total over these (at
    most eight) group rows, and the NULL group is dropped afterwards.
    """
    x = order_facts(t.orders).filter(F.col(DELIVERED).isNotNull())
    b = F.when(F.col(ESTIMATED).isNotNull(), delay_bucket())
    per_bucket = x.groupBy(b.alias("delay_bucket")).agg(F.count(F.lit(1)).alias("cnt"))
    total = F.sum("cnt").over(Window.partitionBy(F.lit(0)))
    return (per_bucket.select("delay_bucket", "cnt", pct(F.col("cnt"), total, 1).alias("pct"))
            .filter(F.col("delay_bucket").isNotNull())
            .orderBy("delay_bucket"))


def delay_bucket_reviews(t: Tables) -> DataFrame:
    """Review score by delay bucket (orders joined with their reviews)."""
    rv = review_totals(t.order_reviews)
    x = nd_orders(t).select("order_id", "delay_days").join(rv, "order_id")
    return (x.groupBy(delay_bucket().alias("delay_bucket"))
            .agg(F.sum("n_reviews").alias("reviews"),
                 rnd(_ratio(F.sum("score_sum"), F.sum("n_scored")), 2).alias("avg_score"),
                 pct(F.sum("n_1star"), F.sum("n_reviews"), 1).alias("pct_1star"),
                 pct(F.sum("n_5star"), F.sum("n_reviews"), 1).alias("pct_5star"))
            .orderBy("delay_bucket"))


# ------------------------------------------------------------------ K15-K17
def status_distribution(t: Tables) -> DataFrame:
    """Orders per status with the share of all orders (the total is
    summed over the handful of status rows, not over orders)."""
    per = t.orders.groupBy("order_status").agg(F.count(F.lit(1)).alias("cnt"))
    total = F.sum("cnt").over(Window.partitionBy(F.lit(0)))
    return (per.select("order_status", "cnt", pct(F.col("cnt"), total, 1).alias("pct"))
            .orderBy(F.col("cnt").desc(), "order_status"))


def cancel_rate_by_promise(t: Tables) -> DataFrame:
    """Cancellation rate by promised duration (rounded days)."""
    est_days = F.round(F.col("promised_us") / F.lit(MICROS_PER_DAY), 0)
    x = order_facts(t.orders).filter(F.col(ESTIMATED).isNotNull())
    return (x.groupBy(bucket(est_days, PROMISE_CUTS, PROMISE_LABELS).alias("estimated_delivery_bucket"))
            .agg(F.count(F.lit(1)).alias("total_orders"),
                 count_when(F.col("order_status") == "canceled").alias("canceled"),
                 pct(count_when(F.col("order_status") == "canceled"), F.count(F.lit(1)), 2)
                 .alias("cancel_rate_pct"))
            .orderBy("estimated_delivery_bucket"))


def delay_cause_split(t: Tables) -> DataFrame:
    """Seller dispatch vs carrier transit time by delay bucket."""
    x = nd_orders(t, CARRIER)
    return (x.groupBy(bucket("delay_days", CAUSE_CUTS, CAUSE_LABELS).alias("delay_bucket"))
            .agg(F.count(F.lit(1)).alias("cnt"),
                 rnd(avg_days("seller_us"), 1).alias("avg_seller_days"),
                 rnd(avg_days("transit_us"), 1).alias("avg_transit_days"),
                 rnd(avg_days("total_us"), 1).alias("avg_total_days"))
            .orderBy("delay_bucket"))


# ------------------------------------------------------------------ K18-K22
def _delay_sums(df: DataFrame, *keys: str, w: Column | None = None) -> DataFrame:
    """Partial sums per key so that means can be finished after a later join."""
    w = F.lit(1) if w is None else w
    d = F.col("delay_us")
    return df.groupBy(*keys).agg(
        F.sum(w).cast("bigint").alias("_n"),
        F.sum(d.cast("decimal(20,0)") * w.cast("decimal(12,0)")).alias("_delay_sum"),
        F.sum(F.when(d.isNotNull(), w).otherwise(0)).cast("bigint").alias("_delay_n"),
        F.sum(F.when(F.col("late"), w).otherwise(0)).cast("bigint").alias("_late_n"),
    )


def _finish_delay() -> list[Column]:
    n = F.sum("_n")
    return [n.alias("orders"),
            rnd(_ratio(F.sum("_delay_sum"), F.sum("_delay_n")) / F.lit(MICROS_PER_DAY), 1).alias("avg_delay"),
            pct(F.sum("_late_n"), n, 1).alias("late_pct")]


def delay_by_customer_state(t: Tables, min_orders: int = 100) -> DataFrame:
    """Mean delay and late share by customer state (states with enough orders)."""
    per_customer = _delay_sums(nd_orders(t), "customer_id")
    x = per_customer.join(t.customers.select("customer_id", "customer_state"), "customer_id")
    return (x.groupBy("customer_state").agg(*_finish_delay())
            .filter(F.col("orders") >= min_orders)
            .orderBy(F.col("avg_delay").desc(), F.col("orders").desc(), "customer_state"))


def slowest_lanes(t: Tables, min_orders: int = 50, k: int = 10) -> DataFrame:
    """Seller state -> customer state lanes with the largest mean delay."""
    # items join orders on the order id first (co-located when bucketed), then
    # rows are reduced per (seller, customer) before the two state lookups
    x = (nd_orders(t).select("order_id", "customer_id", "delay_us", "total_us")
         .join(t.item_rows.select("order_id", "seller_id"), "order_id"))
    per_pair = x.groupBy("seller_id", "customer_id").agg(
        F.count(F.lit(1)).alias("_n"),
        F.sum(F.col("delay_us").cast("decimal(38,0)")).alias("_d"),
        F.sum(F.col("total_us").cast("decimal(38,0)")).alias("_t"))
    per_seller = (per_pair.join(t.customers.select("customer_id", "customer_state"), "customer_id")
                  .groupBy("seller_id", "customer_state")
                  .agg(F.sum("_n").alias("_n"), F.sum("_d").alias("_d"), F.sum("_t").alias("_t")))
    lanes = (per_seller.join(t.sellers.select("seller_id", "seller_state"), "seller_id")
             .groupBy(F.col("seller_state").alias("from_state"), F.col("customer_state").alias("to_state"))
             .agg(F.sum("_n").alias("orders"),
                  rnd(_ratio(F.sum("_d"), F.sum("_n")) / F.lit(MICROS_PER_DAY), 1).alias("avg_delay"),
                  rnd(_ratio(F.sum("_t"), F.sum("_n")) / F.lit(MICROS_PER_DAY), 1).alias("avg_total_days")))
    return (lanes.filter(F.col("orders") >= min_orders)
            .orderBy(F.col("avg_delay").desc(), F.col("orders").desc(), "from_state", "to_state")
            .limit(k))


def _category(products: DataFrame, translation: DataFrame) -> DataFrame:
    """product_id -> English category name, else the source name."""
    return (products.join(translation, "product_category_name", "left")
            .select("product_id", "product_weight_g",
                    F.coalesce("product_category_name_english", "product_category_name").alias("category")))


def slowest_categories(t: Tables, min_orders: int = 50, k: int = 10) -> DataFrame:
    """Categories with the largest mean delay, with weight and review score.

    Rows are item x review (left join), as in the source; the review side is
    reduced to one row per order first and each item row is weighted by its
    number of reviews (at least 1).
    """
    rv = review_totals(t.order_reviews).select("order_id", "n_reviews", "n_scored", "score_sum")
    x = (nd_orders(t).select("order_id", "delay_us")
         .join(t.item_rows.select("order_id", "product_id"), "order_id")
         .join(rv, "order_id", "left"))
    w = F.greatest(F.coalesce(F.col("n_reviews"), F.lit(0)), F.lit(1)).cast("bigint")
    per_product = x.groupBy("product_id").agg(
        F.sum(w).alias("_n"),
        F.sum(F.col("delay_us").cast("decimal(20,0)") * w.cast("decimal(12,0)")).alias("_d"),
        F.sum(F.coalesce("n_scored", F.lit(0))).cast("bigint").alias("_rn"),
        F.sum(F.coalesce("score_sum", F.lit(0))).cast("bigint").alias("_rs"))
    cat = _category(t.products, t.category_translation)
    y = per_product.join(cat, "product_id")
    wt = F.col("product_weight_g").cast("bigint")
    res = y.groupBy("category").agg(
        F.sum("_n").alias("orders"),
        rnd(_ratio(F.sum("_d"), F.sum("_n")) / F.lit(MICROS_PER_DAY), 1).alias("avg_delay"),
        rnd(_ratio(F.sum(wt * F.col("_n")), F.sum(F.when(wt.isNotNull(), F.col("_n")))), 0).alias("avg_weight_g"),
        rnd(_ratio(F.sum("_rs"), F.sum("_rn")), 2).alias("avg_review"))
    return (res.filter(F.col("orders") >= min_orders)
            .orderBy(F.col("avg_delay").desc(), F.col("orders").desc(), F.col("category").asc_nulls_first())
            .limit(k))


def delay_by_weight(t: Tables) -> DataFrame:
    """Delay and late share by product weight bucket (weight known)."""
    x = (nd_orders(t).select("order_id", "delay_us", "late")
         .join(t.item_rows.select("order_id", "product_id"), "order_id"))
    per_product = _delay_sums(x, "product_id")
    p = t.products.filter(F.col("product_weight_g").isNotNull()).select("product_id", "product_weight_g")
    y = per_product.join(p, "product_id")
    return (y.groupBy(bucket("product_weight_g", WEIGHT_CUTS, WEIGHT_LABELS).alias("weight_bucket"))
            .agg(*_finish_delay())
            .orderBy("weight_bucket"))


def chronic_late_sellers(t: Tables, min_orders: int = 30, k: int = 10) -> DataFrame:
    """Sellers with the largest mean delay (items x reviews rows)."""
    rv = review_totals(t.order_reviews).select("order_id", "n_reviews", "n_scored", "score_sum")
    x = (nd_orders(t, CARRIER).select("order_id", "delay_us", "late", "seller_us")
         .join(t.item_rows.select("order_id", "seller_id"), "order_id")
         .join(rv, "order_id", "left"))
    w = F.greatest(F.coalesce(F.col("n_reviews"), F.lit(0)), F.lit(1)).cast("bigint")
    per_seller = x.groupBy("seller_id").agg(
        F.sum(w).alias("_n"),
        F.sum(F.col("delay_us").cast("decimal(20,0)") * w.cast("decimal(12,0)")).alias("_d"),
        F.sum(F.when(F.col("late"), w).otherwise(0)).cast("bigint").alias("_late"),
        F.sum(F.col("seller_us").cast("decimal(20,0)") * w.cast("decimal(12,0)")).alias("_s"),
        F.sum(F.coalesce("n_scored", F.lit(0))).cast("bigint").alias("_rn"),
        F.sum(F.coalesce("score_sum", F.lit(0))).cast("bigint").alias("_rs"))
    top = (per_seller.filter(F.col("_n") >= min_orders)
           .select("seller_id",
                   F.col("_n").alias("orders"),
                   rnd(_ratio(F.col("_d"), F.col("_n")) / F.lit(MICROS_PER_DAY), 1).alias("avg_delay"),
                   pct(F.col("_late"), F.col("_n"), 1).alias("late_pct"),
                   rnd(_ratio(F.col("_s"), F.col("_n")) / F.lit(MICROS_PER_DAY), 1).alias("avg_seller_days"),
                   rnd(_ratio(F.col("_rs"), F.col("_rn")), 2).alias("avg_review")))
    res = top.join(t.sellers.select("seller_id", "seller_city", "seller_state"), "seller_id")
    return (res.select("seller_id", "seller_city", "seller_state", "orders", "avg_delay", "late_pct",
                       "avg_seller_days", "avg_review")
            .orderBy(F.col("avg_delay").desc(), F.col("orders").desc(), "seller_id")
            .limit(k))
