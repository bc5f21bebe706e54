"""Analyses published in the report without code.

Semantics are read from the report's table headings (SURVEY §2.12); every
threshold is a parameter. All are aggregations over joins; item-level
questions are summed per product (or per seller and product) before the
product dimension is joined, so that join moves one row per key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import MICROS_PER_DAY, bucket, count_when, pct, rnd
from ..tables import Tables
from .delivery import CARRIER, DELAY_LABELS, DELIVERED, nd_orders, order_facts, review_totals


def _ratio(num: Column, den: Column) -> Column:
    return F.try_divide(num.cast("double"), den.cast("double"))


def _days(sum_us: Column, n: Column) -> Column:
    return _ratio(sum_us, n) / F.lit(MICROS_PER_DAY)


def _dsum(c: str) -> Column:
    return F.sum(F.col(c).cast("decimal(38,0)"))


def _category(t: Tables) -> DataFrame:
    return (t.products.select("product_id", "product_category_name")
            .join(t.category_translation, "product_category_name", "left")
            .select("product_id",
                    F.coalesce("product_category_name_english", "product_category_name").alias("category")))


# ---------------------------------------------------------------- R1-R6
def early_late_share(t: Tables) -> DataFrame:
    """Share of ND orders arriving early (A-C), on time (D), late (E-G),
    and the mean rounded delay."""
    d = F.col("delay_days")
    n = F.count(F.lit(1))
    return nd_orders(t).agg(
        n.alias("orders"),
        pct(count_when(d <= -1), n, 1).alias("early_pct"),
        pct(count_when((d > -1) & (d <= 1)), n, 1).alias("on_time_pct"),
        pct(count_when(d > 1), n, 1).alias("late_pct"),
        rnd(_ratio(F.sum(d), F.count(d)), 1).alias("mean_delay_days"))


# The late tail merged into one bucket (R2).
TAIL_CUTS = (-15, -7, -1, 1, 7)
TAIL_LABELS = DELAY_LABELS[:5] + ("F. 7+ days late",)


def review_by_late_tail(t: Tables) -> DataFrame:
    """R2: K14 with the two longest-late buckets merged (8+ days late)."""
    rv = review_totals(t.order_reviews)
    x = nd_orders(t).select("order_id", "delay_days").join(rv, "order_id")
    return (x.groupBy(bucket("delay_days", TAIL_CUTS, TAIL_LABELS).alias("delay_bucket"))
            .agg(F.sum("n_reviews").alias("reviews"),
                 rnd(_ratio(F.sum("score_sum"), F.sum("n_scored")), 2).alias("avg_score"),
                 pct(F.sum("n_1star"), F.sum("n_reviews"), 1).alias("pct_1star"),
                 pct(F.sum("n_5star"), F.sum("n_reviews"), 1).alias("pct_5star"))
            .orderBy("delay_bucket"))


def review_coverage(t: Tables) -> DataFrame:
    """Delivered orders (delivered date present) having at least one review."""
    o = t.orders.filter(F.col(DELIVERED).isNotNull()).select("order_id")
    has = t.order_reviews.select("order_id").distinct().withColumn("_r", F.lit(1))
    x = o.join(has, "order_id", "left")
    n = F.count(F.lit(1))
    return x.agg(n.alias("orders"), F.count("_r").alias("reviewed_orders"),
                 pct(F.count("_r"), n, 1).alias("coverage_pct"))


def comment_rate_by_score(t: Tables) -> DataFrame:
    """Share of reviews with a comment, by score."""
    n = F.count(F.lit(1))
    has = F.col("review_comment_message").isNotNull()
    return (t.order_reviews.groupBy("review_score")
            .agg(n.alias("reviews"), count_when(has).alias("with_comment"),
                 pct(count_when(has), n, 1).alias("comment_pct"))
            .orderBy("review_score"))


def cancellation_summary(t: Tables) -> DataFrame:
    """Canceled orders, their share, and those canceled after delivery."""
    n = F.count(F.lit(1))
    canceled = F.col("order_status") == "canceled"
    return t.orders.agg(
        n.alias("orders"), count_when(canceled).alias("canceled"),
        pct(count_when(canceled), n, 2).alias("canceled_pct"),
        count_when(canceled & F.col(DELIVERED).isNotNull()).alias("canceled_after_delivery"))


def repeat_purchase(t: Tables, min_orders: int = 2) -> DataFrame:
    """Buyers (``customer_unique_id``) with at least ``min_orders`` orders
    vs the rest: number and share of buyers, their reviews and mean score."""
    rv = review_totals(t.order_reviews).select("order_id", "n_reviews", "n_scored", "score_sum")
    o = (t.orders.select("order_id", "customer_id").join(rv, "order_id", "left")
         .groupBy("customer_id").agg(F.count(F.lit(1)).alias("_o"),
                                     F.sum("n_reviews").alias("_r"), F.sum("n_scored").alias("_sn"),
                                     F.sum("score_sum").alias("_ss")))
    per_buyer = (o.join(t.customers.select("customer_id", "customer_unique_id"), "customer_id")
                 .groupBy("customer_unique_id")
                 .agg(F.sum("_o").alias("_o"), F.sum("_r").alias("_r"),
                      F.sum("_sn").alias("_sn"), F.sum("_ss").alias("_ss")))
    kind = F.when(F.col("_o") >= min_orders, "repeat").otherwise("single")
    res = per_buyer.groupBy(kind.alias("buyer_type")).agg(
        F.count(F.lit(1)).alias("buyers"), F.sum("_o").cast("bigint").alias("orders"),
        F.coalesce(F.sum("_r"), F.lit(0)).cast("bigint").alias("reviews"),
        rnd(_ratio(F.sum("_ss"), F.sum("_sn")), 2).alias("avg_review"))
    total = F.sum("buyers").over(Window.partitionBy(F.lit(0)))  # over the two group rows
    return (res.select("buyer_type", "buyers", pct(F.col("buyers"), total, 1).alias("buyer_pct"),
                       "orders", "reviews", "avg_review")
            .orderBy("buyer_type"))


# ---------------------------------------------------------------- R7-R9
def _dispatch_items(t: Tables) -> DataFrame:
    """Item rows of orders with a carrier scan: order, product, seller, dispatch us."""
    o = order_facts(t.orders).filter(F.col(CARRIER).isNotNull()).select("order_id", "seller_us")
    return o.join(t.item_rows.select("order_id", "product_id", "seller_id"), "order_id")


def dispatch_days_by_category(t: Tables, min_orders: int = 50) -> DataFrame:
    """Mean seller dispatch days (purchase -> carrier) per category (item rows)."""
    per_product = _dispatch_items(t).groupBy("product_id").agg(
        F.count(F.lit(1)).alias("_n"), _dsum("seller_us").alias("_s"))
    res = (per_product.join(_category(t), "product_id").groupBy("category")
           .agg(F.sum("_n").alias("orders"), rnd(_days(F.sum("_s"), F.sum("_n")), 2).alias("avg_dispatch_days")))
    return (res.filter(F.col("orders") >= min_orders)
            .orderBy(F.col("avg_dispatch_days").desc(), F.col("category").asc_nulls_first()))


def dispatch_days_by_customer_state(t: Tables, min_orders: int = 50) -> DataFrame:
    """Mean seller dispatch days per customer state (order rows)."""
    o = order_facts(t.orders).filter(F.col(CARRIER).isNotNull())
    per_customer = o.groupBy("customer_id").agg(F.count(F.lit(1)).alias("_n"), _dsum("seller_us").alias("_s"))
    res = (per_customer.join(t.customers.select("customer_id", "customer_state"), "customer_id")
           .groupBy("customer_state")
           .agg(F.sum("_n").alias("orders"), rnd(_days(F.sum("_s"), F.sum("_n")), 2).alias("avg_dispatch_days")))
    return (res.filter(F.col("orders") >= min_orders)
            .orderBy(F.col("avg_dispatch_days").desc(), F.col("customer_state").asc_nulls_first()))


def dispatch_spread(t: Tables, min_orders: int = 50) -> DataFrame:
    """R7/R8 together: range of the mean dispatch days across categories and
    across customer states (the report's hypothesis check), one row each."""
    def spread(df: DataFrame, by: str) -> DataFrame:
        return df.agg(F.lit(by).alias("grouping"), F.count(F.lit(1)).alias("groups"),
                      F.min("avg_dispatch_days").alias("min_days"),
                      F.max("avg_dispatch_days").alias("max_days"),
                      rnd(F.max("avg_dispatch_days") - F.min("avg_dispatch_days"), 2).alias("spread_days"))
    return spread(dispatch_days_by_category(t, min_orders), "category").unionByName(
        spread(dispatch_days_by_customer_state(t, min_orders), "customer_state"))


def slow_sellers_vs_category(t: Tables, min_orders: int = 30, k: int = 10) -> DataFrame:
    """Sellers whose mean dispatch days in a category most exceed that
    category's mean (item rows)."""
    per_sp = _dispatch_items(t).groupBy("seller_id", "product_id").agg(
        F.count(F.lit(1)).alias("_n"), _dsum("seller_us").alias("_s"))
    per_sc = (per_sp.join(_category(t), "product_id").groupBy("seller_id", "category")
              .agg(F.sum("_n").alias("_n"), F.sum("_s").alias("_s")))
    # over the reduced rows (one a seller and category), which are planned once
    of_category = Window.partitionBy("category")
    x = (per_sc.withColumn("_cn", F.sum("_n").over(of_category)).withColumn("_cs", F.sum("_s").over(of_category))
         .filter(F.col("_n") >= min_orders))
    seller_days = _days(F.col("_s"), F.col("_n"))
    cat_days = _days(F.col("_cs"), F.col("_cn"))
    return (x.select("seller_id", "category", F.col("_n").alias("orders"),
                     rnd(seller_days, 1).alias("seller_dispatch_days"),
                     rnd(cat_days, 1).alias("category_dispatch_days"),
                     rnd(seller_days - cat_days, 1).alias("excess_days"))
            .orderBy(F.col("excess_days").desc(), F.col("orders").desc(), "seller_id",
                     F.col("category").asc_nulls_first())
            .limit(k))


# ---------------------------------------------------------------- R10-R11
def _lane_sums(t: Tables) -> DataFrame:
    """Per (seller state, customer state): item rows of ND orders with a
    carrier scan, summed transit microseconds and raw-late rows.

    Items join orders on the order id first (co-located when bucketed), rows
    are reduced per (seller, customer), and only then the two state lookups.
    """
    x = (nd_orders(t, CARRIER).select("order_id", "customer_id", "transit_us", "late")
         .join(t.item_rows.select("order_id", "seller_id"), "order_id"))
    per_pair = x.groupBy("seller_id", "customer_id").agg(
        F.count(F.lit(1)).alias("_n"), _dsum("transit_us").alias("_t"), count_when(F.col("late")).alias("_l"))
    per_seller = (per_pair.join(t.customers.select("customer_id", "customer_state"), "customer_id")
                  .groupBy("seller_id", "customer_state")
                  .agg(F.sum("_n").alias("_n"), F.sum("_t").alias("_t"), F.sum("_l").alias("_l")))
    return (per_seller.join(t.sellers.select("seller_id", "seller_state"), "seller_id")
            .groupBy("seller_state", "customer_state")
            .agg(F.sum("_n").alias("_n"), F.sum("_t").alias("_t"), F.sum("_l").alias("_l")))


def lanes_from_origin(t: Tables, origin: str | None = None, min_orders: int = 1) -> DataFrame:
    """Transit days and late share by destination for one seller state.

    ``origin=None`` takes the seller state with the most lane rows (the
    source's example is its largest origin), by windows over the reduced rows
    (one a pair of states), which are planned once.
    """
    lanes = _lane_sums(t)
    if origin is None:
        most = Window.orderBy(F.col("_tot").desc(), F.col("seller_state").asc_nulls_first())
        lanes = (lanes.filter(F.col("seller_state").isNotNull())
                 .withColumn("_tot", F.sum("_n").over(Window.partitionBy("seller_state")))
                 .withColumn("_place", F.dense_rank().over(most)).filter(F.col("_place") == 1))
    else:
        lanes = lanes.filter(F.col("seller_state") == F.lit(origin))
    return (lanes.filter(F.col("_n") >= min_orders)
            .select(F.col("seller_state").alias("from_state"), F.col("customer_state").alias("to_state"),
                    F.col("_n").alias("orders"), rnd(_days(F.col("_t"), F.col("_n")), 1).alias("avg_transit_days"),
                    pct(F.col("_l"), F.col("_n"), 1).alias("late_pct"))
            .orderBy("avg_transit_days", "to_state"))


def late_by_destination_across_origins(t: Tables, min_orders: int = 30) -> DataFrame:
    """Per destination, the late share of each sufficiently used lane
    summarised over origins (min / mean / max), highest minimum first."""
    lanes = (_lane_sums(t).filter(F.col("_n") >= min_orders)
             .select("customer_state", _ratio(F.col("_l") * F.lit(100.0), F.col("_n")).alias("_p")))
    return (lanes.groupBy(F.col("customer_state").alias("to_state"))
            .agg(F.count(F.lit(1)).alias("origins"),
                 rnd(F.min("_p"), 1).alias("min_late_pct"),
                 rnd(F.avg("_p"), 1).alias("avg_late_pct"),
                 rnd(F.max("_p"), 1).alias("max_late_pct"))
            .orderBy(F.col("min_late_pct").desc(), "to_state"))


# ---------------------------------------------------------------- R12-R14
# Early-arrival buckets of the report (rounded delay days).
EARLY_CUTS = (-25, -15, -7, -1)
EARLY_LABELS = ("D. 25+ days early", "C. 15-24 days early", "B. 7-14 days early", "A. 1-6 days early")


def early_breakdown(t: Tables) -> DataFrame:
    """For early arrivals, mean dispatch, transit, promised and actual days."""
    d = F.col("delay_days")
    b = (F.when(d <= EARLY_CUTS[0], EARLY_LABELS[0]).when(d <= EARLY_CUTS[1], EARLY_LABELS[1])
         .when(d <= EARLY_CUTS[2], EARLY_LABELS[2]).when(d <= EARLY_CUTS[3], EARLY_LABELS[3]))
    x = nd_orders(t, CARRIER).withColumn("early_bucket", b).filter(F.col("early_bucket").isNotNull())
    n = F.count(F.lit(1))
    return (x.groupBy("early_bucket")
            .agg(n.alias("orders"),
                 rnd(_days(_dsum("seller_us"), n), 1).alias("avg_seller_days"),
                 rnd(_days(_dsum("transit_us"), n), 1).alias("avg_transit_days"),
                 rnd(_days(_dsum("promised_us"), n), 1).alias("avg_promised_days"),
                 rnd(_days(_dsum("total_us"), n), 1).alias("avg_actual_days"))
            .orderBy("early_bucket"))


def _over_promise(df: DataFrame, key: str, early: int, min_orders: int) -> DataFrame:
    n = F.sum("_n")
    promised, actual = _days(F.sum("_p"), n), _days(F.sum("_a"), n)
    return (df.groupBy(key)
            .agg(n.alias("orders"), pct(F.sum("_e"), n, 1).alias("early_pct"),
                 rnd(promised, 1).alias("avg_promised_days"), rnd(actual, 1).alias("avg_actual_days"),
                 rnd(promised - actual, 1).alias("over_days"))
            .filter(F.col("orders") >= min_orders)
            .orderBy(F.col("early_pct").desc(), F.col(key).asc_nulls_first()))


def _early_sums(df: DataFrame, key: str, early: int) -> DataFrame:
    return df.groupBy(key).agg(
        F.count(F.lit(1)).alias("_n"), count_when(F.col("delay_days") <= -early).alias("_e"),
        _dsum("promised_us").alias("_p"), _dsum("total_us").alias("_a"))


def over_promise_by_state(t: Tables, early: int = 15, min_orders: int = 1) -> DataFrame:
    """Per customer state, share of ND orders arriving ``early``+ days
    early, mean promised and actual days and their difference."""
    per_customer = _early_sums(nd_orders(t), "customer_id", early)
    x = per_customer.join(t.customers.select("customer_id", "customer_state"), "customer_id")
    return _over_promise(x, "customer_state", early, min_orders)


def over_promise_by_category(t: Tables, early: int = 15, min_orders: int = 1) -> DataFrame:
    """R13 by product category (item rows)."""
    x = nd_orders(t).select("order_id", "delay_days", "promised_us", "total_us").join(
        t.item_rows.select("order_id", "product_id"), "order_id")
    per_product = _early_sums(x, "product_id", early)
    y = per_product.join(_category(t), "product_id")
    return _over_promise(y, "category", early, min_orders)
