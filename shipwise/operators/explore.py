"""Exploration queries (K1-K7), the one-order story (K9, K10) and previews
(A10, A11).

As in ``delivery``, fan-out sides (payments per order, reviews per order,
items per product) are reduced per join key before the join, so the joined
row counts of the source queries are reproduced by sums instead of by
materialising the multiplied rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import avg_money, head_chars, is_late, money_sum, month_label, rnd
from ..tables import Tables
from .delivery import DELIVERED, ESTIMATED, review_totals


def _ratio(num: Column, den: Column) -> Column:
    return F.try_divide(num.cast("double"), den.cast("double"))


def status_counts(t: Tables) -> DataFrame:
    """K1: orders per status, most frequent first."""
    return (t.orders.groupBy("order_status").agg(F.count(F.lit(1)).alias("count"))
            .orderBy(F.col("count").desc(), "order_status"))


def payment_mix(t: Tables) -> DataFrame:
    """K2: payment rows and mean value per payment type."""
    return (t.order_payments.groupBy("payment_type")
            .agg(F.count(F.lit(1)).alias("count"), rnd(avg_money("payment_value"), 2).alias("avg_value"))
            .orderBy(F.col("count").desc(), "payment_type"))


def _translated(t: Tables) -> DataFrame:
    """product_id -> English category (inner: untranslated products drop out)."""
    return (t.products.select("product_id", "product_category_name")
            .join(t.category_translation, "product_category_name")
            .select("product_id", F.col("product_category_name_english").alias("category")))


def top_categories_by_revenue(t: Tables, k: int = 10) -> DataFrame:
    """K3: categories by item revenue (item rows counted as ``total_orders``)."""
    per_product = t.item_rows.groupBy("product_id").agg(
        F.count(F.lit(1)).alias("_n"), money_sum("price").alias("_rev"))
    res = (per_product.join(_translated(t), "product_id")
           .groupBy("category")
           .agg(F.sum("_n").alias("total_orders"), rnd(F.sum("_rev"), 2).alias("total_revenue")))
    return (res.orderBy(F.col("total_revenue").desc(), F.col("total_orders").desc(), "category")
            .limit(k))


def lowest_rated_categories(t: Tables, min_reviews: int = 50, k: int = 10) -> DataFrame:
    """K4: categories with the lowest mean review score (review x item rows)."""
    orders = t.orders.select("order_id")
    rv = (review_totals(t.order_reviews).select("order_id", "n_reviews", "n_scored", "score_sum")
          .join(orders, "order_id", "left_semi"))
    x = t.item_rows.select("order_id", "product_id").join(rv, "order_id")
    per_product = x.groupBy("product_id").agg(
        F.sum("n_reviews").alias("_n"), F.sum("n_scored").alias("_sn"), F.sum("score_sum").alias("_ss"))
    res = (per_product.join(_translated(t), "product_id")
           .groupBy("category")
           .agg(F.sum("_n").cast("bigint").alias("review_count"),
                rnd(_ratio(F.sum("_ss"), F.sum("_sn")), 2).alias("avg_score")))
    return (res.filter(F.col("review_count") >= min_reviews)
            .orderBy(F.col("avg_score").asc(), F.col("review_count").desc(), "category")
            .limit(k))


def late_vs_on_time_reviews(t: Tables) -> DataFrame:
    """K5: review rows and mean score for late vs on-time deliveries."""
    rv = review_totals(t.order_reviews).select("order_id", "n_reviews", "n_scored", "score_sum")
    o = t.orders.filter(F.col(DELIVERED).isNotNull() & F.col(ESTIMATED).isNotNull()).select(
        "order_id",
        F.when(is_late(DELIVERED, ESTIMATED), "late").otherwise("on_time").alias("delivery_status"))
    return (o.join(rv, "order_id").groupBy("delivery_status")
            .agg(F.sum("n_reviews").cast("bigint").alias("order_count"),
                 rnd(_ratio(F.sum("score_sum"), F.sum("n_scored")), 2).alias("avg_review_score"))
            .orderBy("delivery_status"))


def monthly_revenue(t: Tables) -> DataFrame:
    """K6: distinct delivered orders and item revenue per purchase month.

    Items are summed per order first; counting the per-order rows then gives
    the distinct order count without a distinct aggregate.
    """
    per_order = t.item_rows.groupBy("order_id").agg(money_sum("price").alias("_rev"))
    o = (t.orders.filter(F.col("order_status") == "delivered")
         .select("order_id", month_label("order_purchase_timestamp").alias("month")))
    return (o.join(per_order, "order_id").groupBy("month")
            .agg(F.count(F.lit(1)).alias("orders"), rnd(F.sum("_rev"), 0).alias("revenue"))
            .orderBy("month"))


def spend_by_state(t: Tables, k: int = 10) -> DataFrame:
    """K7: payment rows and paid value by customer state (top ``k`` by rows)."""
    per_order = t.order_payments.groupBy("order_id").agg(
        F.count(F.lit(1)).alias("_n"), money_sum("payment_value").alias("_v"))
    per_customer = (t.orders.select("order_id", "customer_id").join(per_order, "order_id")
                    .groupBy("customer_id").agg(F.sum("_n").alias("_n"), F.sum("_v").alias("_v")))
    res = (per_customer.join(t.customers.select("customer_id", "customer_state"), "customer_id")
           .groupBy(F.col("customer_state").alias("state"))
           .agg(F.sum("_n").cast("bigint").alias("total_orders"), rnd(F.sum("_v"), 0).alias("total_spent")))
    return (res.orderBy(F.col("total_orders").desc(), F.col("total_spent").desc(), F.col("state").asc_nulls_first())
            .limit(k))


def pick_story_order(t: Tables) -> DataFrame:
    """K9: the smallest delivered order id that has an item and a commented review."""
    commented = t.order_reviews.filter(F.col("review_comment_message").isNotNull()).select("order_id")
    return (t.orders.filter(F.col("order_status") == "delivered").select("order_id")
            .join(commented, "order_id", "left_semi")
            .join(t.item_rows.select("order_id"), "order_id", "left_semi")
            .agg(F.min("order_id").alias("order_id")))


def order_story(t: Tables, order_id: str | None = None) -> DataFrame:
    """The full story of orders, one row per fact (``section``, ``entry``).

    ``order``: customer city and state, purchase, delivery and estimate (one
    row, also for orders without items); ``item``: price, freight and English
    category; ``payment``: type, installments and value; ``review``: score and
    first 100 comment characters. ``entry`` is the item number, the payment
    sequence or the review id. The source traces one order; this gives every
    order (or only ``order_id``). Nothing is collected into lists, so an order
    with any number of items, payments or reviews is only more rows.
    """
    def of_order(df: DataFrame) -> DataFrame:
        return df if order_id is None else df.filter(F.col("order_id") == F.lit(order_id))

    def section(df: DataFrame, name: str, entry: Column, *cols: Column) -> DataFrame:
        return df.select("order_id", F.lit(name).alias("section"), entry.cast("string").alias("entry"), *cols)

    category = (t.products.select("product_id", "product_category_name")
                .join(t.category_translation, "product_category_name", "left")
                .select("product_id", F.col("product_category_name_english").alias("category")))
    header = section(
        of_order(t.orders).join(t.customers.select("customer_id", "customer_city", "customer_state"), "customer_id", "left"),
        "order", F.lit(None), F.col("customer_city"), F.col("customer_state"),
        F.col("order_purchase_timestamp").alias("ordered"), F.col(DELIVERED).alias("delivered"),
        F.col(ESTIMATED).alias("estimated"))
    items = section(of_order(t.order_items).join(category, "product_id", "left"), "item", F.col("order_item_id"),
                    F.col("price"), F.col("freight_value"), F.col("category"))
    payments = section(of_order(t.order_payments), "payment", F.col("payment_sequential"),
                       F.col("payment_type"), F.col("payment_installments"), F.col("payment_value"))
    reviews = section(of_order(t.order_reviews), "review", F.col("review_id"), F.col("review_score"),
                      head_chars("review_comment_message", 100).alias("review_comment"))
    story = header
    for part in (items, payments, reviews):
        story = story.unionByName(part, allowMissingColumns=True)
    return story


def one_order_story(t: Tables) -> DataFrame:
    """The story of the order that K9 picks (on bucketed tables only that order's bucket of each table is read)."""
    picked = pick_story_order(t).first()["order_id"]  # one id
    return order_story(t, picked if picked is not None else "")


# ------------------------------------------------------------------ previews
def preview(df: DataFrame, cols: Sequence[str | Column], n: int, where: Column | None = None,
            order: Sequence[str] = ()) -> DataFrame:
    """First ``n`` rows of a projection (A10), in key order so it repeats."""
    if where is not None:
        df = df.filter(where)
    if order:
        df = df.orderBy(*order)
    return df.select(*cols).limit(n)


def previews(t: Tables, only: Sequence[str] | None = None) -> dict[str, DataFrame]:
    """The eight table previews, or those named; only their tables are built."""
    made = {
        "customers": lambda: preview(t.customers, ["customer_id", "customer_unique_id", "customer_city",
                                           "customer_state"], 5, order=["customer_id"]),
        "orders": lambda: preview(t.orders, ["order_id", "customer_id", "order_status", "order_purchase_timestamp",
                                     DELIVERED, ESTIMATED], 5,
                          where=F.col("order_status") == "delivered", order=["order_id"]),
        "order_items": lambda: preview(t.order_items, ["order_id", "order_item_id", "product_id", "seller_id",
                                               "price", "freight_value"], 5,
                               order=["order_id", "order_item_id"]),
        "products": lambda: preview(t.products, ["product_id", "product_category_name", "product_weight_g",
                                         "product_length_cm"], 5, order=["product_id"]),
        "category_translation": lambda: preview(t.category_translation, ["*"], 10,
                                        order=["product_category_name"]),
        "order_payments": lambda: preview(t.order_payments, ["order_id", "payment_type", "payment_installments",
                                                     "payment_value"], 5,
                                  order=["order_id", "payment_sequential"]),
        "order_reviews": lambda: preview(t.order_reviews,
                                 ["review_id", "order_id", "review_score",
                                  head_chars("review_comment_message", 60).alias("comment_preview"),
                                  "review_creation_date"], 5,
                                 where=F.col("review_comment_message").isNotNull(),
                                 order=["review_id", "order_id"]),
        "sellers": lambda: preview(t.sellers, ["seller_id", "seller_city", "seller_state"], 5, order=["seller_id"]),
    }
    return {name: made[name]() for name in (made if only is None else only)}
