"""Delivery-time features known at purchase (M1-M8).

One row per delivered order item: facts known when the order is placed
(states, category, product size, price, freight, purchase calendar), the
promise shown to the buyer and the actual arrival. Encoders share one
dictionary (one row per state or category) that is joined back; its size is
measured before it is hinted as a broadcast.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import days_between, micros_between, route, same, volume
from ..functions.ranking import chrono_split, number_within
from ..session import ensure_checkpoint_dir, stored
from ..tables import Tables
from .delivery import DELIVERED, ESTIMATED, PURCHASE

# The 15 model features, in the source's order.
FEATURES = (
    "customer_state_le", "seller_state_le", "category_le",
    "same_state", "product_weight_g", "product_volume", "product_photos_qty",
    "price", "freight_value",
    "purchase_dow", "purchase_hour", "purchase_month",
    "customer_state_encoded", "seller_state_encoded", "category_encoded",
)
TARGET = "actual_days"
PROMISE = "promised_days"


def feature_rows(t: Tables, numbered: bool = True, items_first: bool = False) -> DataFrame:
    """M1: delivered order items with purchase-time facts, promise and arrival
    (``numbered=False``: without the item number, which may cost a sort;
    ``items_first``: the order of the joins that the boosted models' samples go by).

    Inner joins to customers, items, products and sellers; left join to the
    category translation (C11). Orders must be ``delivered`` with both the
    delivered and estimated dates present.
    """
    o = (t.orders.filter((F.col("order_status") == "delivered") & F.col(DELIVERED).isNotNull()
                         & F.col(ESTIMATED).isNotNull())
         .select("order_id", "customer_id", PURCHASE, ESTIMATED, DELIVERED))
    number = ["order_item_id"] if numbered else []
    items = (t.order_items if numbered else t.item_rows).select("order_id", *number, "product_id", "seller_id", "price", "freight_value")
    prod = (t.products.join(t.category_translation, "product_category_name", "left")
            .select("product_id",
                    F.coalesce("product_category_name_english", "product_category_name").alias("category"),
                    "product_weight_g", "product_length_cm", "product_height_cm", "product_width_cm",
                    "product_photos_qty"))
    states = t.customers.select("customer_id", "customer_state")
    # the customers' states join the orders, of which there are fewer than items: the items are not moved for them
    both = o.join(items, "order_id").join(states, "customer_id") if items_first else o.join(states, "customer_id").join(items, "order_id")
    return (both
            .join(prod, "product_id")
            .join(t.sellers.select("seller_id", "seller_state"), "seller_id")
            .select("order_id", *number, PURCHASE, ESTIMATED, DELIVERED, "customer_state",
                    "seller_state", "category", "product_weight_g", "product_length_cm", "product_height_cm",
                    "product_width_cm", "product_photos_qty", "price", "freight_value"))


def outlier_keep(max_actual: float = 60.0, max_promised: float = 80.0) -> Column:
    """``0 < actual < max_actual`` and ``0 < promised < max_promised``
    (exclusive; NULL fails)."""
    a, p = days_between(DELIVERED, PURCHASE), days_between(ESTIMATED, PURCHASE)
    return (a > 0) & (a < max_actual) & (p > 0) & (p < max_promised)


def with_targets(df: DataFrame, max_actual: float = 60.0, max_promised: float = 80.0) -> DataFrame:
    """M2 + B6: actual and promised days from purchase, outliers removed."""
    out = (df.withColumn(TARGET, days_between(DELIVERED, PURCHASE))
           .withColumn(PROMISE, days_between(ESTIMATED, PURCHASE)))
    return out.filter(outlier_keep(max_actual, max_promised))


def with_calendar(df: DataFrame) -> DataFrame:
    """M3: purchase weekday (0 = Monday), hour and month."""
    return (df.withColumn("purchase_dow", F.weekday(PURCHASE))
            .withColumn("purchase_hour", F.hour(PURCHASE))
            .withColumn("purchase_month", F.month(PURCHASE)))


def with_shipping(df: DataFrame) -> DataFrame:
    """M4: same-state flag, product volume (NULL sides as 0), route label."""
    return (df.withColumn("same_state", same("customer_state", "seller_state"))
            .withColumn("product_volume", volume("product_length_cm", "product_height_cm", "product_width_cm"))
            .withColumn("route", route("seller_state", "customer_state")))


#: A dictionary of at most so many labels is hinted as broadcast (a measured size: one row a label).
BROADCAST_LABELS = 100_000


def dictionary(fit: DataFrame, cols: Sequence[str], unknown: str = "unknown") -> DataFrame:
    """One row a label of each column: column, label (NULL as ``unknown``), n (its rows, NULLs not counted) and code, its
    place among the column's sorted labels. One aggregation over all columns; the places are distributed ranks."""
    values = fit.select(*[F.col(c).cast("string").alias(c) for c in cols]).unpivot([], list(cols), "column", "value")
    labels = (values.groupBy("column", F.coalesce("value", F.lit(unknown)).alias("label"))
              .agg(F.count("value").cast("double").alias("n"))).checkpoint(eager=True)
    return (number_within(labels, ["column"], ["label"], "code", start=0)
            .withColumn("code", F.col("code").cast("double")))


def encode_labels(df: DataFrame, frequency: Sequence[str], labelled: Sequence[str], fit: DataFrame | None = None,
                  unknown: str = "unknown") -> DataFrame:
    """M5 and M6 for all columns by one dictionary of ``fit`` (default: ``df`` itself, as the source does).

    ``<c>_encoded``: the value's row count in ``fit``, 0 for NULL or unseen
    values. ``<c>_le``: the label's code, NULL as ``unknown``; labels unseen in
    ``fit`` get a code of their own, the vocabulary's size (the source raises).
    """
    cols = sorted({*frequency, *labelled})
    words = dictionary(df if fit is None else fit, cols, unknown).checkpoint(eager=True)
    sizes = {r["column"]: r["n"] for r in words.groupBy("column").agg(F.count(F.lit(1)).alias("n")).collect()}
    small = sum(sizes.values()) <= BROADCAST_LABELS
    for c in cols:
        own = words.filter(F.col("column") == c).select(F.col("label").alias("_lab"), F.col("n").alias("_n"), F.col("code").alias("_code"))
        df = df.withColumn("_lab", F.coalesce(F.col(c).cast("string"), F.lit(unknown))).join(F.broadcast(own) if small else own, "_lab", "left")
        if c in frequency:
            df = df.withColumn(c + "_encoded", F.when(F.col(c).isNull(), 0.0).otherwise(F.coalesce("_n", F.lit(0.0))))
        if c in labelled:
            df = df.withColumn(c + "_le", F.coalesce("_code", F.lit(float(sizes.get(c, 0)))))
        df = df.drop("_lab", "_n", "_code")
    return df


def frequency_encode(df: DataFrame, cols: Sequence[str], fit: DataFrame | None = None) -> DataFrame:
    """M5 alone."""
    return encode_labels(df, cols, (), fit)


def label_encode(df: DataFrame, cols: Sequence[str], fit: DataFrame | None = None) -> DataFrame:
    """M6 alone."""
    return encode_labels(df, (), cols, fit)


ENCODED = ("category", "customer_state", "seller_state")
LABELLED = ("customer_state", "seller_state", "category")


def base_features(t: Tables, numbered: bool = True, items_first: bool = False) -> DataFrame:
    """M1-M4: feature rows with targets, calendar and shipping columns."""
    x = with_shipping(with_calendar(with_targets(feature_rows(t, numbered, items_first))))
    return x.withColumn("actual_us", micros_between(DELIVERED, PURCHASE))


def encode(df: DataFrame, fit: DataFrame | None = None) -> DataFrame:
    """M5-M7: frequency and label encodings fitted on ``fit`` (default ``df``),
    then every feature as a NULL-free double."""
    return fill_features(encode_labels(df, ENCODED, LABELLED, fit=fit))


def build_features(t: Tables) -> DataFrame:
    """M1-M7 without a split, encoders fitted on every filtered row."""
    return encode(base_features(t))


def fill_features(df: DataFrame) -> DataFrame:
    """M7: every feature as double with NULL -> 0."""
    return df.select(*[c for c in df.columns if c not in FEATURES],
                     *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in FEATURES])


#: What no encoder, model or report reads of a row once its targets and features are there.
USED_UP = ("product_length_cm", "product_height_cm", "product_width_cm", ESTIMATED, DELIVERED)


def split_rows(t: Tables, frac: float = 0.8, columnar: bool = True) -> DataFrame:
    """M1-M4 and M8: the feature rows with their ``split``, not encoded (what reports on the rows themselves need).

    The joined rows are stored once: the split reads a few columns of them for
    its counts, then the encoders and the models. ``columnar=False``: as a
    checkpoint, which keeps the rows' order (the boosted models' samples go by it)."""
    ensure_checkpoint_dir(t.spark)
    rows = base_features(t, items_first=not columnar).drop(*USED_UP)
    return chrono_split(stored(rows) if columnar else rows.checkpoint(eager=True), frac)


def encoded_rows(t: Tables, frac: float = 0.8, fit_on: str = "all", columnar: bool = True) -> DataFrame:
    """M1-M8: the feature frame with a chronological ``split`` column, for one reader.

    Encoders are fitted on every row (``fit_on='all'``, the source's choice,
    which lets test-period rows into the counts) or on the train rows only
    (``fit_on='train'``)."""
    if fit_on not in ("all", "train"):
        raise ValueError(fit_on)
    s = split_rows(t, frac, columnar)
    fit = s if fit_on == "all" else s.filter(F.col("split") == "train")
    return encode(s, fit=fit)


def model_frame(t: Tables, frac: float = 0.8, fit_on: str = "all") -> DataFrame:
    """The rows of ``encoded_rows``, stored once: every model and report reads them many times."""
    return encoded_rows(t, frac, fit_on, columnar=False).checkpoint(eager=True)


def narrow_frame(t: Tables, columns: Sequence[str]) -> DataFrame:
    """Some columns of the rows of ``encoded_rows``, stored once for models and reports that read no others."""
    return stored(encoded_rows(t).select(*columns))


def feature_table(t: Tables, fit_on: str = "all") -> DataFrame:
    """The registered M-query: identifiers, route, targets, 15 features, split."""
    m = encoded_rows(t, fit_on=fit_on)
    return m.select("order_id", "order_item_id", PURCHASE, "customer_state", "seller_state", "category",
                    "route", TARGET, PROMISE, *FEATURES, "split")
