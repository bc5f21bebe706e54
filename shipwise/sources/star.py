"""Map the driver's TPC-H-style star schema onto the nine marketplace tables.

The driver tables carry no delivery, promise, review or payment columns, so
these are derived from key arithmetic only (formulas in FIXTURES.md §2). The
same formulas are written as DuckDB SQL in ``shipwise.oracle.duck`` so both
engines produce identical tables. This is a test-data adapter: production
data arrives as the nine tables and is read with ``sources.files``.

Scale notes: orders join customers (both fact-sized at scale) on the
customer key and lineitem joins orders on the order key, so these are
shuffle joins left to AQE. Nation (25 rows) is the only forced broadcast.
The item number is ``functions.ranking.number_within``: a window on the order
key, by which the lines lie after their join with the orders, but an order with
a huge number of lines is ranked over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ranking import number_within
from ..tables import Tables


def _hours(ts: Column, n: Column) -> Column:
    return F.timestamp_add("HOUR", n.cast("int"), ts)


def read_star(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def star_tables(spark: SparkSession, sf_dir: str) -> Tables:
    """The nine-table bundle (geolocation absent) derived from ``sf_dir``."""
    rd = lambda n: read_star(spark, sf_dir, n)
    nation = F.broadcast(rd("nation").select("n_nationkey", "n_name"))

    cust = rd("customer").select("c_custkey", "c_nationkey")
    customers = (cust.join(nation, cust.c_nationkey == nation.n_nationkey, "left")
                 .select(
                     F.col("c_custkey").cast("string").alias("customer_id"),
                     F.when(F.col("c_custkey") % 33 == 1, F.col("c_custkey") - 1)
                      .otherwise(F.col("c_custkey")).cast("string").alias("customer_unique_id"),
                     (F.lit(10000) + F.col("c_custkey") % 900).cast("string").alias("customer_zip_code_prefix"),
                     F.concat(F.lit("city_"), (F.col("c_custkey") % 40).cast("string")).alias("customer_city"),
                     F.col("n_name").alias("customer_state")))

    supp = rd("supplier").select("s_suppkey", "s_nationkey")
    sellers = (supp.join(nation, supp.s_nationkey == nation.n_nationkey, "left")
               .select(
                   F.col("s_suppkey").cast("string").alias("seller_id"),
                   (F.lit(20000) + F.col("s_suppkey") % 900).cast("string").alias("seller_zip_code_prefix"),
                   F.concat(F.lit("city_"), (F.col("s_suppkey") % 40).cast("string")).alias("seller_city"),
                   F.col("n_name").alias("seller_state")))

    part = rd("part").select("p_partkey", "p_name", "p_brand", "p_size")
    pk, size = F.col("p_partkey"), F.col("p_size")
    products = part.select(
        pk.cast("string").alias("product_id"),
        F.when(pk % 61 == 0, F.lit(None).cast("string")).otherwise(F.col("p_brand")).alias("product_category_name"),
        F.length("p_name").cast("int").alias("product_name_lenght"),
        (size * 10).cast("int").alias("product_description_lenght"),
        (1 + pk % 6).cast("int").alias("product_photos_qty"),
        F.when(pk % 50 == 7, F.lit(None)).otherwise(size * size * 5).cast("int").alias("product_weight_g"),
        (10 + size).cast("int").alias("product_length_cm"),
        F.when(pk % 43 == 2, F.lit(None)).otherwise(2 + size % 20).cast("int").alias("product_height_cm"),
        (8 + size % 25).cast("int").alias("product_width_cm"))

    # Brands left without an English name (exercise the left join).
    untranslated = ["Brand#3", "Brand#7"]
    category_translation = (part.select("p_brand").distinct()
                            .filter(~F.col("p_brand").isin(untranslated))
                            .select(F.col("p_brand").alias("product_category_name"),
                                    F.lower("p_brand").alias("product_category_name_english")))

    o = rd("orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate")
    oc = o.join(cust.select("c_custkey", "c_nationkey"), o.o_custkey == cust.c_custkey, "left")
    k, nk, od = F.col("o_orderkey"), F.col("c_nationkey"), F.col("o_orderdate")
    status = (F.when((F.col("o_orderstatus") == "O") & (k % 10 == 0), "canceled")
              .when((F.col("o_orderstatus") == "P") & (k % 7 == 0), "shipped")
              .otherwise("delivered"))
    purchase = _hours(od, k * 13 % 24)
    carrier_raw = _hours(purchase, 6 + k * 101 % 200)
    extra = (F.when(nk % 5 == 0, 240).when(k % 173 == 3, 1500)
             .when(k % 11 == 0, 700).otherwise(0))
    delivered_raw = _hours(carrier_raw, 24 + k * 59 % 241 + extra)
    no_delivery = (k % 29 == 0) | (F.col("_status") == "shipped") | \
                  ((F.col("_status") == "canceled") & (k % 70 != 0))
    orders_full = (oc.withColumn("_status", status)
                   .select(
                       k, nk, od, F.col("o_totalprice"),
                       k.cast("string").alias("order_id"),
                       F.col("o_custkey").cast("string").alias("customer_id"),
                       F.col("_status").alias("order_status"),
                       purchase.alias("order_purchase_timestamp"),
                       _hours(purchase, F.lit(1)).alias("order_approved_at"),
                       F.when(k % 40 == 1, F.lit(None)).otherwise(carrier_raw)
                        .alias("order_delivered_carrier_date"),
                       F.when(no_delivery, F.lit(None)).otherwise(delivered_raw)
                        .alias("order_delivered_customer_date"),
                       F.when(k % 97 == 5, F.lit(None))
                        .otherwise(_hours(od, 24 * (8 + k * 37 % 35 + nk % 5)))
                        .alias("order_estimated_delivery_date")))
    order_cols = ["order_id", "customer_id", "order_status", "order_purchase_timestamp",
                  "order_approved_at", "order_delivered_carrier_date",
                  "order_delivered_customer_date", "order_estimated_delivery_date"]
    orders = orders_full.select(*order_cols)

    li = rd("lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
                               "l_extendedprice", "l_discount", "l_tax", "l_returnflag",
                               "l_linestatus", "l_shipdate")
    lo = (li.join(o.select("o_orderkey", "o_orderdate"), li.l_orderkey == o.o_orderkey, "left")
          .select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
                  "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate", "o_orderdate"))
    # item number = row number inside the order (an order with a huge number of lines
    # stays spread out); it runs a job that counts the orders' lines, so the table is
    # built on first access, and rows without the number are a plain projection
    item_cols = [
        F.col("l_orderkey").cast("string").alias("order_id"),
        F.col("l_partkey").cast("string").alias("product_id"),
        F.col("l_suppkey").cast("string").alias("seller_id"),
        _hours(F.col("o_orderdate"), F.lit(72)).alias("shipping_limit_date"),
        F.col("l_extendedprice").cast("double").alias("price"),
        (F.col("l_quantity") * F.lit(0.5)).cast("double").alias("freight_value")]

    def order_items() -> DataFrame:
        numbered = number_within(lo, ["l_orderkey"], [
            "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity",
            "l_shipdate", "l_discount", "l_tax", "l_returnflag", "l_linestatus"], "_item", counted=li.select("l_orderkey"))
        return numbered.select(item_cols[0], F.col("_item").alias("order_item_id"), *item_cols[1:])

    # Payment types by order key modulo 4.
    pay_type = (F.when(k % 4 == 0, "boleto").when(k % 4 == 1, "voucher").otherwise("credit_card"))
    first = o.select(k.cast("string").alias("order_id"), F.lit(1).alias("payment_sequential"),
                     pay_type.alias("payment_type"), (1 + k % 10).cast("int").alias("payment_installments"),
                     F.col("o_totalprice").cast("double").alias("payment_value"))
    second = o.filter(k % 9 == 0).select(
        k.cast("string").alias("order_id"), F.lit(2).alias("payment_sequential"),
        F.lit("voucher").alias("payment_type"), F.lit(1).alias("payment_installments"),
        F.lit(10.0).alias("payment_value"))
    order_payments = first.unionByName(second)

    delivered, estimated = F.col("order_delivered_customer_date"), F.col("order_estimated_delivery_date")
    score = (F.when(delivered > estimated, 1 + k % 3)
             .when(k % 10 < 3, 5 - k % 3).otherwise(F.lit(5)))
    order_reviews = (orders_full.filter(k % 20 != 3).select(
        k.cast("string").alias("review_id"),
        F.col("order_id"),
        score.cast("int").alias("review_score"),
        F.when(k % 8 == 0, F.lit("title")).alias("review_comment_title"),
        F.when(k % 5 < 3, F.lit(None).cast("string"))
         .otherwise(F.concat(F.lit("comment on order "), F.col("order_id"))).alias("review_comment_message"),
        _hours(F.col("order_purchase_timestamp"), F.lit(600)).alias("review_creation_date"),
        _hours(F.col("order_purchase_timestamp"), F.lit(648)).alias("review_answer_timestamp")))

    return Tables(category_translation=category_translation, customers=customers, sellers=sellers,
                  products=products, orders=orders, order_items=order_items,
                  item_rows=lo.select(*item_cols), order_payments=order_payments, order_reviews=order_reviews, geolocation=None)
