"""Plan shape: no Python UDFs, no cartesian products, top-k as
TakeOrderedAndProject, filters and column pruning reaching the Parquet scan."""

import pytest

from conftest import SF_SMALL
from shipwise import catalog
from shipwise.operators import delivery as dl
from shipwise.operators import explore as ex

from shipwise.plans.inspect import FORBIDDEN, plan_text, scans

# the model-chain queries run actions while building (split, percentiles), so
# only their final plans are inspected here; cheap ones are enough for shape
ANALYSES = [n for n in catalog.queries() if n.startswith(("k", "r", "a"))]


@pytest.mark.parametrize("name", ANALYSES)
def test_no_python_or_cartesian(spark, name):
    text = plan_text(catalog.queries()[name](spark, SF_SMALL))
    for bad in FORBIDDEN:
        assert bad not in text, f"{name}: {bad}"


@pytest.mark.parametrize("name", ["k3_top_categories_by_revenue", "k4_lowest_rated_categories",
                                  "k7_spend_by_state", "k19_slowest_lanes", "k20_slowest_categories",
                                  "k22_chronic_late_sellers"])
def test_top_k_is_take_ordered(spark, name):
    assert "TakeOrderedAndProject" in plan_text(catalog.queries()[name](spark, SF_SMALL))


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """The mapped tables written as Parquet and read back, as in production."""
    from shipwise.sources.files import read_tables, write_tables
    from shipwise.sources.star import star_tables
    d = str(tmp_path_factory.mktemp("tables"))
    write_tables(star_tables(spark, SF_SMALL), d)
    return read_tables(spark, d)


def test_filters_and_pruning_reach_the_scan(stored):
    text = plan_text(dl.delay_buckets(stored))
    assert "PushedFilters: [IsNotNull(order_delivered_customer_date)" in text
    (scan,) = scans(dl.delay_buckets(stored))
    assert scan["read_schema"] == ("struct<order_delivered_customer_date:timestamp_ntz,"
                                   "order_estimated_delivery_date:timestamp_ntz>")


def test_status_filter_pushed(stored):
    text = plan_text(ex.monthly_revenue(stored))
    assert "EqualTo(order_status,delivered)" in text


def test_stored_tables_give_same_answers(spark, stored):
    from shipwise.sources.star import star_tables
    from shipwise.oracle.compare import spark_result
    live = star_tables(spark, SF_SMALL)
    for fn in (dl.delay_buckets, dl.slowest_lanes, ex.spend_by_state):
        assert spark_result(fn(live)) == spark_result(fn(stored))


def test_bucketed_layout_removes_order_shuffles(spark, tmp_path):
    from shipwise.sources.files import read_catalog_tables, write_catalog_tables
    from shipwise.sources.star import star_tables
    from shipwise.oracle.compare import spark_result
    from shipwise.plans.inspect import shuffle_count
    live = star_tables(spark, SF_SMALL)
    write_catalog_tables(live, "shipwise_test_bk", str(tmp_path / "db"), 4)
    tb = read_catalog_tables(spark, "shipwise_test_bk")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for fn in (dl.chronic_late_sellers, ex.pick_story_order):
            assert shuffle_count(fn(tb)) < shuffle_count(fn(live))
            assert spark_result(fn(tb)) == spark_result(fn(live))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_the_caller_chooses_the_layout_and_is_told_the_skew(spark, tmp_path):
    from shipwise.sources.files import bucket_skew, read_catalog_tables, write_catalog_tables
    from shipwise.sources.star import star_tables
    from shipwise.tables import Tables
    from pyspark.sql import functions as F
    live = star_tables(spark, SF_SMALL)
    # one order holding a third of all item rows
    items = live.order_items
    n = items.count()
    hot = items.limit(n // 2).withColumn("order_id", F.lit("hot-order"))
    t = Tables(**{**dict(live.items()), "order_items": items.unionByName(hot)})
    assert bucket_skew(t.order_items, "order_id", 16) > 4.0
    told = write_catalog_tables(t, "shipwise_test_hot", str(tmp_path / "db"), 16)
    assert told["bucketed"] and told["item_bucket_skew"] > 4.0
    plain = write_catalog_tables(t, "shipwise_test_plain", str(tmp_path / "db2"), 16, layout="plain")
    assert plain == {"bucketed": False, "buckets": 0, "item_bucket_skew": None}
    a, b = read_catalog_tables(spark, "shipwise_test_hot"), read_catalog_tables(spark, "shipwise_test_plain")
    assert a.order_items.exceptAll(b.order_items).isEmpty() and a.order_items.count() == n + n // 2
    # dealt before it is written: one file a bucket
    files = [f for f in (tmp_path / "db" / "order_items").iterdir() if f.name.endswith(".parquet")]
    assert len(files) <= 16


def test_one_order_reads_one_bucket(spark, tmp_path):
    from shipwise.sources.files import read_catalog_tables, write_catalog_tables
    from shipwise.sources.star import star_tables
    from shipwise.oracle.compare import spark_result
    live = star_tables(spark, SF_SMALL)
    write_catalog_tables(live, "shipwise_test_one", str(tmp_path / "db"), 8)
    stored = read_catalog_tables(spark, "shipwise_test_one")
    one = live.orders.select("order_id").orderBy("order_id").first()["order_id"]
    story = ex.order_story(stored, one)
    assert spark_result(story) == spark_result(ex.order_story(live, one))
    # the plan shows pruned buckets where the scan keeps its buckets (files of other buckets are left out either way)
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")
    try:
        text = plan_text(ex.order_story(read_catalog_tables(spark, "shipwise_test_one"), one))
    finally:
        spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")
    assert text.count("SelectedBucketsCount: 1 out of 8") >= 4  # orders, items, payments, reviews
    assert f"EqualTo(order_id,{one})" in text


@pytest.mark.parametrize("name", ["k3_top_categories_by_revenue", "k6_monthly_revenue", "k20_slowest_categories",
                                  "r9_slow_sellers_vs_category", "a4_row_counts", "a6_orphan_rows", "e10_filter_report",
                                  "r16_route_margins"])
def test_items_without_their_number_stay_lazy(spark, name):
    """No checkpoint and no sort of the item rows where the item number is not read."""
    text = plan_text(catalog.queries()[name](spark, SF_SMALL))
    assert "ExistingRDD" not in text and "rangepartitioning(l_orderkey" not in text
