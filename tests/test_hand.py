"""Hand fixtures with literal expected values (FIXTURES.md §3)."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from hand import BUCKET, hand_tables
from shipwise.operators import buffers as bf
from shipwise.operators import checks as ck
from shipwise.operators import delivery as dl
from shipwise.operators import evaluate as ev
from shipwise.operators import explore as ex
from shipwise.operators import features as fe
from shipwise.functions.ranking import chrono_split, percentile, rank_rows


@pytest.fixture(scope="module")
def hand(spark):
    return hand_tables(spark)


def test_delay_buckets_edges(hand):
    rows = {r["delay_bucket"][0]: (r["cnt"], r["pct"]) for r in dl.delay_buckets(hand).collect()}
    expect = Counter(b for b in BUCKET.values() if b)
    assert {k: v[0] for k, v in rows.items()} == dict(expect)
    # denominator: 14 orders with a delivered date (h10 counts, h9 does not)
    assert rows["A"][1] == round(2 * 100 / 14, 1)


def test_delay_histogram_half_day_ties(hand):
    hist = {r["delay_days"]: r["cnt"] for r in dl.delay_histogram(hand).collect()}
    assert hist[-1] == 1 and hist[2] == 1  # -0.5 -> -1 (h4), 1.5 -> 2 (h7)
    assert hist[0] == 1 and hist[1] == 1  # same instant (h5), one day late (h6)


def test_raw_late_is_strict(hand):
    x = dl.nd_orders(hand).select("order_id", "late").collect()
    late = {r["order_id"]: r["late"] for r in x}
    assert late["h5"] is False and late["h6"] is True and late["h4"] is False


def test_cause_split_needs_carrier(hand):
    total = sum(r["cnt"] for r in dl.delay_cause_split(hand).collect())
    assert total == 12  # 13 ND orders minus h11 (no carrier scan)


def test_cancel_rate_counts_undelivered(hand):
    rows = dl.cancel_rate_by_promise(hand).collect()
    assert sum(r["total_orders"] for r in rows) == 14  # h10 has no estimate
    assert sum(r["canceled"] for r in rows) == 1


def test_weight_buckets(hand):
    got = {r["weight_bucket"][0]: r["orders"] for r in dl.delay_by_weight(hand).collect()}
    # products by order index i % 10; ND orders only; p6 has NULL weight
    # 13 ND orders, h3 has a second item, h7's product has no weight
    assert sum(got.values()) == 13
    # A <=500: p0 500 (h1), p7 300 (h8a); B <=2000: p1 501 (h2, h11), p2 2000 (h3, h12),
    # p8 700 (h8b, h3 item 2); C: p3 5000 (h4, h13a); D: p4 10000 (h5, h13b); E: p5 10001 (h6)
    assert got == {"A": 2, "B": 6, "C": 2, "D": 2, "E": 1}


def test_fanout_items_times_reviews(hand):
    rows = dl.chronic_late_sellers(hand, min_orders=1, k=100).collect()
    n = {r["seller_id"]: r["orders"] for r in rows}
    # h3: 2 reviews; its s1 item gives 2 rows and its s2 item gives 2 rows
    assert n["s2"] == 2
    cat = dl.slowest_categories(hand, min_orders=1, k=100).collect()
    assert sum(r["orders"] for r in cat) == 13 + 1 + 2  # ND items, h3's second item, h3's extra review x2


def test_untranslated_and_null_category(hand):
    names = {r["category"] for r in dl.slowest_categories(hand, min_orders=1, k=100).collect()}
    assert None in names and "moveis" in names
    top = {r["category"] for r in ex.top_categories_by_revenue(hand).collect()}
    assert None not in top and "moveis" not in top


def test_outlier_filter_and_bins(hand):
    rep = ev.filter_report(hand).first()
    assert rep["rows_before"] == 14 and rep["rows_after"] == 12  # h12 (negative) and h13b (60 days) dropped
    f = fe.with_targets(fe.feature_rows(hand))
    ids = {r["order_id"] for r in f.select("order_id").collect()}
    assert "h12" not in ids and "h13b" not in ids and "h13a" in ids
    b = f.select(ev.duration_bin().alias("b"), "order_id").filter(F.col("order_id") == "h13a").first()["b"]
    assert b.startswith("1.")  # exactly 7 days is in (0, 7]


def test_percentile_fixture(spark):
    df = spark.createDataFrame([(x,) for x in [1.0, 2.5, 7.0, 9.0, 11.5]], "v double")
    assert percentile(df, "v", 0.85, alias="p").first()["p"] == 10.0


def test_grouped_percentile_and_single_row_std(spark):
    rows = [("r1", x) for x in [1.0, 2.5, 7.0, 9.0, 11.5]] + [("r2", 3.0)]
    df = spark.createDataFrame(rows, "route string, residual double")
    stats = {r["route"]: r for r in bf.route_stats(df).collect()}
    assert stats["r1"]["p85_residual"] == 10.0 and stats["r2"]["p85_residual"] == 3.0
    assert stats["r2"]["std_residual"] is None


def test_uncertainty_tiers(spark):
    df = spark.createDataFrame([(n,) for n in [29, 30, 49, 50, 199, 200]], "count int")
    got = [r[0] for r in df.select(bf.uncertainty(F.col("count"))).collect()]
    assert got == [2.0, 2.0, 2.0, 1.0, 1.0, 0.0]


def test_unseen_route_defaults(spark):
    test = spark.createDataFrame([("a", 5.0), ("zz", 5.0), (None, 5.0)], "route string, p double")
    buffers = spark.createDataFrame([("a", 1.5)], "route string, buffer double")
    out = {r["route"]: r["pred_route_buffer"] for r in bf.apply_buffer(test, buffers, 3.25, "p").collect()}
    assert out == {"a": 6.5, "zz": 8.25, None: 8.25}
    extra = spark.createDataFrame([("a", 0.0)], "route string, extra_buffer double")
    out = {r["route"]: r["pred_hybrid"] for r in bf.apply_hybrid(test, extra, "p").collect()}
    assert out == {"a": 5.0, "zz": 7.0, None: 7.0}


@pytest.mark.parametrize("n,train", [(10, 8), (11, 8)])
def test_chrono_split_sizes(spark, n, train):
    from datetime import datetime, timedelta
    rows = [(datetime(2018, 1, 1) + timedelta(hours=(i * 7) % n), str(i), 1) for i in range(n)]
    df = spark.createDataFrame(rows, "order_purchase_timestamp timestamp_ntz, order_id string, order_item_id int")
    s = chrono_split(df).collect()
    tr = [r for r in s if r["split"] == "train"]
    te = [r for r in s if r["split"] == "test"]
    assert len(tr) == train and len(te) == n - train
    assert max(r["order_purchase_timestamp"] for r in tr) <= min(r["order_purchase_timestamp"] for r in te)


def test_rank_rows_is_a_permutation(spark):
    df = spark.range(0, 5000).select((F.col("id") * 7919 % 5000).alias("k"))
    r = rank_rows(df, ["k"]).collect()
    assert sorted(x["_rank"] for x in r) == list(range(5000))
    assert all(x["_rank"] == x["k"] for x in r)


def test_key_violations_and_orphans(spark, hand):
    from shipwise.tables import Tables
    dup = hand.products.unionByName(hand.products.limit(1))
    orphan_item = hand.order_items.unionByName(
        spark.createDataFrame([("h1", 9, "p_missing", "s1", None, 1.0, 1.0)], hand.order_items.schema))
    t = Tables(**{**{n: d for n, d in hand.items()}, "products": dup, "order_items": orphan_item})
    kv = {r["table_name"]: r for r in ck.key_violations(t).collect()}
    assert kv["products"]["duplicate_keys"] == 1 and kv["products"]["duplicate_rows"] == 2
    assert kv["orders"]["duplicate_keys"] == 0
    orph = {r["relation"]: (r["orphans"], r["sample_key"]) for r in ck.orphan_rows(t).collect()}
    assert orph["order_items.product_id -> products.product_id"] == (1, "p_missing")
    assert orph["orders.customer_id -> customers.customer_id"] == (0, None)


def test_csv_reader(spark, tmp_path):
    from shipwise.sources.files import read_csv_table
    p = tmp_path / "reviews.csv"
    p.write_text('review_id,order_id,review_score,review_comment_title,review_comment_message,'
                 'review_creation_date,review_answer_timestamp\n'
                 'r1,o1,5,,"said ""hi""\nthen left",2018-01-02 00:00:00,bogus\n'
                 'r2,o2,x,,,2018-01-03 00:00:00,2018-01-04 10:00:00\n')
    rows = {r["review_id"]: r for r in read_csv_table(spark, str(p), "order_reviews").collect()}
    assert rows["r1"]["review_comment_message"] == 'said "hi"\nthen left'
    assert rows["r1"]["review_answer_timestamp"] is None and rows["r1"]["review_score"] == 5
    assert rows["r2"]["review_score"] is None
    c = tmp_path / "cust.csv"
    c.write_text("customer_id,customer_unique_id,customer_zip_code_prefix,customer_city,customer_state\n"
                 "c1,u1,01037,sao paulo,SP\n")
    assert read_csv_table(spark, str(c), "customers").first()["customer_zip_code_prefix"] == "01037"
    d = tmp_path / "swapped.csv"
    d.write_text("customer_unique_id,customer_id,customer_zip_code_prefix,customer_city,customer_state\nu1,c1,01037,sao paulo,SP\n")
    row = read_csv_table(spark, str(d), "customers").first()
    assert (row["customer_id"], row["customer_unique_id"]) == ("c1", "u1")


def test_story_order_and_previews(hand):
    from shipwise.tables import Tables
    assert ex.pick_story_order(hand).first()["order_id"] == "h3"  # the only commented review
    story = ex.order_story(hand, "h3").collect()
    assert sorted((r["section"], r["entry"]) for r in story) == [
        ("item", "1"), ("item", "2"), ("order", None), ("payment", "1"), ("review", "r_h3"), ("review", "r_h3b")]
    second = next(r for r in story if r["entry"] == "r_h3b")
    assert (second["review_score"], second["review_comment"]) == (1, 'said "hi"\nthen left')
    # an order without items and with two payments keeps its header and both payments
    bare = Tables(**{**dict(hand.items()), "order_items": hand.order_items.filter("order_id <> 'h1'"),
                     "order_payments": hand.order_payments.union(hand.order_payments.filter("order_id = 'h1'").selectExpr(
                         "order_id", "2", "'voucher'", "3", "4.5"))})
    got = {(r["section"], r["entry"], r["payment_installments"], r["payment_value"]) for r in ex.order_story(bare, "h1").collect()}
    assert got == {("order", None, None, None), ("payment", "1", 1, 10.0), ("payment", "2", 3, 4.5), ("review", "r_h1", None, None)}
    pv = ex.previews(hand)
    assert pv["category_translation"].count() == 3 and pv["orders"].count() == 5


def test_label_and_frequency_encoding(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("b",)], "s string")
    enc = fe.label_encode(fe.frequency_encode(df, ["s"]), ["s"])
    got = sorted((r["s"], r["s_encoded"], r["s_le"]) for r in enc.collect() if r["s"])
    assert got == [("a", 1.0, 0.0), ("b", 2.0, 1.0), ("b", 2.0, 1.0)]
    nul = [r for r in enc.collect() if r["s"] is None][0]
    assert nul["s_encoded"] == 0.0 and nul["s_le"] == 2.0  # 'unknown' sorts after a, b


def test_views_and_catalog_listing(spark, hand):
    from shipwise.tables import register_views, tables_from_views
    names = register_views(hand, prefix="hv_")
    assert "hv_orders" in names
    listed = {r["name"] for r in ck.list_tables(spark).collect()}
    assert {"hv_orders", "hv_order_items"} <= listed
    back = tables_from_views(spark, prefix="hv_")
    assert back.orders.count() == len(__import__("hand").ORDERS)
    n = spark.sql("SELECT count(*) AS n FROM hv_orders WHERE order_status = 'delivered'").first()["n"]
    assert n == 14


def test_percentile_approx_option(spark):
    df = spark.createDataFrame([(float(x),) for x in range(1, 101)], "v double")
    exact = percentile(df, "v", 0.85, alias="p").first()["p"]
    approx = percentile(df, "v", 0.85, alias="p", method="approx").first()["p"]
    import numpy as np
    assert exact == float(np.percentile(np.arange(1, 101, dtype=float), 85))  # bit-identical to numpy
    assert approx == 85.0  # approx returns an observed value, no interpolation


def test_encoders_fitted_on_train_only(spark):
    from datetime import datetime, timedelta
    rows = [(datetime(2018, 1, 1) + timedelta(days=i), str(i), 1, "s_late" if i >= 8 else "s_early")
            for i in range(10)]
    df = spark.createDataFrame(rows, "order_purchase_timestamp timestamp_ntz, order_id string, "
                                     "order_item_id int, seller_state string")
    s = chrono_split(df)
    train = s.filter(F.col("split") == "train")
    enc = fe.label_encode(fe.frequency_encode(s, ["seller_state"], fit=train), ["seller_state"], fit=train)
    got = {r["order_id"]: (r["seller_state_encoded"], r["seller_state_le"]) for r in enc.collect()}
    assert got["0"] == (8.0, 0.0)
    assert got["9"] == (0.0, 1.0)  # a value the train split never saw: a code of its own


def test_route_margin_rules_overrides(spark):
    buffers = spark.createDataFrame([("A_B", 1.5), ("A_C", 0.0)], "route string, buffer double")
    overrides = spark.createDataFrame([("A_C", 4.0), ("Z_Z", 7.0)], "route string, margin double")
    got = {r["route"]: (r["margin"], r["source"]) for r in bf.route_margin_rules(buffers, overrides).collect()}
    assert got == {"A_B": (1.5, "history"), "A_C": (4.0, "override"), "Z_Z": (7.0, "override")}
    plain = {r["route"]: r["margin"] for r in bf.route_margin_rules(buffers).collect()}
    assert plain == {"A_B": 1.5, "A_C": 0.0}


def test_number_within_matches_row_number(spark):
    from shipwise.functions.ranking import number_within
    rows = [(k % 3, (k * 37) % 11, k) for k in range(60)]
    df = spark.createDataFrame(rows, "g int, o int, id int")
    got = {r["id"]: r["n"] for r in number_within(df, ["g"], ["o", "id"], "n").collect()}
    for g in range(3):
        members = sorted((o, i) for gg, o, i in rows if gg == g)
        for pos, (_o, i) in enumerate(members, start=1):
            assert got[i] == pos


def test_quantile_model_scores_hundreds_of_trees(spark):
    from shipwise.operators.boosting import BoostedModel, BoostedTrees
    from shipwise.operators.features import FEATURES
    rows = [tuple(float((i * (k + 3)) % 17) for k in range(len(FEATURES))) + (float(i % 23),) for i in range(400)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in FEATURES) + ", actual_days double")
    m = BoostedTrees(alpha=0.85, rounds=3, learning_rate=0.1, max_depth=3, subsample=1.0).fit(df)
    assert all(b <= a + 1e-9 for a, b in zip(m.history(), m.history()[1:]))  # pinball loss never rises
    big = BoostedModel(m.base, m.learning_rate, m.trees * 170, m.features)  # 510 trees
    out = big.transform(df, "p").select("p").collect()
    assert len(out) == 400 and all(r["p"] == r["p"] for r in out)


def test_sqlite_dialect_sql_runs_on_views(spark, hand):
    from shipwise.functions.sql_functions import register_sql_functions
    from shipwise.tables import register_views
    register_sql_functions(spark)
    register_views(hand, prefix="sq_")
    # a SQLite-style query: julianday differences, ROUND, GROUP BY / ORDER BY on the alias
    got = spark.sql("""
        SELECT ROUND(julianday(order_delivered_customer_date) - julianday(order_estimated_delivery_date)) AS delay_days,
               COUNT(*) AS cnt
        FROM sq_orders
        WHERE order_delivered_customer_date IS NOT NULL AND order_estimated_delivery_date IS NOT NULL
        GROUP BY delay_days ORDER BY delay_days""").collect()
    ref = dl.delay_histogram(hand).collect()
    assert [(int(r["delay_days"]), r["cnt"]) for r in got] == [(r["delay_days"], r["cnt"]) for r in ref]
    exact = spark.sql("SELECT days_between(TIMESTAMP_NTZ'2018-05-21 12:00:00', "
                      "TIMESTAMP_NTZ'2018-05-20 00:00:00') AS d").first()["d"]
    assert exact == 1.5
    plan = spark.sql("SELECT julianday(order_purchase_timestamp) FROM sq_orders")._jdf.queryExecution() \
        .executedPlan().toString()
    assert "UDF" not in plan and "Python" not in plan


def test_csv_round_trip_of_all_tables(spark, hand, tmp_path):
    from shipwise.oracle.compare import spark_result
    from shipwise.schemas import TABLE_FILES
    from shipwise.sources.files import read_tables
    for name, df in hand.items():
        (df.write.option("header", True).option("quote", '"').option("escape", '"')
         .option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss").csv(str(tmp_path / TABLE_FILES[name])))
    t = read_tables(spark, str(tmp_path), fmt="csv")
    assert t.geolocation is None
    for fn in (dl.delay_buckets, dl.chronic_late_sellers, ex.order_story):
        (ca, ra), (cb, rb) = spark_result(fn(t)), spark_result(fn(hand))
        assert ca == cb and sorted(ra, key=repr) == sorted(rb, key=repr)
    rv = {r["review_id"]: r["review_comment_message"] for r in t.order_reviews.collect()}
    assert rv["r_h3b"] == 'said "hi"\nthen left'


def test_scoring_closure_runs_without_the_package(spark, tmp_path):
    """Python workers may not have this package: the shipped scorer must not import it."""
    import subprocess
    import sys
    from pyspark import cloudpickle
    from shipwise.operators.features import FEATURES
    from shipwise.operators import boosting
    rows = [tuple(float((i * (k + 3)) % 17) for k in range(len(FEATURES))) + (float(i % 23),) for i in range(300)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in FEATURES) + ", actual_days double")
    m = boosting.BoostedTrees(alpha=0.85, rounds=2, learning_rate=0.1, max_depth=3).fit(df)
    blob = tmp_path / "closures.pkl"
    t = m.trees[0]
    level = boosting.level_histograms(0.85, tuple(np.array([v]) for v in (-1, 0, -1, -1)), [0], [0, 1], 8, (1, 0, 0.8), True)
    blob.write_bytes(cloudpickle.dumps((m.scorer(), level, boosting._stepper(t, 0.1), boosting._residuals((t.feature, t.bin, t.left, t.right), (1, 0, 0.8), {0}),
                                       boosting.node_rows(0.85, tuple(np.array([v]) for v in (-1, 0, -1, -1)), [0], [0, 1], (1, 0, 1.0), True),
                                       boosting.grow_rest(0.85, [0, 1], 8, {0: 2}, boosting.split_of([0, 1], 1, 0.1, 0.1)))))
    code = ("import pickle, sys, numpy as np\n"
            "assert not any('repo' in p for p in sys.path)\n"
            f"score, level, step, rest, rows, grow = pickle.load(open({str(blob)!r}, 'rb'))\n"
            f"x = np.ones(({len(FEATURES)}, 2))\n"
            "block = (5, x.astype(np.uint8), np.array([1.0, 2.0]), np.zeros(2))\n"
            "assert dict(level(iter([block])))[-1][1] == 2 and len(step(block)[3]) == 2 and len(rest(block)) == 2\n"
            "found = dict(rows(iter([block]))); assert grow((0, [found[0]]))[0] == 0\n"
            "print(len(score(x)))\n")
    res = subprocess.run([sys.executable, "-c", code], cwd=str(tmp_path), capture_output=True, text=True,
                         env={"PATH": "/usr/bin:/bin"})
    assert res.returncode == 0, res.stderr[-2000:]
    assert res.stdout.strip() == "2"


def test_e8_sorts_states_by_the_unrounded_late_share(spark):
    from shipwise.operators.evaluate import by_state
    from shipwise.operators.features import TARGET
    late = {"AA": (500, 3000), "BB": (501, 3000)}  # 16.67 and 16.70 %, both 16.7 when rounded
    rows = [(s, 10.0 if k < a else 1.0, 5.0, 5.0) for s, (a, n) in late.items() for k in range(n)]
    got = by_state(spark.createDataFrame(rows, f"customer_state string, {TARGET} double, promised_days double, p double"), "p", base="promised_days", late=True).collect()
    assert [(r.state, r.model_late_pct) for r in got] == [("BB", 16.7), ("AA", 16.7)]
