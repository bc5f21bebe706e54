"""Selection instead of sorting, the label dictionary, rejects and trailing margins, on rows made for them."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from hand import hand_tables
from shipwise.functions import ranking as rk
from shipwise.operators import buffers as bf
from shipwise.operators import features as fe
from shipwise.plans.inspect import plan_text


def groups(spark, n=60_000):
    rng = np.random.default_rng(1)
    g = np.array(["a", "b", "c", None], object)[rng.choice(4, n, p=[0.7, 0.2, 0.0995, 0.0005])]
    v = np.where(rng.random(n) < 0.7, 5.0, np.round(rng.normal(5, 3, n), 2))  # 70 % of the rows share one value
    v[:4] = (-0.0, 0.0, 1e300, -1e300)
    rows = [(x, float(y)) for x, y in zip(g, v)] + [("a", None), ("d", None), ("e", 1.5), (None, None)]
    return spark.createDataFrame(rows, "g string, v double").repartition(8), g, v


@pytest.mark.parametrize("q", [0.0, 0.15, 0.5, 0.85, 0.9999, 1.0])
def test_percentile_of_hot_values_and_groups(spark, q):
    df, g, v = groups(spark)
    got = {r.g: r.p for r in rk.percentile(df, "v", q, ["g"], alias="p").collect()}
    want = {k: float(np.quantile(v[g == k], q)) for k in ("a", "b", "c", None)}
    assert got == {**want, "e": 1.5}
    assert rk.percentile(df, "v", q, alias="p").first().p == float(np.quantile(np.r_[v, 1.5], q))


def test_percentile_moves_few_rows(spark):
    """A value that most rows share is one row behind the map side; no row is sorted or checkpointed."""
    df, _, _ = groups(spark)
    p = rk.percentile(df, "v", 0.85, ["g"], alias="p")
    text = plan_text(p)
    assert "rangepartitioning" not in text and "Scan ExistingRDD" not in text.replace("Scan ExistingRDD[g", "")
    spread = np.random.default_rng(2).normal(size=200_000)
    x = spark.createDataFrame([(float(s),) for s in spread], "v double")
    row = x.agg(F.percentile_approx("v", [0.849, 0.851], rk.SKETCH).alias("e")).first().e
    assert x.filter(F.col("v").between(*row)).count() < 0.004 * len(spread)  # what is counted value by value
    assert rk.percentile(x, "v", 0.85, alias="p").first().p == float(np.percentile(spread, 85))
    assert rk.percentile(x.limit(0), "v", 0.85, alias="p").collect()[0].p is None


def test_split_boundary_within_one_hour_and_at_the_ends(spark):
    t0 = dt.datetime(2020, 3, 29, 2, 10)
    rows = [(t0 + dt.timedelta(minutes=7 * (k % 3)), f"o{k % 7}", k) for k in range(50)] + [(t0 + dt.timedelta(days=d, hours=d), "x", d) for d in range(1, 30)] + [(None, "n", 0)]
    df = spark.createDataFrame(rows, "order_purchase_timestamp timestamp_ntz, order_id string, order_item_id int").repartition(5)
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or t0, r[1], r[2]))
    for frac in (0.0, 0.01, 0.3, 0.62, 0.8, 1.0):
        got = {(r[0], r[1], r[2]) for r in rk.chrono_split(df, frac).filter("split = 'train'").collect()}
        assert got == set(ordered[: int(len(rows) * frac)])
    assert rk.chrono_split(df.limit(0)).count() == 0


def test_split_moves_no_rows(spark):
    df = spark.createDataFrame([(dt.datetime(2020, 1, 1 + k % 20), str(k), 1) for k in range(100)], "order_purchase_timestamp timestamp_ntz, order_id string, order_item_id int")
    assert "Exchange" not in plan_text(rk.chrono_split(df))


def test_dictionary_of_several_columns(spark):
    df = spark.createDataFrame([("SP", "x"), ("SP", None), ("RJ", "unknown"), (None, "y"), ("SP", "x")], "a string, b string")
    words = {(r["column"], r.label): (r.n, r.code) for r in fe.dictionary(df, ["a", "b"]).collect()}
    assert words == {("a", "RJ"): (1.0, 0.0), ("a", "SP"): (3.0, 1.0), ("a", "unknown"): (0.0, 2.0),
                     ("b", "unknown"): (1.0, 0.0), ("b", "x"): (2.0, 1.0), ("b", "y"): (1.0, 2.0)}
    enc = fe.encode_labels(df, ["a", "b"], ["a", "b"])
    assert "WindowExec" not in plan_text(enc) and plan_text(enc).count("BroadcastHashJoin") == 2
    got = sorted((r.a or "", r.b or "", r.a_encoded, r.b_encoded, r.a_le, r.b_le) for r in enc.collect())
    assert got == [("", "y", 0.0, 1.0, 2.0, 2.0), ("RJ", "unknown", 1.0, 1.0, 0.0, 0.0), ("SP", "", 3.0, 0.0, 1.0, 0.0),
                   ("SP", "x", 3.0, 2.0, 1.0, 1.0), ("SP", "x", 3.0, 2.0, 1.0, 1.0)]


def test_large_dictionaries_are_not_hinted(spark, monkeypatch):
    monkeypatch.setattr(fe, "BROADCAST_LABELS", 2)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = spark.createDataFrame([(x,) for x in "abcab"], "a string")
        enc = fe.encode_labels(df, ["a"], ["a"])
        assert "BroadcastHashJoin" not in plan_text(enc)
        assert sorted((r.a, r.a_encoded, r.a_le) for r in enc.collect()) == [("a", 2.0, 0.0), ("a", 2.0, 0.0), ("b", 2.0, 1.0), ("b", 2.0, 1.0), ("c", 1.0, 2.0)]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


# ------------------------------------------------------------------ rejects
def test_every_record_is_typed_or_rejected(spark, tmp_path):
    from shipwise.schemas import TABLE_FILES
    from shipwise.sources.files import load_csv, reject_faults
    for name, df in hand_tables(spark).items():
        rows = [",".join(df.columns)] + [",".join("" if v is None else f'"{str(v).replace(chr(34), chr(34) * 2)}"' for v in r) for r in df.collect()]
        (tmp_path / TABLE_FILES[name]).write_text("\n".join(rows) + "\n")
    items = tmp_path / TABLE_FILES["order_items"]
    good = len(items.read_text().splitlines()) - 1
    items.write_text(items.read_text() + 'o9,1,p1,s1,2020-01-01 00:00:00,12.5,1.0\no9,two,p1,s1,not a date,"1,5",1.0\no9,2,p1\no9,3,p1,s1,,, 7.25 \n')
    t, rejects = load_csv(spark, str(tmp_path))
    assert t.order_items.count() + rejects.filter(F.col("file") == TABLE_FILES["order_items"]).count() == good + 4
    faults = sorted((r.column, r.value, r.reason) for r in reject_faults(rejects).collect())
    assert faults == [("", "o9,2,p1", "not 7 fields"), ("order_item_id", "two", "not a int"), ("price", "1,5", "not a double"), ("shipping_limit_date", "not a date", "not a timestamp_ntz")]
    kept = t.order_items.filter("order_id = 'o9' and order_item_id = 3").first()
    assert kept.price is None and kept.freight_value == 7.25  # empty is NULL, not a fault
    for name, df in hand_tables(spark).items():
        if name != "order_items":
            assert getattr(t, name).count() == df.count()


# ------------------------------------------------------------------ R16
def test_margins_of_trailing_days(spark):
    day = dt.datetime(2020, 1, 10)
    hour = 3_600_000_000
    rows = [("A_B", day, 24 * hour)] * 10 + [("A_B", day + dt.timedelta(days=1), 48 * hour + 1)] * 10 + [("A_B", dt.datetime(2020, 3, 31), 24 * hour)] + [(None, day, hour)]
    states = bf.day_states(spark.createDataFrame(rows, "route string, at timestamp_ntz, actual_us long"), "at")
    assert states.count() == 3
    got = {str(r.as_of): r for r in bf.margins_as_of(bf.merge_trailing(states, 60)).collect()}
    # ten January rows a day count from February 1 to March 1; the March row alone from April 1 on
    assert {k: r.n for k, r in got.items()} == {"2020-02-01": 20, "2020-03-01": 20, "2020-04-01": 1, "2020-05-01": 1}
    feb = got["2020-02-01"]
    assert feb.mean_days == pytest.approx(1.5) and feb.p_days == 49 / 24 and feb.buffer == pytest.approx(49 / 24 - 1.5 + 2)
    # merging is adding: the states of two days merge to those of both
    both = bf.merge_trailing(states, 60).groupBy("as_of").agg(F.sum("n").alias("n"), F.sum("us").alias("us"))
    assert {str(r.as_of): int(r.us) for r in both.collect()}["2020-02-01"] == 10 * 24 * hour + 10 * (48 * hour + 1)
    long = [("S_R", day, 25 * 24 * hour)] * 10 + [("S_R", day, 5 * 24 * hour)] * 30
    merged = bf.merge_trailing(bf.day_states(spark.createDataFrame(long, "route string, at timestamp_ntz, actual_us long"), "at"), 30)
    rules = bf.route_margin_rules(bf.margins_as_of(merged), bf.long_haul_overrides(merged), ("as_of", "route"))
    assert {(r.source, round(r.margin, 6)) for r in rules.collect()} == {("override", round((25 * 24 + 1) / 24 - 10 + 2, 6))}


@pytest.mark.parametrize("limit", [100_000, 6])
def test_numbers_by_window_and_by_rank_are_alike(spark, monkeypatch, limit):
    """Small groups take a window, large ones a global rank; rows with a NULL key are left out."""
    from shipwise.functions import ranking
    monkeypatch.setattr(ranking, "GROUP_ROWS", limit)
    rows = [(None if k % 13 == 0 else 0 if k % 2 else k % 5, k * 37 % 11, k) for k in range(80)]
    df = spark.createDataFrame(rows, "g int, o int, id int")
    got = {r.id: r.n for r in ranking.number_within(df, ["g"], ["o", "id"], "n", start=0).collect()}
    want = {}
    for g in {g for g, _, _ in rows if g is not None}:
        want.update({i: n for n, (_, i) in enumerate(sorted((o, i) for h, o, i in rows if h == g))})
    assert got == want


def test_item_numbers_store_no_rows(star):
    """The items are numbered where their join with the orders leaves them."""
    plan = star.order_items._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan and "ExistingRDD" not in plan
