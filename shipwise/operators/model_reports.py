"""Report views of the model pipeline (the registered M/E queries).

Each builds the feature frame with its split, runs the v2 comparison with the
given models and returns one of its tables. With the default route models the
results are deterministic and have SQL oracles; with boosted models they are
checked by invariants.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import count_when, rnd
from ..tables import Tables
from . import buffers as bf
from . import evaluate as ev
from .boosting import BoostedModel, BoostedTrees
from .delivery import DELIVERED
from .features import TARGET, base_features, feature_rows, feature_table, model_frame, narrow_frame, split_rows
from .models import METHODS, ROUTE_ROWS, Comparison, compare_methods, feature_importance, split_counts

BUFFER_COLS = ("route", "count", "pct_late", "p85_residual", "data_uncertainty", "buffer")


def comparison(t: Tables, base=None, quantile=None) -> Comparison:
    """The v2 comparison; without given models that of the route models, which read no features."""
    frame = narrow_frame(t, ROUTE_ROWS) if base is None and quantile is None else model_frame(t)
    return compare_methods(frame, base=base, quantile=quantile)


def route_stats_report(c: Comparison) -> DataFrame:
    s = c.route_stats
    return s.select("route", "count", rnd("mean_residual", 6).alias("mean_residual"),
                    rnd("std_residual", 6).alias("std_residual"), "pct_late", "p85_residual")


def global_buffer_report(c: Comparison) -> DataFrame:
    spark = c.buffers.sparkSession
    return spark.createDataFrame([(float(c.global_buffer),)], "global_buffer double")


def buffer_summary_report(c: Comparison) -> DataFrame:
    s = bf.buffer_summary(c.buffers)
    return s.select("routes", rnd("mean_buffer", 6).alias("mean_buffer"), "min_buffer", "max_buffer")


def route_margins(t: Tables, days: int = 90) -> DataFrame:
    """Margins per route as of each month start, from the arrivals of the ``days`` days before it, with the long-haul
    rule of the same arrivals as overrides."""
    merged = bf.merge_trailing(bf.day_states(base_features(t, numbered=False), DELIVERED), days)
    margins = bf.margins_as_of(merged)
    rules = bf.route_margin_rules(margins, bf.long_haul_overrides(merged), ("as_of", bf.ROUTE))
    return (rules.join(margins.select("as_of", bf.ROUTE, "n"), ["as_of", bf.ROUTE])
            .select("as_of", bf.ROUTE, "n", rnd("margin", 6).alias("margin"), "source"))


def queries() -> dict:
    """Name -> operator over ``Tables`` (route models)."""
    return {
        "m1_feature_rows": feature_rows,
        "m7_feature_table": feature_table,
        "m5_m6_feature_table_fit_on_train": lambda t: feature_table(t, fit_on="train"),
        "e9_split_report": lambda t: ev.split_report(split_rows(t)),
        "e10_filter_report": ev.filter_report,
        "r15_long_haul_share": lambda t: ev.long_haul_share(split_rows(t).filter(F.col("split") == "test")),
        "r16_route_margins": route_margins,
        "e1_e3_errors_route_mean": lambda t: ev.promise_errors(comparison(t).test, "pred_base"),
        "m13_route_stats_route_mean": lambda t: route_stats_report(comparison(t)),
        "m15_route_buffers_route_mean": lambda t: comparison(t).buffers.select(*BUFFER_COLS),
        "m15_global_buffer_route_mean": lambda t: global_buffer_report(comparison(t)),
        "m17_largest_buffers_route_mean": lambda t: bf.buffer_extremes(comparison(t).buffers, 10, True),
        "m17_smallest_buffers_route_mean": lambda t: bf.buffer_extremes(comparison(t).buffers, 10, False),
        "m17_buffer_summary_route_mean": lambda t: buffer_summary_report(comparison(t)),
        "m18_hybrid_extra_route_p85": lambda t: comparison(t).hybrid_extra.select(
            "route", "count", "pct_late_q85", "extra_buffer"),
        "e4_scoreboard_route_models": lambda t: ev.scoreboard(comparison(t).test, METHODS),
        "e5_by_duration_route_mean": lambda t: ev.by_duration(comparison(t).test, "pred_base"),
        "e6_by_duration_hybrid_route_p85": lambda t: ev.by_duration(comparison(t).test, "pred_hybrid"),
        "e7_by_state_route_mean": lambda t: ev.by_state(comparison(t).test, "pred_base"),
        "e8_by_state_hybrid_route_p85": lambda t: ev.by_state(comparison(t).test, "pred_hybrid", late=True),
    }


# ------------------------------------------------------------------ boosted models
# The source's schedule.
ROUNDS, LEARNING_RATE = 500, 0.05


def boosted(rounds: int = ROUNDS, lr: float = LEARNING_RATE, **settings) -> tuple[BoostedTrees, BoostedTrees]:
    """M9 and M10 with the source's settings. Their training state is named after data and settings, so all reports on the
    same tables read one training."""
    return (BoostedTrees(rounds=rounds, learning_rate=lr, **settings),
            BoostedTrees(alpha=0.85, rounds=rounds, learning_rate=lr, **settings))


def boosted_comparison(t: Tables, rounds: int = ROUNDS) -> Comparison:
    """The v2 comparison with the boosted models."""
    base, quantile = boosted(rounds)
    return comparison(t, base, quantile)


def boosted_cells(t: Tables, rounds: int = ROUNDS) -> DataFrame:
    """The sums behind E1-E8 of all five methods, from one scan of the scored test rows."""
    return ev.report_cells(boosted_comparison(t, rounds).test, METHODS)


def training_curves(base: BoostedModel, quantile: BoostedModel, rows: DataFrame) -> DataFrame:
    """Mean train loss of either model before each tree and after the last (curve points: rounds + 1)."""
    last = rows.filter(F.col("split") == "train").agg(
        F.avg(F.pow(F.col(TARGET) - F.col("pred_base"), 2)).alias("b"),
        F.avg(F.greatest(0.85 * (F.col(TARGET) - F.col("pred_q85")), -0.15 * (F.col(TARGET) - F.col("pred_q85")))).alias("q")).first()
    b, q = [*base.history(), last["b"]], [*quantile.history(), last["q"]]
    points = [(k, x, y) for k, (x, y) in enumerate(zip(b, q))]
    return rows.sparkSession.createDataFrame(points, "round int, train_squared_error double, train_pinball double")


def training_checks(t: Tables, rounds: int = ROUNDS) -> DataFrame:
    """M9-M11 and M19 as facts that hold for any right training: rounds and curve points, rises of either train loss, trees
    over the leaf or feature limits, trees whose leaves are not one more than their splits, splits that the split counts
    miss, and rows scored by both models in train and test."""
    c = boosted_comparison(t, rounds)
    spark = c.test.sparkSession
    curve = training_curves(c.base, c.quantile, c.train.unionByName(c.test.select(*c.train.columns)))
    before = Window.orderBy("round")  # one row a round
    rises = (curve.withColumn("_b", F.col("train_squared_error") > F.lag("train_squared_error").over(before) * 1.001)
             .withColumn("_q", F.col("train_pinball") > F.lag("train_pinball").over(before) * 1.001)
             .agg(F.count(F.lit(1)).alias("curve_points"), count_when(F.col("_b")).alias("rises_mean"), count_when(F.col("_q")).alias("rises_p85")))
    nodes = c.base.nodes(spark).withColumn("model", F.lit("mean")).unionByName(c.quantile.nodes(spark).withColumn("model", F.lit("p85")))
    trees = nodes.groupBy("model", "tree").agg(F.count("feature").alias("inner"), F.count(F.lit(1)).alias("all"), F.count_distinct("feature").alias("used"))
    shape = trees.agg(count_when(F.col("model") == "mean").alias("trees_mean"), count_when(F.col("model") == "p85").alias("trees_p85"),
                      count_when((F.col("all") - F.col("inner") > 63) | (F.col("used") > 12)).alias("trees_over_limits"),
                      count_when(F.col("all") != 2 * F.col("inner") + 1).alias("trees_not_binary"))
    inner = c.base.nodes(spark).agg(F.count("feature").alias("i")).first()["i"]
    counted = split_counts(c.base.nodes(spark)).agg(F.sum("splits").alias("s")).first()["s"] or 0
    both = F.col("pred_base").isNotNull() & F.col("pred_q85").isNotNull()
    facts = {**rises.first().asDict(), **shape.first().asDict(), "splits_not_counted": inner - counted,
             "train_scored": c.train.filter(both).count(), "test_scored": c.test.filter(both & F.col("pred_hybrid").isNotNull()).count()}
    return spark.createDataFrame([tuple(facts.values())], ", ".join(f"{k} long" for k in facts))


def importance_report(t: Tables, rounds: int = ROUNDS) -> DataFrame:
    """The ten features with the most splits in the mean model."""
    base, _ = boosted(rounds)
    model = base.fit(model_frame(t).filter(F.col("split") == "train"))
    return feature_importance(model.nodes(t.spark))


def curve_report(t: Tables, rounds: int = ROUNDS) -> DataFrame:
    """The train loss curves."""
    c = boosted_comparison(t, rounds)
    return training_curves(c.base, c.quantile, c.train)


def boosted_queries() -> dict:
    return {
        "m9_m10_training_checks": training_checks,
        "m10_quantile_training_curve": curve_report,
        "m19_gbt_feature_importance": importance_report,
        "e1_e3_errors_boosted": lambda t: ev.cells_errors(boosted_cells(t), "2_base"),
        "e4_scoreboard_boosted": lambda t: ev.cells_scoreboard(boosted_cells(t)),
        "e5_by_duration_boosted": lambda t: ev.cells_by_duration(boosted_cells(t), "2_base"),
        "e6_by_duration_hybrid_boosted": lambda t: ev.cells_by_duration(boosted_cells(t), "5_hybrid"),
        "e7_by_state_boosted": lambda t: ev.cells_by_state(boosted_cells(t), "2_base"),
        "e8_by_state_hybrid_boosted": lambda t: ev.cells_by_state(boosted_cells(t), "5_hybrid", late=True),
        "m17_largest_buffers_boosted": lambda t: bf.buffer_extremes(boosted_comparison(t).buffers, 10, True),
    }
