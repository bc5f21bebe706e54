"""Evaluation of arrival-time predictions against the actual days.

All metrics are one grouped aggregation; the five-method scoreboard stacks the
prediction columns into long form (``unpivot``) and groups by method, so the
test rows are scanned once for all methods.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import bround, count_when, pct, right_closed_bin, rnd
from ..tables import Tables
from .features import PROMISE, TARGET, feature_rows, outlier_keep

# Actual-duration bins (right-closed) and their labels, E5/E6.
DURATION_EDGES = (0, 7, 14, 21, 30, 60)
DURATION_LABELS = ("1. <=7 days", "2. 7-14 days", "3. 14-21 days", "4. 21-30 days", "5. 30+ days")


def _mean(c: Column) -> Column:
    return F.avg(c)


def errors(df: DataFrame, pred: str, actual: str = TARGET) -> DataFrame:
    """MAE and RMSE of one prediction column (one row)."""
    e = F.col(pred) - F.col(actual)
    return df.agg(F.count(F.lit(1)).alias("n"), rnd(_mean(F.abs(e)), 2).alias("mae"),
                  rnd(F.sqrt(_mean(e * e)), 2).alias("rmse"))


def over_late(pred: str, actual: str = TARGET) -> tuple[Column, Column]:
    """Over-prediction (pred > actual) and late (actual > pred) shares in %."""
    return (pct(count_when(F.col(pred) > F.col(actual)), F.count(F.lit(1)), 1),
            pct(count_when(F.col(actual) > F.col(pred)), F.count(F.lit(1)), 1))


def improvement(base: Column, new: Column) -> Column:
    """``(base - new) / base * 100`` (NULL when base is 0)."""
    return F.try_divide((base - new) * F.lit(100.0), base)


def promise_errors(df: DataFrame, pred: str | None = None) -> DataFrame:
    """E1-E3 on the test rows: the promise and optionally a model, with
    MAE, RMSE, over and late shares and MAE/RMSE improvement."""
    e_p = F.col(PROMISE) - F.col(TARGET)
    cols = [F.count(F.lit(1)).alias("n"),
            _mean(F.abs(e_p)).alias("_pm"), F.sqrt(_mean(e_p * e_p)).alias("_pr")]
    over_p, late_p = over_late(PROMISE)
    cols += [over_p.alias("promise_over_pct"), late_p.alias("promise_late_pct")]
    if pred:
        e_m = F.col(pred) - F.col(TARGET)
        over_m, late_m = over_late(pred)
        cols += [_mean(F.abs(e_m)).alias("_mm"), F.sqrt(_mean(e_m * e_m)).alias("_mr"),
                 over_m.alias("model_over_pct"), late_m.alias("model_late_pct")]
    out = df.agg(*cols)
    sel = ["n", rnd("_pm", 2).alias("promise_mae"), rnd("_pr", 2).alias("promise_rmse"),
           "promise_over_pct", "promise_late_pct"]
    if pred:
        sel += [rnd("_mm", 2).alias("model_mae"), rnd("_mr", 2).alias("model_rmse"),
                "model_over_pct", "model_late_pct",
                rnd(improvement(F.col("_pm"), F.col("_mm")), 1).alias("mae_improvement_pct"),
                rnd(improvement(F.col("_pr"), F.col("_mr")), 1).alias("rmse_improvement_pct")]
    return out.select(*sel)


def scoreboard(df: DataFrame, methods: Mapping[str, str], big: float = 15.0,
               actual: str = TARGET) -> DataFrame:
    """Per method, MAE, late %, over % and over-by-more-than-``big`` %."""
    names = list(methods)
    long = df.select(F.col(actual).alias("_a"), *[F.col(c).alias(n) for n, c in methods.items()]).unpivot(
        "_a", names, "method", "_p")
    err = F.col("_p") - F.col("_a")
    n = F.count(F.lit(1))
    return (long.groupBy("method")
            .agg(n.alias("n"), rnd(_mean(F.abs(err)), 2).alias("mae"),
                 pct(count_when(F.col("_a") > F.col("_p")), n, 1).alias("late_pct"),
                 pct(count_when(F.col("_p") > F.col("_a")), n, 1).alias("over_pct"),
                 pct(count_when(err > big), n, 1).alias("over_big_pct"))
            .orderBy("method"))


def duration_bin(c: str = TARGET) -> Column:
    """right-closed bins of the actual days."""
    return right_closed_bin(c, DURATION_EDGES, DURATION_LABELS)


def by_duration(df: DataFrame, pred: str, base: str = PROMISE, min_n: int = 10) -> DataFrame:
    """Per actual-duration bin (bins under ``min_n`` rows dropped): MAE
    of base and model, improvement, late shares of both, row count."""
    a = F.col(TARGET)
    n = F.count(F.lit(1))
    g = (df.withColumn("duration_bin", duration_bin()).filter(F.col("duration_bin").isNotNull())
         .groupBy("duration_bin")
         .agg(n.alias("n"), _mean(F.abs(F.col(base) - a)).alias("_b"), _mean(F.abs(F.col(pred) - a)).alias("_m"),
              pct(count_when(a > F.col(base)), n, 0).alias("base_late_pct"),
              pct(count_when(a > F.col(pred)), n, 0).alias("model_late_pct")))
    return (g.filter(F.col("n") >= min_n)
            .select("duration_bin", "n", rnd("_b", 1).alias("base_mae"), rnd("_m", 1).alias("model_mae"),
                    rnd(improvement(F.col("_b"), F.col("_m")), 0).alias("improvement_pct"),
                    "base_late_pct", "model_late_pct")
            .orderBy("duration_bin"))


def by_state(df: DataFrame, pred: str, base: str = PROMISE, min_n: int = 50, late: bool = False) -> DataFrame:
    """E7 (``late=False``: MAE both and improvement, Python rounding, best
    improvement first) and E8 (``late=True``: MAE and late share of both,
    highest model late share first), customer states with ``min_n`` rows."""
    a = F.col(TARGET)
    n = F.count(F.lit(1))
    g = (df.groupBy("customer_state")
         .agg(n.alias("n"), _mean(F.abs(F.col(base) - a)).alias("_b"), _mean(F.abs(F.col(pred) - a)).alias("_m"),
              pct(count_when(a > F.col(base)), n, 1).alias("base_late_pct"),
              pct(count_when(a > F.col(pred)), n, 1).alias("model_late_pct"),
              (count_when(a > F.col(pred)) / n).alias("_late"))
         .filter(F.col("n") >= min_n))
    if not late:
        return (g.select(F.col("customer_state").alias("state"), F.col("n").alias("orders"),
                         bround("_b", 1).alias("base_mae"), bround("_m", 1).alias("model_mae"),
                         bround(improvement(F.col("_b"), F.col("_m")), 1).alias("improvement_pct"))
                .orderBy(F.col("improvement_pct").desc(), "state"))
    # sorted by the share before it is rounded
    return (g.orderBy(F.col("_late").desc(), "customer_state")
            .select(F.col("customer_state").alias("state"), "n", rnd("_b", 1).alias("base_mae"),
                    rnd("_m", 1).alias("model_mae"), "base_late_pct", "model_late_pct"))


# ------------------------------------------------------------------ all reports from one aggregation
def report_cells(df: DataFrame, methods: Mapping[str, str], big: float = 15.0) -> DataFrame:
    """The sums behind E1-E8 of all methods, from one scan of the scored rows.

    One row per method and grain (all rows, each actual-duration bin, each
    customer state; GROUPING SETS): n, absolute and squared error sums, rows
    late, over and over by more than ``big`` days. A handful of rows, whatever
    the input.
    """
    long = (df.select(F.col(TARGET).alias("_a"), duration_bin().alias("duration_bin"), "customer_state",
                      *[F.col(c).alias(n) for n, c in methods.items()])
            .unpivot(["_a", "duration_bin", "customer_state"], list(methods), "method", "_p"))
    err = F.col("_p") - F.col("_a")
    method, bin_, state = F.col("method"), F.col("duration_bin"), F.col("customer_state")
    return (long.groupingSets([[method], [method, bin_], [method, state]], method, bin_, state)
            .agg(F.grouping_id().alias("grain"), F.count(F.lit(1)).alias("n"), F.sum(F.abs(err)).alias("abs_sum"), F.sum(err * err).alias("sq_sum"),
                 count_when(err < 0).alias("late"), count_when(err > 0).alias("over"), count_when(err > big).alias("over_big")))


GRAIN_ALL, GRAIN_BIN, GRAIN_STATE = 3, 1, 2  # grouping ids: which of (bin, state) are summed over


def _pair(cells: DataFrame, grain: int, keys: list[str], model: str, base: str) -> DataFrame:
    """Cells of one grain with the base method's (b_) and the model's (m_) numbers side by side."""
    sums = [F.max(F.when(F.col("method") == m, F.col(c))).alias(p + c) for m, p in ((base, "b_"), (model, "m_")) for c in ("n", "abs_sum", "sq_sum", "late", "over")]
    return cells.filter(F.col("grain") == grain).groupBy(*keys).agg(*sums)


def cells_errors(cells: DataFrame, model: str, base: str = "1_promise") -> DataFrame:
    """E1-E3 of one model against the promise."""
    n = F.col("b_n")
    mean, rms = (lambda p: F.col(p + "abs_sum") / n), (lambda p: F.sqrt(F.col(p + "sq_sum") / n))
    return _pair(cells, GRAIN_ALL, [], model, base).select(
        n.alias("n"), rnd(mean("b_"), 2).alias("promise_mae"), rnd(rms("b_"), 2).alias("promise_rmse"),
        pct(F.col("b_over"), n, 1).alias("promise_over_pct"), pct(F.col("b_late"), n, 1).alias("promise_late_pct"),
        rnd(mean("m_"), 2).alias("model_mae"), rnd(rms("m_"), 2).alias("model_rmse"),
        pct(F.col("m_over"), n, 1).alias("model_over_pct"), pct(F.col("m_late"), n, 1).alias("model_late_pct"),
        rnd(improvement(mean("b_"), mean("m_")), 1).alias("mae_improvement_pct"),
        rnd(improvement(rms("b_"), rms("m_")), 1).alias("rmse_improvement_pct"))


def cells_scoreboard(cells: DataFrame) -> DataFrame:
    """E4."""
    n = F.col("n")
    return (cells.filter(F.col("grain") == GRAIN_ALL)
            .select("method", "n", rnd(F.col("abs_sum") / n, 2).alias("mae"), pct(F.col("late"), n, 1).alias("late_pct"),
                    pct(F.col("over"), n, 1).alias("over_pct"), pct(F.col("over_big"), n, 1).alias("over_big_pct"))
            .orderBy("method"))


def cells_by_duration(cells: DataFrame, model: str, base: str = "1_promise", min_n: int = 10) -> DataFrame:
    """E5/E6."""
    n = F.col("b_n")
    mean = lambda p: F.col(p + "abs_sum") / n
    return (_pair(cells, GRAIN_BIN, ["duration_bin"], model, base).filter(F.col("duration_bin").isNotNull() & (n >= min_n))
            .select("duration_bin", n.alias("n"), rnd(mean("b_"), 1).alias("base_mae"), rnd(mean("m_"), 1).alias("model_mae"),
                    rnd(improvement(mean("b_"), mean("m_")), 0).alias("improvement_pct"),
                    pct(F.col("b_late"), n, 0).alias("base_late_pct"), pct(F.col("m_late"), n, 0).alias("model_late_pct"))
            .orderBy("duration_bin"))


def cells_by_state(cells: DataFrame, model: str, base: str = "1_promise", min_n: int = 50, late: bool = False) -> DataFrame:
    """E7 (``late=False``) and E8."""
    n = F.col("b_n")
    mean = lambda p: F.col(p + "abs_sum") / n
    g = _pair(cells, GRAIN_STATE, ["customer_state"], model, base).filter(n >= min_n)
    if not late:
        return (g.select(F.col("customer_state").alias("state"), n.alias("orders"), bround(mean("b_"), 1).alias("base_mae"),
                         bround(mean("m_"), 1).alias("model_mae"), bround(improvement(mean("b_"), mean("m_")), 1).alias("improvement_pct"))
                .orderBy(F.col("improvement_pct").desc(), "state"))
    return (g.orderBy((F.col("m_late") / n).desc(), "customer_state")
            .select(F.col("customer_state").alias("state"), n.alias("n"), rnd(mean("b_"), 1).alias("base_mae"), rnd(mean("m_"), 1).alias("model_mae"),
                    pct(F.col("b_late"), n, 1).alias("base_late_pct"), pct(F.col("m_late"), n, 1).alias("model_late_pct")))


def split_report(df: DataFrame, ts: str = "order_purchase_timestamp") -> DataFrame:
    """Rows and purchase-date span of each split."""
    return (df.groupBy("split").agg(F.count(F.lit(1)).alias("rows"), F.min(ts).alias("first_purchase"),
                                    F.max(ts).alias("last_purchase"))
            .orderBy(F.col("split").desc()))


def filter_report(t: Tables, max_actual: float = 60.0, max_promised: float = 80.0) -> DataFrame:
    """Feature rows before and after the outlier filter (one pass, one row)."""
    return feature_rows(t, numbered=False).agg(F.count(F.lit(1)).alias("rows_before"),
                               count_when(outlier_keep(max_actual, max_promised)).alias("rows_after"))


def long_haul_share(df: DataFrame, days: float = 21.0) -> DataFrame:
    """Share of rows whose actual duration exceeds ``days``."""
    n = F.count(F.lit(1))
    return df.agg(n.alias("n"), count_when(F.col(TARGET) > days).alias("long_haul"),
                  pct(count_when(F.col(TARGET) > days), n, 1).alias("long_haul_pct"))
