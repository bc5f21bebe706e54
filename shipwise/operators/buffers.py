"""Route safety buffers and the hybrid promise.

Everything is grouped by ``route`` (seller state + customer state); route
frames have one row per route, so joining them back to the rows is a lookup
whose size is bounded by the number of state pairs. Percentiles are exact and
distributed (``functions.ranking.percentile``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranking import percentile
from .features import TARGET

ROUTE = "route"


def with_residual(df: DataFrame, pred: str, out: str = "residual") -> DataFrame:
    """Actual minus predicted days (positive = predicted too early)."""
    return df.withColumn(out, F.col(TARGET) - F.col(pred))


def route_stats(train: DataFrame, residual: str = "residual", q: float = 0.85) -> DataFrame:
    """Per route (NULL routes dropped, as pandas groupby does):
    count, mean, sample std, share above 0 and the ``q`` percentile."""
    x = train.filter(F.col(ROUTE).isNotNull())
    r = F.col(residual)
    stats = x.groupBy(ROUTE).agg(
        F.count(F.lit(1)).alias("count"), F.avg(r).alias("mean_residual"),
        F.stddev_samp(r).alias("std_residual"),
        F.avg((r > 0).cast("double")).alias("pct_late"))
    p = percentile(x, residual, q, [ROUTE], alias="p85_residual")
    return stats.join(p, ROUTE)


def uncertainty(n: Column) -> Column:
    """Extra days for thin data: 2 under 50 rows, 1 under 200, else 0."""
    return F.when(n < 50, 2.0).when(n < 200, 1.0).otherwise(0.0)


def route_buffers(stats: DataFrame) -> DataFrame:
    """buffer = max(0, p85 residual) + uncertainty tier."""
    return (stats.withColumn("data_uncertainty", uncertainty(F.col("count")))
            .withColumn("buffer", F.greatest(F.lit(0.0), F.col("p85_residual")) + F.col("data_uncertainty")))


def global_buffer(train: DataFrame, residual: str = "residual", q: float = 0.85, extra: float = 1.0) -> float:
    """Buffer for unseen routes: max(0, p85 of all residuals) + ``extra``.

    A scalar: the percentile is computed on the cluster, one number returns."""
    row = percentile(train, residual, q, alias="p").first()
    p = row["p"] if row is not None and row["p"] is not None else 0.0
    return max(0.0, p) + extra


def apply_buffer(df: DataFrame, buffers: DataFrame, default: float, pred: str,
                 out: str = "pred_route_buffer") -> DataFrame:
    """M16 (method A): prediction plus the route's buffer, or ``default``."""
    b = buffers.select(ROUTE, F.col("buffer").alias("route_buffer"))
    return (df.join(b, ROUTE, "left")
            .withColumn("route_buffer", F.coalesce(F.col("route_buffer"), F.lit(float(default))))
            .withColumn(out, F.col(pred) + F.col("route_buffer")))


def buffer_extremes(buffers: DataFrame, k: int = 10, largest: bool = True) -> DataFrame:
    """The ``k`` largest (or smallest) buffers, ties by route."""
    o = F.col("buffer").desc() if largest else F.col("buffer").asc()
    return (buffers.select(ROUTE, "count", "pct_late", "p85_residual", "data_uncertainty", "buffer")
            .orderBy(o, ROUTE).limit(k))


def buffer_summary(buffers: DataFrame) -> DataFrame:
    """Mean, min and max buffer over routes."""
    return buffers.agg(F.count(F.lit(1)).alias("routes"), F.avg("buffer").alias("mean_buffer"),
                       F.min("buffer").alias("min_buffer"), F.max("buffer").alias("max_buffer"))


def hybrid_extra(train: DataFrame, pred: str, late_share: float = 0.25, min_rows: int = 30,
                 extra: float = 2.0) -> DataFrame:
    """Per route, ``extra`` days when more than ``late_share`` of the
    train rows arrive after ``pred`` or the route has under ``min_rows`` rows."""
    x = train.filter(F.col(ROUTE).isNotNull())
    g = x.groupBy(ROUTE).agg(F.count(F.lit(1)).alias("count"),
                             F.avg((F.col(TARGET) > F.col(pred)).cast("double")).alias("pct_late_q85"))
    return g.withColumn("extra_buffer", F.when((F.col("pct_late_q85") > late_share) | (F.col("count") < min_rows),
                                               F.lit(extra)).otherwise(F.lit(0.0)))


def apply_hybrid(df: DataFrame, extra: DataFrame, pred: str, default: float = 2.0,
                 out: str = "pred_hybrid") -> DataFrame:
    """M18 (method C): quantile prediction plus the route's extra days
    (``default`` for unseen routes)."""
    e = extra.select(ROUTE, "extra_buffer")
    return (df.join(e, ROUTE, "left")
            .withColumn("extra_buffer", F.coalesce(F.col("extra_buffer"), F.lit(float(default))))
            .withColumn(out, F.col(pred) + F.col("extra_buffer")))


# ------------------------------------------------------------------ R16: margins from past arrivals
TICK_US = 3_600_000_000   # a state's resolution: one hour
LONG_HAUL_TICKS = 21 * 24


def day_states(rows: DataFrame, day: str, actual_us: str = "actual_us") -> DataFrame:
    """Per route and arrival day, the state that margins are made of: a histogram of the actual duration in hours (``tick``),
    with the rows and the exact duration sum of each tick. States merge by adding counts and sums, so a day is reduced once
    and serves every range of days that holds it."""
    return (rows.filter(F.col(ROUTE).isNotNull() & F.col(day).isNotNull())
            .groupBy(ROUTE, F.to_date(day).alias("day"), F.floor(F.col(actual_us) / F.lit(TICK_US)).cast("int").alias("tick"))
            .agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(actual_us).cast("decimal(38,0)")).alias("us")))


def merge_trailing(states: DataFrame, days: int = 90) -> DataFrame:
    """States of the ``days`` days before each month start, merged: as_of, route, tick, n, us. A day's state goes to the few
    month starts whose range holds it; no state is compared with a calendar."""
    first = F.trunc(F.add_months(F.col("day"), 1), "month")
    last = F.trunc(F.date_add(F.col("day"), days), "month")
    return (states.filter(first <= last)
            .withColumn("as_of", F.explode(F.sequence(first, last, F.expr("interval 1 month"))))
            .groupBy("as_of", ROUTE, "tick").agg(F.sum("n").alias("n"), F.sum("us").alias("us")))


def margins_as_of(merged: DataFrame, q: float = 0.85) -> DataFrame:
    """Per as_of and route: rows, mean days, the ``q`` percentile (the end of the tick that holds the ceil(q n)-th row), the
    share of long hauls, and the margin: what the percentile is above the mean, plus the uncertainty tier (M14)."""
    by = ["as_of", ROUTE]
    run = Window.partitionBy(*by).orderBy("tick")  # at most one row an hour of the longest duration
    total = Window.partitionBy(*by)
    x = merged.withColumn("_to", F.sum("n").over(run)).withColumn("_all", F.sum("n").over(total))
    at = F.ceil(F.col("_all") * F.lit(q))
    out = x.groupBy(*by).agg(
        F.sum("n").alias("n"), (F.sum("us").cast("double") / F.sum("n").cast("double") / F.lit(24.0 * TICK_US)).alias("mean_days"),
        (F.min(F.when(F.col("_to") >= at, F.col("tick") + 1)) / F.lit(24.0)).alias("p_days"),
        (F.sum(F.when(F.col("tick") >= LONG_HAUL_TICKS, F.col("n")).otherwise(0)) / F.sum("n")).alias("long_share"))
    return out.withColumn("buffer", F.greatest(F.lit(0.0), F.col("p_days") - F.col("mean_days")) + uncertainty(F.col("n")))


def long_haul_overrides(merged: DataFrame, share: float = 0.1, min_rows: int = 30, q: float = 0.95) -> DataFrame:
    """The manual rule for routes of long hauls, as a frame (as_of, route, margin): where more than ``share`` of at least
    ``min_rows`` rows took 21 days or longer, the margin reaches the ``q`` percentile."""
    m = margins_as_of(merged, q)
    return m.filter((F.col("n") >= min_rows) & (F.col("long_share") > share)).select("as_of", ROUTE, F.col("buffer").alias("margin"))


def route_margin_rules(buffers: DataFrame, overrides: DataFrame | None = None, keys: Sequence[str] = (ROUTE,)) -> DataFrame:
    """Margin per route (or per other ``keys``, such as as_of and route) from past arrivals, with an optional override
    frame ``(*keys, margin)`` taking precedence."""
    keys = list(keys)
    b = buffers.select(*keys, F.col("buffer").alias("_b"))
    if overrides is None:
        return b.select(*keys, F.col("_b").alias("margin"), F.lit("history").alias("source"))
    o = overrides.select(*keys, F.col("margin").cast("double").alias("_o"))
    return (b.join(o, keys, "full")
            .select(*keys, F.coalesce("_o", "_b").alias("margin"),
                    F.when(F.col("_o").isNotNull(), "override").otherwise("history").alias("source")))
