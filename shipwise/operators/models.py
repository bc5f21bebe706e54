"""Arrival-time models (M9-M11, M19) and the five-method comparison (v2).

Models share one small interface: ``fit(train) -> fitted`` and
``fitted.transform(df, out) -> df`` with a prediction column ``out``.

* ``RouteMean`` / ``RouteQuantile``: per-route mean / percentile of the train
  arrival days, falling back to the global value. Deterministic, so the whole
  buffer chain built on them has exact SQL oracles.
* ``BoostedTrees`` (``shipwise.operators.boosting``): gradient-boosted trees
  for the mean (M9) and for a percentile (M10).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import MICROS_PER_DAY
from ..functions.ranking import percentile
from ..session import stored
from . import buffers as bf
from .boosting import BoostedModel, score_all
from .features import PROMISE, TARGET

ROUTE = "route"


# ------------------------------------------------------------------ stand-ins
class RouteMean:
    """Mean train arrival days per route (exact), global mean otherwise."""

    def fit(self, train: DataFrame) -> "_Lookup":
        us = F.col("actual_us")
        mean = F.try_divide(F.sum(us.cast("decimal(38,0)")).cast("double"), F.count(us).cast("double")) \
            / F.lit(MICROS_PER_DAY)
        per = train.filter(F.col(ROUTE).isNotNull()).groupBy(ROUTE).agg(mean.alias("_pred"))
        return _Lookup(per, train.agg(mean.alias("g")).first()["g"])


class RouteQuantile:
    """``alpha`` percentile of train arrival days per route, global otherwise."""

    def __init__(self, alpha: float = 0.85):
        self.alpha = alpha

    def fit(self, train: DataFrame) -> "_Lookup":
        per = percentile(train.filter(F.col(ROUTE).isNotNull()), TARGET, self.alpha, [ROUTE], alias="_pred")
        glob = percentile(train, TARGET, self.alpha, alias="g").first()["g"]
        return _Lookup(per, glob)


@dataclass
class _Lookup:
    per_route: DataFrame
    default: float | None    # None: no train rows

    def transform(self, df: DataFrame, out: str) -> DataFrame:
        return (df.join(self.per_route, ROUTE, "left")
                .withColumn(out, F.coalesce(F.col("_pred"), F.lit(self.default).cast("double")))
                .drop("_pred"))


# ------------------------------------------------------------------ M19
def split_counts(nodes: DataFrame) -> DataFrame:
    """Per feature, how many splits of the ensemble use it (the source's importance) and their total gain."""
    return (nodes.filter(F.col("feature").isNotNull()).groupBy("feature")
            .agg(F.count(F.lit(1)).alias("splits"), F.sum("gain").alias("gain")))


def feature_importance(nodes: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` features with the most splits."""
    return split_counts(nodes).orderBy(F.col("splits").desc(), "feature").limit(k)


# ------------------------------------------------------------------ v2 pipeline
# The prediction columns of the source's five methods.
METHODS = {
    "1_promise": PROMISE,
    "2_base": "pred_base",
    "3_route_buffer": "pred_route_buffer",
    "4_quantile_85": "pred_q85",
    "5_hybrid": "pred_hybrid",
}


#: What the buffers and reports read of a row.
NARROW = ("split", ROUTE, "customer_state", TARGET, PROMISE)
#: What the route models read, and what is read of the rows that they score.
ROUTE_ROWS = (*NARROW, "actual_us")


@dataclass
class Comparison:
    train: DataFrame         # train rows with pred_base and pred_q85
    test: DataFrame          # test rows with every prediction column
    route_stats: DataFrame   # M13 on the base model's train residuals
    buffers: DataFrame       # M15
    global_buffer: float     # M15, unseen routes
    hybrid_extra: DataFrame  # M18
    base: object
    quantile: object


def fit_pair(train: DataFrame, base, quantile, parallel: bool = True) -> tuple:
    """Both models, fitted side by side from two driver threads: each is a chain of short jobs, and Spark fills the gaps of
    one with those of the other. An error in either ends the call."""
    if not parallel:
        return base.fit(train), quantile.fit(train)
    from concurrent.futures import FIRST_EXCEPTION, ThreadPoolExecutor, wait
    pool = ThreadPoolExecutor(max_workers=2)
    try:
        jobs = [pool.submit(m.fit, train) for m in (base, quantile)]
        wait(jobs, return_when=FIRST_EXCEPTION)
        for job in jobs:
            if job.done() and job.exception():
                raise job.exception()
        return tuple(job.result() for job in jobs)
    finally:
        pool.shutdown(wait=False, cancel_futures=True)


def scored(frame: DataFrame, base, quantile) -> DataFrame:
    """One narrow frame of all rows with both predictions (boosted models: one pass over the features), stored:
    buffers, the hybrid and every report read this frame and nothing else."""
    if isinstance(base, BoostedModel) and isinstance(quantile, BoostedModel):
        used = [c for c in dict.fromkeys([*base.features, *quantile.features]) if c not in NARROW]
        x = score_all(frame.select(*NARROW, *used), {"pred_base": base, "pred_q85": quantile})
    else:
        x = quantile.transform(base.transform(frame, "pred_base"), "pred_q85")
        return stored(x.select(*NARROW, "pred_base", "pred_q85"))
    return x.select(*NARROW, "pred_base", "pred_q85").checkpoint(eager=True)


def compare_methods(frame: DataFrame, base=None, quantile=None, alpha: float = 0.85,
                    parallel: bool = True) -> Comparison:
    """v2 end to end: base model, method A (route buffers on its train
    residuals), method B (quantile model), method C (B plus extra days on
    routes still late too often), all applied to the test rows."""
    fb, fq = fit_pair(frame.filter(F.col("split") == "train"), base or RouteMean(), quantile or RouteQuantile(alpha), parallel)
    rows = scored(frame, fb, fq)
    train, test = (rows.filter(F.col("split") == s) for s in ("train", "test"))
    tr = bf.with_residual(train, "pred_base")
    stats = bf.route_stats(tr, q=alpha)
    buffers = bf.route_buffers(stats)
    gbuf = bf.global_buffer(tr, q=alpha)
    extra = bf.hybrid_extra(train, "pred_q85")
    te = bf.apply_hybrid(bf.apply_buffer(test, buffers, gbuf, "pred_base"), extra, "pred_q85")
    return Comparison(train, te, stats, buffers, gbuf, extra, fb, fq)
