"""Column expressions shared by the analyses.

All of these are built-in Spark expressions, so they stay inside whole-stage
codegen; nothing here is a Python UDF.

Exactness. Averages of durations are computed as an exact sum of integer
microseconds divided once, and every rounded output goes through ``decimal``
(half away from zero). The result therefore does not depend on the order in
which partitions are summed, and the same value comes out of any engine that
follows the same recipe.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS_PER_DAY = 86_400_000_000.0


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ---------------------------------------------------------------- durations
def micros_between(later: str | Column, earlier: str | Column) -> Column:
    """``later - earlier`` in microseconds (bigint); NULL if either is NULL."""
    return F.timestamp_diff("MICROSECOND", col(earlier), col(later))


def days_between(later: str | Column, earlier: str | Column) -> Column:
    """``later - earlier`` in fractional days."""
    return micros_between(later, earlier) / F.lit(MICROS_PER_DAY)


def whole_days(later: str | Column, earlier: str | Column) -> Column:
    """Day difference rounded half away from zero, as bigint (``delay_days``)."""
    return F.round(days_between(later, earlier), 0).cast("bigint")


def add_hours(ts: str | Column, n: int | Column) -> Column:
    return F.timestamp_add("HOUR", F.lit(n) if isinstance(n, int) else n.cast("int"), col(ts))


# ---------------------------------------------------------------- rounding
def rnd(c: str | Column, digits: int = 0) -> Column:
    """Round half away from zero through decimal, returned as double (F1)."""
    return F.round(col(c).cast("decimal(38,9)"), digits).cast("double")


def bround(c: str | Column, digits: int = 1) -> Column:
    """Round half to even (Python/numpy ``round``, F2)."""
    return F.bround(col(c).cast("decimal(38,9)"), digits).cast("double")


# ---------------------------------------------------------------- aggregates
def count_when(cond: Column) -> Column:
    """``SUM(CASE WHEN cond THEN 1 ELSE 0 END)`` as bigint."""
    return F.sum(F.when(cond, 1).otherwise(0)).cast("bigint")


def pct(num: Column, den: Column, digits: int = 1) -> Column:
    """``num * 100 / den`` rounded (G5); NULL when ``den`` is 0."""
    return rnd(F.try_divide(num.cast("double") * F.lit(100.0), den.cast("double")), digits)


def pct_when(cond: Column, digits: int = 1) -> Column:
    """Share of rows of the group meeting ``cond``, in percent."""
    return pct(count_when(cond), F.count(F.lit(1)), digits)


def exact_sum_micros(us: Column) -> Column:
    return F.sum(us.cast("decimal(38,0)"))


def avg_days(us: str | Column) -> Column:
    """Exact mean of a microsecond duration column, in days (NULLs ignored)."""
    us = col(us)
    return F.try_divide(exact_sum_micros(us).cast("double"), F.count(us).cast("double")) / F.lit(MICROS_PER_DAY)


def avg_int(c: str | Column) -> Column:
    """Mean of an integer column: exact bigint sum over count."""
    c = col(c)
    return F.try_divide(F.sum(c.cast("bigint")).cast("double"), F.count(c).cast("double"))


def money_sum(c: str | Column) -> Column:
    """Exact sum of a two-decimal money column (as decimal)."""
    return F.sum(col(c).cast("decimal(18,2)"))


def avg_money(c: str | Column) -> Column:
    c = col(c)
    return F.try_divide(money_sum(c).cast("double"), F.count(c).cast("double"))


def weighted_avg_days(us: Column, w: Column) -> Column:
    """Exact mean of ``us`` where each row stands for ``w`` joined rows."""
    num = F.sum(us.cast("decimal(20,0)") * w.cast("decimal(12,0)"))
    den = F.sum(F.when(us.isNotNull(), w).otherwise(0))
    return F.try_divide(num.cast("double"), den.cast("double")) / F.lit(MICROS_PER_DAY)


# ---------------------------------------------------------------- buckets
def bucket(c: str | Column, cuts: Sequence[float], labels: Sequence[str]) -> Column:
    """Searched CASE: first label whose cut-off ``c <= cut`` holds, else the last
    label (which also catches NULL), as in the source's CASE chains (B7)."""
    if len(labels) != len(cuts) + 1:
        raise ValueError("need one more label than cut-offs")
    c = col(c)
    expr = None
    for cut, label in zip(cuts, labels):
        expr = (F.when(c <= cut, label) if expr is None else expr.when(c <= cut, label))
    return expr.otherwise(labels[-1])


def right_closed_bin(c: str | Column, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """``pd.cut`` with right-closed bins ``(e0,e1], (e1,e2], ...``; outside -> NULL."""
    c = col(c)
    expr = None
    for lo, hi, label in zip(edges[:-1], edges[1:], labels):
        cond = (c > lo) & (c <= hi)
        expr = F.when(cond, label) if expr is None else expr.when(cond, label)
    return expr


# ---------------------------------------------------------------- misc
def is_late(delivered: str | Column, estimated: str | Column) -> Column:
    """Raw strict comparison ``delivered > estimated``."""
    return col(delivered) > col(estimated)


def same(a: str | Column, b: str | Column) -> Column:
    """1 when equal, 0 otherwise, including when either side is NULL."""
    return F.coalesce((col(a) == col(b)).cast("int"), F.lit(0))


def route(seller_state: str | Column, customer_state: str | Column) -> Column:
    """``seller_state + '_' + customer_state``; NULL if either is NULL."""
    return F.concat(col(seller_state), F.lit("_"), col(customer_state))


def volume(length: str | Column, height: str | Column, width: str | Column) -> Column:
    """Product of the three dimensions with NULL taken as 0."""
    z = F.lit(0)
    return (F.coalesce(col(length), z) * F.coalesce(col(height), z)
            * F.coalesce(col(width), z)).cast("double")


def month_label(ts: str | Column) -> Column:
    """``yyyy-MM`` of a timestamp."""
    return F.date_format(col(ts), "yyyy-MM")


def head_chars(c: str | Column, n: int) -> Column:
    """First ``n`` characters."""
    return F.substring(col(c), 1, n)
