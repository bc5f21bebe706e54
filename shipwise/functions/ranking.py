"""Distributed global ranks, exact grouped percentiles and the chronological split.

``rank_rows`` gives every row its 0-based position in a total order without a
single-partition window: rows are range-partitioned on the order columns
(Spark samples the boundaries), sorted within each partition and numbered
there; the checkpoint fixes partition contents so the per-partition counts and
the numbering agree; the offset of each partition is a running sum over one
row per partition (a frame bounded by the partition count). Rows equal on all
order columns lie in one partition: give it columns that tell rows apart.

``percentile`` and ``chrono_split`` select instead of sorting: sketches or
counts by day and hour narrow the target ranks down to a small range, and only
that range is put in order. Percentiles interpolate linearly between the two
closest ranks (numpy's default and DuckDB's ``quantile_cont``).
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

_POS_MASK = (1 << 33) - 1  # record number bits of monotonically_increasing_id


def rank_rows(df: DataFrame, order: Sequence[str | Column], rank_col: str = "_rank",
              partitions: int | None = None) -> DataFrame:
    """Add ``rank_col``: 0-based position of each row in ``order`` (ascending).

    Rows equal on every order column get distinct but arbitrary ranks. The
    result is checkpointed (reliable, in ``spark.checkpoint.dir``).
    """
    ensure_checkpoint_dir(df.sparkSession)
    parts = [partitions] if partitions else []
    s = (df.repartitionByRange(*parts, *order).sortWithinPartitions(*order)
         .withColumn("_pid", F.spark_partition_id())
         .withColumn("_pos", F.monotonically_increasing_id().bitwiseAND(F.lit(_POS_MASK))))
    s = s.checkpoint(eager=True)
    offsets = (s.groupBy("_pid").agg(F.count(F.lit(1)).alias("_bn"))
               .withColumn("_off", F.coalesce(
                   F.sum("_bn").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)),
                   F.lit(0)))
               .select("_pid", "_off"))
    # one row per partition: a broadcast whose size is bounded by the partition count
    return (s.join(F.broadcast(offsets), "_pid")
            .withColumn(rank_col, (F.col("_off") + F.col("_pos")).cast("bigint"))
            .drop("_pid", "_pos", "_off"))


# Rows of a group up to which it is numbered in one task.
GROUP_ROWS = 100_000


def number_within(df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str,
                  start: int = 1, counted: DataFrame | None = None) -> DataFrame:
    """Row number of each row inside its ``keys`` group in ``order`` (what
    ``row_number() OVER (PARTITION BY keys ORDER BY order)`` gives). Rows with
    a NULL key are left out.

    Groups of at most GROUP_ROWS rows are numbered by that window: one shuffle
    by ``keys``, or none if the rows lie so. Rows of larger groups get a global
    rank on ``keys + order`` less the group's first rank, so such a group is
    spread over many range partitions. ``counted``: what to count the groups'
    rows in instead of ``df`` (any frame with ``keys``; it decides the way, not
    the numbers)."""
    keys = list(keys)
    rows = df.filter(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys]))
    ensure_checkpoint_dir(df.sparkSession)
    # at most one row for each GROUP_ROWS of the input
    large = ((rows if counted is None else counted).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
             .filter(F.col("_n") > GROUP_ROWS).select(*keys).checkpoint(eager=True))
    within = Window.partitionBy(*keys).orderBy(*order)
    number = (F.row_number().over(within) + F.lit(start - 1)).cast("int")
    if large.isEmpty():
        return rows.withColumn(out, number)
    large = F.broadcast(large)
    r = rank_rows(rows.join(large, keys, "left_semi"), [*keys, *order], rank_col="_grank")
    first = r.groupBy(*keys).agg(F.min("_grank").alias("_g0"))
    spread = (r.join(first, keys).withColumn(out, (F.col("_grank") - F.col("_g0") + F.lit(start)).cast("int"))
              .drop("_grank", "_g0"))
    return rows.join(large, keys, "left_anti").withColumn(out, number).unionByName(spread)


# Width of the bracket around a target rank (a share of the group's rows), the accuracy of the sketch that gives it
# (rank errors of at most a tenth of the width), and the cells into which a bracket is cut before its values are ranked.
BRACKET, SKETCH, CELLS = 0.001, 10_000, 1024


def percentile(df: DataFrame, value: str, q: float, keys: Sequence[str] = (),
               alias: str | None = None, method: str = "exact") -> DataFrame:
    """Per-group ``q``-percentile of ``value`` (NULL values ignored; a NULL
    group key is a group of its own). One row per group: keys + ``alias``.

    Exact, by selection: a mergeable sketch (one pass) brackets the target
    ranks of every group; a second pass reduces the rows to one count below
    the bracket and one a distinct value inside it, combined before the
    shuffle, so a value that most rows share is one row. The bracket's values
    are first counted in CELLS ranges, and only the cells that hold the target
    ranks are put in order. No row is sorted, and none outside the bracket
    is shuffled. ``method='approx'`` returns the sketch's value instead.
    """
    alias = alias or f"p{int(round(q * 100))}_{value}"
    keys = list(keys)
    # 0.0 and -0.0 are one value
    x = df.select(*keys, (F.col(value).cast("double") + F.lit(0.0)).alias("_v")).filter(F.col("_v").isNotNull())
    if method == "approx":
        return x.groupBy(*keys).agg(F.percentile_approx("_v", q, SKETCH).alias(alias))
    if method != "exact":
        raise ValueError(method)
    n = F.count(F.lit(1))
    ends = F.percentile_approx("_v", [max(0.0, q - BRACKET), min(1.0, q + BRACKET)], SKETCH)
    pos = (F.col("_n") - 1).cast("double") * F.lit(float(q))
    # a bracket of a few ranks is the whole group, as is one that reaches the end of the ranks
    thin = F.col("_n") * F.lit(BRACKET) < 4
    g = (x.groupBy(*keys).agg(n.alias("_n"), ends.alias("_e"), F.min("_v").alias("_min"), F.max("_v").alias("_max"))
         .select(*keys, "_n", pos.alias("_p"),
                 F.when(thin | F.lit(q <= BRACKET), F.col("_min")).otherwise(F.col("_e")[0]).alias("_a"),
                 F.when(thin | F.lit(q >= 1 - BRACKET), F.col("_max")).otherwise(F.col("_e")[1]).alias("_b"))
         .withColumn("_lo", F.floor("_p").cast("bigint")).withColumn("_hi", F.ceil("_p").cast("bigint")))
    j = _with_group(x, g, keys)
    if j is None:
        return df.sparkSession.createDataFrame([(None,)], f"`{alias}` double")
    inside = F.col("_v") >= F.col("_a")
    cell = F.floor(F.try_divide(F.col("_v") - F.col("_a"), F.col("_b") - F.col("_a")) * F.lit(CELLS)).cast("int")
    groups = [*keys, "_p", "_lo", "_hi"]
    counts = (j.filter(F.col("_v") <= F.col("_b"))
              .groupBy(*groups, F.when(inside, F.coalesce(cell, F.lit(0))).otherwise(-1).alias("_cell"), F.when(inside, F.col("_v")).alias("_u"))
              .agg(F.count(F.lit(1)).alias("_c")))
    # at most CELLS + 2 rows a group
    cells = counts.groupBy(*groups, "_cell").agg(F.sum("_c").alias("_c"))
    run = Window.partitionBy(*groups).orderBy("_cell").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    held = (cells.withColumn("_to", F.sum("_c").over(run)).withColumn("_from", F.col("_to") - F.col("_c"))
            .filter(_holds("_from", "_to")).select(*[F.col(k).alias(f"_g_{k}") for k in keys], F.col("_cell").alias("_k"), "_from"))
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_g_{k}")) for k in keys] + [F.col("_cell") == F.col("_k")])
    near = counts.join(held, on).select(*groups, "_k", "_u", "_c", "_from")
    run = Window.partitionBy(*groups, "_k").orderBy("_u").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    near = (near.withColumn("_to", F.col("_from") + F.sum("_c").over(run)).withColumn("_from", F.col("_to") - F.col("_c"))
            .filter(_holds("_from", "_to")))
    at = lambda r: F.max(F.when((F.col("_from") <= F.col(r)) & (F.col(r) < F.col("_to")), F.col("_u")))
    res = near.groupBy(*groups).agg(at("_lo").alias("_x"), at("_hi").alias("_y"))
    return res.select(*keys, lerp(F.col("_x"), F.col("_y"), F.col("_p") - F.col("_lo").cast("double")).alias(alias))


def _holds(start: str, end: str) -> Column:
    """Does the range of ranks hold a target rank?"""
    return reduce(lambda a, b: a | b, [(F.col(start) <= F.col(r)) & (F.col(r) < F.col(end)) for r in ("_lo", "_hi")])


def _with_group(x: DataFrame, g: DataFrame, keys: list[str]) -> DataFrame | None:
    """Each row with its group's numbers; without keys these are scalars, read once on the driver (None without rows)."""
    names = ("_p", "_lo", "_hi", "_a", "_b")
    if keys:
        gr = g.select(*[F.col(k).alias(f"_g_{k}") for k in keys], *names)
        on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_g_{k}")) for k in keys])
        return x.join(gr, on).drop(*[f"_g_{k}" for k in keys])
    row = g.first()
    if not row["_n"]:
        return None
    return x.select("_v", *[F.lit(row[c]).cast("bigint" if c in ("_lo", "_hi") else "double").alias(c) for c in names])


def lerp(a: Column, b: Column, t: Column) -> Column:
    """numpy's linear interpolation: ``a + (b-a)*t``, computed from ``b`` when ``t >= 0.5``."""
    return F.when(t >= 0.5, b - (b - a) * (F.lit(1.0) - t)).otherwise(a + (b - a) * t)


def split_boundary(df: DataFrame, rows: int, order: Sequence[str]) -> Row | None:
    """The ``order`` key (as strings) of the ``rows``-th row in that order, NULL first; None if there is no such row.

    The first column is a timestamp. Days are counted, then the hours of the
    day that holds the row, and only the rows of that hour are put in order.
    """
    if rows < 1:
        return None
    part, before = df, 0
    for unit in (F.to_date(order[0]), F.hour(order[0])):
        cells = part.groupBy(unit.alias("_t")).agg(F.count(F.lit(1)).alias("_n"))
        # a running count over one row a day, then over at most 24
        run = Window.orderBy(F.col("_t").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        cut = cells.withColumn("_to", F.sum("_n").over(run) + F.lit(before)).filter(F.col("_to") >= F.lit(rows)).orderBy("_to").first()
        if cut is None:
            return None
        part, before = part.filter(unit.eqNullSafe(F.lit(cut["_t"]))), cut["_to"] - cut["_n"]
    ranked = rank_rows(part.select(*order), [F.col(c).asc_nulls_first() for c in order])
    return ranked.filter(F.col("_rank") == F.lit(rows - before - 1)).select(*[F.col(c).cast("string").alias(c) for c in order]).first()


def chrono_split(df: DataFrame, frac: float = 0.8,
                 order: Sequence[str] = ("order_purchase_timestamp", "order_id", "order_item_id"),
                 split_col: str = "split") -> DataFrame:
    """Label the first ``int(frac * n)`` rows in ``order`` as ``train``
    and the rest as ``test``, by comparing each row with the key of the last
    train row (``split_boundary``): the rows themselves are not moved.
    ``order`` must be unique for a repeatable split."""
    k = int(df.count() * frac)  # the source's int(len(df) * 0.8)
    last = split_boundary(df, k, order)
    if last is None:
        return df.withColumn(split_col, F.lit("test"))
    types = dict(df.dtypes)
    key = F.struct(*[F.lit(last[c]).cast(types[c]).alias(c) for c in order])
    return df.withColumn(split_col, F.when(F.struct(*order) <= key, "train").otherwise("test"))
