"""Load checks (A4-A6, A8): row counts, key violations, orphan rows.

The source enforced keys at insert time in its database; here they are
reports computed with aggregations and anti joins, so a bad row never fails
the load. Duplicate detection is a grouped count (partial aggregation on the
map side, so a hot key is pre-combined before the shuffle).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import FOREIGN_KEYS, PRIMARY_KEYS
from ..tables import Tables


def row_counts(t: Tables) -> DataFrame:
    """A4: one row per table with its row count."""
    parts = [df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table_name"), "rows")
             for name, df in t.unnumbered()]
    return reduce(DataFrame.unionByName, parts)


def key_violations(t: Tables) -> DataFrame:
    """A5: per table with a primary key, rows with a NULL key part, key values
    that occur more than once, and the rows carrying those values."""
    parts = []
    for name, keys in PRIMARY_KEYS.items():
        df = getattr(t, name)
        if df is None:
            continue
        null_any = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
        # one grouped pass; rows with a NULL key part land in NULL groups
        per_key = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).withColumn("_null", null_any)
        dup = ~F.col("_null") & (F.col("_n") > 1)
        parts.append(per_key.agg(
            F.coalesce(F.sum(F.when(F.col("_null"), F.col("_n"))), F.lit(0)).cast("bigint").alias("null_keys"),
            F.count(F.when(dup, 1)).alias("duplicate_keys"),
            F.coalesce(F.sum(F.when(dup, F.col("_n"))), F.lit(0)).cast("bigint").alias("duplicate_rows"),
        ).select(F.lit(name).alias("table_name"), F.lit(",".join(keys)).alias("key_columns"),
                 "null_keys", "duplicate_keys", "duplicate_rows"))
    return reduce(DataFrame.unionByName, parts)


def orphan_rows(t: Tables) -> DataFrame:
    """Per foreign key, child rows whose non-NULL key has no parent row,
    with the smallest such key as a sample (NULL when there is none)."""
    parts = []
    tables = dict(t.unnumbered())
    for child, ccol, parent, pcol in FOREIGN_KEYS:
        c, p = tables.get(child), tables.get(parent)
        if c is None or p is None:
            continue
        orphans = (c.select(F.col(ccol).alias("_k")).filter(F.col("_k").isNotNull())
                   .join(p.select(F.col(pcol).alias("_k")), "_k", "left_anti"))
        parts.append(orphans.agg(F.count(F.lit(1)).alias("orphans"), F.min("_k").alias("sample_key")).select(
            F.lit(f"{child}.{ccol} -> {parent}.{pcol}").alias("relation"), "orphans", "sample_key"))
    return reduce(DataFrame.unionByName, parts)


def list_tables(spark: SparkSession) -> DataFrame:
    """Tables and views of the current catalog, ordered by name."""
    rows = [(x.name, "view" if x.isTemporary else (x.tableType or "table").lower())
            for x in spark.catalog.listTables()]
    return spark.createDataFrame(rows, "name string, type string").orderBy("name")
