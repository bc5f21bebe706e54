"""Connected components of a link table by alternating star contraction."""

from __future__ import annotations

import gc

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def release(spark: SparkSession) -> None:
    """Has Spark delete the shuffle files of steps whose results are checkpointed: it does so once the driver has
    collected the objects that stand for them, which long jobs with a large heap rarely reach by themselves."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _both(edges: DataFrame) -> DataFrame:
    """Every edge in both directions, in one pass over the edges."""
    return edges.select(F.inline(F.array(F.struct(F.col("u").alias("u"), F.col("v").alias("v")), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))))


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) for every id in ``links``; component is the smallest id it reaches.

    Each round hangs the larger neighbours of every node under the smallest
    one, then the smaller neighbours. The minimum of a node is a map-side
    combined aggregate and the joins are plain equi-joins, so a hub of any
    degree stays splittable. The rounds are logarithmic in the longest path;
    each is checkpointed to the shared folder. Nulls and self links are dropped.
    """
    edges = (links.select(F.col(a).alias("u"), F.col(b).alias("v"))
             .where("u is not null and v is not null and u <> v")
             .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct().checkpoint())
    while True:
        both = _both(edges)
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .union(low.select("u", "m"))
                 .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct().checkpoint())
        release(edges.sparkSession)
        ends = small.select(F.inline(F.array(F.struct(F.col("u").alias("id"), F.lit(1).alias("up"), F.lit(0).alias("down")),
                                             F.struct(F.col("v").alias("id"), F.lit(0).alias("up"), F.lit(1).alias("down")))))
        flat = ends.groupBy("id").agg(F.sum("up").alias("up"), F.sum("down").alias("down")).where("up > 1 or (up > 0 and down > 0)").isEmpty()
        edges = small
        if flat:
            roots = edges.select(F.col("v").alias("id")).distinct().withColumn("component", F.col("id"))
            return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).union(roots)
