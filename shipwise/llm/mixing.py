"""Mixing sources to target weights: water-filled targets and Pareto order sampling.

Targets: the mix has BUDGET times all sizes (words ``[^\\x20\\x09-\\x0D]+``).
Sources in code point order, null last, get the weights WEIGHTS in turn and
share the budget by weight; a target stops at MAX_REPEATS times its source's
size and the excess is reshared by weight. That is target = min(MAX_REPEATS *
size, level * weight) for one level, found in closed form from prefix sums over
the sources in the order of MAX_REPEATS * size / weight.

Sample: a source whose target is f times its size takes floor(f) certain whole
copies of every document. The rest p = f - floor(f) is a Pareto order sample:
documents rank by their random odds u / (1 - u) divided by their inclusion odds
p / (1 - p), u in (0, 1) from a hash of the doc_id, and are taken in that order
while the words taken stay nearest to the rest of the target (fixed size in
words). Inclusion probabilities differ from source to source.

Order without a global sort: ranks are cut into RANK_BINS bins by p-free u, the
bins' words are summed first (map-side combined), and only the one bin of each
source in which the target falls is ordered document by document. A source with
a third of all rows is thus spread over all tasks.

Defined cases: null and empty texts have size 0 and are taken 0 words; a null
source is a source of its own, after all others; equal ranks are ordered by
doc_id, then size (rows equal in both are interchangeable; a null doc_id hashes
as the empty text); an empty table gives an empty result; extra columns are
ignored unless carried by ``mixed_copies``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

WEIGHTS = (5, 2, 1)
BUDGET = 1.0
MAX_REPEATS = 3
RANK_BINS = 1024
WORD = r"[^\x20\x09-\x0D]+"
SEED = "mix-1"


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def uniform(doc_id: Column) -> Column:
    """In (0, 1), from the first 48 bits of an md5; the same in any SQL engine."""
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(SEED), F.coalesce(doc_id.cast("string"), F.lit("")))), 1, 12), 16, 10)
    return (bits.cast("double") + 0.5) / float(2**48)


def source_targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, target) from (source, n), with n summed to one row per source."""
    by_order = W.orderBy(F.col("source").isNull(), "source")
    sources = (sizes.groupBy("source").agg(F.sum("n").alias("source_size"))
               .withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.pmod(F.row_number().over(by_order) - 1, F.lit(len(WEIGHTS))) + 1).cast("int")))
               .withColumn("cap", F.col("source_size") * MAX_REPEATS))
    # in this order sources fill up; when all before one are full, the rest of the budget is shared by the weights from it on
    fill = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    left = F.sum("source_size").over(W.partitionBy()) * F.lit(BUDGET) - (F.sum("cap").over(fill.rowsBetween(W.unboundedPreceding, 0)) - F.col("cap"))
    level = left / F.sum("weight").over(fill.rowsBetween(0, W.unboundedFollowing))
    reached = F.max(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))).over(W.partitionBy())
    target = F.when(F.col("at").isNull(), F.col("cap").cast("double")).otherwise(F.least(F.col("cap").cast("double"), F.col("at") * F.col("weight")))
    return sources.withColumn("level", level).withColumn("at", reached).select("source", "source_size", target.alias("target"))


def mixed(docs: DataFrame) -> DataFrame:
    """Every row's columns in a struct ``row``, with doc_id, size, source_size, target and copies (whole ones and the sampled one)."""
    sized = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row")).select(
        "row", F.col("row.doc_id").alias("doc_id"), F.col("row.source").cast("string").alias("source"), words(F.col("row.text")).alias("size"),
        uniform(F.col("row.doc_id")).alias("u"))
    bin_of = F.floor(F.col("u") * RANK_BINS).cast("int")  # within a source the rank grows with u
    bins = sized.groupBy("source", bin_of.alias("bin")).agg(F.sum("size").alias("n"))
    has = F.col("source_size") > 0
    plan = (source_targets(bins).withColumn("whole", F.when(has, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
            .withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
            .withColumn("odds", F.when(has, F.col("rest") / (F.col("source_size") - F.col("rest"))))
            .withColumnRenamed("source", "s"))
    upto = F.sum("n").over(W.partitionBy("source").orderBy("bin"))
    cut = (bins.withColumn("before", upto - F.col("n")).join(plan.select("s", "rest"), F.col("source").eqNullSafe(F.col("s")))
           .where("before <= rest and before + n > rest").select(F.col("source").alias("t"), F.col("bin").alias("cut"), "before"))
    plan = plan.join(cut, F.col("s").eqNullSafe(F.col("t")), "left").drop("t")
    dealt = sized.join(plan, F.col("source").eqNullSafe(F.col("s"))).drop("s").withColumn("bin", bin_of)
    out = ["row", "doc_id", "size", "source_size", "target"]
    clear = dealt.where("cut is null or bin <> cut").select(*out, (F.col("whole") + F.when((F.col("rest") > 0) & (F.col("bin") < F.col("cut")), 1).otherwise(0)).alias("copies"))
    ranked = W.partitionBy("source").orderBy(F.try_divide(F.col("u") / (1 - F.col("u")), F.col("odds")), "doc_id", "size").rowsBetween(W.unboundedPreceding, 0)
    half_way = F.col("before") + F.sum("size").over(ranked) - F.col("size") / 2
    edge = dealt.where("bin = cut").withColumn("mid", half_way).select(*out, (F.col("whole") + F.when((F.col("rest") > 0) & (F.col("mid") <= F.col("rest")), 1).otherwise(0)).alias("copies"))
    return clear.unionByName(edge)


def mixed_copies(docs: DataFrame) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as many times as it is taken (rows of size 0 are not)."""
    return (mixed(docs).where("copies > 0 and size > 0")
            .select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy")).select("row.*"))


ORACLE_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         (('0x' || substr(md5('mix-1' || coalesce(doc_id::VARCHAR, '')), 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0::DOUBLE AS u
  FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, 3 * sum(size)::BIGINT AS cap,
         [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight
  FROM sized GROUP BY source),
levels AS (
  SELECT *, ((sum(source_size) OVER ())::DOUBLE * 1.0::DOUBLE - (sum(cap) OVER w - cap)::DOUBLE) / (sum(weight) OVER v)::DOUBLE AS level
  FROM sources
  WINDOW w AS (ORDER BY cap::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
         v AS (ORDER BY cap::DOUBLE / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
filled AS (SELECT *, max(CASE WHEN level * weight <= cap THEN level END) OVER () AS reached FROM levels),
plan AS (
  SELECT source, source_size, coalesce(least(cap::DOUBLE, reached * weight), cap::DOUBLE) AS target FROM filled),
parts AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM plan),
ranked AS (
  SELECT s.doc_id, s.size, p.source_size, p.target, p.whole, p.target - p.whole * p.source_size AS rest,
         sum(s.size) OVER (PARTITION BY s.source ORDER BY s.u, s.doc_id, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - s.size / 2.0::DOUBLE AS mid
  FROM sized s JOIN parts p ON s.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target, (size * (whole + CASE WHEN rest > 0 AND mid <= rest THEN 1 ELSE 0 END))::BIGINT AS taken FROM ranked
"""
