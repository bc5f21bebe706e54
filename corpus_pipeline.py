"""A corpus preparation pipeline over ``documents``, as stages that are each written and reread.

Every stage takes and, but for the last, returns the columns of its input,
whatever further columns that has, works on all rows and puts its decisions
into effect. The stages handle null columns, empty texts, repeated rows and
empty tables as their operators define.
"""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shipwise.llm import langid, sentencepiece_codec
from shipwise.llm.minhash import near_duplicates
from shipwise.llm.mixing import mixed_copies
from shipwise.llm.queries import piece_model
from shipwise.llm.substring import dedup_substrings
from shipwise.session import ensure_checkpoint_dir

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _row(docs: DataFrame):
    return F.struct(*(docs[c] for c in docs.columns)).alias("__row")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language go: null texts and texts without a letter."""
    found = langid.identify(docs.select("text", _row(docs)), langid.fit(docs), ("__row",))
    return found.where(F.col("lang_pred") != "und").select("__row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near duplicates stays, the one of smallest doc_id. Texts that share a doc_id are classed each on their own; of rows equal in doc_id and text, one stays. Rows without a doc_id stay."""
    ensure_checkpoint_dir(spark)
    text, doc_id = F.coalesce(F.col("text").cast("string"), F.lit("")), F.col("doc_id").cast("long")
    names = docs.where("doc_id is not null").select(doc_id.alias("doc"), F.xxhash64(text).alias("h"))
    several = names.groupBy("doc").agg(F.min("h").alias("h"), F.max("h").alias("last")).where("h <> last").select("doc").checkpoint()
    rows = docs.select(doc_id.alias("doc"), text.alias("text"), _row(docs))
    if several.isEmpty():
        found = near_duplicates(rows.select(F.col("doc").alias("doc_id"), "text"))
        gone = found.where("not kept").select(F.col("doc_id").alias("id")).distinct()
        rows = rows.withColumn("id", F.col("doc"))
    else:
        # a text of a doc_id with several goes by a hash of both
        rows = rows.join(several.withColumn("many", F.lit(True)), "doc", "left").withColumn("id", F.when(F.col("many"), F.xxhash64("doc", "text")).otherwise(F.col("doc")))
        found = near_duplicates(rows.select(F.col("id").alias("doc_id"), "text")).where("doc_id is not null").select(F.col("doc_id").alias("id"), "class_id").distinct()
        first = found.join(rows.select("id", "doc").distinct(), "id").groupBy("class_id").agg(F.min(F.struct("doc", "id")).getField("id").alias("first"))
        gone = found.join(first, "class_id").where("id <> first").select("id")
    # of rows equal in doc_id and text, the one whose other columns come first
    rest = F.to_json(F.struct(*(F.col("__row")[c].alias(c) for c in docs.columns if c != "text")))
    one = rows.where("doc is not null").join(gone, "id", "left_anti").groupBy("id").agg(F.min_by("__row", F.struct(F.col("text"), rest)).alias("__row"))
    return one.select("__row").unionByName(rows.where("doc is null").select("__row")).select("__row.*")


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages go, and with them documents that hold nothing else; n_chars follows the text."""
    rest = [c for c in docs.columns if c != "text"]
    kept = dedup_substrings(docs.select("doc_id", "text", F.struct(*(docs[c] for c in rest)).alias("__row")), ("__row",))
    own = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return kept.where("n_words = 0 or n_removed < n_words").select(*((own[c] if c in own else F.col("__row")[c]).alias(c) for c in docs.columns))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: each document as often as it is taken."""
    return mixed_copies(docs)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang and source of every row with its ids and the checks of encoding and decoding."""
    return sentencepiece_codec.encode(docs, piece_model(), ("doc_id", "lang", "source"))


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("source_mixing", source_mixing),
    ("sentencepiece", sentencepiece),
]
#: Suffix automata, weighted sampling and piece ids are beyond SQL: tests/llm holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to ``documents``; every stage's rows are written to the shared folder and read again."""
    shared = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{shared}/{k}-{name}")
        docs = spark.read.parquet(f"{shared}/{k}-{name}")
    return docs
