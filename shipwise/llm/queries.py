"""Registered queries of the training-data operators: each applies its operator to the whole of its table."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from . import ann, collocations, embed_dedup, hard_negatives, langid, lm_score, mixing, sentencepiece_codec, token_count, token_file, toxicity
from .minhash import near_duplicates
from .substring import dedup_substrings

Query = Callable[[SparkSession, str], DataFrame]
PIECES = "piece_bpe_32k.model"
WORD_BPE = "word_bpe_49k.json"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ensure_checkpoint_dir(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def piece_model(path: str | None = None) -> bytes:
    """The model file, read by the driver."""
    return Path(path or public_tokenizers.path(PIECES)).read_bytes()


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class of near duplicates of every document."""
    return near_duplicates(_table(spark, sf_dir, "documents"))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Start, number and checksum of every document's ids, from the files written."""
    docs = _table(spark, sf_dir, "documents")
    path = token_file.new_folder(spark)
    token_file.write_token_files(docs, path, Path(public_tokenizers.path(WORD_BPE)).read_text(encoding="utf-8"))
    return token_file.read_token_files(spark, path)


def op3_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of every vector."""
    return embed_dedup.near_duplicate_vectors(_table(spark, sf_dir, "embeddings"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document."""
    docs = _table(spark, sf_dir, "documents")
    marked = docs.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "text")
    return langid.identify(marked, langid.fit(docs), ("doc_id", "held_out"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that repeat earlier text in runs of 20 or more, removed."""
    return dedup_substrings(_table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op6_sentencepiece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Piece ids of every document, with the checks of encoding and decoding."""
    return sentencepiece_codec.encode(_table(spark, sf_dir, "documents"), piece_model())


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document."""
    docs = _table(spark, sf_dir, "documents")
    marked = docs.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "text")
    return toxicity.score(marked, toxicity.fit(docs, _table(spark, sf_dir, "labels")), ("doc_id", "held_out"))


def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """20 nearest neighbours of every 20th vector."""
    return ann.nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    return mixing.mixed(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of unigram pieces of every document."""
    return token_count.count_tokens(_table(spark, sf_dir, "documents"), piece_model())


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every 50th vector."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return (hard_negatives.mine(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, label)
            .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))


def op12_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probability of every document, by the model and by word counts."""
    held = F.coalesce(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 7 == 2, F.lit(False))
    return lm_score.score_texts(_table(spark, sf_dir, "documents"), ~held).withColumn("held_out", held)


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's first 2000 collocations."""
    return collocations.collocations(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    found = (op1_minhash_near_dedup, op2_token_files, op3_embedding_near_dedup, op4_language_id, op5_substring_dedup,
             op6_sentencepiece_codec, op7_toxicity, op8_nearest_neighbours, op9_source_mixing, op10_token_counts,
             op11_hard_negatives, op12_lm_scores, op13_phrase_collocations)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op9_source_mixing": mixing.ORACLE_SQL, "op11_hard_negatives": hard_negatives.ORACLE_SQL,
            "op13_phrase_collocations": collocations.ORACLE_SQL}
