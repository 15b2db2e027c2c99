"""The queries of this subpackage, for the driver's entry file."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, langid, lm, mixing, neardup, quality, substring, toxicity, winnow
from .store import text_session


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return text_session(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    held = langid.held_out(F.col("doc_id"), 7, 2)
    scored = lm.score(documents, *lm.learn(documents.where(~held)))
    return scored.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    held = langid.held_out(F.col("doc_id"), 4, 2)
    found = langid.identify(documents, langid.learn(documents.where(~held)))
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.shared_passages(table(spark, sf_dir, "documents")).drop("row", "lead_row")


def op4_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnow.compared(table(spark, sf_dir, "documents"))


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat.format_digests(rows.unionByName(more))


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(table(spark, sf_dir, "documents")).drop("text_key")


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.token_digests(table(spark, sf_dir, "documents"), *bpe.public_vocabulary())


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = langid.held_out(F.col("doc_id"), 3, 1)
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").where(~held)
    found = toxicity.score(documents, toxicity.learn(documents, labels))
    return found.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.by_first_position(mixing.mix(table(spark, sf_dir, "documents")))
    return mixed.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken", "first_position", "positions")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return quality.with_quality(documents, ["doc_id"], quality.learn_references(documents))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_lm_scoring, op2_language_id, op3_substring_dedup, op4_winnowing, op5_chat_formatting, op6_minhash_near_dedup, op7_bpe, op8_toxicity, op9_mixing, op10_quality)}


def oracle_sql() -> dict[str, str]:
    return {}
