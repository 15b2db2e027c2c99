"""From raw documents to token ids: quality, near-duplicates, passages, mix, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next stage's docs.  All stages but
the last return the columns of documents; a document that the mix takes twice
is there twice, as equal rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from voxelframe.llm import bpe, mixing, neardup, quality, substring
from voxelframe.llm.store import text_session, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    text_session(spark)
    return quality.reject_low_quality(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates stays: that of the least doc_id."""
    text_session(spark)
    return neardup.keep_one_of_each(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A passage that repeats stays in one document and is cut out of the others."""
    text_session(spark)
    return substring.without_repeats(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each source's documents as often as its target says."""
    return mixing.mixed_documents(docs)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id and the ids of each text."""
    text_session(spark)
    return bpe.encode(docs, *bpe.public_vocabulary())


STAGES = [
    ("quality rules", quality_rules),
    ("near-dedup", near_dedup),
    ("substring dedup", substring_dedup),
    ("mixing", mix_sources),
    ("byte-level BPE", encode_tokens),
]

#: Signatures, divergences and merges are not expressible in SQL; tests compare
#: each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
