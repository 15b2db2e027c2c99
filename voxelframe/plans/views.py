"""Domain views over the given tables: manifests, inventories, volumes and scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelframe.functions.labels import to_long


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def manifest(spark: SparkSession, sf_dir: str, text: bool = False) -> DataFrame:
    """Documents as samples, sources as patients, languages as views, with their labels."""
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    more = [F.sha2("text", 256).alias("pixel_hash")] if text else []
    rows = documents.select("doc_id", F.col("doc_id").cast("string").alias("sample_id"), F.col("source").alias("patient_id"), F.upper("lang").alias("view_position"), "n_chars", *more)
    return rows.join(labels, "doc_id", "left")


def label_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return to_long(manifest(spark, sf_dir), ("quality", "toxic"), ("sample_id", "patient_id"))


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sample_id, target, label, mask, score): text lengths as scores of both labels."""
    rows = to_long(manifest(spark, sf_dir), ("quality", "toxic"), ("sample_id", "n_chars"))
    return rows.select("sample_id", "target", F.coalesce("value", F.lit(0)).cast("double").alias("label"), F.col("value").isNotNull().cast("double").alias("mask"), F.col("n_chars").cast("double").alias("score"))


def repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("group_key"), F.col("user_id").alias("repeat"), "value", "ts", "event_id")


def dealt(rows: DataFrame, key: str, most: int = 250_000) -> DataFrame:
    """The rows, by ``key`` in tasks of about ``most`` rows if the session's partitions would hold more.

    For joins whose keys are then aggregated in the same task: its sorts and
    hash maps stay at one size, however many rows there are.
    """
    n = -(-rows.count() // most)
    return rows.repartition(n, key) if n > int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) else rows


def instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as patients, orders as studies, suppliers' lines as series."""
    orders, lines = table(spark, sf_dir, "orders"), dealt(table(spark, sf_dir, "lineitem"), "l_orderkey")
    rows = lines.join(orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.select(
        F.col("o_custkey").alias("patient_id"), F.col("o_orderkey").alias("study_id"), F.col("l_returnflag").alias("series_id"), F.col("l_linenumber").alias("ordinal"),
        F.col("l_linestatus").alias("modality"), F.col("l_quantity").cast("int").alias("rows"), F.col("l_quantity").cast("int").alias("columns"),
    )


def volumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("values"), "label")
