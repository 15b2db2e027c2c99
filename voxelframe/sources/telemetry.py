"""Process telemetry: memory maps and GPU samples as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bucket(name: Column) -> Column:
    return (
        F.when(F.coalesce(name, F.lit("")) == "", "anon").when(name.startswith("[heap"), "heap").when(name.startswith("[stack"), "stack").when(name.startswith("/dev/"), "dev")
        .when(name.contains("images"), "cache_images").when(name.contains("labels") | name.contains("masks"), "cache_labels").otherwise("other_file")
    )


def map_memory(lines: DataFrame) -> DataFrame:
    """(bucket, pss_kb, uss_kb) of lines (process, number, text) of memory maps.

    A map's header names it; the lines below belong to the last header.
    """
    head = F.regexp_extract("text", r"^[0-9a-f]+-[0-9a-f]+ \S+ \S+ \S+ \S+ *(.*)$", 1)
    is_head = F.col("text").rlike(r"^[0-9a-f]+-[0-9a-f]+ ")
    order = Window.partitionBy("process").orderBy("number").rowsBetween(Window.unboundedPreceding, 0)
    named = lines.withColumn("_b", F.last(F.when(is_head, bucket(head)), ignorenulls=True).over(order))
    value = F.regexp_extract("text", r"^\w+: +(\d+) kB", 1).try_cast("long")
    field = F.substring_index("text", ":", 1)
    kb = lambda *names: F.sum(F.when(field.isin(*names), value).otherwise(0))
    return named.where(~is_head).groupBy(F.col("_b").alias("bucket")).agg(kb("Pss").alias("pss_kb"), kb("Private_Clean", "Private_Dirty").alias("uss_kb"))


def gpu_samples(lines: DataFrame) -> DataFrame:
    """(utilization, memory_mb) of comma-separated lines; unreadable ones are left out."""
    parts = F.split("text", ",")
    number = lambda i: F.regexp_extract(F.coalesce(F.get(parts, F.lit(i)), F.lit("")), r"([0-9.]+)", 1).try_cast("double")
    return lines.select(number(0).alias("utilization"), number(1).alias("memory_mb")).where("utilization is not null and memory_mb is not null")
