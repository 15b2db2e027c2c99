"""Repeated measurements: statistics, stability, comparisons and profiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxelframe.functions.text import ratio


def finite(value: Column) -> Column:
    return F.when(value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf")), value)


def repeat_summary(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """count, mean, sample deviation (0 of one), CV in per cent, min, max; only finite values count."""
    v = finite(F.col(value).cast("double"))
    sd = F.coalesce(F.stddev_samp(v), F.lit(0.0))
    return df.groupBy(*by).agg(F.count(v).alias("count"), F.avg(v).alias("mean"), sd.alias("stdev"), F.try_divide(100 * sd, F.avg(v)).alias("cv_percent"), F.min(v).alias("min"), F.max(v).alias("max"))


def stability(count: Column, cv: Column, ok: float = 3.0, warn: float = 5.0) -> Column:
    return F.when((count < 2) | cv.isNull(), "insufficient").when(cv <= ok, "ok").when(cv <= warn, "warn").otherwise("reject")


def group_status(df: DataFrame, by: Sequence[str], expected: int) -> DataFrame:
    """Completed, ok and failed repeats of each group, and its status."""
    counts = df.groupBy(*by).agg(F.countDistinct("repeat").alias("completed"), F.count_if(F.col("status") == "ok").alias("ok"), F.count_if(F.col("status") != "ok").alias("failed"))
    status = F.when(F.col("failed") > 0, "failed").when(F.col("completed") < expected, "incomplete").otherwise("ok")
    return counts.withColumns({"expected": F.lit(expected), "status": status})


def speedups(summary: DataFrame, key: str, baseline: str, mean: str = "mean") -> DataFrame:
    """Each group's mean against the baseline group's: ratio and difference."""
    base = summary.where(F.col(key) == baseline).select(F.col(mean).alias("base"))
    rows = summary.join(F.broadcast(base), how="left")
    return rows.select(key, mean, "base", ratio(F.col(mean), F.col("base")).alias("speedup"), (F.col(mean) - F.col("base")).alias("delta"))


def pair_repeats(candidates: DataFrame, raw: DataFrame) -> DataFrame:
    """Each candidate repeat with the raw row of its number, or else the first raw one."""
    first = raw.agg(F.min_by("value", "repeat").alias("first_value"), F.min("repeat").alias("first_repeat"))
    same = raw.select("repeat", F.col("value").alias("raw_value"), F.col("repeat").alias("raw_repeat"))
    joined = candidates.join(same, "repeat", "left").crossJoin(F.broadcast(first))
    return joined.select("repeat", "value", F.coalesce("raw_repeat", "first_repeat").alias("raw_repeat"), F.coalesce("raw_value", "first_value").alias("raw_value"))


def matrix(repeats: DataFrame, *axes: DataFrame) -> DataFrame:
    """Every combination of the (small, configured) axes."""
    out = repeats
    for axis in axes:
        out = out.crossJoin(axis)
    return out


def largest_phase(df: DataFrame, by: Sequence[str], phase: str, value: str) -> DataFrame:
    """The phase of the greatest value of each group; of equal ones the first by name."""
    sums = df.groupBy(*by, phase).agg(F.sum(value).alias("total"))
    order = Window.partitionBy(*by).orderBy(F.desc("total"), phase)
    return sums.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def phase_budget(df: DataFrame, phase: str, value: str) -> DataFrame:
    """Total, mean and share of each phase."""
    totals = df.groupBy(phase).agg(F.sum(value).alias("total"), F.avg(value).alias("mean"), F.count(value).alias("steps"))
    everything = totals.agg(F.sum("total").alias("_whole"))
    return totals.crossJoin(F.broadcast(everything)).select(phase, "total", "mean", "steps", F.try_divide(100 * F.col("total"), F.col("_whole")).alias("percent"))


def upsert(rows: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """The last row of each key."""
    last = Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    return rows.withColumn("_r", F.row_number().over(last)).where("_r = 1").drop("_r")


def promotion(summary: DataFrame, least_ratio: float = 1.0) -> DataFrame:
    """promote, hold or reject: by stability and by the ratio to the baseline."""
    decision = F.when(F.col("stability") == "reject", "reject").when((F.col("stability") == "ok") & (F.col("speedup") >= least_ratio), "promote").otherwise("hold")
    return summary.withColumn("decision", decision)


def wait_summary(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Cold and reusing runs and distinct contents of (content_key, cold, wait)."""
    return df.groupBy(*by).agg(F.count_if("cold").alias("cold"), F.count_if(~F.col("cold")).alias("reused"), F.countDistinct("content_key").alias("contents"), F.avg(finite(F.col("wait"))).alias("mean_wait"))


def epoch_summary(order: DataFrame, expected: DataFrame) -> DataFrame:
    """Per epoch of (epoch, sample_id): seen, unique, repeated and dropped samples."""
    per_sample = order.groupBy("epoch", "sample_id").agg(F.count("*").alias("n"))
    counts = per_sample.groupBy("epoch").agg(F.sum("n").alias("seen"), F.count("*").alias("unique"), F.count_if(F.col("n") > 1).alias("repeated"))
    total = expected.agg(F.countDistinct("sample_id").alias("_all"))
    known = per_sample.join(expected.select("sample_id").distinct(), "sample_id").groupBy("epoch").agg(F.count("*").alias("_known"))
    return counts.join(known, "epoch", "left").crossJoin(F.broadcast(total)).select("epoch", "seen", "unique", "repeated", (F.col("_all") - F.coalesce("_known", F.lit(0))).alias("dropped"))


def order_difference(candidate: DataFrame, reference: DataFrame) -> DataFrame:
    """Per epoch: samples both dropped, and those only one did, of (epoch, sample_id) tables."""
    c, r = candidate.withColumn("_c", F.lit(True)), reference.withColumn("_r", F.lit(True))
    both = c.join(r, ["epoch", "sample_id"], "full_outer")
    return both.groupBy("epoch").agg(F.count_if(F.col("_c") & F.col("_r")).alias("shared"), F.count_if(F.col("_r").isNull()).alias("only_candidate"), F.count_if(F.col("_c").isNull()).alias("only_reference"))
