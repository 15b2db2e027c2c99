"""Label values: parsing, histograms, encoding policies and class weights.

A label is 1 (positive), 0 (negative), -1 (uncertain) or null (missing).
Analytics use the long form (sample, target, value).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What an encoder does with missing and with uncertain labels (fixed values).
POLICIES = ("ignore", "zero", "negative", "one", "positive", "fail")


def parse_label(text: Column) -> Column:
    """Exactly '1', '0', '-1' and their '.0' forms; any other text is missing."""
    t = F.trim(text)
    return F.when(t.isin("1", "1.0"), 1).when(t.isin("0", "0.0"), 0).when(t.isin("-1", "-1.0"), -1).cast("tinyint")


def to_long(df: DataFrame, targets: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """One row for each row and target: (keep..., target, value)."""
    cells = F.array(*[F.struct(F.lit(t).alias("target"), F.col(t).cast("int").alias("value")) for t in sorted(targets)])
    return df.select(*keep, F.explode(cells).alias("_l")).select(*keep, "_l.target", "_l.value")


def known(value: Column) -> Column:
    return F.coalesce(value.isin(1, 0, -1), F.lit(False))


def histogram_columns(value: Column) -> list[Column]:
    """positive, negative, uncertain, and missing: null or any other number."""
    return [
        F.count_if(value == 1).alias("positive"), F.count_if(value == 0).alias("negative"),
        F.count_if(value == -1).alias("uncertain"), F.count_if(~known(value)).alias("missing"),
    ]


def histogram(long: DataFrame, by: Sequence[str] = ("target",)) -> DataFrame:
    return long.groupBy(*by).agg(*histogram_columns(F.col("value")))


def distribution_by_split(long: DataFrame, splits: Sequence[str] = ("train", "val", "test")) -> DataFrame:
    """Overall (split 'all') and per split, in one pass over the grouping sets; all splits are present."""
    grouped = long.groupingSets([["target"], ["split", "target"]], "split", "target").agg(F.grouping("split").alias("_all"), *histogram_columns(F.col("value")))
    names = ("positive", "negative", "uncertain", "missing")
    counted = grouped.select(F.when(F.col("_all") == 1, "all").otherwise(F.col("split")).alias("split"), "target", F.struct(*names).alias("c")).where("split is not null")
    by_target = counted.groupBy("target").agg(F.map_from_entries(F.collect_list(F.struct("split", "c"))).alias("m"))
    each = by_target.select("target", "m", F.explode(F.array(*[F.lit(s) for s in (*splits, "all")])).alias("split"))
    found = each.withColumn("c", F.try_element_at("m", F.col("split")))
    return found.select("split", "target", *[F.coalesce(f"c.{n}", F.lit(0)).alias(n) for n in names])


def missing_counts(long: DataFrame) -> DataFrame:
    """Rows without a value, for each target; zero counts stay."""
    return long.groupBy("target").agg(F.count_if(F.col("value").isNull()).alias("missing"))


def prevalence(long: DataFrame, by: Sequence[str] = ("target",)) -> DataFrame:
    counts = histogram(long, by)
    return counts.withColumn("prevalence", F.try_divide("positive", F.col("positive") + F.col("negative")))


def encode(value: Column, missing: str = "ignore", uncertain: str = "ignore") -> Column:
    """struct(label, mask) under the policies; other numbers stand for themselves."""

    def act(policy: str) -> Column:
        if policy not in POLICIES:
            raise ValueError(f"unknown label policy {policy!r}")
        if policy == "fail":
            return F.raise_error(F.lit("a label is missing or uncertain and the policy is fail"))
        label, mask = {"ignore": (0.0, 0.0), "zero": (0.0, 1.0), "negative": (0.0, 1.0), "one": (1.0, 1.0), "positive": (1.0, 1.0)}[policy]
        return F.struct(F.lit(label).alias("label"), F.lit(mask).alias("mask"))

    plain = F.struct(value.cast("double").alias("label"), F.lit(1.0).alias("mask"))
    return F.when(value.isNull(), act(missing)).when(value == -1, act(uncertain)).otherwise(plain)


def project_targets(labels: Column, targets: Sequence[str]) -> Column:
    """A label map reduced to the given targets, absent ones as null."""
    return F.map_from_arrays(F.array(*[F.lit(t) for t in targets]), F.array(*[F.try_element_at(labels, F.lit(t)) for t in targets]))


def target_names(labels: Column) -> Column:
    return F.sort_array(F.map_keys(labels))


def pos_weight(long: DataFrame, cap: float = 10.0) -> DataFrame:
    """negative / positive of each target, capped; 1 where either is absent."""
    counts = histogram(long)
    ratio = F.when((F.col("positive") > 0) & (F.col("negative") > 0), F.least(F.col("negative") / F.col("positive"), F.lit(cap))).otherwise(F.lit(1.0))
    return counts.select("target", "positive", "negative", ratio.alias("pos_weight"))


def batch_label_sums(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """Sums of label * mask and counts of mask > 0, for each batch and target."""
    return rows.groupBy(*by, "target").agg(F.sum(F.col("label") * F.col("mask")).alias("label_sum"), F.count_if(F.col("mask") > 0).alias("valid"))
