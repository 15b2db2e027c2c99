"""Distributions, ranking metrics, operating points and prediction comparisons.

Ranking metrics and percentiles aggregate to one row per distinct value first;
running counts over these go by ranges of the value, so that no task holds a
target or a group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordering import running_sums


def linear_distribution(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """count, min, p25, median, p75, max, mean, percentiles by linear interpolation."""
    ranked = _ranked(df.where(F.col(value).isNotNull()), value, by)
    rank = lambda q: F.lit(q) * (F.col("n_all") - 1)
    at = lambda r: F.min(F.when(F.col("n_upto") > r, F.col("_v")))
    shares = {"p25": 0.25, "median": 0.5, "p75": 0.75}
    ends = [c for name, q in shares.items() for c in (at(F.floor(rank(q))).alias(f"_{name}_low"), at(F.ceil(rank(q))).alias(f"_{name}_high"))]
    out = ranked.groupBy(*by).agg(F.max("n_all").alias("count"), F.min("_v").alias("min"), *ends, F.max("_v").alias("max"), (F.sum(F.col("_v") * F.col("_n")) / F.max("n_all")).alias("mean"))
    part = lambda name, q: F.lit(q) * (F.col("count") - 1) - F.floor(F.lit(q) * (F.col("count") - 1))
    between = [(F.col(f"_{name}_low") + (F.col(f"_{name}_high") - F.col(f"_{name}_low")) * part(name, q)).alias(name) for name, q in shares.items()]
    return out.select(*by, "count", "min", *between, "max", "mean")


def _ranked(df: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """(by..., _v, _n, n_upto, n_all): distinct values, their rows, and the rows of values up to each."""
    counts = df.groupBy(*by, F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_n"))
    return running_sums(counts, by, "_v", {"_n": "n"})


def nearest_rank(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """mean, p50, p95 by nearest rank; values that are not finite are left out; no rows give zeros."""
    v = F.col(value).cast("double")
    finite = v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    ranked = _ranked(df.where(finite), value, by)
    at = lambda q: F.min(F.when(F.col("n_upto") >= F.lit(q) * F.col("n_all"), F.col("_v")))
    found = ranked.groupBy(*by).agg((F.sum(F.col("_v") * F.col("_n")) / F.max("n_all")).alias("mean"), at(0.5).alias("p50"), at(0.95).alias("p95"))
    zero = [F.coalesce(c, F.lit(0.0)).alias(c) for c in ("mean", "p50", "p95")]
    if not by:
        return found.select(*zero)
    groups = df.select(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(by)]).distinct()  # also those without a finite value
    same = F.lit(True)
    for i, c in enumerate(by):
        same &= F.col(f"_g{i}").eqNullSafe(F.col(c))
    return groups.join(found, same, "left").select(*[F.col(f"_g{i}").alias(c) for i, c in enumerate(by)], *zero)


def value_bins(df: DataFrame, fraction: Column, by: Sequence[str] = ()) -> DataFrame:
    """small under 2 %, medium under 10 %, large: counts and shares (null without rows)."""
    small, medium = fraction < 0.02, (fraction >= 0.02) & (fraction < 0.1)
    out = df.groupBy(*by).agg(F.count_if(small).alias("small"), F.count_if(medium).alias("medium"), F.count_if(fraction >= 0.1).alias("large"), F.count(fraction).alias("total"))
    return out.select("*", *[F.try_divide(c, "total").alias(f"{c}_share") for c in ("small", "medium", "large")])


def localization_report(df: DataFrame, splits: Sequence[str] = ("train", "val", "test")) -> DataFrame:
    """Per split and overall: positives, boxed positives, boxes, rows with several, and their ratios."""
    counts = df.groupingSets([["split"], []], "split").agg(
        F.grouping("split").alias("_all"), F.count("*").alias("samples"), F.count_if(F.col("label") == 1).alias("positive"), F.count_if(F.col("label") == 0).alias("negative"),
        F.count_if((F.col("label") == 1) & (F.col("boxes") > 0)).alias("boxed"), F.coalesce(F.sum("boxes"), F.lit(0)).alias("boxes"), F.count_if(F.col("boxes") > 1).alias("multi"),
    )
    return counts.select(
        F.when(F.col("_all") == 1, "all").otherwise(F.col("split")).alias("split"), "samples", "positive", "negative", "boxed", "boxes", "multi",
        F.try_divide("boxed", "positive").alias("boxed_share"), F.try_divide("boxes", "positive").alias("boxes_per_positive"),
    )


def by_score(scored: DataFrame) -> DataFrame:
    """(target, score, p, n): positives and negatives at each distinct score."""
    rows = scored.where((F.col("mask") > 0) & F.col("score").isNotNull())
    return rows.groupBy("target", "score").agg(F.count_if(F.col("label") == 1).alias("p"), F.count_if(F.col("label") != 1).alias("n"))


def sweep(scored: DataFrame) -> DataFrame:
    """For each target and distinct score: counts at or above it, and the target's totals."""
    summed = running_sums(by_score(scored), ["target"], "score", {"p": "p", "n": "n"}, descending=True)
    return summed.select("target", "score", "p", "n", F.col("p_upto").alias("tp"), F.col("n_upto").alias("fp"), F.col("p_all").alias("positives"), F.col("n_all").alias("negatives"))


def ranking_metrics(scored: DataFrame) -> DataFrame:
    """(target, positives, negatives, auroc, average_precision) of masked rows; ties count half.

    auroc is null without both kinds, average precision without positives.
    """
    s = sweep(scored)
    pairs = F.col("p") * (F.col("negatives") - F.col("fp")) + F.col("p") * F.col("n") / 2
    gain = F.try_divide("p", "positives") * F.try_divide("tp", F.col("tp") + F.col("fp"))
    return s.groupBy("target").agg(
        F.max("positives").alias("positives"), F.max("negatives").alias("negatives"),
        F.try_divide(F.sum(pairs), F.max(F.col("positives") * F.col("negatives"))).alias("auroc"), F.sum(gain).alias("average_precision"),
    )


def macro_means(metrics: DataFrame) -> DataFrame:
    return metrics.agg(F.avg("auroc").alias("macro_auroc"), F.avg("average_precision").alias("macro_average_precision"), F.count("auroc").alias("defined_targets"))


def point_columns(tp: Column, fp: Column, positives: Column, negatives: Column) -> list[Column]:
    """Rates of an operating point; empty denominators count as one."""
    at_least_one = lambda c: F.greatest(c, F.lit(1))
    sensitivity, specificity = tp / at_least_one(positives), (negatives - fp) / at_least_one(negatives)
    precision = tp / at_least_one(tp + fp)
    f1 = 2 * precision * sensitivity / F.greatest(precision + sensitivity, F.lit(1e-12))
    return [sensitivity.alias("sensitivity"), specificity.alias("specificity"), precision.alias("precision"), f1.alias("f1")]


def operating_point(scored: DataFrame, threshold: Column) -> DataFrame:
    """tp, tn, fp, fn and rates of each target at a threshold (score >= threshold)."""
    rows = scored.where((F.col("mask") > 0) & F.col("score").isNotNull())
    hit, positive = F.col("score") >= threshold, F.col("label") == 1
    counts = rows.groupBy("target").agg(F.count_if(hit & positive).alias("tp"), F.count_if(~hit & ~positive).alias("tn"), F.count_if(hit & ~positive).alias("fp"), F.count_if(~hit & positive).alias("fn"))
    return counts.select("*", *point_columns(F.col("tp"), F.col("fp"), F.col("tp") + F.col("fn"), F.col("fp") + F.col("tn")))


def best_f1(scored: DataFrame) -> DataFrame:
    """The threshold of greatest F1; of equal ones that of higher sensitivity, then the lowest."""
    s = sweep(scored)
    points = s.select("target", F.col("score").alias("threshold"), "tp", "fp", *point_columns(F.col("tp"), F.col("fp"), F.col("positives"), F.col("negatives")))
    order = Window.partitionBy("target").orderBy(F.desc("f1"), F.desc("sensitivity"), F.asc("threshold"))
    return points.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def fixed_sensitivity(scored: DataFrame, least: float = 0.8) -> DataFrame:
    """The highest threshold whose sensitivity reaches ``least``."""
    s = sweep(scored)
    points = s.select("target", F.col("score").alias("threshold"), *point_columns(F.col("tp"), F.col("fp"), F.col("positives"), F.col("negatives")))
    order = Window.partitionBy("target").orderBy(F.desc("threshold"))
    return points.where(F.col("sensitivity") >= least).withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def fixed_specificity(scored: DataFrame, least: float = 0.8) -> DataFrame:
    """The lowest threshold whose specificity reaches ``least``."""
    s = sweep(scored)
    points = s.select("target", F.col("score").alias("threshold"), *point_columns(F.col("tp"), F.col("fp"), F.col("positives"), F.col("negatives")))
    order = Window.partitionBy("target").orderBy(F.asc("threshold"))
    return points.where(F.col("specificity") >= least).withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def masked_loss(rows: DataFrame, gamma: float | None = None) -> DataFrame:
    """Binary cross-entropy on logits (focal if gamma is given), over masked cells: sum / max(cells, 1)."""
    x, y, m = F.col("logit"), F.col("label"), F.col("mask")
    loss = F.greatest(x, F.lit(0.0)) - x * y + F.log1p(F.exp(-F.abs(x)))
    if gamma is not None:
        p = 1 / (1 + F.exp(-x))
        loss = loss * F.pow(1 - (y * p + (1 - y) * (1 - p)), F.lit(gamma))
    return rows.groupBy("target").agg((F.sum(loss * m) / F.greatest(F.sum(m), F.lit(1.0))).alias("loss"))


def pair_predictions(candidate: DataFrame, reference: DataFrame) -> DataFrame:
    """One row: matched and missing samples, equal positions, and score differences of (sample_id, position, score)."""
    c = candidate.select("sample_id", F.col("position").alias("cp"), F.col("score").alias("cs"))
    r = reference.select("sample_id", F.col("position").alias("rp"), F.col("score").alias("rs"))
    both = c.join(r, "sample_id", "full_outer")
    matched = F.col("cp").isNotNull() & F.col("rp").isNotNull()
    delta = F.abs(F.col("cs") - F.col("rs"))
    return both.agg(
        F.count_if(matched).alias("matched"), F.count_if(F.col("cp").isNull()).alias("missing_in_candidate"), F.count_if(F.col("rp").isNull()).alias("missing_in_reference"),
        F.count_if(matched & (F.col("cp") != F.col("rp"))).alias("moved"), F.avg(F.when(matched, delta)).alias("mean_difference"), F.max(F.when(matched, delta)).alias("max_difference"),
    )


def quality_gate(metrics: DataFrame, samples: DataFrame, least_samples: int = 900, least_targets: int = 5, auroc: float = 0.55, average_precision: float = 0.10) -> DataFrame:
    """(rule, status, value): each rule of the gate as a row."""
    means = macro_means(metrics).crossJoin(samples.agg(F.count("*").alias("n")))
    rules = [("eval_samples", F.col("n").cast("double"), float(least_samples)), ("defined_targets", F.col("defined_targets").cast("double"), float(least_targets)), ("macro_auroc", F.col("macro_auroc"), auroc), ("macro_average_precision", F.col("macro_average_precision"), average_precision)]
    cells = F.array(*[F.struct(F.lit(name).alias("rule"), value.alias("value"), F.when(value >= least, "ok").otherwise("error").alias("status")) for name, value, least in rules])
    return means.select(F.explode(cells).alias("x")).select("x.*")


def recheck(reported: DataFrame, recomputed: DataFrame, keys: Sequence[str], value: str, tolerance: float = 1e-6) -> DataFrame:
    """Rows whose reported value is missing on a side or differs by more than the tolerance."""
    a, b = reported.select(*keys, F.col(value).alias("reported")), recomputed.select(*keys, F.col(value).alias("recomputed"))
    both = a.join(b, list(keys), "full_outer")
    same = F.coalesce(F.abs(F.col("reported") - F.col("recomputed")) <= tolerance, F.col("reported").isNull() & F.col("recomputed").isNull())
    return both.where(~same)
