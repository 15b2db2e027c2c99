"""Rules over rows: violations, gates and decisions as tables.

A rule set is a mapping from a rule's name to the condition that breaks it; a
condition that cannot be decided (null) counts as broken.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def broken(rules: Mapping[str, Column]) -> Column:
    """Names of the broken rules of a row, in the order given."""
    return F.filter(F.array(*[F.when(F.coalesce(bad, F.lit(True)), F.lit(name)) for name, bad in rules.items()]), lambda n: n.isNotNull())


def violations(df: DataFrame, keys: Sequence[str], rules: Mapping[str, Column]) -> DataFrame:
    """(keys..., rule): one row for each broken rule."""
    return df.select(*keys, F.explode(broken(rules)).alias("rule"))


def verdicts(df: DataFrame, keys: Sequence[str], errors: Mapping[str, Column], warnings: Mapping[str, Column]) -> DataFrame:
    """(keys..., errors, warnings, status): error before warning before ok."""
    out = df.select(*keys, broken(errors).alias("errors"), broken(warnings).alias("warnings"))
    return out.withColumn("status", F.when(F.size("errors") > 0, "error").when(F.size("warnings") > 0, "warning").otherwise("ok"))


def consistent(df: DataFrame, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """(by..., field, values): fields that differ between the rows of a group, null being a value too."""
    cells = F.array(*[F.struct(F.lit(c).alias("field"), F.coalesce(F.col(c).cast("string"), F.lit("\0")).alias("value")) for c in columns])
    return df.select(*by, F.explode(cells).alias("c")).groupBy(*by, "c.field").agg(F.countDistinct("c.value").alias("values")).where("values > 1")


def preflight(there: Column, same_metadata: Column, valid: Column, may_overwrite: Column) -> Column:
    """What to do with a table that may exist: build, reuse, rebuild or blocked."""
    return F.when(~there, "build").when(same_metadata & valid, "reuse").when(may_overwrite, "rebuild").otherwise("blocked")


def claim_eligibility(repeats: Column, stability: Column, quality: Column, least_repeats: int = 3) -> Column:
    """Whether a speed may be claimed, or the first reason why not."""
    return F.when(repeats < least_repeats, "too_few_repeats").when(stability.isin("reject", "insufficient"), "unstable").when(quality != "ok", "quality_gate").otherwise("eligible")


def profile_reconciliation(df: DataFrame, by: Sequence[str], phases: Sequence[str], whole: str, tolerance: float = 0.05) -> DataFrame:
    """Sum of the phases against the measured whole: totals, their ratio, and whether they agree."""
    parts = sum((F.coalesce(F.col(p), F.lit(0.0)) for p in phases[1:]), F.coalesce(F.col(phases[0]), F.lit(0.0)))
    out = df.groupBy(*by).agg(F.sum(parts).alias("phases"), F.sum(whole).alias("whole"))
    ratio = F.try_divide("phases", "whole")
    return out.withColumn("ratio", ratio).withColumn("agrees", F.coalesce(F.abs(ratio - 1) <= tolerance, F.lit(False)))
