"""Dataset validation: pairing images with labels, problems of a case, geometry checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Greatest absolute differences of compatible geometries (fixed values).
TOLERANCES = {"spacing": 1e-5, "origin": 1e-4, "direction": 1e-6}


def pair(images: DataFrame, labels: DataFrame) -> DataFrame:
    """(case_id, images, labels): one row for each case of either side."""
    left = images.groupBy("case_id").agg(F.count("*").alias("images"))
    right = labels.groupBy("case_id").agg(F.count("*").alias("labels"))
    both = left.join(right, "case_id", "full_outer")
    return both.select("case_id", F.coalesce("images", F.lit(0)).alias("images"), F.coalesce("labels", F.lit(0)).alias("labels"))


def with_problems(pairs: DataFrame, duplicates_matter: bool = True) -> DataFrame:
    """Adds the problems of each case, in a fixed order, and its status."""
    rules = [("missing_image", F.col("images") == 0), ("missing_label", F.col("labels") == 0)]
    if duplicates_matter:
        rules += [("duplicate_image", F.col("images") > 1), ("duplicate_label", F.col("labels") > 1)]
    problems = F.filter(F.array(*[F.when(test, F.lit(code)) for code, test in rules]), lambda p: p.isNotNull())
    return pairs.withColumn("problems", problems).withColumn("status", F.when(F.size("problems") == 0, "valid").otherwise("invalid"))


def summary(cases: DataFrame) -> DataFrame:
    """(code, n): cases in all, valid, invalid, and problems by code."""
    totals = cases.agg(F.count("*").alias("total"), F.count_if(F.col("status") == "valid").alias("valid"), F.count_if(F.col("status") == "invalid").alias("invalid"))
    listed = totals.select(F.explode(F.array(*[F.struct(F.lit(f"cases_{c}").alias("code"), F.col(c).alias("n")) for c in ("total", "valid", "invalid")])).alias("x")).select("x.*")
    problems = cases.select(F.explode("problems").alias("p")).groupBy(F.concat(F.lit("problem_"), "p").alias("code")).agg(F.count("*").alias("n"))
    return listed.unionByName(problems)


def duplicate_channels(files: DataFrame) -> DataFrame:
    """(case_id, channel, n) found on two files or more."""
    return files.groupBy("case_id", "channel").agg(F.count("*").alias("n")).where("n > 1")


def channel_gaps(files: DataFrame) -> DataFrame:
    """Cases whose channels are not 0, 1, 2, ... without gaps."""
    return files.groupBy("case_id").agg(F.min("channel").alias("least"), F.max("channel").alias("most"), F.countDistinct("channel").alias("n")).where("least <> 0 or most <> n - 1")


def mismatches(field: str, a: Column, b: Column, tolerance: float) -> Column:
    """struct(field, axis, difference) where two arrays differ; the common length is compared."""
    size = F.least(F.size(a), F.size(b))
    cells = F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.struct(F.lit(field).alias("field"), i.alias("axis"), F.abs(F.get(a, i) - F.get(b, i)).alias("difference")))
    return F.when(size > 0, F.filter(cells, lambda c: c["difference"] > tolerance)).otherwise(F.array().cast("array<struct<field:string,axis:int,difference:double>>"))


def geometry_mismatches(pairs: DataFrame, tolerances: dict[str, float] = TOLERANCES) -> DataFrame:
    """One row for each differing axis of ``x_a`` and ``x_b`` for x in spacing, origin and direction."""
    parts = [mismatches(name, F.col(f"{name}_a"), F.col(f"{name}_b"), tolerance) for name, tolerance in tolerances.items() if f"{name}_a" in pairs.columns]
    return pairs.select("case_id", F.explode(F.concat(*parts)).alias("m")).select("case_id", "m.*")


def nearly_equal(a: Column, b: Column, tolerance: float = 1e-6) -> Column:
    return (F.size(a) == F.size(b)) & F.forall(F.zip_with(a, b, lambda x, y: F.abs(x - y) <= tolerance), lambda t: F.coalesce(t, F.lit(False)))
