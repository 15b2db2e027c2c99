"""Numbers and running sums for rows without a global sort."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxelframe.functions.hashing import stable_bucket


def numbered(df: DataFrame, key: str, by: Sequence[str] = (), name: str = "number", seed: int = 0) -> DataFrame:
    """Rows numbered 0, 1, ... within each group, in the order of the key's stable bucket.

    The order depends on keys and seed alone.  Rows are counted in 4,096 ranges
    of the bucket; a task numbers a range, so neither a group nor the table has
    to fit one.  Keys and groups must not be null.
    """
    rows = df.withColumn("_bucket", stable_bucket(F.col(key), seed)).withColumn("_range", F.substring("_bucket", 1, 3))
    sums = rows.groupBy(*by, "_range").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*by, "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(*by, "_range").orderBy("_bucket", key)
    out = rows.withColumn("_inside", F.row_number().over(inside) - 1).join(starts, [*by, "_range"])
    return out.select(*df.columns, (F.col("_inside") + F.col("_start")).cast("long").alias(name))


def running_sums(rows: DataFrame, by: Sequence[str], value: str, sums: Mapping[str, str], descending: bool = False, ranges: int = 256) -> DataFrame:
    """Rows with running sums and totals of columns, in the order of ``value`` (distinct in its group).

    sums: column -> prefix; adds ``<prefix>_upto`` (the row included) and
    ``<prefix>_all``.  Rows are dealt into ``ranges`` of the value by
    approximate percentiles; a task orders one range of one group, and what
    lies before a range comes from the sums of the ranges.
    """
    found = rows.agg(F.percentile_approx(value, F.array(*[F.lit(i / ranges) for i in range(1, ranges)]), 10_000).alias("p")).first()["p"]
    bounds = F.array(*[F.lit(b) for b in sorted(set(found or []))]) if found else F.array().cast("array<double>")
    dealt = rows.withColumn("_range", F.size(F.filter(bounds, lambda b: b < F.col(value))))
    order = lambda c: F.desc(c) if descending else F.asc(c)
    before = Window.partitionBy(*by).orderBy(order("_range")).rowsBetween(Window.unboundedPreceding, -1)
    parts = dealt.groupBy(*by, "_range").agg(*[F.sum(c).alias(f"_{p}") for c, p in sums.items()])
    starts = parts.select(
        *[F.col(c).alias(f"_by_{i}") for i, c in enumerate(by)], F.col("_range").alias("_in"),
        *[F.coalesce(F.sum(f"_{p}").over(before), F.lit(0)).alias(f"_{p}_before") for p in sums.values()], *[F.sum(f"_{p}").over(Window.partitionBy(*by)).alias(f"{p}_all") for p in sums.values()],
    )
    same = F.col("_range") == F.col("_in")
    for i, c in enumerate(by):
        same &= F.col(c).eqNullSafe(F.col(f"_by_{i}"))
    inside = Window.partitionBy(*by, "_range").orderBy(order(value)).rowsBetween(Window.unboundedPreceding, 0)
    summed = dealt.withColumns({f"_{p}_inside": F.sum(c).over(inside) for c, p in sums.items()}).join(starts, same)
    return summed.select(*rows.columns, *[(F.col(f"_{p}_before") + F.col(f"_{p}_inside")).alias(f"{p}_upto") for p in sums.values()], *[f"{p}_all" for p in sums.values()])
