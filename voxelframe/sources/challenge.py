"""Annotation sets of a detection challenge: boxes, final labels and records with reasons for skips."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def clamp_box(x: Column, y: Column, width: Column, height: Column, image_width: Column, image_height: Column) -> Column:
    """The box inside its image with derived fractions; null if nothing of it is left."""
    n = lambda c: c.try_cast("double")
    w, h = n(image_width), n(image_height)
    x1, y1 = F.least(F.greatest(n(x), F.lit(0.0)), w), F.least(F.greatest(n(y), F.lit(0.0)), h)
    x2, y2 = F.least(F.greatest(n(x) + n(width), F.lit(0.0)), w), F.least(F.greatest(n(y) + n(height), F.lit(0.0)), h)
    bw, bh = x2 - x1, y2 - y1
    box = F.struct(
        x1.alias("x"), y1.alias("y"), bw.alias("width"), bh.alias("height"), x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"), w.alias("image_width"), h.alias("image_height"),
        F.try_divide(bw * bh, w * h).alias("area_fraction"), F.try_divide(bw, w).alias("width_fraction"), F.try_divide(bh, h).alias("height_fraction"),
        F.try_divide((x1 + x2) / 2, w).alias("center_x_fraction"), F.try_divide((y1 + y2) / 2, h).alias("center_y_fraction"),
    )
    return F.when((bw > 0) & (bh > 0), box)


def final_label(names: Column) -> Column:
    """1 with an opacity, 0 if normal or without opacity, else null."""
    has = lambda v: F.coalesce(F.array_contains(names, v), F.lit(False))
    return F.when(has("Lung Opacity"), 1).when(has("Normal") | has("No Lung Opacity / Not Normal"), 0).cast("tinyint")


def records(mappings: DataFrame, labels: DataFrame, files: DataFrame) -> DataFrame:
    """mappings (sop_uid, ...) with labels and files by it, and the first reason to skip a row."""
    joined = mappings.join(labels, "sop_uid", "left").join(files, "sop_uid", "left")
    reason = F.when(F.col("sop_uid").isNull() | (F.col("sop_uid") == ""), "missing_uid").when(F.col("path").isNull(), "missing_file").when(F.col("label").isNull(), "missing_label")
    return joined.withColumn("skip", reason)


def skip_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy(F.coalesce("skip", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))
