"""File inventories: filters, warnings, duplicates, summaries and hierarchy."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxelframe.functions.text import blank_to_null

#: Transfer syntaxes (fixed values): read natively, and explicit little-endian.
NATIVE_SYNTAXES = ("1.2.840.10008.1.2", "1.2.840.10008.1.2.1", "1.2.840.10008.1.2.2", "1.2.840.10008.1.2.4.50", "1.2.840.10008.1.2.5")
UNCOMPRESSED_SYNTAXES = ("1.2.840.10008.1.2", "1.2.840.10008.1.2.1", "1.2.840.10008.1.2.2")
OPTIONAL_SYNTAXES = ("1.2.840.10008.1.2.4.57", "1.2.840.10008.1.2.4.70", "1.2.840.10008.1.2.4.80", "1.2.840.10008.1.2.4.81", "1.2.840.10008.1.2.4.90", "1.2.840.10008.1.2.4.91")


def syntax_class(uid: Column) -> Column:
    return F.when(uid.isin(*UNCOMPRESSED_SYNTAXES), "uncompressed").when(uid.isin(*NATIVE_SYNTAXES), "native").when(uid.isin(*OPTIONAL_SYNTAXES), "optional").otherwise("unsupported")


def filter_reason(syntax: Column | None = None, syntaxes: Sequence[str] = (), modality: Column | None = None, modalities: Sequence[str] = (), view: Column | None = None, views: Sequence[str] = ()) -> Column:
    """The first rule that rejects a row, or null; an empty list allows all."""
    allowed = lambda c, values: F.coalesce(F.upper(F.trim(c)).isin(*[v.upper() for v in values]), F.lit(False))
    reason = F.lit(None).cast("string")
    for column, values, name in reversed(((syntax, syntaxes, "filtered_transfer_syntax"), (modality, modalities, "filtered_modality"), (view, views, "filtered_view_position"))):
        if column is not None and values:
            reason = F.when(~allowed(column, values), name).otherwise(reason)
    return reason


def apply_filter(inventory: DataFrame, reason: Column, policy: str = "skip") -> tuple[DataFrame, DataFrame]:
    """(kept, skipped with reason); ``fail`` turns rejected rows into an error that names the least of their reasons, whichever task meets it."""
    marked = inventory.withColumn("reason", reason)
    if policy == "fail":
        least = marked.agg(F.min("reason").alias("_least"))  # one row
        marked = marked.crossJoin(F.broadcast(least)).withColumn("reason", F.when(F.col("_least").isNotNull(), F.raise_error(F.concat(F.lit("rejected: "), "_least")))).drop("_least")
    elif policy not in ("skip", "warn"):
        raise ValueError(f"unknown filter policy {policy!r}")
    return marked.where("reason is null").drop("reason"), marked.where("reason is not null")


def warnings(row: dict[str, Column]) -> Column:
    """Codes of what is private, missing or unusable in a row, in a fixed order."""
    absent = lambda c: blank_to_null(c).isNull()
    rules = [
        ("phi_patient_name", ~absent(row["patient_name"])), ("phi_patient_birth_date", ~absent(row["birth_date"])),
        ("unsupported_transfer_syntax", ~syntax_class(row["transfer_syntax_uid"]).isin("uncompressed", "native")),
        ("missing_patient_id", absent(row["patient_id"])), ("missing_study_instance_uid", absent(row["study_instance_uid"])),
        ("missing_series_instance_uid", absent(row["series_instance_uid"])), ("missing_sop_instance_uid", absent(row["sop_instance_uid"])),
        ("missing_view_position", absent(row["view_position"])), ("missing_pixel_spacing", row["pixel_spacing"].isNull() & row["imager_pixel_spacing"].isNull()),
        ("invalid_image_dimensions", F.coalesce(row["rows"] == 0, F.lit(False)) | F.coalesce(row["columns"] == 0, F.lit(False))),
    ]
    return F.filter(F.array(*[F.when(test, F.lit(code)) for code, test in rules]), lambda c: c.isNotNull())


def duplicates(inventory: DataFrame, key: str, path: str = "path", listed: int = 100) -> DataFrame:
    """Keys on two rows or more, with their count and their first paths.

    The count is a plain aggregate; paths are ranked inside salted parts first,
    so a key on very many rows is not gathered.
    """
    rows = inventory.where(F.col(key).isNotNull())
    counts = rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")
    salt = F.pmod(F.xxhash64(path), F.lit(64))
    near = Window.partitionBy(key, salt).orderBy(path)
    final = Window.partitionBy(key).orderBy(path)
    first = rows.select(key, path).withColumn("_r", F.row_number().over(near)).where(F.col("_r") <= listed)
    first = first.withColumn("_r", F.row_number().over(final)).where(F.col("_r") <= listed).groupBy(key).agg(F.sort_array(F.collect_list(path)).alias("paths"))
    return counts.join(first, key)


def duplicate_flags(inventory: DataFrame, key: str) -> DataFrame:
    """Every row with the number of rows of its key; a hot key is counted before it is joined."""
    counts = inventory.groupBy(key).agg(F.count("*").alias("copies"))
    return inventory.join(counts, key, "left")


def first_of_duplicates(inventory: DataFrame, key: str, order: str) -> DataFrame:
    """One row for each repeated key: its first row by ``order``."""
    groups = inventory.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("copies"), F.min(order).alias(order))
    return groups.where("copies > 1")


def scan_summary(inventory: DataFrame, keys: Sequence[str], warning_count: Column) -> DataFrame:
    """Rows, warnings, and how many values of each key are on two rows or more."""
    out = inventory.agg(F.count("*").alias("records"), F.coalesce(F.sum(warning_count), F.lit(0)).alias("warnings"))
    for key in keys:
        repeated = inventory.where(F.col(key).isNotNull()).groupBy(key).count().where("count > 1").agg(F.count("*").alias(f"duplicate_{key}"))
        out = out.crossJoin(repeated)
    return out


def categorical_counts(df: DataFrame, columns: Sequence[str], upper: bool = True) -> DataFrame:
    """(field, value, n): null counts as MISSING, values upper-cased, or all verbatim."""
    text = lambda c: F.upper(F.coalesce(F.col(c).cast("string"), F.lit("missing"))) if upper else F.col(c).cast("string")
    cells = F.array(*[F.struct(F.lit(c).alias("field"), text(c).alias("value")) for c in columns])
    return df.select(F.explode(cells).alias("c")).groupBy("c.field", "c.value").agg(F.count("*").alias("n"))


def numeric_summary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(field, count, min, max, mean) in one pass."""
    cells = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("double").alias("value")) for c in columns])
    return df.select(F.explode(cells).alias("c")).groupBy("c.field").agg(F.count("c.value").alias("count"), F.min("c.value").alias("min"), F.max("c.value").alias("max"), F.avg("c.value").alias("mean"))


def spacing_summary(inventory: DataFrame) -> DataFrame:
    spacing = F.coalesce("pixel_spacing", "imager_pixel_spacing")
    return numeric_summary(inventory.select(F.get(spacing, F.lit(0)).alias("row_spacing"), F.get(spacing, F.lit(1)).alias("column_spacing")), ["row_spacing", "column_spacing"])


def missing_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(field, missing): null or blank; fields with none are absent."""
    cells = F.array(*[F.struct(F.lit(c).alias("field"), blank_to_null(F.col(c).cast("string")).isNull().alias("gone")) for c in columns])
    return df.select(F.explode(cells).alias("c")).where("c.gone").groupBy("c.field").agg(F.count("*").alias("missing"))


def warning_counts(inventory: DataFrame, column: str = "warnings") -> DataFrame:
    return inventory.select(F.explode(column).alias("code")).groupBy("code").agg(F.count("*").alias("n"))


def error_code(message: Column) -> Column:
    text = F.lower(message)
    return F.when(text.contains("preamble") | text.contains("dicm"), "not_dicom").when(text.contains("truncated") | text.contains("unexpected end"), "truncated").when(text.contains("permission"), "unreadable").otherwise("parse_error")


def hierarchy(instances: DataFrame) -> DataFrame:
    """One row for each series of (patient, study, series, sop, ordinal, modality, rows, columns).

    First non-null values go by ordinal; series whose rows differ in modality
    or size are marked.
    """
    both = F.when(F.col("rows").isNotNull() & F.col("columns").isNotNull(), F.struct("rows", "columns"))
    several = lambda c: F.coalesce(F.min(c) != F.max(c), F.lit(False))
    first = lambda c: F.min(F.when(F.col(c).isNotNull(), F.struct("ordinal", c)))[c].alias(c)
    return instances.groupBy("patient_id", "study_id", "series_id").agg(
        F.count("*").alias("instances"), first("modality"), first("rows"), first("columns"),
        several("modality").alias("mixed_modality"), several(both).alias("mixed_dimensions"),
    )


def hierarchy_counts(instances: DataFrame) -> DataFrame:
    """(patient, studies, series, instances), each level from the one below it."""
    series = instances.groupBy("patient_id", "study_id", "series_id").agg(F.count("*").alias("instances"))
    studies = series.groupBy("patient_id", "study_id").agg(F.count("*").alias("series"), F.sum("instances").alias("instances"))
    return studies.groupBy("patient_id").agg(F.count("*").alias("studies"), F.sum("series").alias("series"), F.sum("instances").alias("instances"))


def nested(instances: DataFrame) -> DataFrame:
    """One row per patient with arrays of studies, series and instances; for a browser of one patient at a time."""
    series = instances.groupBy("patient_id", "study_id", "series_id").agg(F.sort_array(F.collect_list(F.struct("sop_id", "path"))).alias("instances"))
    studies = series.groupBy("patient_id", "study_id").agg(F.sort_array(F.collect_list(F.struct("series_id", "instances"))).alias("series"))
    return studies.groupBy("patient_id").agg(F.sort_array(F.collect_list(F.struct("study_id", "series"))).alias("studies"))
