"""Sample manifests: rows from metadata, images or an inventory, joined with labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxelframe.functions.labels import histogram_columns
from voxelframe.functions.text import blank_to_null, first_present, is_frontal, patient_from_name, stem


def last_wins(rows: DataFrame, keys: list[str], position: str) -> DataFrame:
    """The row of the greatest position for each key."""
    order = Window.partitionBy(*keys).orderBy(F.desc(position))
    return rows.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def with_labels(records: DataFrame, labels: DataFrame, keys: list[str]) -> DataFrame:
    """Left join on null-unsafe keys: a record without a label row keeps null labels."""
    return records.join(labels, keys, "left")


def from_metadata(metadata: DataFrame, images: DataFrame, labels: DataFrame) -> DataFrame:
    """metadata (image_id, subject_id, study_id, ...) with an image, and labels by the raw ids."""
    joined = metadata.join(images, "image_id").join(labels, ["subject_id", "study_id"], "left")
    patient, study = F.concat(F.lit("p"), "subject_id"), F.concat(F.lit("s"), "study_id")
    return joined.withColumns({"patient_id": patient, "study_id": study, "sample_id": F.concat_ws("/", patient, study, "image_id")}).orderBy("sample_id")


def from_images(images: DataFrame) -> DataFrame:
    """(image_id, image_path) without metadata: the patient is the name's first part, the modality CR."""
    patient = patient_from_name(F.col("image_id"))
    return images.select(
        F.col("image_id").alias("sample_id"), patient.alias("patient_id"), F.lit("unknown-study").alias("study_id"), "image_id", "image_path", F.lit("CR").alias("modality"),
    )


def from_inventory(inventory: DataFrame, labels: DataFrame, order: str = "path") -> DataFrame:
    """Inventory rows as records; identifiers fall back to the file's name and then its number."""
    number = F.row_number().over(Window.partitionBy().orderBy(order)) - 1
    image = first_present(F.col("sop_instance_uid"), stem(F.col("path")))
    named = inventory.withColumn("image_id", image)
    lost = named.where("image_id is null").withColumn("image_id", F.concat(F.lit("dicom-"), number.cast("string")))
    named = named.where("image_id is not null").unionByName(lost)
    named = named.withColumns({"subject_id": first_present(F.col("patient_id"), F.lit("unknown-patient")), "study_id": first_present(F.col("study_instance_uid"), F.lit("unknown-study"))})
    return named.join(labels, ["subject_id", "study_id"], "left").withColumn("sample_id", F.concat_ws("/", "subject_id", "study_id", "image_id"))


def duplicate_hash(pixel_hash: Column, sha: Column) -> Column:
    return F.coalesce(blank_to_null(pixel_hash), blank_to_null(sha))


def index_summary(manifest: DataFrame) -> DataFrame:
    return manifest.agg(F.count("*").alias("samples"), F.countDistinct("patient_id").alias("patients"), F.countDistinct("study_id").alias("studies"))


def validation(manifest: DataFrame, frontal_only: bool = True) -> DataFrame:
    """One row: kept and filtered rows, and of the kept ones readable, unreadable, patients and duplicates."""
    keep = is_frontal(F.col("view_position")) if frontal_only else F.lit(True)
    marked = manifest.withColumn("_keep", keep)
    kept = marked.where("_keep")
    repeated = kept.groupBy("pixel_hash").agg(F.count("*").alias("n")).where("n > 1 and pixel_hash is not null").agg(F.count("*").alias("duplicate_hashes"), F.coalesce(F.sum("n"), F.lit(0)).alias("duplicate_rows"))
    counts = marked.agg(
        F.count("*").alias("total"), F.count_if(~F.col("_keep")).alias("filtered"), F.count_if(F.col("_keep") & F.col("readable")).alias("readable"),
        F.count_if(F.col("_keep") & ~F.col("readable")).alias("unreadable"), F.countDistinct(F.when(F.col("_keep"), F.col("patient_id"))).alias("patients"),
    )
    return counts.crossJoin(repeated)


def target_counts(long: DataFrame) -> DataFrame:
    return long.groupBy("target").agg(*histogram_columns(F.col("value")))


def manifest_summary(manifest: DataFrame) -> DataFrame:
    """Counts by split, view and source, in long form, and whether sources are mixed."""
    parts = [
        manifest.groupBy(F.lit(name).alias("kind"), F.coalesce(F.col(column), F.lit("unknown")).alias("value")).agg(F.count("*").alias("samples"), F.countDistinct("patient_id").alias("patients"))
        for name, column in (("split", "split"), ("view", "view_position"), ("source", "source"))
        if column in manifest.columns
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def source_kind(manifest: DataFrame) -> DataFrame:
    few = F.when(F.countDistinct("source") > 1, "mixed").otherwise(F.coalesce(F.max("source"), F.lit("unknown")))
    return manifest.agg(few.alias("source_kind"), F.countDistinct("source").alias("sources"))
