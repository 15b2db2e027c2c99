"""From a folder of DICOM files and a label table to a validated tensor table."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelframe.functions.labels import encode
from voxelframe.operators import cache, inventory, manifest, splits
from voxelframe.operators.images import fit_pad
from voxelframe.operators.ordering import numbered
from voxelframe.plans.config import Recipe
from voxelframe.sources import dicom, sinks, tabular

STEPS = ("scan", "filter", "manifest", "split", "cache", "validate", "report")


@dataclass
class Ingest:
    """The tables of a run; all are lazy but what was written."""

    inventory: DataFrame
    errors: DataFrame
    skipped: DataFrame
    manifest: DataFrame
    long: DataFrame
    tensors: DataFrame | None = None
    problems: DataFrame | None = None
    status: str = "planned"
    summary: dict[str, Any] | None = None


def plan(recipe: Recipe, out: str) -> list[tuple[str, str]]:
    """(step, what it would write): the dry run."""
    return [(s, f"{out}/{n}") for s, n in zip(STEPS, ("inventory", "skipped", "manifest", "splits", "cache", "problems", "report.md"), strict=True)]


def build_manifest(spark: SparkSession, recipe: Recipe, kept: DataFrame, labels_path: str) -> tuple[DataFrame, DataFrame]:
    """(manifest, long labels) of the kept inventory rows; targets of the recipe only, absent ones as null."""
    label_long = tabular.label_table(spark, labels_path)
    studies = label_long.select("subject_id", "study_id").distinct().withColumn("has_labels", F.lit(True))
    rows = manifest.from_inventory(kept, studies)
    targets = spark.createDataFrame([(t,) for t in recipe.labels.targets], "target string")
    pairs = rows.select("sample_id", F.col("subject_id").alias("patient_id"), "subject_id", "study_id").crossJoin(F.broadcast(targets))
    long = pairs.join(label_long, ["subject_id", "study_id", "target"], "left").select("sample_id", "patient_id", "target", "value")
    return rows.withColumn("patient_id", F.col("subject_id")), long


def assign(recipe: Recipe, rows: DataFrame, long: DataFrame) -> DataFrame:
    ratios = (recipe.split.train, recipe.split.val, recipe.split.test)
    if recipe.split.stratify:
        targets = [t for t in recipe.split.stratify if t in recipe.labels.targets]
        fields = [t for t in recipe.split.stratify if t not in recipe.labels.targets]
        patients = splits.stratified_split(rows, splits.strata(rows, long, targets, fields), ratios, recipe.split.seed)
    else:
        patients = splits.hash_split(rows, ratios, recipe.split.seed)
    return splits.apply_patients(rows, patients)


def tensors(spark: SparkSession, recipe: Recipe, rows: DataFrame, folder: str, dtype: str = "uint8") -> DataFrame:
    """(sample_index, sample_id, split, tensor, sha256, error): shown pixels, fitted and stored.

    Samples are numbered within their split in an order of their ids' hashes,
    so a number depends on the manifest alone.
    """
    size, show = recipe.image.size[0], recipe.presentation

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells, digests, errors = [], [], []
            for content in batch.column("content").to_pylist():
                try:
                    image, _ = dicom.present(dicom.parse(content), show.apply_rescale, show.voi, show.invert_monochrome1)
                    data = cache.encode_image(fit_pad(image, size).astype(np.float32), dtype, 0.5, 0.25)
                    cells.append(data)
                    digests.append(hashlib.sha256(data).hexdigest())
                    errors.append(None)
                except (dicom.DicomError, ValueError) as error:
                    cells.append(None)
                    digests.append(None)
                    errors.append(str(error))
            keep = [batch.column(c) for c in ("sample_index", "sample_id", "split")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(cells, pa.binary()), pa.array(digests, pa.string()), pa.array(errors, pa.string())], ["sample_index", "sample_id", "split", "tensor", "sha256", "error"])

    indexed = numbered(rows.select("path", "sample_id", "split"), "sample_id", ["split"], "sample_index")
    files = dicom.candidates(spark, folder).select("path", "content")
    joined = files.join(indexed, "path").select("sample_index", "sample_id", "split", "content")
    return joined.mapInArrow(run, "sample_index long, sample_id string, split string, tensor binary, sha256 string, error string")


def run(spark: SparkSession, recipe: Recipe, folder: str, labels_path: str, out: str, dry_run: bool = False, dtype: str = "uint8") -> Ingest:
    """All steps; with ``dry_run`` nothing is written.

    Patients of two splits are counted after splitting, so the audit sees the
    splits that are used.
    """
    found, errors = dicom.scan(spark, folder)
    reason = inventory.filter_reason(F.col("transfer_syntax_uid"), recipe.dicom.allow_transfer_syntaxes, F.col("modality"), recipe.dicom.modalities, F.col("view_position"), recipe.dicom.views)
    if recipe.dicom.unsupported_transfer_syntax == "fail":
        bad = inventory.filter_reason(F.col("transfer_syntax_uid"), recipe.dicom.allow_transfer_syntaxes)
        found = found.withColumn("transfer_syntax_uid", F.when(bad.isNotNull(), F.raise_error(F.concat(F.lit("transfer syntax "), "transfer_syntax_uid", F.lit(" of "), "path", F.lit(" is not allowed")))).otherwise(F.col("transfer_syntax_uid")))
    kept, skipped = inventory.apply_filter(found, reason)
    rows, long = build_manifest(spark, recipe, kept, labels_path)
    result = Ingest(found, errors, skipped, assign(recipe, rows, long), long)
    if dry_run:
        return result
    result.manifest.write.mode("overwrite").parquet(f"{out}/manifest")
    result.manifest = spark.read.parquet(f"{out}/manifest")
    skipped.select("path", "reason").write.mode("overwrite").parquet(f"{out}/skipped")
    samples = result.manifest.select("sample_id", "split")
    encoded = long.join(samples, "sample_id").select("sample_id", "split", "target", encode(F.col("value"), recipe.labels.missing, recipe.labels.uncertain).alias("e")).select("sample_id", "split", "target", "e.label", "e.mask")
    encoded.write.mode("overwrite").partitionBy("split").parquet(f"{out}/labels")
    made = tensors(spark, recipe, result.manifest, folder, dtype)
    result.status = cache.write_promoted(made, f"{out}/cache", {"recipe": recipe.fingerprint, "dtype": dtype, "size": recipe.image.size[0]})
    result.tensors = cache.read_table(spark, f"{out}/cache")
    length = recipe.image.size[0] ** 2 * np.dtype(cache.DTYPES[dtype]).itemsize
    failed = result.tensors.where("error is not null").select("sample_index", "split", F.lit("undecodable").alias("problem"))
    result.problems = cache.validate(result.tensors.where("error is null"), result.tensors.select("sample_index", "split"), length).where("problem <> 'missing_row'").unionByName(failed)
    overlap = splits.overlap_values(result.manifest, "patient_id").count()
    result.summary = {"scanned": found.count(), "unreadable": errors.count(), "skipped": skipped.count(), "samples": result.manifest.count(), "problems": result.problems.count(), "patients_in_two_splits": overlap}
    sinks.write_text(spark, f"{out}/report.md", sinks.report(f"Ingest {recipe.name}", {"Summary": result.summary, "Splits": splits.split_summary(result.manifest), "Skipped": skipped.groupBy("reason").count(), "Labels": manifest.target_counts(long)}))
    return result
