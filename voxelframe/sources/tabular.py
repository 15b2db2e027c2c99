"""Tables of text: CSV with header aliases, label tables, JSON lines and manifests."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from voxelframe.functions.hashing import stable_bucket
from voxelframe.functions.labels import parse_label
from voxelframe.functions.text import blank_to_null, extension, stem

ID_NAMES = ("subject_id", "study_id", "dicom_id", "image_id", "patient_id")


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text; short rows are filled with nulls, gz files are unpacked."""
    return spark.read.csv(path, header=True, mode="PERMISSIVE", inferSchema=False, enforceSchema=False)


def pick(df: DataFrame, *names: str) -> Column:
    """The first of the named columns (case does not matter) that is there and not blank."""
    there = {c.lower(): c for c in df.columns}
    found = [blank_to_null(F.col(f"`{there[n.lower()]}`")) for n in names if n.lower() in there]
    return F.coalesce(*found) if found else F.lit(None).cast("string")


def with_aliases(df: DataFrame, aliases: Mapping[str, Sequence[str]]) -> DataFrame:
    return df.select(*[pick(df, name, *others).alias(name) for name, others in aliases.items()])


def label_table(spark: SparkSession, path: str, ids: Sequence[str] = ID_NAMES) -> DataFrame:
    """(subject_id, study_id, target, value): every column but the ids is a target; the last row of a pair wins.

    Rows are numbered as the file is read, so a single file keeps its order.
    """
    df = read_csv(spark, path)
    targets = [c for c in df.columns if c.lower() not in ids]
    rows = df.select(pick(df, "subject_id").alias("subject_id"), pick(df, "study_id").alias("study_id"), F.monotonically_increasing_id().alias("_n"), *[F.col(f"`{t}`") for t in targets])
    order = Window.partitionBy("subject_id", "study_id").orderBy(F.desc("_n"))
    rows = rows.withColumn("_r", F.row_number().over(order)).where("_r = 1")
    cells = F.array(*[F.struct(F.lit(t).alias("target"), parse_label(F.col(f"`{t}`")).alias("value")) for t in targets])
    return rows.select("subject_id", "study_id", F.explode(cells).alias("c")).select("subject_id", "study_id", "c.target", "c.value")


def label_maps(long: DataFrame) -> DataFrame:
    """(subject_id, study_id, labels map): the map form, for the edge of the engine."""
    return long.groupBy("subject_id", "study_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("target", "value")))).alias("labels"))


def image_listing(spark: SparkSession, path: str) -> DataFrame:
    """(image_id, image_path) of jpg, jpeg and png files; of equal stems the greatest path. Contents are not read."""
    return images_of(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path))


def images_of(files: DataFrame) -> DataFrame:
    """image_listing() of rows (path)."""
    files = files.select("path")
    images = files.where(extension(F.col("path")).isin("jpg", "jpeg", "png"))
    return images.groupBy(stem(F.col("path")).alias("image_id")).agg(F.max("path").alias("image_path"))


def read_jsonl(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Rows of JSON lines; blank lines are skipped and anything else unreadable is an error."""
    return spark.read.schema(schema).json(path, mode="FAILFAST")


def read_patches(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    rows = read_jsonl(spark, path, schema)
    if rows.isEmpty():
        raise ValueError(f"{path} has no patches")
    return rows


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the ``cases`` of a manifest that is one JSON document."""
    return spark.read.json(path, multiLine=True).select(F.explode("cases").alias("c")).select("c.*")


def split_lists(spark: SparkSession, path: str) -> DataFrame:
    """(sample_id, split, ordinal) of a JSON document with a list for each split."""
    found = spark.read.json(path, multiLine=True)
    parts = [found.select(F.posexplode(name).alias("ordinal", "sample_id"), F.lit(name).alias("split")) for name in ("train", "val", "test") if name in found.columns]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.select("sample_id", "split", "ordinal")


def directory_bytes(spark: SparkSession, path: str) -> int:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("length")
    return int(files.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("n")).first()["n"])


def subset(df: DataFrame, key: str, seed: int, limit: int) -> DataFrame:
    """A repeatable sample of ``limit`` rows: the least seeded buckets. The limit is the operator."""
    return df.orderBy(stable_bucket(F.col(key), seed), key).limit(limit)
