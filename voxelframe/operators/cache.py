"""Content-addressed tensor tables: writing, reuse, validation and inspection."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator, Mapping, Sequence
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelframe.functions.hashing import stable_hash

from .ordering import numbered

SCHEMA_VERSION = 1
DTYPES = {"float32": "<f4", "float16": "<f2", "uint8": "u1"}


def normalization(images: DataFrame, index: str, values: str, sample: int = 512) -> DataFrame:
    """(n, mean, std) over every stride-th image, stride = max(1, images / sample).

    Two sums, with floors of 1e-6 for the variance and 1e-3 for the deviation.
    Without images it is (0, 0.5, 0.25).
    """
    count = images.count()
    stride = max(1, count // sample)
    some = images.where(F.col(index) % stride == 0).select(F.explode(values).alias("x")).select(F.col("x").cast("double").alias("x"))
    sums = some.agg(F.count("*").alias("n"), F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"))
    std = F.greatest(F.sqrt(F.greatest(F.try_divide("q", "n") - F.try_divide("s", "n") * F.try_divide("s", "n"), F.lit(1e-6))), F.lit(1e-3))
    empty = F.col("n") == 0
    return sums.select("n", F.when(empty, 0.5).otherwise(F.try_divide("s", "n")).alias("mean"), F.when(empty, 0.25).otherwise(std).alias("std"))


def encode_image(values: np.ndarray, dtype: str, mean: float, std: float) -> bytes:
    """Little-endian bytes; uint8 keeps the raw values and leaves normalizing to the reader."""
    if dtype == "uint8":
        return np.clip(values, 0, 255).astype("u1").tobytes()
    return (((values.astype(np.float32) / np.float32(255)) - np.float32(mean)) / np.float32(std)).astype(DTYPES[dtype]).tobytes()


def decode_image(data: bytes, dtype: str, mean: float, std: float) -> np.ndarray:
    raw = np.frombuffer(data, DTYPES[dtype])
    if dtype == "uint8":
        return raw * np.float32(1.0 / (255.0 * std)) - np.float32(mean / std)
    return raw.astype(np.float32)


def image_rows(images: DataFrame, dtype: str, mean: float, std: float) -> DataFrame:
    """(sample_index, split, tensor, sha256) from (sample_index, split, values)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = [encode_image(np.asarray(v, np.float32), dtype, mean, std) for v in batch.column("values").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("sample_index"), batch.column("split"), pa.array(cells, pa.binary()), pa.array([hashlib.sha256(c).hexdigest() for c in cells])], ["sample_index", "split", "tensor", "sha256"])

    return images.select("sample_index", "split", "values").mapInArrow(run, "sample_index long, split string, tensor binary, sha256 string")


def _files(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def write_promoted(df: DataFrame, path: str, metadata: Mapping[str, Any], partition: Sequence[str] = ("split",)) -> str:
    """Writes beside the target and renames at the end, so that a reader sees all of a table or none.

    A table whose metadata is the same is reused; another one under the same
    path is an error.  Returns ``written`` or ``reused``.
    """
    spark = df.sparkSession
    found = read_metadata(spark, path)
    wanted = {"schema_version": SCHEMA_VERSION, "fingerprint": stable_hash(dict(metadata)), **metadata}
    if found is not None:
        if found == wanted:
            return "reused"
        raise ValueError(f"{path} holds a table with other metadata")
    staging = f"{path.rstrip('/')}.staging"
    fs, at = _files(spark, staging)
    fs.delete(at, True)
    try:
        df.write.partitionBy(*partition).parquet(f"{staging}/data")
        spark.createDataFrame([(json.dumps(wanted, sort_keys=True),)], "value string").coalesce(1).write.text(f"{staging}/metadata")
        _, final = _files(spark, path)
        if not fs.rename(at, final):
            raise OSError(f"cannot promote {staging}")
    except BaseException:
        fs.delete(at, True)
        raise
    return "written"


def read_metadata(spark: SparkSession, path: str) -> dict | None:
    fs, at = _files(spark, f"{path.rstrip('/')}/metadata")
    if not fs.exists(at):
        return None
    found = json.loads(spark.read.text(f"{path.rstrip('/')}/metadata").first()["value"])
    if found.get("schema_version") != SCHEMA_VERSION:
        raise ValueError(f"schema version {found.get('schema_version')} is not {SCHEMA_VERSION}")
    return found


def read_table(spark: SparkSession, path: str) -> DataFrame:
    read_metadata(spark, path)
    return spark.read.parquet(f"{path.rstrip('/')}/data")


def validate(rows: DataFrame, expected: DataFrame, length: int) -> DataFrame:
    """(sample_index, split, problem) of a table of tensors: size, digest, missing and unknown rows."""
    size = rows.where(F.length("tensor") != length).select("sample_index", "split", F.lit("wrong_size").alias("problem"))
    digest = rows.where(F.sha2("tensor", 256) != F.col("sha256")).select("sample_index", "split", F.lit("wrong_digest").alias("problem"))
    keys = ["sample_index", "split"]
    missing = expected.select(*keys).join(rows, keys, "left_anti").withColumn("problem", F.lit("missing_row"))
    unknown = rows.select(*keys).join(expected, keys, "left_anti").withColumn("problem", F.lit("unknown_row"))
    return size.unionByName(digest).unionByName(missing).unionByName(unknown)


def check_rows(rows: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """(check_name, errors, checked) for named conditions that mark bad rows, in one pass."""
    cells = F.array(*[F.struct(F.lit(name).alias("check_name"), F.coalesce(bad, F.lit(True)).alias("bad")) for name, bad in rules.items()])
    return rows.select(F.explode(cells).alias("c")).groupBy("c.check_name").agg(F.count_if("c.bad").alias("errors"), F.count("*").alias("checked"))


def existing_status(staged: DataFrame, existing: DataFrame) -> DataFrame:
    """What to do with each staged case (cache_key, digest, metadata): add, keep, replace or refuse."""
    old = existing.select("cache_key", F.col("digest").alias("_d"), F.col("metadata").alias("_m"), F.col("valid").alias("_v"))
    status = F.when(F.col("_d").isNull(), "add").when(F.col("metadata") != F.col("_m"), "refuse").when(F.col("_v") & (F.col("digest") == F.col("_d")), "keep").otherwise("replace")
    return staged.join(old, "cache_key", "left").withColumn("status", status).drop("_d", "_m", "_v")


def inspect(cases: DataFrame) -> DataFrame:
    """One row: cases, bytes, chunked cases, cases with errors, and the status."""
    bad = F.size("errors") > 0
    return cases.agg(
        F.count("*").alias("cases"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"), F.count_if("chunked").alias("chunked"), F.count_if(bad).alias("with_errors"),
        F.when(F.count_if(bad) > 0, "invalid").otherwise("valid").alias("status"),
    )


def volume_chunks(cases: DataFrame, chunk: Sequence[int]) -> DataFrame:
    """(case_id, channel, cx, cy, cz, block): volumes cut into cells, zeros beyond the edge.

    cases: (case_id, channel, shape array<int> x y z, values array<float>).
    """
    cx, cy, cz = chunk

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for case, channel, shape, values in zip(*[batch.column(c).to_pylist() for c in ("case_id", "channel", "shape", "values")], strict=True):
                x = np.asarray(values, np.float32).reshape(shape[::-1])
                counts = [-(-n // c) for n, c in zip(shape, chunk, strict=True)]
                padded = np.zeros((counts[2] * cz, counts[1] * cy, counts[0] * cx), np.float32)
                padded[: shape[2], : shape[1], : shape[0]] = x
                rows = [(i, j, k, padded[k * cz : (k + 1) * cz, j * cy : (j + 1) * cy, i * cx : (i + 1) * cx].tobytes()) for k in range(counts[2]) for j in range(counts[1]) for i in range(counts[0])]
                n = len(rows)
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array([case] * n), pa.array([channel] * n, pa.int32()), *[pa.array(c, pa.int32()) for c in cols[:3]], pa.array(cols[3], pa.binary())], ["case_id", "channel", "cx", "cy", "cz", "block"])

    kind = cases.schema["case_id"].dataType.simpleString()
    return cases.select("case_id", "channel", "shape", "values").mapInArrow(run, f"case_id {kind}, channel int, cx int, cy int, cz int, block binary")


def shard_rows(rows: DataFrame, key: str, size: int) -> DataFrame:
    """Rows with a shard number; every shard but the last has ``size`` of them."""
    return numbered(rows, key, name="_number").withColumn("shard", F.floor(F.col("_number") / size).cast("long")).drop("_number")
