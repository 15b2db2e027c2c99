"""An inventory that grows with its folder: new files are parsed and merged, the last row of a path wins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from voxelframe.functions.text import extension
from voxelframe.operators.repeats import upsert

FILES = "path string, modificationTime timestamp, length long, content binary"


def merge(spark: SparkSession, target: str, batch: DataFrame, epoch: int) -> None:
    """Adds a batch's rows as a version of their own; readers take the last version of each path.

    A batch that runs again writes the same version again, so nothing is
    counted twice.
    """
    rows = batch.select("path", F.sha2("content", 256).alias("sha256"), "length", "modificationTime").withColumn("version", F.lit(epoch).cast("long"))
    rows.write.mode("overwrite").parquet(f"{target}/version={epoch}")


def current(spark: SparkSession, target: str) -> DataFrame:
    rows = spark.read.option("basePath", target).parquet(f"{target}/version=*")
    return upsert(rows, "path", ["version", "modificationTime"])


def follow(spark: SparkSession, folder: str, target: str, checkpoint: str) -> StreamingQuery:
    """Takes what is new in the folder and stops; run it again for later files."""
    files = spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", "true").load(folder)
    wanted = files.where(extension(F.col("path")).isin("dc", "dcm", "dicom", "ima", ""))
    return wanted.writeStream.foreachBatch(lambda batch, epoch: merge(spark, target, batch, epoch)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
