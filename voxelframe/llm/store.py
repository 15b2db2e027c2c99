"""Intermediate tables in the folder that the cluster names."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, a folder of our own if all runs on this machine, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="checkpoints-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def text_session(spark: SparkSession) -> SparkSession:
    """Texts are kilobytes a row: Arrow batches of 1,000 rows instead of 10,000, unless the session sets a number."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, "1000")
    return spark


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}.parquet"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, column: str, finish: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, Callable[[], None]]:
    """``finish`` of ``df`` dealt by ``column``, as a table in the shared folder that keeps the dealing; and what drops its name.

    Joins on ``column`` read it without a shuffle.  ``finish`` may join and
    group by ``column`` only, so that each bucket is one file.
    """
    spark = df.sparkSession
    name, parts = f"bucketed_{uuid.uuid4().hex}", int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = finish(df.repartition(parts, column))
    table.write.bucketBy(parts, column).option("path", f"{shared_folder(spark)}/{name}").saveAsTable(name)
    return spark.table(name), lambda: spark.sql(f"DROP TABLE IF EXISTS {name}")


def row_hash(documents: DataFrame) -> Column:
    """A hash of a whole row; columns that hold maps are hashed as JSON."""
    kinds = {f.name: f.dataType.simpleString() for f in documents.schema.fields}
    plain = [c for c in documents.columns if not re.search("map<|variant", kinds[c])]
    return F.xxhash64(*plain, *[F.to_json(F.struct(c)) for c in documents.columns if c not in plain])


def set_aside(documents: DataFrame, used: tuple[str, ...] = ("doc_id", "text", "source", "lang", "n_chars")) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``documents`` with all columns but ``used`` under names of our own, and the way back.

    Whatever a table's other columns are called, they clash with nothing.
    """
    hidden = {c: f"aside_{i}" for i, c in enumerate(documents.columns) if c not in used}
    col = lambda name: F.col("`" + name.replace("`", "``") + "`")
    inner = documents.select(*[col(c).alias(hidden.get(c, c)) for c in documents.columns])

    def back(df: DataFrame) -> DataFrame:
        return df.select(*[F.col(hidden.get(c, c)).alias(c) for c in documents.columns])

    return inner, back


BIT_WORDS = 1 << 17


def _place(value: Column) -> tuple[Column, Column]:
    return F.pmod(F.shiftrightunsigned(value, 6), F.lit(BIT_WORDS)), F.pmod(value, F.lit(64)).cast("int")


def maybe_in(df: DataFrame, column: str, values: DataFrame, there: bool = True) -> DataFrame:
    """Rows whose 64-bit hash may be among ``values``; with ``there`` false, those that are surely not.

    A bitmap of a fixed size (8 million bits, 1 MB) is sent to all tasks, so
    that rows without a match need no shuffle.  With very many values it fills
    up and lets more rows pass, which the join that follows puts right.
    """
    word, bit = _place(F.col(values.columns[0]))
    some = values.groupBy(word.alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, CAST(pmod({values.columns[0]}, 64) AS INT))")).alias("bits"))
    every = df.sparkSession.range(BIT_WORDS).join(some, F.col("id") == F.col("word"), "left")
    cells = F.sort_array(F.collect_list(F.struct("id", F.coalesce("bits", F.lit(0).cast("long")).alias("bits"))))
    bitmap = every.agg(F.transform(cells, lambda c: c["bits"]).alias("_bitmap"))
    word, bit = _place(F.col(column))
    found = F.getbit(F.get("_bitmap", word.cast("int")), bit) == 1
    return df.join(F.broadcast(bitmap), found, "left_semi" if there else "left_anti")
