"""Sinks: JSON documents, JSON lines, tar shards and text reports."""

from __future__ import annotations

import io
import json
import tarfile
from collections.abc import Iterator, Mapping, Sequence
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """One small text file, in whatever store the path names."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    out = fs.create(p, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def write_json(spark: SparkSession, path: str, document: Mapping[str, Any]) -> None:
    write_text(spark, path, json.dumps(document, indent=2, sort_keys=True, default=str) + "\n")


def write_jsonl(df: DataFrame, path: str, compress: bool = False) -> None:
    df.write.mode("overwrite").option("compression", "gzip" if compress else "none").option("ignoreNullFields", "false").json(path)


def verified_jsonl(df: DataFrame, path: str, key: str) -> int:
    """Writes gz JSON lines and reads them again: the number of rows, if keys and rows agree."""
    write_jsonl(df, path, compress=True)
    back = df.sparkSession.read.schema(df.schema).json(path, mode="FAILFAST")
    digest = lambda d: d.agg(F.count("*").alias("n"), F.sum(F.xxhash64(F.to_json(F.struct(*d.columns))).cast("decimal(38,0)")).alias("h")).first()
    a, b = digest(df), digest(back)
    if a != b:
        raise OSError(f"{path}: {a['n']} rows written, {b['n']} read, or they differ")
    return a["n"]


def tar_shards(rows: DataFrame, key: str, image: str, metadata: Sequence[str]) -> DataFrame:
    """(shard, name, content): a tar file of each shard, with a png and a json member for each row.

    rows: (shard, key, image bytes, metadata...).  A shard has a fixed number
    of rows, so a shard fits a task.
    """

    def run(pdf):
        import pandas as pd

        out = io.BytesIO()
        with tarfile.open(fileobj=out, mode="w", format=tarfile.USTAR_FORMAT) as tar:
            for _, row in pdf.sort_values(key).iterrows():
                for suffix, data in (("png", bytes(row[image])), ("json", json.dumps({m: row[m] for m in metadata}, sort_keys=True, default=str).encode())):
                    info = tarfile.TarInfo(f"{row[key]}.{suffix}")
                    info.size = len(data)
                    tar.addfile(info, io.BytesIO(data))
        shard = int(pdf["shard"].iloc[0])
        return pd.DataFrame({"shard": [shard], "name": [f"shard-{shard:06d}.tar"], "content": [out.getvalue()]})

    return rows.groupBy("shard").applyInPandas(run, "shard long, name string, content binary")


def read_shards(shards: DataFrame) -> DataFrame:
    """(key, suffix, content) of the members of tar files (name, content)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for content in batch.column("content").to_pylist():
                with tarfile.open(fileobj=io.BytesIO(content)) as tar:
                    for member in tar:
                        key, _, suffix = member.name.rpartition(".")
                        rows.append((key, suffix, tar.extractfile(member).read()))
            columns = list(zip(*rows, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.binary()), strict=True)], ["key", "suffix", "content"])

    return shards.select("content").mapInArrow(run, "key string, suffix string, content binary")


def report(title: str, sections: Mapping[str, DataFrame | Mapping[str, Any]], most: int = 200) -> str:
    """Markdown of small tables and facts; a table is cut after ``most`` rows and says so."""
    lines = [f"# {title}", ""]
    for name, section in sections.items():
        lines += [f"## {name}", ""]
        if isinstance(section, Mapping):
            lines += [f"- {k}: {v}" for k, v in section.items()]
        else:
            rows = section.limit(most + 1).collect()
            lines += ["| " + " | ".join(section.columns) + " |", "|" + " --- |" * len(section.columns)]
            lines += ["| " + " | ".join("" if v is None else str(v) for v in row) + " |" for row in rows[:most]]
            if len(rows) > most:
                lines.append(f"({most} rows shown)")
        lines.append("")
    return "\n".join(lines)
