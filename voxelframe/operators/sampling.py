"""Patch sampling: case rotation, a portable generator, and extraction from whole or chunked volumes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .volumes import box_count, prefix_sums

MASK = (1 << 64) - 1


class SplitMix:
    """The SplitMix64 generator; the constants are its published ones."""

    def __init__(self, seed: int):
        self.state = seed & MASK

    def next(self) -> int:
        self.state = (self.state + 0x9E3779B97F4A7C15) & MASK
        z = self.state
        z = (z ^ (z >> 30)) * 0xBF58476D1CE4E5B9 & MASK
        z = (z ^ (z >> 27)) * 0x94D049BB133111EB & MASK
        return z ^ (z >> 31)

    def below(self, bound: int) -> int:
        return self.next() % bound if bound > 0 else 0


def patch_seed(base: int, case: str, epoch: int, worker: int, index: int) -> int:
    """A seed that depends on nothing but these."""
    parts = base.to_bytes(8, "little") + case.encode() + b"".join(n.to_bytes(8, "little") for n in (epoch, worker, index))
    return int.from_bytes(hashlib.sha256(parts).digest()[:8], "little")


def plan_cases(cases: DataFrame, count: int) -> DataFrame:
    """(index, case_id, wants_foreground): cases in turn by name, foreground on even numbers.

    The cases of a cache are ranked in one task: a row for each case only.
    """
    spark = cases.sparkSession
    ranked = cases.select("case_id", (F.row_number().over(Window.orderBy("case_id")) - 1).alias("_r"))
    n = ranked.agg(F.count("*").alias("_n"))
    plan = spark.range(count).withColumnRenamed("id", "index").crossJoin(F.broadcast(n))
    return plan.withColumn("_r", F.col("index") % F.col("_n")).join(ranked, "_r").select("index", "case_id", (F.col("index") % 2 == 0).alias("wants_foreground"))


def start_near(centre: Sequence[int], patch: Sequence[int], shape: Sequence[int]) -> list[int]:
    return [min(max(c - p // 2, 0), n - p) for c, p, n in zip(centre, patch, shape, strict=True)]


def sample_patches(plan: DataFrame, cases: DataFrame, patch: Sequence[int], seed: int, epoch: int = 0, worker: int = 0) -> DataFrame:
    """Patch records of (index, case_id, wants_foreground) x (case_id, shape, label array<int>).

    Wanted foreground: a foreground voxel is drawn and the patch put around it.
    Else the start is drawn, and the foreground counted by the integral volume.
    """
    size = list(patch)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            starts, found = [], []
            for index, case, wanted, shape, label in zip(*[batch.column(c).to_pylist() for c in ("index", "case_id", "wants_foreground", "shape", "label")], strict=True):
                if any(p > n for p, n in zip(size, shape, strict=True)):
                    raise ValueError(f"a patch of {size} does not fit into case {case} of {shape}")
                draw, cube = SplitMix(patch_seed(seed, str(case), epoch, worker, index)), np.asarray(label, np.int32).reshape(shape[::-1])
                at = np.flatnonzero(cube)
                if wanted and len(at):
                    flat = int(at[draw.below(len(at))])
                    start, inside = start_near((flat % shape[0], flat // shape[0] % shape[1], flat // (shape[0] * shape[1])), size, shape), True
                else:
                    start = [draw.below(n - p + 1) for n, p in zip(shape, size, strict=True)]
                    inside = box_count(prefix_sums(cube), start, size) > 0
                starts.append(start)
                found.append(inside)
            n = batch.num_rows
            cells = [batch.column("index"), batch.column("case_id"), pa.array(starts, pa.list_(pa.int32())), pa.array([size] * n, pa.list_(pa.int32())), pa.array(found, pa.bool_()), pa.array(["foreground_balanced"] * n), pa.array([epoch] * n, pa.int64()), pa.array([worker] * n, pa.int64())]
            yield pa.RecordBatch.from_arrays(cells, ["index", "case_id", "patch_start", "patch_size", "has_foreground", "strategy", "epoch", "worker"])

    joined = plan.join(cases, "case_id").select("index", "case_id", "wants_foreground", "shape", "label")
    kind = plan.schema["case_id"].dataType.simpleString()
    return joined.mapInArrow(run, f"index long, case_id {kind}, patch_start array<int>, patch_size array<int>, has_foreground boolean, strategy string, epoch long, worker long")


def check_plan(plan: DataFrame, cases: DataFrame) -> DataFrame:
    """(problem, n): empty plans, unknown cases and mixed patch sizes."""
    unknown = plan.join(cases, "case_id", "left_anti").agg(F.lit("unknown_case").alias("problem"), F.count("*").alias("n"))
    sizes = plan.agg(F.lit("mixed_patch_sizes").alias("problem"), (F.countDistinct("patch_size") - 1).alias("n")).where("n > 0")
    empty = plan.agg(F.lit("empty_plan").alias("problem"), F.count("*").alias("c")).where("c = 0").select("problem", F.lit(1).cast("long").alias("n"))
    return unknown.where("n > 0").unionByName(sizes).unionByName(empty)


def chunk_cells(patches: DataFrame, chunk: Sequence[int]) -> DataFrame:
    """Each patch with the cells of the chunk grid it overlaps: an equi-join key instead of a range."""
    out = patches
    for axis, name in enumerate(("cx", "cy", "cz")):
        start, size = F.get("patch_start", F.lit(axis)), F.get("patch_size", F.lit(axis))
        low, high = F.floor(start / chunk[axis]).cast("int"), F.floor((start + size - 1) / chunk[axis]).cast("int")
        out = out.withColumn(name, F.explode(F.sequence(low, high)))
    return out


def _extracted(kind: str) -> str:
    return f"index long, case_id {kind}, patch array<float>"


def extract_whole(patches: DataFrame, cases: DataFrame) -> DataFrame:
    """Patches cut from whole volumes (case_id, shape, values)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for start, size, shape, values in zip(*[batch.column(c).to_pylist() for c in ("patch_start", "patch_size", "shape", "values")], strict=True):
                x = np.asarray(values, np.float32).reshape(shape[::-1])
                out.append(x[start[2] : start[2] + size[2], start[1] : start[1] + size[1], start[0] : start[0] + size[0]].ravel())
            yield pa.RecordBatch.from_arrays([batch.column("index"), batch.column("case_id"), pa.array(out, pa.list_(pa.float32()))], ["index", "case_id", "patch"])

    joined = patches.join(cases, "case_id").select("index", "case_id", "patch_start", "patch_size", "shape", "values")
    return joined.mapInArrow(run, _extracted(patches.schema["case_id"].dataType.simpleString()))


def extract_chunked(patches: DataFrame, chunks: DataFrame, chunk: Sequence[int]) -> DataFrame:
    """Patches put together from the cells they overlap; only those cells are read."""
    joined = chunk_cells(patches, chunk).join(chunks, ["case_id", "cx", "cy", "cz"])
    cells = joined.groupBy("index", "case_id", "patch_start", "patch_size").agg(F.collect_list(F.struct("cx", "cy", "cz", "block")).alias("cells"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for start, size, cells in zip(*[batch.column(c).to_pylist() for c in ("patch_start", "patch_size", "cells")], strict=True):
                patch = np.zeros(size[::-1], np.float32)
                for cell in cells:
                    block = np.frombuffer(cell["block"], np.float32).reshape(chunk[::-1])
                    base = [cell[a] * n for a, n in zip(("cx", "cy", "cz"), chunk, strict=True)]
                    low = [max(b, s) for b, s in zip(base, start, strict=True)]
                    high = [min(b + n, s + p) for b, n, s, p in zip(base, chunk, start, size, strict=True)]
                    target = tuple(slice(low[a] - start[a], high[a] - start[a]) for a in (2, 1, 0))
                    patch[target] = block[tuple(slice(low[a] - base[a], high[a] - base[a]) for a in (2, 1, 0))]
                out.append(patch.ravel())
            yield pa.RecordBatch.from_arrays([batch.column("index"), batch.column("case_id"), pa.array(out, pa.list_(pa.float32()))], ["index", "case_id", "patch"])

    return cells.mapInArrow(run, _extracted(patches.schema["case_id"].dataType.simpleString()))
