"""Batches: fixed sizes, runs of consecutive indices, indexed reads and schedules."""

from __future__ import annotations

import random
from collections.abc import Iterator, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def batch_id(index: Column, size: int) -> Column:
    return F.floor(index / size).cast("long")


def complete_batches(rows: DataFrame, size: int, drop_last: bool) -> DataFrame:
    """Rows of (index, ...) with their batch; short batches go if ``drop_last``."""
    out = rows.withColumn("batch_id", batch_id(F.col("index"), size))
    if drop_last:
        full = out.groupBy("batch_id").count().where(F.col("count") == size).select("batch_id")
        out = out.join(full, "batch_id", "left_semi")
    return out


def worker_share(rows: DataFrame, worker: int, workers: int) -> DataFrame:
    if not 0 <= worker < workers:
        raise ValueError("the worker's number must be below the number of workers")
    return rows.where(F.col("batch_id") % workers == worker)


def contiguous_runs(rows: DataFrame, index: str, by: Sequence[str] = ()) -> DataFrame:
    """(start, length) of runs of consecutive indices within each group; a repeated index begins a run.

    A run that a group's boundary cuts is two runs: groups are the unit of reading.
    """
    order = Window.partitionBy(*by).orderBy(index)
    new = F.coalesce(F.col(index) - F.lag(index).over(order) != 1, F.lit(True))
    runs = rows.withColumn("_run", F.sum(F.when(new, 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(*by, "_run").agg(F.min(index).alias("start"), F.count("*").alias("length")).drop("_run")


def runs_of(indices: Sequence[int]) -> list[tuple[int, int]]:
    """(start, length) for the indices of one batch, sorted first."""
    ranked = sorted(indices)
    starts = [i for i, v in enumerate(ranked) if not i or v != ranked[i - 1] + 1]
    return [(ranked[a], b - a) for a, b in zip(starts, [*starts[1:], len(ranked)], strict=True)]


def is_contiguous(rows: DataFrame, index: str, position: str, by: Sequence[str]) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(position)
    step = F.col(index) - F.lag(index).over(order)
    return rows.withColumn("_step", F.coalesce(step == 1, F.lit(True))).groupBy(*by).agg(F.bool_and("_step").alias("contiguous"))


def indexed_read(table: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """Rows of (pos, key), range-sorted into request order; how the two are joined goes by their sizes."""
    return wanted.join(table, key).orderBy("pos")


def shuffled(n: int, seed: int, block: int = 1) -> list[int]:
    """Indices in the order of a seeded shuffle of blocks of neighbours; blocks keep their order inside."""
    blocks = [list(range(i, min(i + block, n))) for i in range(0, n, block)]
    random.Random(seed).shuffle(blocks)
    return [i for b in blocks for i in b]


def schedule(spark: SparkSession, n: int, size: int, iterations: int, seed: int | None = None, block: int = 1, drop_last: bool = False, every_epoch: bool = True) -> DataFrame:
    """(iteration, batch_id, pos, sample_index): a replayable order of an epoch's batches, again for each iteration."""
    rows = []
    for iteration in range(iterations):
        order = list(range(n)) if seed is None else shuffled(n, seed + (iteration if every_epoch else 0), block)
        for b in range(0, n, size):
            part = order[b : b + size]
            if len(part) == size or not drop_last:
                rows += [(iteration, b // size, p, i) for p, i in enumerate(part)]
    return spark.createDataFrame(rows, "iteration long, batch_id long, pos long, sample_index long")


class BatchReader:
    """Yields batches of a table of (sample_index, image, labels, masks, ...) as dicts of NumPy arrays.

    Batches stream from Spark one partition ahead; nothing else is held.
    """

    def __init__(self, table: DataFrame, size: int, order: Sequence[int] | None = None, drop_last: bool = False, worker: int = 0, workers: int = 1):
        self.table, self.size, self.order, self.drop_last, self.worker, self.workers = table, size, order, drop_last, worker, workers

    def __iter__(self) -> Iterator[dict[str, np.ndarray | list]]:
        rows = self.table
        if self.order is not None:
            wanted = rows.sparkSession.createDataFrame([(p, int(i)) for p, i in enumerate(self.order)], "pos long, sample_index long")
            rows = indexed_read(rows, wanted, "sample_index").drop("pos")
        else:
            rows = rows.orderBy("sample_index")
        held, number = [], 0
        for row in rows.toLocalIterator(prefetchPartitions=True):
            held.append(row)
            if len(held) == self.size:
                if number % self.workers == self.worker:
                    yield self._pack(held)
                held, number = [], number + 1
        if held and not self.drop_last and number % self.workers == self.worker:
            yield self._pack(held)

    @staticmethod
    def _pack(rows: list) -> dict[str, np.ndarray | list]:
        out = {}
        for name in rows[0].asDict():
            cells = [r[name] for r in rows]
            out[name] = np.array(cells, np.float32) if isinstance(cells[0], list) and cells[0] and isinstance(cells[0][0], float) else np.array(cells) if isinstance(cells[0], (int, float, bool)) else cells
        return out
