"""Toxicity by FTRL-proximal logistic regression.

Features are hashed word unigrams, bigrams and skip-bigrams (one word left
out), present or not.  Words are lower-cased runs of letters, digits and
non-ASCII characters.  Learning rates are per coordinate, and the L1 term
leaves few weights, which are broadcast (at most ``2**bits`` of them).

The classifier is fitted on a bounded sample of labelled rows
(``FtrlConfig.sample``), in one task over features alone.

Defined results: an empty or null text scores by the intercept; a label that
is null does not count, a document with several labels is toxic if one says
so; without labels every score is 0.  A row is scored alone, so repeated rows
agree.  Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textbatch import Words, chunks, mix64, text_buffer


@dataclass(frozen=True)
class FtrlConfig:
    sample: int = 20_000
    bits: int = 20
    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 6.0
    l2: float = 0.0
    epochs: int = 4
    positive_weight: float = 1.0
    least_documents: int = 4


@dataclass(frozen=True)
class SparseWeights:
    intercept: float
    index: np.ndarray
    weight: np.ndarray
    bits: int


def word_features(data: np.ndarray, offsets: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) of each unigram, bigram and skip-bigram, with repeats."""
    table = np.full(256, 32, np.uint8)
    for c in range(128):
        if chr(c).isalnum():
            table[c] = ord(chr(c).lower())
    table[128:] = np.arange(128, 256)
    words = Words(table[data], offsets)
    h, doc = words.hash, words.doc
    docs, keys = [doc], [h]
    for gap, salt in ((1, 0x51ED270B35A3D5E1), (2, 0xB492B66FBE98F273)):
        if len(h) > gap:
            same = doc[gap:] == doc[:-gap]
            docs.append(doc[:-gap][same])
            keys.append(mix64(h[:-gap][same] * np.uint64(salt) + h[gap:][same]))
    shift = np.uint64(64 - bits)
    return np.concatenate(docs), (np.concatenate(keys) >> shift).astype(np.int64)


def ftrl(rows: list[np.ndarray], labels: np.ndarray, config: FtrlConfig) -> SparseWeights:
    """One pass per epoch, row by row; within a row, all coordinates at once."""
    size = 1 << config.bits
    seen = np.zeros(size, np.int64)
    for row in rows:
        seen[row] += 1
    rows = [row[seen[row] >= config.least_documents] for row in rows]
    z, n = np.zeros(size + 1), np.zeros(size + 1)
    l1 = np.float64(config.l1)

    def weights(at: np.ndarray) -> np.ndarray:
        free = np.where(at == size, 0.0, l1)  # the intercept has no L1 term
        zed = z[at]
        w = -(zed - np.sign(zed) * free) / ((config.beta + np.sqrt(n[at])) / config.alpha + config.l2)
        return np.where(np.abs(zed) > free, w, 0.0)

    rng = np.random.default_rng(11)
    for _ in range(config.epochs):
        for r in rng.permutation(len(rows)).tolist():
            at = np.append(rows[r], size)
            w = weights(at)
            p = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35)))
            g = (p - labels[r]) * (config.positive_weight if labels[r] else 1.0)
            step = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / config.alpha
            z[at] += g - step * w
            n[at] += g * g
    final = weights(np.arange(size + 1))
    kept = np.flatnonzero(final[:-1])
    return SparseWeights(float(final[-1]), kept, final[kept], config.bits)


def distinct_by_text(doc: np.ndarray, feature: np.ndarray, docs: int, bits: int) -> list[np.ndarray]:
    keys = np.unique((doc.astype(np.int64) << bits) | feature)
    at = np.searchsorted(keys, np.arange(docs + 1, dtype=np.int64) << bits)
    keys &= (1 << bits) - 1
    return [keys[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def learn(documents: DataFrame, labels: DataFrame, config: FtrlConfig = FtrlConfig()) -> SparseWeights:
    """Fits on the documents that ``labels`` (doc_id, toxic) marks."""
    marked = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    count = marked.count()
    if not count:
        return SparseWeights(-35.0, np.zeros(0, np.int64), np.zeros(0), config.bits)
    draw = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit("toxicity")), 11) / F.lit(float(1 << 53))
    sample = marked.where(draw < min(1.0, config.sample / count))
    texts = documents.select("doc_id", F.col("text").cast("binary").alias("text")).join(F.broadcast(sample), "doc_id")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                rows = distinct_by_text(*word_features(*text_buffer(part.column("text")), config.bits), part.num_rows, config.bits)
                cells = pa.array([r.astype(np.int32).tobytes() for r in rows], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("toxic"), cells], ["doc_id", "toxic", "x"])

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, toxic = [], []
        for batch in batches:
            rows += [np.frombuffer(x, np.int32) for x in batch.column("x").to_pylist()]
            toxic += batch.column("toxic").to_pylist()
        if rows:
            got = ftrl(rows, np.array(toxic, float), config)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(got.index, 1 << config.bits)), pa.array(np.append(got.weight, got.intercept))], ["i", "w"])

    found = texts.mapInArrow(read, f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, toxic int, x binary").repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), F.xxhash64("x")).drop("doc_id")
    got = found.mapInArrow(train, "i long, w double").toArrow()
    index, weight = got.column("i").to_numpy(), got.column("w").to_numpy()
    if not len(index):
        return SparseWeights(-35.0, np.zeros(0, np.int64), np.zeros(0), config.bits)
    return SparseWeights(float(weight[-1]), index[:-1], weight[:-1], config.bits)


def scores(data: np.ndarray, offsets: np.ndarray, dense: np.ndarray, model: SparseWeights) -> np.ndarray:
    docs = len(offsets) - 1
    doc, feature = word_features(data, offsets, model.bits)
    hit = dense[feature] != 0
    keys = np.unique((doc[hit].astype(np.int64) << model.bits) | feature[hit])
    total = np.bincount(keys >> model.bits, weights=dense[keys & ((1 << model.bits) - 1)], minlength=docs)[:docs]
    return 1 / (1 + np.exp(-np.clip(total + model.intercept, -35, 35)))


def score(documents: DataFrame, model: SparseWeights) -> DataFrame:
    """doc_id and score of each text."""
    kind = documents.schema["doc_id"].dataType.simpleString()
    # plain data: an instance could be read only where this package is
    shared = documents.sparkSession.sparkContext.broadcast((model.intercept, model.index, model.weight, model.bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = SparseWeights(*shared.value)
        dense = np.zeros(1 << model.bits, np.float32)
        dense[model.index] = model.weight
        for batch in batches:
            for part in chunks(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(scores(*text_buffer(part.column("text")), dense, model))], ["doc_id", "score"])

    return documents.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, f"doc_id {kind}, score double")
