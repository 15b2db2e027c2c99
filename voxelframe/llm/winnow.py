"""Document fingerprints by winnowing.

Hashes of all k-grams of UTF-8 bytes are taken; of each window of w
consecutive ones the least is kept, the rightmost of equal ones, with its
position.  Texts that share a run of at least k + w - 1 bytes share a
fingerprint entry.  A text of fewer than k bytes has one entry, the hash of
all of it; an empty (or null) text has none.

Equal texts have equal fingerprints.  The likeness of two fingerprints is the
Jaccard similarity of their sets of hashes, 1 if both are empty.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textbatch import chunks, mix64, text_buffer

#: Runs of 27 bytes are surely met; texts of a few words have several entries.
K = 12
WINDOW = 16
_BASE = 0x9E3779B97F4A7C15


@dataclass
class Fingerprints:
    """Entries of several texts: text index, hash (32 bits) and position, in order."""

    doc: np.ndarray
    hash: np.ndarray
    position: np.ndarray
    docs: int

    def hex(self) -> list[str]:
        raw = self.hash.astype(">u4").tobytes().hex()
        at = np.searchsorted(self.doc, np.arange(self.docs + 1)) * 8
        return [raw[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]

    def sets(self, shift: int = 0) -> np.ndarray:
        """Sorted distinct (text, hash) keys, the texts counted from ``shift`` on."""
        keys = np.unique((self.doc.astype(np.int64) << 32) | self.hash.astype(np.int64))
        return keys[keys >= np.int64(shift) << 32] - (np.int64(shift) << 32)


def gram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """Polynomial hash of the k bytes from each byte on, by doubling."""
    total, done, power, span = None, 0, data.astype(np.uint64) + np.uint64(1), 1
    need = k
    while need:
        if need & 1:
            total = power if total is None else total[: len(power) - done] * np.uint64(pow(_BASE, span, 1 << 64)) + power[done:]
            done += span
        need >>= 1
        if need:
            power = power[:-span] * np.uint64(pow(_BASE, span, 1 << 64)) + power[span:] if len(power) > span else power[:0]
            span *= 2
    return mix64(total[: max(0, len(data) - k + 1)])


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    span, least = 1, values
    while span * 2 <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    rest = width - span
    return np.minimum(least[: len(least) - rest], least[rest:]) if rest else least


def fingerprint(data: np.ndarray, offsets: np.ndarray, k: int = K, window: int = WINDOW) -> Fingerprints:
    docs = len(offsets) - 1
    lengths = np.diff(offsets)
    grams = np.maximum(lengths - k + 1, 0)
    parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    if grams.any():
        low = gram_hashes(data, k) >> np.uint64(32)
        at = np.arange(len(low), dtype=np.uint64)
        packed = (low << np.uint64(32)) | (np.uint64(0xFFFFFFFF) - at)  # the rightmost of equal hashes is least
        long = np.flatnonzero(grams >= window)
        if len(long):
            # windows of long texts: those that begin early enough in their text
            least = sliding_min(packed, window)
            step = np.zeros(len(low) + 1, np.int8)
            np.add.at(step, offsets[:-1][long], 1)
            np.add.at(step, offsets[:-1][long] + grams[long] - window + 1, -1)
            picked = least[np.flatnonzero(np.cumsum(step[: len(least)]) > 0)]
            picked = picked[np.append(True, picked[1:] != picked[:-1])]
            parts.append(_unpack(picked, offsets))
        short = np.flatnonzero((grams > 0) & (grams < window))
        if len(short):
            begin = offsets[:-1][short]
            bounds = np.stack([begin, begin + grams[short]], axis=1).ravel()
            if bounds[-1] >= len(packed):
                bounds = bounds[:-1]
            parts.append(_unpack(np.minimum.reduceat(packed, bounds)[::2], offsets))
    tiny = np.flatnonzero((lengths > 0) & (lengths < k))
    if len(tiny):
        hashes = [int.from_bytes(hashlib.blake2b(data[offsets[d] : offsets[d + 1]].tobytes(), digest_size=4).digest(), "big") for d in tiny.tolist()]
        parts.append((tiny, np.array(hashes, np.uint64), np.zeros(len(tiny), np.int64)))
    if not parts:
        return Fingerprints(np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), docs)
    doc, hashes, position = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((position, doc))
    return Fingerprints(doc[order], hashes[order], position[order], docs)


def _unpack(packed: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    at = (np.uint64(0xFFFFFFFF) - (packed & np.uint64(0xFFFFFFFF))).astype(np.int64)
    doc = np.searchsorted(offsets, at, side="right") - 1
    return doc, packed >> np.uint64(32), at - offsets[doc]


def likeness(a: np.ndarray, b: np.ndarray, docs: int) -> np.ndarray:
    """Jaccard similarity for each text of two sets of (text, hash) keys."""
    count = lambda keys: np.bincount(keys >> 32, minlength=docs)[:docs]
    both = count(np.intersect1d(a, b, assume_unique=True))
    either = count(a) + count(b) - both
    return np.where(either > 0, both / np.maximum(either, 1), 1.0)


def fingerprints(documents: DataFrame, k: int = K, window: int = WINDOW) -> DataFrame:
    """doc_id, hashes and positions of each text: the operator's plain form."""
    kind = documents.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                got = fingerprint(*text_buffer(part.column("text")), k, window)
                at = pa.array(np.searchsorted(got.doc, np.arange(got.docs + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(at, pa.array(x.astype(np.int64))) for x in (got.hash, got.position)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *lists], ["doc_id", "hashes", "positions"])

    return documents.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, f"doc_id {kind}, hashes array<long>, positions array<long>")


def _bounds_below(value: Column, bounds: list[int]) -> Column:
    """How many of the sorted bounds are below a value: first among every block's last, then in the block."""
    if not bounds:
        return F.lit(0)
    block = math.isqrt(len(bounds)) + 1
    everyone, lasts = F.array(*[F.lit(b) for b in bounds]), bounds[block - 1 :: block]
    whole = F.size(F.filter(F.array(*[F.lit(b) for b in lasts]), lambda b: b < value)) if lasts else F.lit(0)
    rest = F.slice(everyone, whole * block + 1, block)
    return whole * block + F.size(F.filter(rest, lambda b: b < value))


def in_order_with_next(documents: DataFrame, pieces: int | None = None) -> DataFrame:
    """Rows in pieces by descending doc_id, each followed by the row after it.

    Columns: piece, guest, doc_id, text (binary).  Split points are
    approximate percentiles of the ids, so a row's piece depends on its id
    alone.  The first row of each piece is also sent, as guest, to the end of
    the piece before it (the very first to the last), so that no task needs
    another piece.  Null ids come last; rows of one id go by a hash of the
    text.  Only the split points and one id for each piece reach the driver.
    """
    spark = documents.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    pieces = pieces or 4 * tasks
    rows = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    shares = F.array(*[F.lit(i / pieces) for i in range(1, pieces)])
    found = rows.agg(F.percentile_approx("doc_id", shares, 10_000).alias("p")).first()["p"] if pieces > 1 else None
    bounds = sorted(set(found or []))
    below = _bounds_below(F.col("doc_id"), bounds)
    rows = rows.withColumn("piece", F.when(F.col("doc_id").isNull(), F.lit(len(bounds) + 1)).otherwise(F.lit(len(bounds)) - below).cast("int"))
    rows = rows.withColumn("_hash", F.xxhash64("text"))
    key = F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "_hash")
    firsts = sorted((r["piece"], r["f"]["doc_id"], r["f"]["_hash"]) for r in rows.groupBy("piece").agg(F.max(key).alias("f")).collect())
    if firsts:
        before = [f[0] for f in firsts[-1:] + firsts[:-1]]
        kind = documents.schema["doc_id"].dataType.simpleString()
        guests = spark.createDataFrame([(i, h, p) for (_, i, h), p in zip(firsts, before, strict=True)], f"_id {kind}, _h long, _to int")
        joined = rows.join(F.broadcast(guests), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("_h")), "left")
        place = lambda piece, guest: F.struct(F.col(piece).alias("piece"), F.lit(guest).alias("guest"))
        to = F.when(F.col("_to").isNull(), F.array(place("piece", 0))).otherwise(F.array(place("piece", 0), place("_to", 1)))
        rows = joined.select(F.explode(to).alias("_at"), "doc_id", "text", "_hash").select("_at.piece", "_at.guest", "doc_id", "text", "_hash")
    else:
        rows = rows.withColumn("guest", F.lit(0))
    rows = rows.select("piece", "guest", "doc_id", F.col("text").cast("binary").alias("text"), "_hash")
    rows = rows.repartition(tasks, "piece").sortWithinPartitions("piece", "guest", F.col("doc_id").desc_nulls_last(), F.col("_hash").desc())
    return rows.drop("_hash")


def edited(text: str, following: str) -> str:
    """The last third of the code points replaced by the first as many of the next text."""
    cut = len(text) // 3
    return text[: len(text) - cut] + following[:cut]


def _rows(part: pa.RecordBatch, k: int, window: int) -> pa.RecordBatch | None:
    """Results of all rows but the last, which only serves as the next of the one before it."""
    mine = np.flatnonzero(part.column("guest").to_numpy()[:-1] == 0)
    if not len(mine):
        return None
    texts = [t.decode() for t in part.column("text").to_pylist()]
    changed = [edited(t, n).encode() for t, n in zip(texts, texts[1:], strict=False)]
    docs = len(changed)
    data, offsets = text_buffer(part.column("text"))
    own = fingerprint(data, offsets, k, window)
    other = fingerprint(*text_buffer(pa.array(changed, pa.binary())), k, window)
    mine_set = own.sets()
    near_edited = likeness(mine_set[mine_set < np.int64(docs) << 32], other.sets(), docs)
    near_next = likeness(mine_set[mine_set < np.int64(docs) << 32], own.sets(1), docs)
    own_hex, other_hex = own.hex(), other.hex()
    at = pa.array(np.searchsorted(own.doc, np.arange(docs + 1)).astype(np.int32))
    positions = pa.ListArray.from_arrays(at, pa.array(own.position.astype(np.int32)))
    columns = [
        part.column("doc_id").slice(0, docs), pa.array([len(t) for t in texts[:-1]], pa.int64()),
        pa.array([hashlib.sha256(c).hexdigest() for c in changed]), pa.array(own_hex[:-1]), pa.array(other_hex),
        pa.array(near_edited), pa.array(near_next), positions,
    ]
    out = pa.RecordBatch.from_arrays(columns, ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "positions"])
    return out if len(mine) == docs else out.take(pa.array(mine))


def compared(documents: DataFrame, k: int = K, window: int = WINDOW) -> DataFrame:
    """Fingerprints of each text and of its edited text, and how alike they are.

    ``positions`` has the byte at which each entry of ``fingerprint`` (eight
    hex digits) begins, so that an entry two texts share shows where they match.
    """
    kind = documents.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None
        for batch in batches:
            for part in chunks(batch, "text"):
                if held is not None:
                    part = pa.Table.from_batches([held, part]).combine_chunks().to_batches()[0]
                if part.num_rows > 1 and (out := _rows(part, k, window)) is not None:
                    yield out
                held = part.slice(part.num_rows - 1)

    return in_order_with_next(documents).mapInArrow(run, f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, positions array<int>")
