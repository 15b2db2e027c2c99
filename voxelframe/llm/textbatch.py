"""Vectorised views of a batch of texts: bytes, words and word hashes.

Words are maximal runs of bytes outside \\x20 and \\x09-\\x0D, which are the
same runs as those of ``[^\\x20\\x09-\\x0D]+`` over code points, because UTF-8
never uses ASCII bytes inside a longer character.

A word is identified by a mixed 64-bit polynomial hash.  Two different words
of a corpus with n distinct words share one with probability of about
n*n / 2**65.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20
_SEGMENT = 1 << 19
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective mixer of 64-bit integers (xor-shift-multiply)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and n+1 offsets into them; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = pc.fill_null(column, b"")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(batch: pa.RecordBatch, column: str, most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of whole rows with about ``most`` bytes of text; a longer text comes alone."""
    if batch.num_rows == 0:
        return
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(lengths.astype(np.int64))
    start = 0
    while start < len(ends):
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + most, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


class Words:
    """Words of a batch of texts.

    starts, ends: byte positions; doc: index of the text; hash: 64 bits of
    each word; per_doc: number of words of each text.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False):
        n = len(data)
        self.n_docs = len(offsets) - 1
        if lower:
            table = np.arange(256, dtype=np.uint8)
            table[65:91] += 32
            data = table[data]
        self.data = data
        inside = (data != 32) & ((data < 9) | (data > 13))
        first, last = inside.copy(), inside.copy()
        if n:
            first[1:] &= ~inside[:-1]
            last[:-1] &= ~inside[1:]
            edge = offsets[:-1][offsets[:-1] < n]
            first[edge] = inside[edge]
            edge = offsets[1:][offsets[1:] > 0] - 1
            last[edge] = inside[edge]
        self.starts, self.ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.doc = np.searchsorted(offsets, self.starts, side="right") - 1
        self.per_doc = np.bincount(self.doc, minlength=self.n_docs).astype(np.int64)
        self.first_word = np.concatenate([[0], np.cumsum(self.per_doc)])
        self._hash: np.ndarray | None = None

    @property
    def hash(self) -> np.ndarray:
        if self._hash is None:
            self._hash = self._hashes()
        return self._hash

    def _hashes(self) -> np.ndarray:
        """Segments of whole words keep the tables of powers small."""
        out = np.empty(len(self.starts), np.uint64)
        at = 0
        powers = inverse = np.ones(0, np.uint64)
        while at < len(out):
            low = self.starts[at]
            stop = max(at + 1, int(np.searchsorted(self.ends, low + _SEGMENT, side="right")))
            size = int(self.ends[stop - 1] - low)
            if len(powers) < size:
                powers = np.full(size, _BASE, np.uint64)
                inverse = np.full(size, _BASE_INVERSE, np.uint64)
                powers[0] = inverse[0] = 1
                powers, inverse = np.multiply.accumulate(powers), np.multiply.accumulate(inverse)
            sums = np.zeros(size + 1, np.uint64)
            np.cumsum((self.data[low : low + size].astype(np.uint64) + np.uint64(1)) * powers[:size], out=sums[1:])
            s, e = self.starts[at:stop] - low, self.ends[at:stop] - low
            out[at:stop] = (sums[e] - sums[s]) * inverse[s]
            at = stop
        return mix64(out)

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the k words from each word on, and whether all k are of one text."""
        n = len(self.doc) - k + 1
        if n <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, bool)
        h, total = self.hash, np.zeros(n, np.uint64)
        for j in range(k):
            total = total * np.uint64(_BASE) + h[j : n + j]
        return mix64(total), self.doc[:n] == self.doc[k - 1 :]


def batch_words(column: pa.Array, lower: bool = False) -> Words:
    return Words(*text_buffer(column), lower=lower)

