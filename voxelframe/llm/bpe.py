"""Byte-level BPE by merge replay over the distinct pieces of a batch.

Texts are cut into pieces by a pattern.  The distinct pieces that are not yet
known are laid out as one row of tokens, and an inverted index from mergeable
pair (by the rank of what it makes) to positions is built over them.  Merges
are then applied in rank order, all positions of a rank in one go, and only
the two pairs that touch a new token are looked up again.  A merge can make a
pair of a lower rank than its own (tables made by other trainers do); that
pair is then applied first, before the rest of the current rank.

Defined results: a null text is empty and has no tokens; a row is encoded
alone, so repeated rows get equal results; a piece that is a token itself is
one id.  Extra columns are not read.  Memory is bounded by one batch of texts,
twice ``CACHE`` pieces and the longest text.

A worker process keeps its tables and the pieces it met for all its tasks.
Pieces are not first made distinct over the whole corpus: to look them up there
would take a second pass of the pattern over all texts, which costs about as
much as the merges (see the README's figures).
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .textbatch import chunks

CACHE = 200_000
#: Text whose distinct pieces are merged together: each rank is one step, so more is cheaper.
PIECE_BYTES = 3 << 20


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class MergeReplay:
    """Encodes many pieces together."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.token = {rank: token for token, rank in ranks.items()}
        self.single = np.array([ranks.get(bytes([b]), -1) for b in range(256)], np.int64)
        self.made_by_bytes = np.array([[ranks.get(bytes([a, b]), -1) for b in range(256)] for a in range(256)], np.int64)
        self.made: dict[int, int] = {}
        # every way to make a token of two: sorted keys for lookups of many pairs
        ways = [(ranks[t[:i]] << 32 | ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        ways.sort()
        self.keys = np.array([k for k, _ in ways] + [1 << 62], np.int64)
        self.values = np.array([r for _, r in ways] + [-1], np.int64)

    def pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the token that each pair makes, or -1."""
        key = left.astype(np.int64) << 32 | right
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.values[at], -1)

    def pair(self, left: int, right: int) -> int:
        """Rank of the token that two tokens make, or -1."""
        key = left << 32 | right
        rank = self.made.get(key)
        if rank is None:
            rank = self.made[key] = self.ranks.get(self.token[left] + self.token[right], -1)
        return rank

    def encode(self, pieces: list[bytes]) -> list[list[int]]:
        if len(self.made) > 2_000_000:
            self.made.clear()
        whole = [self.ranks.get(p) for p in pieces]
        rest = [p for p, rank in zip(pieces, whole, strict=True) if rank is None]
        done = iter(self._replay(rest))
        return [next(done) if rank is None else [rank] for rank in whole]

    def _replay(self, pieces: list[bytes]) -> list[list[int]]:
        if not pieces:
            return []
        lengths = np.array([len(p) for p in pieces], np.int64)
        ends = np.cumsum(lengths + 1)  # one more place ends each piece
        begin, size = ends - lengths - 1, int(ends[-1])
        piece = np.repeat(np.arange(len(pieces), dtype=np.int32), lengths + 1)
        flat = np.frombuffer(b"\0".join(pieces) + b"\0", np.uint8)
        token = self.single[flat]
        token[ends - 1] = -1
        after, before = np.arange(1, size + 1), np.arange(-1, size - 1)
        ranks = np.where((token[:-1] >= 0) & (token[1:] >= 0), self.made_by_bytes[flat[:-1], flat[1:]], -1)
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def add(rank: np.ndarray, at: np.ndarray) -> None:
            """Puts places under the ranks of the pairs that begin there."""
            keep = rank >= 0
            rank, at = rank[keep], at[keep]
            order = np.argsort(rank, kind="stable")
            rank, at = rank[order], at[order]
            first = np.flatnonzero(np.append(True, rank[1:] != rank[:-1])) if len(rank) else rank
            for r, places in zip(rank[first].tolist(), np.split(at, first[1:]), strict=False):
                if r in index:
                    index[r].append(places)
                else:
                    index[r] = [places]
                    heapq.heappush(heap, r)

        add(ranks, np.arange(size - 1))
        while heap:
            rank = heapq.heappop(heap)
            at = np.unique(np.concatenate(index.pop(rank)))
            nxt = after[at]
            left, right = token[at], token[np.minimum(nxt, size - 1)]
            good = (left >= 0) & (right >= 0)
            good[good] = self.pairs(left[good], right[good]) == rank  # else a neighbour has changed since
            at, nxt = at[good], nxt[good]
            if not len(at):
                continue
            end, back = after[nxt], before[at]
            # a piece where the rank meets itself, or opens a lower one, is done place by place
            touching = (nxt[:-1] == at[1:]) | (end[:-1] == at[1:])
            careful = np.zeros(len(at), bool)
            careful[:-1] |= touching
            careful[1:] |= touching
            made = np.full(len(at), rank)
            with_right = np.where(token[end] >= 0, self.pairs(made, token[end]), -1)
            has_left = back >= 0
            has_left[has_left] = token[back[has_left]] >= 0
            with_left = np.full(len(at), -1)
            with_left[has_left] = self.pairs(token[back[has_left]], made[has_left])
            careful |= ((with_right >= 0) & (with_right < rank)) | ((with_left >= 0) & (with_left < rank))
            if careful.any():
                slow = np.isin(piece[at], piece[at[careful]])
                add(*self._one_by_one(rank, at[slow].tolist(), token, after, before))
                fast = ~slow
                at, nxt, end, back, with_right, with_left = at[fast], nxt[fast], end[fast], back[fast], with_right[fast], with_left[fast]
            token[at], token[nxt] = rank, -2
            after[at], before[end] = end, at
            add(np.concatenate([with_right, with_left]), np.concatenate([at, back]))
        live = np.flatnonzero(token >= 0)
        bounds = np.searchsorted(live, np.append(begin, size)).tolist()
        ids = token[live].tolist()
        return [ids[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]

    def _one_by_one(self, rank: int, places: list[int], token: np.ndarray, after: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merges from left to right; new (rank, place) pairs.  A lower rank puts the rest off."""
        found: list[tuple[int, int]] = []
        for k, at in enumerate(places):
            left, nxt = int(token[at]), int(after[at])
            right = int(token[nxt])
            if left < 0 or right < 0 or self.pair(left, right) != rank:
                continue
            end, back = int(after[nxt]), int(before[at])
            token[at], token[nxt], after[at], before[end] = rank, -2, end, at
            new = []
            if token[end] >= 0:
                new.append((self.pair(rank, int(token[end])), at))
            if back >= 0 and token[back] >= 0:
                new.append((self.pair(int(token[back]), rank), back))
            found += new
            if any(0 <= r < rank for r, _ in new):
                found += [(rank, p) for p in places[k + 1 :]]
                break
        pairs = np.array(found, np.int64).reshape(-1, 2)
        return pairs[:, 0], pairs[:, 1]

    def decode(self, ids: list[int]) -> bytes:
        token = self.token
        return b"".join([token[i] for i in ids])


class Encoder:
    """Texts to ids, with the pieces met so far."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.replay = MergeReplay(ranks)
        self.find = regex.compile(pattern).findall
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def encode_batch(self, texts: list[str | None]) -> Iterator[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        found = [self.find(text) if text else [] for text in texts]
        new: set[str] = set()
        for pieces in found:
            new.update(pieces)
        if len(self.known) > CACHE:
            self.older, self.known = self.known, {}  # pieces met since then move on, the rest goes at the next turn
        known, older = self.known, self.older
        fresh = []
        for piece in new:
            if piece not in known:
                if (ids := older.get(piece)) is not None:
                    known[piece] = ids
                else:
                    fresh.append(piece)
        for piece, ids in zip(fresh, self.replay.encode([p.encode() for p in fresh]), strict=True):
            known[piece] = np.array(ids, "<u4").tobytes()
        for pieces in found:
            yield b"".join([known[p] for p in pieces])

    def decode(self, ids: bytes) -> bytes:
        return self.replay.decode(np.frombuffer(ids, "<u4").tolist())


def _encoder(shared: dict, pattern: str) -> Encoder:
    """Of this worker process: a broadcast value lives as long as the process does."""
    if pattern not in shared["encoders"]:
        shared["encoders"][pattern] = Encoder(shared["ranks"], pattern)
    return shared["encoders"][pattern]


def _by_batch(shared, pattern: str, finish: Callable[[Encoder, bytes], tuple], names: list[str], types: list[pa.DataType], keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared.value, pattern)
        for batch in batches:
            for part in chunks(batch, "text", PIECE_BYTES):
                rows = [finish(encoder, ids) for ids in encoder.encode_batch(part.column("text").to_pylist())]
                columns = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in keep], *[pa.array(c, t) for c, t in zip(columns, types, strict=True)]], [*keep, *names])

    return run


def _digests(encoder: Encoder, ids: bytes) -> tuple[int, str, str]:
    return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(encoder.decode(ids)).hexdigest()


def token_digests(documents: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each whole text."""
    shared = documents.sparkSession.sparkContext.broadcast({"ranks": ranks, "encoders": {}})
    run = _by_batch(shared, pattern, _digests, ["n_tokens", "ids_sha256", "decoded_sha256"], [pa.int64(), pa.string(), pa.string()], ["doc_id"])
    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode(documents: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """doc_id and the ids of each text: what a trainer reads."""
    shared = documents.sparkSession.sparkContext.broadcast({"ranks": ranks, "encoders": {}})
    run = _by_batch(shared, pattern, lambda _, ids: (np.frombuffer(ids, "<u4").astype(np.int32),), ["ids"], [pa.list_(pa.int32())], ["doc_id"])
    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode(encoded: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """doc_id and the text of each row of ids."""
    shared = encoded.sparkSession.sparkContext.broadcast({rank: token for token, rank in ranks.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = shared.value
        for batch in batches:
            texts = [b"".join([token[i] for i in ids or ()]).decode(errors="replace") for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, text string")


def public_vocabulary(name: str = "byte_bpe_50k.tiktoken") -> tuple[dict[bytes, int], str]:
    """Ranks and pattern of an installed public vocabulary."""
    import public_tokenizers

    return read_ranks(public_tokenizers.path(name)), public_tokenizers.PATTERN
