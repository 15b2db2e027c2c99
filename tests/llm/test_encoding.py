import hashlib
import random

import numpy as np
import pytest
import tiktoken
from conftest import documents
from hypothesis import given, settings
from hypothesis import strategies as st

from voxelframe.llm import bpe

RANKS, PATTERN = bpe.public_vocabulary()
ORACLE = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=RANKS, special_tokens={})


def ids(texts):
    return [np.frombuffer(b, "<u4").tolist() for b in bpe.Encoder(RANKS, PATTERN).encode_batch(texts)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=5))
def test_same_ids_as_the_library(texts):
    assert ids(texts) == [ORACLE.encode_ordinary(t) for t in texts]


def test_hard_pieces():
    rng = random.Random(3)
    texts = ["a" * 5000, "ab" * 2000, "the" * 999, "é" * 300, " " * 500, "\n" * 77, "!" * 400, "<|endoftext|>"]
    texts += ["".join(rng.choice("aeiounrstlTHE'  \n1é中😀") for _ in range(80)) for _ in range(300)]
    assert ids(texts) == [ORACLE.encode_ordinary(t) for t in texts]


def naive(piece, ranks):
    """Lowest rank first, leftmost first, one merge at a time."""
    if piece in ranks:
        return [ranks[piece]]
    parts = [bytes([b]) for b in piece]
    while len(parts) > 1:
        found = [(ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False))]
        rank, i = min(found)
        if rank == 1 << 60:
            break
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return [ranks[p] for p in parts]


def test_merges_that_make_a_pair_of_a_lower_rank():
    """Such tables exist; a lower rank must be applied before the rest of the current one."""
    rng = random.Random(5)
    for trial in range(60):
        letters = [bytes([c]) for c in b"abc"]
        tokens = set(letters)
        while len(tokens) < 25:
            tokens.add(rng.choice(sorted(tokens)) + rng.choice(sorted(tokens)))
        rest = sorted(tokens - set(letters))
        rng.shuffle(rest)
        ranks = {t: i for i, t in enumerate(letters + rest)}
        pieces = [bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 14))) for _ in range(40)]
        assert bpe.MergeReplay(ranks).encode(pieces) == [naive(p, ranks) for p in pieces], trial


def test_query_digests_and_round_trip(spark, edge, edge_rows, none_at_all):
    got = bpe.token_digests(edge, RANKS, PATTERN).collect()
    assert len(got) == len(edge_rows)
    want = sorted((str(i), len(e), hashlib.sha256(np.array(e, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for i, t, _, _ in edge_rows for e in [ORACLE.encode_ordinary(t or "")])
    assert sorted((str(r["doc_id"]), *r[1:]) for r in got) == want
    back = bpe.decode(bpe.encode(edge, RANKS, PATTERN), RANKS).collect()
    assert sorted((str(r["doc_id"]), r["text"]) for r in back) == sorted((str(i), t or "") for i, t, _, _ in edge_rows)
    assert bpe.token_digests(none_at_all, RANKS, PATTERN).count() == 0


def test_small_cache_gives_the_same(spark, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE", 3)
    texts = [f"word{i} and more {i}" for i in range(50)]
    encoder = bpe.Encoder(RANKS, PATTERN)
    got = [np.frombuffer(b, "<u4").tolist() for t in texts for b in encoder.encode_batch([t])]
    assert got == [ORACLE.encode_ordinary(t) for t in texts]


@pytest.mark.parametrize("text", ["", None])
def test_no_text_has_no_tokens(spark, text):
    r = bpe.token_digests(documents(spark, [(1, text, None, None)]), RANKS, PATTERN).first()
    assert r["n_tokens"] == 0 and r["ids_sha256"] == r["decoded_sha256"] == hashlib.sha256(b"").hexdigest()
