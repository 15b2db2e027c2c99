import hashlib

import numpy as np
import pyarrow as pa
import pytest
from conftest import documents, prose
from hypothesis import given, settings
from hypothesis import strategies as st

from voxelframe.llm import winnow
from voxelframe.llm.textbatch import text_buffer


def brute(text, k, window):
    """(hash, position) picked window by window, the rightmost least of each."""
    data = np.frombuffer(text.encode(), np.uint8)
    if len(data) < k:
        return None
    hashes = (winnow.gram_hashes(data, k) >> np.uint64(32)).tolist()
    picked = []
    for i in range(max(1, len(hashes) - window + 1)):
        part = hashes[i : i + window]
        at = i + max(j for j, h in enumerate(part) if h == min(part))
        if not picked or picked[-1][1] != at:
            picked.append((hashes[at], at))
    return picked


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(alphabet="ab é", max_size=60), min_size=1, max_size=5), st.integers(1, 6), st.integers(1, 9))
def test_picks_against_brute_force(texts, k, window):
    got = winnow.fingerprint(*text_buffer(pa.array(texts)), k, window)
    for d, text in enumerate(texts):
        mine = list(zip(got.hash[got.doc == d].tolist(), got.position[got.doc == d].tolist(), strict=True))
        want = brute(text, k, window)
        if want is None:
            assert len(mine) == (1 if text else 0)
        else:
            assert mine == want


@pytest.mark.parametrize("k", [1, 2, 3, 7, 24, 31])
def test_gram_hash_depends_on_its_bytes_alone(k):
    data = np.frombuffer((b"xyz" * 30 + b"q" + b"xyz" * 30), np.uint8)
    got = winnow.gram_hashes(data, k)
    assert len(got) == len(data) - k + 1
    seen = {}
    for i, h in enumerate(got.tolist()):
        assert seen.setdefault(data[i : i + k].tobytes(), h) == h
    assert len(set(seen.values())) == len(seen)


def test_shared_run_is_guaranteed_an_entry():
    shared = prose(1, 60)[: winnow.K + winnow.WINDOW - 1]
    for seed in range(20):
        got = winnow.fingerprint(*text_buffer(pa.array([prose(seed + 10, 40) + shared + prose(seed + 50, 30), prose(seed + 90, 55) + shared])))
        assert set(got.hash[got.doc == 0].tolist()) & set(got.hash[got.doc == 1].tolist())


def test_query_against_brute_force(spark, edge, edge_rows, none_at_all):
    rows = [(i, prose(i % 40, 20 + i), "en", "a") for i in range(120)] + [(500 + i, t, "x", "y") for i, t in enumerate(["", None, "é", "ab", "x" * 5000])]
    docs = documents(spark, rows)
    ordered = sorted(((i, t or "") for i, t, _, _ in rows), reverse=True)
    got = {r["doc_id"]: r for r in winnow.compared(docs).collect()}
    assert len(got) == len(rows)
    finger = lambda t: winnow.fingerprint(*text_buffer(pa.array([t]))).hex()[0]
    sets = lambda h: {h[i : i + 8] for i in range(0, len(h), 8)}
    near = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    for n, (i, text) in enumerate(ordered):
        following = ordered[(n + 1) % len(ordered)][1]
        cut = len(text) // 3
        changed = text[: len(text) - cut] + following[:cut]
        r = got[i]
        assert r["n_chars"] == len(text)
        assert r["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest()
        assert r["fingerprint"] == finger(text) and r["edited_fingerprint"] == finger(changed)
        assert r["near_edited"] == pytest.approx(near(sets(finger(text)), sets(finger(changed))))
        assert r["near_next"] == pytest.approx(near(sets(finger(text)), sets(finger(following))))


def test_edges(spark, edge, edge_rows, none_at_all):
    got = winnow.compared(edge).collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(r[0]) for r in edge_rows)
    by = {}
    for r in got:
        by.setdefault(r["n_chars"], set()).add(r["fingerprint"])
    assert by[0] == {""}
    assert winnow.compared(none_at_all).count() == 0
    one = documents(spark, [(1, "abc" * 30, None, None)])
    r = winnow.compared(one).first()
    assert r["near_next"] == 1.0  # the only document is next to itself
    plain = winnow.fingerprints(edge).collect()
    assert len(plain) == len(edge_rows)


def test_bounds_below(spark):
    from pyspark.sql import functions as F

    for bounds in ([], [5], [1, 2, 3, 10, 20, 30, 31], list(range(0, 100, 3))):
        rows = spark.range(-2, 105).select("id", winnow._bounds_below(F.col("id"), bounds).alias("n")).collect()
        assert all(r["n"] == sum(b < r["id"] for b in bounds) for r in rows)
