"""Words and their hashes against plain Python."""

import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from voxelframe.llm import textbatch
from voxelframe.llm.textbatch import Words, batch_words, chunks

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab é \n\t\x0b\x1c中", max_size=30)), max_size=6))
def test_words_are_the_runs_of_the_pattern(texts):
    got = batch_words(pa.array(texts, pa.string()))
    want = [WORD.findall(t or "") for t in texts]
    assert got.per_doc.tolist() == [len(w) for w in want]
    flat = [w for ws in want for w in ws]
    assert [got.data[a:b].tobytes().decode() for a, b in zip(got.starts, got.ends, strict=True)] == flat
    seen = {}
    for word, h in zip(flat, got.hash.tolist(), strict=True):
        assert seen.setdefault(word, h) == h
    assert len(set(seen.values())) == len(seen)


def test_hash_does_not_depend_on_place_or_segment(monkeypatch):
    text = " ".join(f"w{i % 37}" for i in range(3000)) + " " + "x" * 700
    whole = Words(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)]))
    first = whole.hash.copy()
    monkeypatch.setattr(textbatch, "_SEGMENT", 64)
    again = Words(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)]))
    assert (again.hash == first).all()


def test_chunks_hold_whole_rows():
    batch = pa.RecordBatch.from_arrays([pa.array([b"a" * 10, None, b"b" * 50, b"", b"c" * 5], pa.binary())], ["text"])
    parts = list(chunks(batch, "text", 20))
    assert [p.num_rows for p in parts] == [2, 1, 2]
    assert sum((p.column("text").to_pylist() for p in parts), []) == batch.column("text").to_pylist()


def test_shingles_stay_within_a_text():
    got = batch_words(pa.array(["a b c", "a b", "a b c"]))
    keys, same = got.shingles(3)
    assert same.tolist() == [True, False, False, False, False, True]
    assert keys[0] == keys[5]
