import random
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from conftest import documents, prose

from voxelframe.llm import neardup
from voxelframe.llm.components import connected_components
from voxelframe.llm.textbatch import text_buffer


def bag(text, k=5):
    words = text.lower().split()
    return Counter(tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))) if words else Counter()


def likeness(a, b):
    if not a or not b:
        return 0.0
    plain = len(a.keys() & b.keys()) / len(a.keys() | b.keys())
    return max(plain, sum(1 / sum(max(a[e] / a[d], b[e] / b[d]) for e in a | b) for d in a.keys() & b.keys()))


def changed(text, seed, every):
    words, rng = text.split(), random.Random(seed)
    for i in rng.sample(range(len(words)), max(1, len(words) // every)):
        words[i] = f"new{seed}x{i}"
    return " ".join(words)


def test_similarity_against_the_formula():
    rng = random.Random(1)
    for _ in range(200):
        a, b = (Counter(rng.choices(range(12), k=rng.randint(1, 20))) for _ in range(2))
        pack = lambda c: (np.array(sorted(c), np.uint32), np.array([c[k] for k in sorted(c)], np.uint32))
        assert neardup.similarity(*pack(a), *pack(b)) == pytest.approx(likeness(a, b))


def test_registers_estimate_probability_jaccard():
    rng = random.Random(2)
    words = [f"w{i}" for i in range(400)]
    x = " ".join(rng.choice(words) for _ in range(300))
    y = changed(x, 4, 60) + " " + " ".join(x.split()[:40]) * 2
    doc, shingle, count = neardup.weighted_shingles(*text_buffer(pa.array([x, y])), 5)
    signature = neardup.prob_minhash(doc, shingle, count.astype(float), 2, 1024)
    a, b = bag(x), bag(y)
    want = sum(1 / sum(max(a[e] / a[d], b[e] / b[d]) for e in a | b) for d in a.keys() & b.keys())
    assert abs((signature[0] == signature[1]).mean() - want) < 4 * (want * (1 - want) / 1024) ** 0.5


def test_early_end_changes_nothing():
    """All arrivals up to a late time give the same winners."""
    doc, shingle, count = neardup.weighted_shingles(*text_buffer(pa.array([prose(3, 30), "a b c", ""])), 5)
    got = neardup.prob_minhash(doc, shingle, count.astype(float), 3, 16)
    best = {}
    for d, s, w in zip(doc.tolist(), shingle.tolist(), count.tolist(), strict=True):
        t = 0.0
        for step in range(2000):
            draw = neardup.mix64(np.array([s], np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((step * 0xD1B54A32D192ED03 + 1) & (2**64 - 1)))
            t -= np.log(((int(draw[0]) >> 12) + 0.5) / float(1 << 52)) / w
            aim = d, (int(neardup.mix64(draw)[0]) >> 33) % 16
            best[aim] = min(best.get(aim, (1e300, 0)), (t, s + 1))
    want = np.zeros((3, 16), np.uint64)
    for (d, k), (_, s) in best.items():
        want[d, k] = s
    assert (got == want).all() and not got[2].any()


def test_classes_against_brute_force(spark):
    texts = [prose(i, 60 + i) for i in range(40)]
    texts += [changed(texts[i % 10], i, 60) for i in range(40)] + texts[:5] + [texts[0]] * 20
    texts += [("spam " * 30).strip(), ("spam " * 60).strip(), "two words", "TWO words", "other words"]
    docs = documents(spark, [(i, t, None, None) for i, t in enumerate(texts)])
    got = {r["doc_id"]: r for r in neardup.classes(docs).collect()}
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    bags = [bag(t) for t in texts]
    for a, b in combinations(range(len(texts)), 2):
        if texts[a] == texts[b] or likeness(bags[a], bags[b]) >= 0.8:
            parent[max(find(a), find(b))] = min(find(a), find(b))
    assert {i: r["class_id"] for i, r in got.items()} == {i: find(i) for i in range(len(texts))}
    sizes = Counter(find(i) for i in range(len(texts)))
    assert all(r["class_size"] == sizes[r["class_id"]] and r["kept"] == (i == r["class_id"]) for i, r in got.items())
    left = neardup.keep_one_of_each(docs)
    assert sorted(r["doc_id"] for r in left.collect()) == sorted(sizes)


def test_a_crowd_of_near_copies(spark):
    """Many variants of one text, more than a bucket compares in full."""
    base = prose(9, 200)
    texts = [changed(base, i, 150) for i in range(80)] + [prose(100 + i, 150) for i in range(20)]
    got = neardup.classes(documents(spark, [(i, t, None, None) for i, t in enumerate(texts)])).collect()
    assert {r["class_id"] for r in got if r["doc_id"] < 80} == {0}
    assert all(r["class_id"] == r["doc_id"] for r in got if r["doc_id"] >= 80)


def test_similar_texts_that_meet_only_in_crowds(spark):
    """A loose crowd with close pairs and weighted copies in it: any two texts with an equal band and 0.8 are of one class."""
    base = prose(9, 120)
    texts = [changed(base, i, 40) for i in range(80)]
    texts += [changed(texts[3 * i], 1000 + i, 120) for i in range(25)] + [texts[3 * i + 1] + " " + texts[3 * i + 1] for i in range(10)]
    config = neardup.NearDupConfig(registers=4, crowd=4, block=8)
    docs = documents(spark, [(i, t, None, None) for i, t in enumerate(texts)])
    doc, shingle, count = neardup.weighted_shingles(*text_buffer(pa.array(texts)), config.words)
    keys = neardup.band_keys(neardup.prob_minhash(doc, shingle, count.astype(float), len(texts), config.registers), config.band)
    label, bags = list(range(len(texts))), [bag(t) for t in texts]
    for a, b in combinations(range(len(texts)), 2):
        if (keys[a] == keys[b]).any() and label[a] != label[b] and likeness(bags[a], bags[b]) >= 0.8:
            low, high = sorted((label[a], label[b]))
            label = [low if x == high else x for x in label]
    assert {r["doc_id"]: r["class_id"] for r in neardup.classes(docs, config).collect()} == dict(enumerate(label))


def test_components(spark):
    links = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (101, 100), (200, 200)] + [(300, 300 + i) for i in range(1, 30)]
    got = {r["node"]: r["label"] for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got[i] == 1 for i in range(1, 41)) and got[101] == 100 and got[200] == 200 and got[329] == 300
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_edges(spark, edge, edge_rows, none_at_all):
    got = neardup.classes(edge).collect()
    assert len(got) == len(edge_rows)
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
    assert by[1][0]["class_id"] == 1 and sorted(r["class_id"] for r in by[2]) == [1, 2]
    assert by[3][0]["class_id"] == by[4][0]["class_id"] == 3  # empty texts are copies
    assert {r["class_id"] for r in by[None]} == {None, 3}
    left = neardup.keep_one_of_each(edge)
    assert left.columns == edge.columns
    assert Counter(r["doc_id"] for r in left.collect())[9] == 1
    assert neardup.classes(none_at_all).count() == 0 and neardup.keep_one_of_each(none_at_all).count() == 0


def test_the_row_that_stays_is_the_same_each_time(spark):
    rows = [(1, prose(1, 60), {"n": i}) for i in range(12)] + [(2, prose(1, 60) + " end", {"n": 9})]
    docs = spark.createDataFrame(rows, "doc_id long, text string, facts map<string,int>")
    kept = [neardup.keep_one_of_each(docs.repartition(n)).collect() for n in (1, 5, 9)]
    assert all(len(k) == 1 and k[0]["doc_id"] == 1 for k in kept)
    assert len({str(k[0]["facts"]) for k in kept}) == 1
