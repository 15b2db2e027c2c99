import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from conftest import documents, prose

from voxelframe.llm import toxicity
from voxelframe.llm.textbatch import text_buffer

BAD = ["grob", "Snark", "vile"]


def sample(n):
    rng = random.Random(2)
    out = []
    for i in range(n):
        words = prose(i, rng.randint(10, 200)).split()
        toxic = rng.random() < 0.25
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(BAD) + rng.choice(["", ",", "."]))
        out.append((i, " ".join(words), toxic))
    return out


def test_held_out_scores(spark):
    from pyspark.sql import functions as F

    from voxelframe.llm.langid import held_out

    rows = sample(900)
    docs = documents(spark, [(i, t, None, None) for i, t, _ in rows])
    labels = spark.createDataFrame([(i, int(y)) for i, _, y in rows] + [(None, 1), (5, None)], "doc_id long, toxic int").where(~held_out(F.col("doc_id"), 3, 1))
    model = toxicity.learn(docs, labels)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    test = [(y, got[i]) for i, _, y in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean([s >= 0.7 for y, s in test if y]) > 0.9
    assert np.mean([s >= 0.7 for y, s in test if not y]) < 0.02


def test_features_are_words_pairs_and_skips():
    bits = 20
    def of(t):
        return set(toxicity.word_features(*text_buffer(pa.array([t])), bits)[1].tolist())
    assert len(of("a b c")) == 3 + 2 + 1
    assert of("A, b! c") == of("a b c")
    assert len(of("a b c") & of("a x c")) == 3  # a, c and the skip a_c
    assert len(of("a b") & of("b a")) == 2


def test_step_against_the_formulas():
    config = toxicity.FtrlConfig(bits=4, epochs=1, least_documents=1, l1=0.01, l2=0.5, alpha=0.3)
    rows, labels = [np.array([1, 3]), np.array([3])], np.array([1.0, 0.0])
    got = toxicity.ftrl(rows, labels, config)
    z, n = np.zeros(17), np.zeros(17)
    for r in np.random.default_rng(11).permutation(2):
        at, w = np.append(rows[r], 16), {}
        for i in at:
            l1 = 0 if i == 16 else config.l1
            w[i] = 0.0 if abs(z[i]) <= l1 else -(z[i] - np.sign(z[i]) * l1) / ((config.beta + np.sqrt(n[i])) / config.alpha + config.l2)
        p = 1 / (1 + np.exp(-sum(w.values())))
        for i in at:
            g = p - labels[r]
            z[i] += g - (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / config.alpha * w[i]
            n[i] += g * g
    for i, weight in zip(got.index, got.weight, strict=True):
        assert weight == pytest.approx(-(z[i] - np.sign(z[i]) * config.l1) / ((config.beta + np.sqrt(n[i])) / config.alpha + config.l2))


def test_edges(spark, edge, edge_rows, none_at_all):
    labels = spark.createDataFrame([(1, 1), (1, 0), (9, 0), (99, 1), (None, 1), (2, None)], "doc_id long, toxic int")
    model = toxicity.learn(edge, labels)
    got = toxicity.score(edge, model).collect()
    assert len(got) == len(edge_rows)
    assert all(0 <= r["score"] <= 1 for r in got)
    nothing = toxicity.learn(edge, labels.where("false"))
    assert max(r["score"] for r in toxicity.score(edge, nothing).collect()) < 1e-10
    toxicity.learn(none_at_all, labels)
    assert toxicity.score(none_at_all, model).count() == 0


def test_scores_against_brute_force(spark):
    rows = sample(300)
    docs = spark.createDataFrame([(f"id{i}", t) for i, t, _ in rows], "doc_id string, text string")
    labels = spark.createDataFrame([(f"id{i}", int(y)) for i, _, y in rows], "doc_id string, toxic int")
    model = toxicity.learn(docs, labels)
    weight = dict(zip(model.index.tolist(), model.weight.tolist(), strict=True))
    assert len(weight) > 3
    text = {f"id{i}": t for i, t, _ in rows}
    for r in toxicity.score(docs, model).collect():
        features = set(toxicity.word_features(*text_buffer(pa.array([text[r["doc_id"]]])), model.bits)[1].tolist())
        z = model.intercept + sum(weight.get(f, 0.0) for f in features)
        assert r["score"] == pytest.approx(1 / (1 + np.exp(-z)), rel=1e-4)
