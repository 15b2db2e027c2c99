import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from conftest import documents, prose

from voxelframe.llm import lm
from voxelframe.llm.langid import held_out

SMALL = lm.LmConfig(classes=4, members=4, bits=10, head_words=64, table_words=100, suffixes=256)


def tokens(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", lowered), None]


def run(spark, docs, config):
    from pyspark.sql import functions as F

    held = held_out(F.col("doc_id"), 7, 2)
    model, counts = lm.learn(docs.where(~held), config)
    return model, lm.score(docs, model, counts).collect()


@pytest.mark.parametrize("config", [SMALL, lm.LmConfig()])
def test_base_against_brute_force(spark, config):
    rows = [(i, prose(i % 70, 5 + i).title() + " É Z", "en", None) for i in range(150)]
    model, got = run(spark, documents(spark, rows), config)
    counts = Counter(t for i, text, _, _ in rows if zlib.crc32(str(i).encode()) % 7 != 2 for t in tokens(text))
    n, v = sum(counts.values()), len(counts)
    by = {r["doc_id"]: r for r in got}
    for i, text, _, _ in rows:
        ts, r = tokens(text), by[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(ts), sum(counts[t] > 0 for t in ts), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in ts))
        assert math.isfinite(r["score"]) and r["score"] < 0


def test_model_beats_the_base_on_held_out_texts(spark):
    """Two invented languages, told apart by their words."""
    rows = []
    for i in range(400):
        rng = random.Random(i)
        rows.append((i, " ".join(f"{'xq'[i % 2]}{min(rng.randrange(60), rng.randrange(60))}" for _ in range(80)), None, None))
    _, got = run(spark, documents(spark, rows), lm.LmConfig())
    held = [r for r in got if zlib.crc32(str(r["doc_id"]).encode()) % 7 == 2]
    assert sum(r["score"] for r in held) > 0.95 * sum(r["base_score"] for r in held)


def test_probabilities_add_up_to_one(spark):
    """Over all known words and one unknown place in each class, after some history."""
    rows = [(i, prose(i, 40), None, None) for i in range(60)]
    docs = documents(spark, rows)
    config = lm.LmConfig(classes=4, members=4, bits=10, head_words=64, suffixes=256)
    model, _ = lm.learn(docs, config)
    words = sorted({t for _, text, _, _ in rows for t in tokens(text) if t})
    history = "tari moke"
    got = lm.tokens_of(pa.array([f"{history} {w}" for w in words] + [history]), config.suffixes)
    row, kind, own = lm.token_scores(got, model)
    last = np.append(got.first[1:-1] - 2, got.first[-1] - 1)  # each word, and the end after the history
    total = (10.0 ** own[last]).sum()
    member_share = 0.0

    def share(weights, rows, bias):
        e = lm._exponentials(weights, rows, bias)[0]
        return e / e.sum()

    index = got.first[-1] - 1
    of_class, of_member = model.features(got, model.places(got)[0])
    p_class = share(model.class_weights, [r[index : index + 1] for r in of_class], model.class_bias)
    for c in range(config.classes):
        at = np.flatnonzero(kind[last] == c)
        if len(at):
            i = last[at[0]]
            p = share(model.member_weights, [r[i : i + 1] for r in of_member], model.member_bias[c])
            unseen = sum(p[m] for m in range(config.members - 1) if not any(model.places(got)[1][last[a]] == m for a in at))
            member_share += p_class[c] * (p[-1] / model.rest_size[c] + unseen)
        else:
            member_share += p_class[c]
    assert total + member_share == pytest.approx(1.0, abs=1e-3)


def test_lookup():
    keys = np.unique(np.random.default_rng(1).integers(0, 2**63, 5000).astype(np.uint64))
    table = lm.Lookup.build(keys)
    assert (table.find(keys) == np.arange(len(keys))).all()
    assert (table.find(keys + np.uint64(1))[~np.isin(keys + np.uint64(1), keys)] == -1).all()
    assert (lm.Lookup.build(keys[:0]).find(keys) == -1).all()


def slow_features(got, kind, config):
    """The hashed rows of each token, one at a time, from the definition of the features."""
    mask = (1 << 64) - 1

    def mixed(x, rows):
        return int(lm.mix64(np.array([x & mask], np.uint64))[0]) % rows

    (a, b, c, d), (e, _) = config.rows
    out = []
    for i in range(len(kind)):
        begin = got.first[got.doc[i]]
        one, two = (int(got.hash[i - j]) if i - j >= begin else int(lm.START) for j in (1, 2))
        past = [int(kind[i - j]) if i - j >= begin else 0 for j in (1, 2, 3)]
        trio = (past[0] * config.classes + past[1]) * config.classes + past[2] + 13
        own = int(lm.mix64(np.array([int(kind[i]) + 101], np.uint64))[0])
        out.append(([mixed(one, a), mixed(one * 5 + two, b), mixed(two + 7, c), mixed(trio, d)], [mixed(one ^ own, e), past[0] * config.classes + int(kind[i])]))
    return out


def softmax(bias, tables, rows):
    z = np.array(bias, float) + sum(t[r].astype(float) for t, r in zip(tables, rows, strict=True))
    e = np.exp(z - z.max())
    return e / e.sum()


def test_gradient_and_scores_against_brute_force(spark):
    rows = [(i, prose(i % 25, 10 + i), None, None) for i in range(40)]
    docs = documents(spark, rows)
    model, counts = lm.learn(docs, SMALL)
    texts = docs.repartition(5).selectExpr("cast(text as binary) as text")
    sizes = [(n, 4) for group in SMALL.rows for n in group]
    observed, expected = [np.zeros(n, int) for n in sizes], [np.zeros(n) for n in sizes]
    for r in lm.gradient(texts, model).collect():
        o, e = np.frombuffer(r["observed"], np.int64).reshape(-1, 4), np.frombuffer(r["expected"], np.float64).reshape(-1, 4)
        observed[r["number"]][r["low"] : r["low"] + len(o)], expected[r["number"]][r["low"] : r["low"] + len(o)] = o, e
    moves = lm.steps(lm.gradient(texts, model), SMALL)
    count = Counter(t for _, text, _, _ in rows for t in tokens(text))
    want_o, want_e, by = [np.zeros(o.shape) for o in observed], [np.zeros(o.shape) for o in observed], {}
    table = {int(w): int(n) for w, n in ((r["word"], r["n"]) for r in counts.collect())}
    for i, text, _, _ in rows:
        got = lm.tokens_of(pa.array([text]), SMALL.suffixes)
        kind, member = model.places(got)
        total = 0.0
        for at, (of_class, of_member) in enumerate(slow_features(got, kind, SMALL)):
            p = softmax(model.class_bias, model.class_weights, of_class)
            q = softmax(model.member_bias[kind[at]], model.member_weights, of_member)
            for t, row in enumerate(of_class):
                want_o[t][row, kind[at]] += 1
                want_e[t][row] += p
            for t, row in enumerate(of_member):
                want_o[4 + t][row, member[at]] += 1
                want_e[4 + t][row] += q
            total += math.log10(p[kind[at]] * q[member[at]])
            if member[at] == SMALL.members - 1:
                total += math.log10((table[int(got.hash[at : at + 1].view(np.int64)[0])] + 1) / model.rest_size[kind[at]])
        by[i] = total
    assert all((o == w).all() for o, w in zip(observed, want_o, strict=True))
    met = [w.any(axis=1) for w in want_o]  # counts are sent as roots of 16 bits
    assert all(np.allclose(e[m], w[m], rtol=3e-3, atol=1e-4) for e, w, m in zip(expected, want_e, met, strict=True))
    assert all(np.allclose(s[m], 0.5 * np.log((o + 1) / (w + 1))[m], atol=3e-3) for s, o, w, m in zip(moves, want_o, want_e, met, strict=True))
    assert sum(table.values()) == sum(count.values())
    for r in lm.score(docs, model, counts).collect():
        assert r["score"] == pytest.approx(by[r["doc_id"]], rel=1e-4)


def test_weights_do_not_depend_on_the_number_of_tasks(spark):
    docs = documents(spark, [(i, prose(i % 40, 20 + i % 90), None, None) for i in range(300)])
    one, many = (lm.learn(docs.repartition(n, "doc_id"), SMALL)[0] for n in (1, 16))
    for a, b in zip([*one.class_weights, *one.member_weights], [*many.class_weights, *many.member_weights], strict=True):
        assert np.abs(a).max() > 0 and np.allclose(a, b, atol=5e-3)


def test_each_update_lowers_the_loss(spark):
    docs = documents(spark, [(i, " ".join(f"{'xq'[i % 2]}{(i * j * j) % 23}" for j in range(60)), None, None) for i in range(200)])
    losses = []
    for rounds in ((), (4,), (4, 4), (4, 4, 8)):
        model, counts = lm.learn(docs, lm.LmConfig(classes=4, members=4, bits=10, head_words=64, rounds=rounds))
        losses.append(-lm.score(docs, model, counts).agg({"score": "sum"}).first()[0])
    assert losses == sorted(losses, reverse=True) and losses[-1] < 0.9 * losses[0]


def test_edges(spark, edge, edge_rows, none_at_all):
    model, got = run(spark, edge, SMALL)
    assert len(got) == len(edge_rows)
    assert {r["n_tokens"] for r in got if r["doc_id"] in (3, 4, 5)} == {1}
    twice = [tuple(r) for r in got if r["doc_id"] == 9]
    assert len(twice) == 2 and twice[0] == twice[1]
    assert lm.score(none_at_all, *lm.learn(edge, SMALL)).count() == 0
    untrained = lm.score(edge, *lm.learn(none_at_all, SMALL)).collect()
    assert {(r["base_score"], r["score"], r["train_tokens"]) for r in untrained} == {(0.0, 0.0, 0)}
