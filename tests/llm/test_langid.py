import math
import random
import zlib

import pyarrow as pa
import pytest
from conftest import documents

from voxelframe.llm import langid
from voxelframe.llm.textbatch import text_buffer

PARTS = {"en": "th ing er and on the st ha of ly", "de": "sch ung en der ch ie ein ge keit pf", "fr": "eau eux le é è ment qu tion ou vi", "es": "ción os ar el ado que ñ ll ez mente"}


def text(lang, seed, words=60):
    rng = random.Random(f"{lang}{seed}")
    parts = PARTS[lang].split()
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(words))


@pytest.fixture(scope="module")
def docs(spark):
    return documents(spark, [(i, text(lang, i, 3 + i % 80), lang, "s") for i in range(400) for lang in [sorted(PARTS)[i % 4]]])


def test_held_out_accuracy(spark, docs):
    from pyspark.sql import functions as F

    held = langid.held_out(F.col("doc_id"), 4, 2)
    model = langid.learn(docs.where(~held))
    assert sorted(sum(model.families, ())) == sorted(PARTS) and len(model.families) == 2
    got = {r["doc_id"]: r for r in langid.identify(docs, model).collect()}
    right = [got[i]["lang_pred"] == sorted(PARTS)[i % 4] for i in range(400) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert sum(right) / len(right) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_prediction_uses_the_text_alone(spark, docs):
    from pyspark.sql import functions as F

    model = langid.learn(docs)
    changed = docs.withColumns({"lang": F.lit("zz"), "source": F.lit("q"), "doc_id": F.col("doc_id") + 1000})
    a = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify(docs, model).collect()}
    b = {r["doc_id"] - 1000: (r["lang_pred"], r["score"]) for r in langid.identify(changed, model).collect()}
    assert a == b


def test_letters():
    texts = ["", "123 !?", "é", "中文", "1a", "😀", "٣"]
    assert langid.has_letters(*text_buffer(pa.array(texts))).tolist() == [any(c.isalpha() for c in t) for t in texts]


def test_edges(spark, edge, edge_rows, none_at_all, docs):
    model = langid.learn(docs)
    got = langid.identify(edge, model).collect()
    assert len(got) == len(edge_rows)
    for r in got:
        if r["doc_id"] in (3, 4, 5, 10):
            assert r["lang_pred"] == "und" and r["score"] == 0
    assert langid.learn(none_at_all).families == ()
    assert {r["lang_pred"] for r in langid.identify(edge, langid.learn(none_at_all)).collect()} == {"und"}
    single = langid.learn(documents(spark, [(1, "abc def", "en", None), (2, None, "en", None)]))
    assert {r["lang_pred"] for r in langid.identify(documents(spark, [(1, "xyz", None, None)]), single).collect()} == {"en"}
    assert langid.identify(none_at_all, model).count() == 0


def test_votes_against_brute_force(spark, docs):
    """Every prediction again, from the weights, one text and one machine at a time."""
    model = langid.learn(docs)
    got = {r["doc_id"]: r for r in langid.identify(docs, model).collect()}
    squash = lambda m: 1 / (1 + math.exp(-2 * max(-30, min(30, m))))
    for r in docs.collect():
        x = langid.features(*text_buffer(pa.array([r["text"]])), model.config)[0].astype(float)
        margins = [float(w[:-1].astype(float) @ x + w[-1]) for w in model.of_family]
        best = max(range(len(margins)), key=margins.__getitem__)
        group, score = model.families[best], squash(margins[best])
        wins, sure = {g: 0.0 for g in group}, {g: 1.0 for g in group}
        for (a, b), w in model.of_pair.items():
            if a in group:
                p = squash(float(w[:-1].astype(float) @ x + w[-1]))
                for name, q, won in ((a, p, p >= 0.5), (b, 1 - p, p < 0.5)):
                    wins[name] += won + q / 1000
                    sure[name] = min(sure[name], q)
        name = max(wins, key=wins.get)
        assert got[r["doc_id"]]["lang_pred"] == name
        assert got[r["doc_id"]]["score"] == pytest.approx(score * sure[name], abs=1e-4)
