import pickle

import numpy as np
import pytest
from conftest import documents, prose

from voxelframe.llm import langid, lm, store, toxicity


def test_broadcasts_need_no_copy_of_the_package(spark, monkeypatch):
    """What executors get by broadcast holds no class of ours, so they can read it without the package."""
    sent = []
    put = spark.sparkContext.broadcast
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda self, value: sent.append(value) or put(value))
    docs = documents(spark, [(i, prose(i, 60), "en" if i % 2 else "fr", "a") for i in range(40)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    langid.identify(docs, langid.learn(docs)).collect()
    toxicity.score(docs, toxicity.learn(docs, labels)).collect()
    lm.score(docs, *lm.learn(docs, lm.LmConfig(classes=4, members=4, bits=8))).collect()
    assert len(sent) >= 4
    for value in sent:
        assert b"voxelframe" not in pickle.dumps(value)


def test_plain_and_restored_models_agree(spark):
    model, _ = lm.learn(documents(spark, [(i, prose(i, 60), "en", "a") for i in range(10)]), lm.LmConfig(classes=4, members=4, bits=8))
    again = lm.restored(lm.plain(model))
    assert again.config == model.config and (again.head.slots == model.head.slots).all()
    assert all(np.array_equal(a, b) for a, b in zip(again.class_weights, model.class_weights, strict=True))


def test_a_cluster_must_name_its_folder():
    class Conf:
        def get(self, key, default):
            return default

    class Context:
        master = "spark://host:7077"

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        store.shared_folder(Session())
