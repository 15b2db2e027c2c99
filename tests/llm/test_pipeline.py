from collections import Counter

import tiktoken
from conftest import prose

import corpus_pipeline
from voxelframe.llm import bpe, mixing, neardup, quality, substring


def stage(spark, docs, index, path):
    corpus_pipeline.STAGES[index][1](spark, docs, None).write.mode("overwrite").parquet(str(path))
    return spark.read.parquet(str(path))


def test_stages_one_by_one(spark, tmp_path):
    shared = prose(900, 70)
    texts = [prose(i, 100 + i % 50) for i in range(60)]
    texts += [texts[3], texts[3] + " end", prose(300, 20), prose(301, 120).upper(), "same words " * 60]
    texts += [f"{prose(400 + i, 90)} {shared}" for i in range(4)] + [None, ""]
    rows = [(i, t, "en", f"s{i % 3}" if i % 5 else None, len(t or "")) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "near-dedup", "substring dedup", "mixing", "byte-level BPE"]

    first = stage(spark, docs, 0, tmp_path / "0")
    judged = quality.with_quality(docs, ["doc_id"], quality.learn_references(docs)).where("kept").collect()
    assert first.columns == docs.columns
    assert sorted(r["doc_id"] for r in first.collect()) == sorted(r["doc_id"] for r in judged)
    assert {r["doc_id"] for r in first.collect()} == set(range(len(texts))) - {62, 63, 64, 69, 70}

    second = stage(spark, first, 1, tmp_path / "1")
    assert {r["doc_id"] for r in second.collect()} == {r["doc_id"] for r in first.collect()} - {60, 61}

    third = stage(spark, second, 2, tmp_path / "2")
    assert third.count() == second.count()
    assert sum(shared in r["text"] for r in third.collect()) == 1

    fourth = stage(spark, third, 3, tmp_path / "3")
    taken = Counter(r["doc_id"] for r in fourth.collect())
    assert set(taken) <= {r["doc_id"] for r in third.collect()} and max(taken.values()) <= 2
    for r in mixing.mix(third).collect():
        if r["taken"] in (0, 2 * r["size"]):
            assert taken[r["doc_id"]] == (0 if r["taken"] == 0 else 2)

    last = stage(spark, fourth, 4, tmp_path / "4").collect()
    ranks, pattern = bpe.public_vocabulary()
    oracle = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    text = {r["doc_id"]: r["text"] for r in third.collect()}
    assert Counter(r["doc_id"] for r in last) == taken
    assert all(r["ids"] == oracle.encode_ordinary(text[r["doc_id"]]) for r in last)


def test_run_is_the_stages(spark, tmp_path):
    rows = [(i, prose(i, 60 + i), "en", f"s{i % 3}", 1) for i in range(30)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in got} <= set(range(30)) and len(got) > 20
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for index in range(5):
        docs = stage(spark, docs, index, tmp_path / str(index))
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in got) == Counter((r["doc_id"], tuple(r["ids"])) for r in docs.collect())


def test_run_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_extra_columns_of_any_type_pass_all_stages(spark, tmp_path):
    rows = [(i, prose(i, 60 + i), "en", "a", 1, {"k": i}, [[i]], None) for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, row map<string,int>, key array<array<int>>, label string")
    for index in range(4):
        docs = stage(spark, docs, index, tmp_path / str(index))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "row", "key", "label"]
        assert all(r["row"] == {"k": r["doc_id"]} and r["key"] == [[r["doc_id"]]] for r in docs.collect())
    assert stage(spark, docs, 4, tmp_path / "4").count() >= 12
