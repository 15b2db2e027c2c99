import pytest
from conftest import documents, prose

from voxelframe.llm import mixing


def targets(sizes, weights, share=1.5, limit=2.0):
    """Water filling, one source at a time."""
    want, full = share * sum(sizes), set()
    while True:
        left = want - sum(limit * sizes[i] for i in full)
        weight = sum(w for i, w in enumerate(weights) if i not in full)
        new = {i for i, w in enumerate(weights) if i not in full and left * w / weight > limit * sizes[i]}
        if not new:
            return [limit * sizes[i] if i in full else left * w / weight for i, w in enumerate(weights)]
        full |= new


@pytest.mark.parametrize("sizes", [[10, 1000, 50, 400, 3], [5], [0, 7], [100, 100, 100]])
def test_targets_against_water_filling(spark, sizes):
    names = [chr(97 + i) for i in range(len(sizes) - 1)] + [None]
    df = spark.createDataFrame(list(zip(names, sizes, strict=True)), "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(df).collect()}
    want = targets(sizes, [(5, 2, 1)[i % 3] for i in range(len(sizes))])
    assert [got[n] for n in names] == pytest.approx(want)


def test_schedules_have_the_stated_means():
    assert [mixing.integral(s) for s in mixing.SCHEDULES] == pytest.approx([5, 2, 1])


def test_inverse_demand_undoes_the_integral(spark):
    from pyspark.sql import functions as F

    def demand(schedule, t):
        total = 0.0
        for (t0, w0), (t1, w1) in zip(schedule, schedule[1:], strict=False):
            end = min(t, t1)
            if end > t0:
                at = w0 + (w1 - w0) * (end - t0) / (t1 - t0)
                total += (end - t0) * (w0 + at) / 2
        return total

    for schedule in (*mixing.SCHEDULES, ((0.0, 0.0), (0.3, 2.0), (1.0, 0.0))):
        rows = spark.range(1).select(*[mixing.inverse_demand(F.lit(i / 10), schedule).alias(f"t{i}") for i in range(11)]).first()
        for i, t in enumerate(rows):
            assert demand(schedule, t) == pytest.approx(i / 10 * mixing.integral(schedule), abs=1e-9)


def test_mix_takes_each_target_and_repeats(spark):
    rows = [(i, prose(i, 5 + i % 40), "en", "abcd"[0 if i % 3 else i % 4]) for i in range(400)]
    docs = documents(spark, rows)
    got = mixing.mix(docs).collect()
    again = mixing.mix(docs.repartition(7)).collect()
    assert sorted((r["doc_id"], r["taken"], r["positions"]) for r in got) == sorted((r["doc_id"], r["taken"], r["positions"]) for r in again)
    assert {r["doc_id"]: r["size"] for r in got} == {i: len(t.split()) for i, t, _, _ in rows}
    by = {}
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"]
        assert all(0 <= p <= 1 for p in r["positions"])
        by.setdefault(r["source"], []).append(r)
    for own in by.values():
        assert sum(r["taken"] for r in own) == pytest.approx(own[0]["target"], abs=1)
        assert own[0]["source_size"] == sum(r["size"] for r in own)


def test_training_order_is_by_position(spark):
    docs = documents(spark, [(i, prose(i, 20), "en", "ab"[i % 2]) for i in range(60)])
    got = mixing.training_order(mixing.mix(docs), 3).collect()
    at = [r["position"] for r in got]
    assert at == sorted(at)
    assert sum(r["pass_words"] for r in got) == sum(r["taken"] for r in mixing.mix(docs).collect())


def test_fading_source_comes_earlier(spark):
    docs = documents(spark, [(i, prose(i, 30), "en", "abc"[i % 3]) for i in range(600)])
    got = mixing.training_order(mixing.mix(docs), 1).collect()
    mean = lambda s: sum(r["position"] for r in got if r["source"] == s) / sum(r["source"] == s for r in got)
    assert mean("a") < mean("b") < mean("c")


def test_edges(spark, edge, edge_rows, none_at_all):
    got = mixing.mix(edge).collect()
    assert len(got) == len(edge_rows)
    assert {r["size"] for r in got if r["doc_id"] in (3, 4, 5)} == {0}
    assert {r["source_size"] for r in got if r["source"] is None} == {sum(len((t or "").split()) for _, t, _, s in edge_rows if s is None)}
    assert mixing.mix(none_at_all).count() == 0
    mixed = mixing.mixed_documents(edge)
    assert mixed.columns == edge.columns
    assert mixing.mixed_documents(none_at_all).count() == 0


def test_mixed_documents_are_whole_and_near_target(spark):
    rows = [(i, prose(i, 10 + i % 30), "en", "abcd"[i % 4]) for i in range(400)]
    docs = documents(spark, rows)
    texts = {i: t for i, t, _, _ in rows}
    mixed = mixing.mixed_documents(docs).collect()
    target = {r["source"]: r["target"] for r in mixing.mix(docs).collect()}
    words = {}
    for r in mixed:
        assert r["text"] == texts[r["doc_id"]]
        words[r["source"]] = words.get(r["source"], 0) + len(r["text"].split())
    for source, n in words.items():
        assert abs(n - target[source]) <= 40


def test_query_rows_go_by_position(spark):
    docs = documents(spark, [(i, prose(i, 20), "en", "ab"[i % 2]) for i in range(300)])
    got = mixing.by_first_position(mixing.mix(docs)).collect()
    first = [r["first_position"] for r in got]
    known = [p for p in first if p is not None]
    assert len(got) == 300 and first[: len(known)] == known == sorted(known)
    assert all((r["positions"][:1] or [None])[0] == r["first_position"] for r in got)


def test_written_mix_goes_by_position(spark, tmp_path):
    """The files of the mix, read in order, hold a fading source early and a growing one late."""
    docs = documents(spark, [(i, prose(i, 30), "en", "abc"[i % 3]) for i in range(600)])
    mixing.mixed_documents(docs).write.parquet(str(tmp_path / "mix"))
    order = {r["doc_id"]: r["positions"] for r in mixing.mix(docs).collect()}
    names = sorted(p.name for p in (tmp_path / "mix").iterdir() if p.name.startswith("part"))
    ids = [r["doc_id"] for n in names for r in spark.read.parquet(str(tmp_path / "mix" / n)).coalesce(1).collect()]
    met, places = {}, []
    for i in ids:
        places.append(order[i][met.get(i, 0)])
        met[i] = met.get(i, 0) + 1
    assert len(ids) > 600 and places == sorted(places)


def test_the_number_of_ranges_does_not_matter(spark):
    docs = documents(spark, [(i, prose(i, 5 + i % 40), "en", "ab"[i % 2]) for i in range(200)])
    few, many = ({r["doc_id"]: (r["taken"], r["positions"]) for r in mixing.mix(docs, bits=b).collect()} for b in (1, 9))
    assert few == many


def test_columns_of_any_type_and_equal_rows(spark):
    rows = [(str(i // 2), prose(i // 2, 40), {"k": i // 2}, [{"x": 1}], "a") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id string, text string, facts map<string,int>, more array<struct<x:int>>, source string")
    got = mixing.mixed_documents(docs)
    assert got.schema == docs.schema
    taken = sum(r["taken"] for r in mixing.mix(docs).collect())
    assert abs(sum(len(r["text"].split()) for r in got.collect()) - taken) <= 60
