import random
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelframe.functions import hashing, labels, text
from voxelframe.operators import batches, cache, dataset, inventory, manifest, metrics, repeats, sampling
from voxelframe.plans import views


def test_label_policies(spark):
    df = spark.createDataFrame([(1,), (0,), (-1,), (None,), (2,)], "v int")
    got = lambda m, u: [tuple(r["e"]) for r in df.select(labels.encode(F.col("v"), m, u).alias("e")).collect()]
    assert got("zero", "positive") == [(1, 1), (0, 1), (1, 1), (0, 1), (2, 1)]
    assert got("ignore", "ignore") == [(1, 1), (0, 1), (0, 0), (0, 0), (2, 1)]
    with pytest.raises(Exception, match="fail"):
        got("fail", "zero")
    with pytest.raises(ValueError):
        labels.encode(F.col("v"), "maybe")


def test_label_histogram_and_parse(spark):
    df = spark.createDataFrame([("1",), ("1.0",), (" 0 ",), ("-1",), ("2",), (None,), ("",), ("yes",)], "t string").select(F.lit("x").alias("target"), labels.parse_label(F.col("t")).alias("value"))
    assert tuple(labels.histogram(df).first()) == ("x", 2, 1, 1, 4)
    weights = labels.pos_weight(spark.createDataFrame([("a", 1)] + [("a", 0)] * 30 + [("b", 1)], "target string, value int"))
    assert {r["target"]: r["pos_weight"] for r in weights.collect()} == {"a": 10.0, "b": 1.0}
    maps = spark.createDataFrame([({"a": 1, "z": 0},)], "m map<string,int>").select(labels.project_targets(F.col("m"), ["a", "b"]).alias("m")).first()["m"]
    assert maps == {"a": 1, "b": None}


def test_text_functions(spark):
    names = ["p1_x", "_x", "abc", "case_0001", "case_1000", "a_0000", "_0001"]
    rows = spark.createDataFrame([(n,) for n in names], "n string").select(text.patient_from_name(F.col("n")), text.case_id(F.col("n")), text.channel_index(F.col("n"))).collect()
    assert [r[0] for r in rows] == ["p1", "_x", "abc", "case", "case", "a", "_0001"]
    assert [r[1] for r in rows] == ["p1_x", "_x", "abc", "case", "case_1000", "a", "_0001"]
    assert [r[2] for r in rows] == [None, None, None, 1, None, 0, None]
    df = spark.createDataFrame([("a/b\\c: d", " 1.5\\2 ", "a | b||c", "/x/y.tar.GZ", "inf")], "a string, b string, c string, d string, e string")
    row = df.select(text.safe_component(F.col("a")), text.two_numbers(F.col("b")), text.split_labels(F.col("c")), text.extension(F.col("d")), text.stem(F.col("d")), text.finite(F.col("e")), text.first_number(F.col("b"))).first()
    assert tuple(row) == ("a_b_c__d", [1.5, 2.0], ["a", "b", "c"], "gz", "y.tar", None, 1.5)


def test_multiset_hash_ignores_order(spark):
    a = spark.createDataFrame([("g", v) for v in "abca"] + [("h", v) for v in "aabc"] + [("i", v) for v in "abc"], "k string, v string")
    rows = {r["k"]: tuple(r)[1:] for r in hashing.multiset_hash(a, "v", ["k"]).collect()}
    assert rows["g"] == rows["h"] != rows["i"]
    assert hashing.stable_hash({"b": 1, "a": 2}) == hashing.stable_hash({"a": 2, "b": 1})


def test_inventory_cascade_and_first_values(spark):
    rows = spark.createDataFrame([("ok", "CR", "PA"), ("mr", "MR", "PA"), ("lat", "cr ", "LL"), ("none", None, None)], "path string, modality string, view string")
    reason = inventory.filter_reason(None, (), F.col("modality"), ("CR", "DX"), F.col("view"), ("PA", "AP"))
    kept, skipped = inventory.apply_filter(rows, reason)
    assert [r["path"] for r in kept.collect()] == ["ok"]
    assert {r["path"]: r["reason"] for r in skipped.collect()} == {"mr": "filtered_modality", "lat": "filtered_view_position", "none": "filtered_modality"}
    with pytest.raises(Exception, match="filtered_modality"):
        inventory.apply_filter(rows, reason, "fail")[0].collect()
    numbers = {r["field"]: r for r in inventory.numeric_summary(spark.createDataFrame([(1, None), (3, None)], "a int, b double"), ["a", "b"]).collect()}
    assert numbers["a"]["mean"] == 2 and numbers["b"]["count"] == 0 and numbers["b"]["mean"] is None
    series = spark.createDataFrame([("p", "s", "x", 2, "CR", 5, 5), ("p", "s", "x", 1, None, 4, 4)], "patient_id string, study_id string, series_id string, ordinal int, modality string, rows int, columns int")
    r = inventory.hierarchy(series).first()
    assert (r["modality"], r["rows"], r["mixed_modality"], r["mixed_dimensions"]) == ("CR", 4, False, True)


def test_inventory_warnings(spark):
    names = ["patient_name", "birth_date", "transfer_syntax_uid", "patient_id", "study_instance_uid", "series_instance_uid", "sop_instance_uid", "view_position"]
    row = ("n", None, "1.2.9", "p", " ", "s", "i", None, None, [0.1, 0.1], 0, 5)
    df = spark.createDataFrame([row], ", ".join(f"{n} string" for n in names) + ", pixel_spacing array<float>, imager_pixel_spacing array<float>, rows int, columns int")
    assert df.select(inventory.warnings({c: F.col(c) for c in df.columns}).alias("w")).first()["w"] == ["phi_patient_name", "unsupported_transfer_syntax", "missing_study_instance_uid", "missing_view_position", "invalid_image_dimensions"]


def test_manifest_rows(spark):
    meta = spark.createDataFrame([("i1", "1", "10"), ("i2", "2", "20"), ("i3", "3", "30")], "image_id string, subject_id string, study_id string")
    images = spark.createDataFrame([("i1", "/a"), ("i2", "/b")], "image_id string, image_path string")
    marks = spark.createDataFrame([("1", "10", 1)], "subject_id string, study_id string, x int")
    rows = manifest.from_metadata(meta, images, marks).collect()
    assert [(r["sample_id"], r["x"]) for r in rows] == [("p1/s10/i1", 1), ("p2/s20/i2", None)]
    assert manifest.from_images(spark.createDataFrame([("p7_a", "/q")], "image_id string, image_path string")).first()["patient_id"] == "p7"
    found = spark.createDataFrame([("/z/f1.dcm", "1.9", "p", "st"), ("/z/f2.dcm", " ", None, None)], "path string, sop_instance_uid string, patient_id string, study_instance_uid string")
    ids = [r["sample_id"] for r in manifest.from_inventory(found, spark.createDataFrame([], "subject_id string, study_id string, y int")).orderBy("path").collect()]
    assert ids == ["p/st/1.9", "unknown-patient/unknown-study/f2"]


def brute_auroc(rows):
    pos, neg = [s for y, s in rows if y == 1], [s for y, s in rows if y != 1]
    return sum((p > n) + (p == n) / 2 for p, n in product(pos, neg)) / (len(pos) * len(neg)) if pos and neg else None


def brute_ap(rows):
    pos = sum(y == 1 for y, _ in rows)
    total, last = 0.0, 0.0
    for t in sorted({s for _, s in rows}, reverse=True):
        hit = [y for y, s in rows if s >= t]
        recall = sum(y == 1 for y in hit) / pos
        total += (recall - last) * sum(y == 1 for y in hit) / len(hit)
        last = recall
    return total


def test_ranking_metrics_against_brute_force(spark):
    rng = random.Random(1)
    data = {f"t{k}": [(rng.randint(0, 1), rng.randint(0, 6) / 6) for _ in range(40)] for k in range(4)} | {"only": [(1, 0.5)] * 3}
    rows = [("t", k, float(y), 1.0, s) for k, v in data.items() for y, s in v] + [("t", "t0", 1.0, 0.0, 9.0)]
    df = spark.createDataFrame(rows, "sample_id string, target string, label double, mask double, score double")
    got = {r["target"]: r for r in metrics.ranking_metrics(df).collect()}
    for k, v in data.items():
        assert got[k]["auroc"] == (pytest.approx(brute_auroc(v)) if brute_auroc(v) is not None else None)
        assert got[k]["average_precision"] == pytest.approx(brute_ap(v))
    best = {r["target"]: r for r in metrics.best_f1(df).collect()}
    for k, v in data.items():
        points = []
        for t in {s for _, s in v}:
            tp, fp, p = sum(y == 1 and s >= t for y, s in v), sum(y != 1 and s >= t for y, s in v), sum(y == 1 for y, _ in v)
            points.append((round(2 * tp / max(tp + fp + p, 1), 9), round(tp / max(p, 1), 9), -t))
        assert best[k]["threshold"] == -max(points)[2]


def test_pairing_and_gate(spark):
    a = spark.createDataFrame([("x", 0, 1.0), ("y", 1, 2.0)], "sample_id string, position int, score double")
    b = spark.createDataFrame([("y", 0, 2.5), ("z", 1, 1.0)], "sample_id string, position int, score double")
    assert tuple(metrics.pair_predictions(a, b).first()) == (1, 1, 1, 1, 0.5, 0.5)
    left = spark.createDataFrame([("a", 1.0), ("b", None), ("c", 2.0)], "t string, v double")
    right = spark.createDataFrame([("a", 1.0 + 1e-8), ("b", None), ("d", 2.0)], "t string, v double")
    assert sorted(r["t"] for r in metrics.recheck(left, right, ["t"], "v").collect()) == ["c", "d"]


def test_nearest_rank_edges(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", float("nan")), ("a", float("inf")), ("b", None)], "k string, v double")
    assert {r["k"]: tuple(r)[1:] for r in metrics.nearest_rank(df, "v", ["k"]).collect()} == {"a": (1.0, 1.0, 1.0), "b": (0.0, 0.0, 0.0)}


def test_repeats(spark):
    df = spark.createDataFrame([("a", 1, 10.0), ("a", 2, 10.2), ("b", 1, 5.0), ("b", 2, float("nan"))], "g string, repeat int, value double")
    got = {r["g"]: r for r in repeats.repeat_summary(df, ["g"], "value").withColumn("s", repeats.stability(F.col("count"), F.col("cv_percent"))).collect()}
    assert got["a"]["s"] == "ok" and got["a"]["stdev"] == pytest.approx(0.141421356) and got["b"]["count"] == 1 and got["b"]["stdev"] == 0 and got["b"]["s"] == "insufficient"
    status = repeats.group_status(spark.createDataFrame([("a", 1, "ok"), ("a", 2, "bad"), ("b", 1, "ok")], "g string, repeat int, status string"), ["g"], 2)
    assert {r["g"]: r["status"] for r in status.collect()} == {"a": "failed", "b": "incomplete"}


def test_dataset_checks(spark):
    files = spark.createDataFrame([("a", 0), ("a", 1), ("b", 0), ("b", 2), ("c", 1)], "case_id string, channel int")
    assert sorted(r["case_id"] for r in dataset.channel_gaps(files).collect()) == ["b", "c"]
    df = spark.createDataFrame([([1.0, 2.0], [1.0, 2.0 + 1e-7]), ([1.0], [1.0, 2.0]), ([1.0, None], [1.0, 2.0])], "a array<double>, b array<double>")
    assert [r[0] for r in df.select(dataset.nearly_equal(F.col("a"), F.col("b"))).collect()] == [True, False, False]


def test_batches(spark):
    rows = spark.range(10).withColumnRenamed("id", "index")
    assert batches.complete_batches(rows, 4, True).count() == 8 and batches.complete_batches(rows, 4, False).count() == 10
    assert {r["batch_id"] for r in batches.worker_share(batches.complete_batches(rows, 2, False), 1, 2).collect()} == {1, 3}
    assert batches.runs_of([5, 1, 2, 2, 3, 9]) == [(1, 2), (2, 2), (5, 1), (9, 1)]
    got = batches.contiguous_runs(spark.createDataFrame([(i,) for i in [5, 1, 2, 2, 3, 9]], "i long"), "i").orderBy("start", "length").collect()
    assert [tuple(r) for r in got] == [(1, 2), (2, 2), (5, 1), (9, 1)]
    assert sorted(batches.shuffled(10, 3, 4)) == list(range(10)) and batches.shuffled(10, 3) == batches.shuffled(10, 3)
    plan = batches.schedule(spark, 7, 3, 2, seed=1, drop_last=True)
    assert plan.count() == 12 and plan.where("iteration = 0").select("sample_index").distinct().count() == 6


def test_batch_reader(spark):
    table = spark.createDataFrame([(i, [float(i)] * 2, f"s{i}") for i in range(5)], "sample_index long, image array<float>, sample_id string")
    got = list(batches.BatchReader(table, 2))
    assert [b["sample_id"] for b in got] == [["s0", "s1"], ["s2", "s3"], ["s4"]] and got[0]["image"].shape == (2, 2)
    got = list(batches.BatchReader(table, 2, order=[4, 1, 0], drop_last=True))
    assert [b["sample_index"].tolist() for b in got] == [[4, 1]]
    assert [b["sample_id"] for b in batches.BatchReader(table, 2, worker=1, workers=2)] == [["s2", "s3"]]


def volumes_of(spark, n=3, shape=(5, 4, 3)):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(n):
        values = rng.random(int(np.prod(shape))).astype(np.float32)
        rows.append((f"c{i}", 0, list(shape), values.tolist(), (values > 0.8).astype(int).tolist()))
    return spark.createDataFrame(rows, "case_id string, channel int, shape array<int>, values array<float>, label array<int>")


def test_patches_from_chunks_equal_those_from_volumes(spark):
    cases = volumes_of(spark)
    plan = sampling.plan_cases(cases, 12)
    patches = sampling.sample_patches(plan, cases, (3, 2, 2), seed=5)
    again = sampling.sample_patches(plan.repartition(3), cases, (3, 2, 2), seed=5)
    key = lambda df: sorted(map(str, df.collect()))
    assert key(patches) == key(again)
    whole = {r["index"]: r["patch"] for r in sampling.extract_whole(patches, cases).collect()}
    cells = cache.volume_chunks(cases, (2, 2, 2))
    chunked = {r["index"]: r["patch"] for r in sampling.extract_chunked(patches, cells, (2, 2, 2)).collect()}
    assert whole == chunked and len(whole) == 12
    for r in patches.collect():
        assert r["has_foreground"] == any(v > 0.8 for v in whole[r["index"]])
        if r["index"] % 2 == 0:
            assert r["has_foreground"]
    assert sampling.check_plan(patches, cases).count() == 0
    assert sampling.check_plan(patches, cases.where("case_id <> 'c0'")).first()["problem"] == "unknown_case"


def test_generator_is_the_published_one():
    draw = sampling.SplitMix(1234567)
    assert [draw.next() for _ in range(3)] == [6457827717110365317, 3203168211198807973, 9817491932198370423]


def test_cache_promotion_reuse_and_tampering(spark, tmp_path):
    images = spark.createDataFrame([(i, "train" if i < 3 else "val", [float(i)] * 4) for i in range(5)], "sample_index long, split string, values array<float>")
    path = f"file://{tmp_path}/c"
    rows = cache.image_rows(images, "float32", 0.5, 0.25)
    assert cache.write_promoted(rows, path, {"dtype": "float32"}) == "written"
    assert cache.write_promoted(rows, path, {"dtype": "float32"}) == "reused"
    with pytest.raises(ValueError):
        cache.write_promoted(rows, path, {"dtype": "uint8"})
    back = cache.read_table(spark, path)
    assert back.count() == 5 and cache.validate(back, images, 16).count() == 0
    assert np.allclose(cache.decode_image(back.where("sample_index = 2").first()["tensor"], "float32", 0.5, 0.25), (2 / 255 - 0.5) / 0.25)
    bad = back.withColumn("tensor", F.when(F.col("sample_index") == 1, F.unhex(F.lit("00"))).otherwise(F.col("tensor"))).where("sample_index <> 4")
    assert sorted(r["problem"] for r in cache.validate(bad, images, 16).collect()) == ["missing_row", "wrong_digest", "wrong_size"]
    raw = np.array([0, 51, 255], np.float32)
    assert np.allclose(cache.decode_image(cache.encode_image(raw, "uint8", 0.5, 0.25), "uint8", 0.5, 0.25), (raw / 255 - 0.5) / 0.25, atol=1e-5)


def test_numbering_without_a_sort(spark):
    from voxelframe.operators.ordering import numbered

    rows = spark.createDataFrame([(f"s{i}", "ab"[i % 3 == 0]) for i in range(300)], "k string, g string")
    got = numbered(rows, "k", ["g"]).collect()
    for g in "ab":
        assert sorted(r["number"] for r in got if r["g"] == g) == list(range(sum(r["g"] == g for r in got)))
    again = numbered(rows.repartition(7), "k", ["g"]).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))
    sizes = [r["count"] for r in cache.shard_rows(rows, "k", 64).groupBy("shard").count().orderBy("shard").collect()]
    assert sizes == [64, 64, 64, 64, 44]


def test_existing_cases(spark):
    staged = spark.createDataFrame([("a", "1", "m"), ("b", "1", "m"), ("c", "1", "m"), ("d", "1", "m")], "cache_key string, digest string, metadata string")
    old = spark.createDataFrame([("b", "1", "m", True), ("c", "2", "m", True), ("d", "1", "x", True)], "cache_key string, digest string, metadata string, valid boolean")
    assert {r["cache_key"]: r["status"] for r in cache.existing_status(staged, old).collect()} == {"a": "add", "b": "keep", "c": "replace", "d": "refuse"}


def test_normalization_floor(spark):
    df = spark.createDataFrame([(i, [3.0, 3.0]) for i in range(4)], "i long, v array<double>")
    assert tuple(cache.normalization(df, "i", "v").first()) == (8, 3.0, pytest.approx(1e-3))
    assert tuple(cache.normalization(df.where("false"), "i", "v").first()) == (0, 0.5, 0.25)


def test_running_sums_go_over_all_ranges(spark):
    from pyspark.sql import functions as F

    from voxelframe.operators.ordering import running_sums

    rows = spark.range(1000).select(F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("g"), (F.col("id") * 0.5 - 100).alias("v"), (F.col("id") % 7).alias("n"))
    for descending in (False, True):
        got = running_sums(rows, ["g"], "v", {"n": "n"}, descending, ranges=16).collect()
        assert len(got) == 1000
        for g in (None, 1, 2):
            own, total = sorted((r for r in got if r["g"] == g), key=lambda r: -r["v"] if descending else r["v"]), 0
            for r in own:
                total += r["n"]
                assert r["n_upto"] == total
            assert {r["n_all"] for r in own} == {total}
    assert running_sums(rows.where("false"), ["g"], "v", {"n": "n"}).count() == 0


def test_instances_are_dealt_out_by_their_number(spark, tmp_path):
    """The task that joins and counts the instances of a study holds a share of one size, however few partitions the session has."""
    lines = spark.range(600_000).selectExpr("id div 4 l_orderkey", "id % 4 l_linenumber", "if(id % 4 < 3, 'A', 'R') l_returnflag", "'O' l_linestatus", "5.0D l_quantity")
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(150_000).selectExpr("id o_orderkey", "id % 1000 o_custkey").write.parquet(f"{tmp_path}/orders.parquet")
    confs = {"spark.sql.shuffle.partitions": "1", "spark.sql.autoBroadcastJoinThreshold": "-1"}  # large orders are not broadcast
    before = {k: spark.conf.get(k) for k in confs}
    for k, v in confs.items():
        spark.conf.set(k, v)
    try:
        held = views.instances(spark, str(tmp_path)).groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
        got = inventory.hierarchy_counts(views.instances(spark, str(tmp_path))).groupBy("studies", "series", "instances").count().collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert held <= 250_000
    assert [tuple(r) for r in got] == [(150, 300, 600, 1000)]
