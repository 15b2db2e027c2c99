import hashlib
import random

import pytest

from voxelframe.functions.hashing import stable_bucket
from voxelframe.operators import splits


def bucket(value, seed):
    return int.from_bytes(hashlib.sha256(seed.to_bytes(8, "little") + value.encode()).digest()[:8], "little")


def greedy(sizes, ratios, seed):
    n = max(sum(sizes.values()), 1)
    train, val = splits.half_away(ratios[0] * n), splits.half_away(ratios[1] * n)
    out, counts = {}, [0, 0]
    for p in sorted(sizes, key=lambda p: (bucket(p, seed), p)):
        if counts[0] < train:
            out[p] = "train"
            counts[0] += sizes[p]
        elif counts[1] < val:
            out[p] = "val"
            counts[1] += sizes[p]
        else:
            out[p] = "test"
    return out


@pytest.mark.parametrize("seed, ratios", [(0, (0.8, 0.1, 0.1)), (7, (0.5, 0.25, 0.25)), (3, (0.0, 0.5, 0.5)), (1, (1.0, 0.0, 0.0))])
def test_hash_split_is_the_greedy_fill(spark, seed, ratios):
    rng = random.Random(seed)
    sizes = {f"p{i}é": rng.randint(1, 9) for i in range(150)}
    rows = spark.createDataFrame([(p,) for p, n in sizes.items() for _ in range(n)], "patient_id string")
    got = {r["patient_id"]: r["split"] for r in splits.hash_split(rows, ratios, seed).collect()}
    assert got == greedy(sizes, ratios, seed)


def test_bucket(spark):
    from pyspark.sql import functions as F

    row = spark.createDataFrame([("patient-1",), ("é",)], "v string").select("v", stable_bucket(F.col("v"), 11).alias("b")).collect()
    assert all(int(r["b"], 16) == bucket(r["v"], 11) for r in row)


@pytest.mark.parametrize("bad", [(0.5, 0.5), (0.5, 0.6, 0.1), (-0.1, 0.6, 0.5), (float("nan"), 0.5, 0.5)])
def test_bad_ratios(bad):
    with pytest.raises(ValueError):
        splits.check_ratios(bad)


def twelve(spark):
    rows = [(f"s{i}", f"patient-{i}", "PA" if i % 2 == 0 else "AP", 1 if i < 6 else 0) for i in range(12)]
    samples = spark.createDataFrame(rows, "sample_id string, patient_id string, view_position string, finding int")
    long = spark.createDataFrame([(s, p, "Finding", f) for s, p, _, f in rows], "sample_id string, patient_id string, target string, value int")
    return samples, long


def test_stratified_golden(spark):
    samples, long = twelve(spark)
    found = splits.strata(samples, long, ["Finding"], ["ViewPosition"])
    got = {r["patient_id"]: r["split"] for r in splits.stratified_split(samples, found, (0.5, 0.25, 0.25), 11).collect()}
    count = lambda s: [p for p, x in got.items() if x == s]
    assert [len(count(s)) for s in splits.SPLITS] == [6, 3, 3]
    assert [sum(int(p.split("-")[1]) < 6 for p in count(s)) for s in splits.SPLITS] == [3, 2, 1]
    assert all({int(p.split("-")[1]) % 2 for p in count(s)} == {0, 1} for s in splits.SPLITS)
    again = {r["patient_id"]: r["split"] for r in splits.stratified_split(samples.repartition(5), splits.strata(samples, long, ["Finding"], ["view_position"]), (0.5, 0.25, 0.25), 11).collect()}
    assert got == again


def test_unknown_stratify_field(spark):
    samples, long = twelve(spark)
    with pytest.raises(ValueError, match="unknown stratify target"):
        splits.strata(samples, long, [], ["weight"])


def test_list_order_and_unknown(spark):
    manifest = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "sample_id string, x int")
    listed = spark.createDataFrame([("c", 0), ("a", 1)], "sample_id string, ordinal int")
    assert [r["x"] for r in splits.in_list_order(listed, manifest).collect()] == [3, 1]
    with pytest.raises(Exception, match="unknown sample"):
        splits.in_list_order(listed.union(spark.createDataFrame([("z", 2)], "s string, o int")), manifest).collect()


def test_capped_split():
    got = splits.capped_split([(f"p{i}", 2) for i in range(20)], (10, 4, 4), 3)
    counts = {s: 2 * sum(x == s for x in got.values()) for s in splits.SPLITS}
    assert counts == {"train": 10, "val": 4, "test": 4}
    assert got == splits.capped_split([(f"p{i}", 2) for i in reversed(range(20))], (10, 4, 4), 3)


def test_overlap(spark):
    rows = spark.createDataFrame([("x", "train"), ("x", "val"), ("x", "test"), ("y", "train"), ("z", "val"), ("z", "val"), (None, "train"), (None, "val")], "v string, split string")
    assert [r["v"] for r in splits.overlap_values(rows, "v").collect()] == ["x"]
    assert sorted(tuple(r) for r in splits.overlap_pairs(rows, "v").collect()) == [("test", "train", "x"), ("test", "val", "x"), ("train", "val", "x")]
