import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelframe.operators import images, volumes
from voxelframe.plans import catalogue
from voxelframe.plans.transform import OPERATIONS, Pair, TransformPlan, prepare

RAMP = np.array([0, 10, 20, 30], np.float32)
GOLDEN = {
    "percentile_clip": ({"lower": 25.0, "upper": 75.0}, [7.5, 10, 20, 22.5]),
    "min_max_normalize": ({"output_min": -1.0, "output_max": 1.0}, [-1, -1 / 3, 1 / 3, 1]),
    "dataset_mean_std_normalize": ({"mean": 10.0, "std": 5.0}, [-2, 0, 2, 4]),
    "z_score_normalize": ({"epsilon": 1e-6}, [-1.3416407, -0.4472136, 0.4472136, 1.3416407]),
    "ct_window": ({"min": 5.0, "max": 25.0}, [5, 10, 20, 25]),
}


@pytest.mark.parametrize("name", GOLDEN)
def test_goldens_in_numpy_and_sql(spark, name):
    options, want = GOLDEN[name]
    pair = Pair([RAMP.reshape(1, 1, 4)], None, (1, 1, 1), (0, 0, 0), tuple(np.eye(3).ravel()))
    OPERATIONS[name][0](pair, options)
    assert pair.channels[0].ravel() == pytest.approx(want, abs=1e-6)
    sql = {"percentile_clip": lambda v: volumes.percentile_clip(v, 25.0, 75.0), "min_max_normalize": lambda v: volumes.min_max(v, -1.0, 1.0), "dataset_mean_std_normalize": lambda v: volumes.standardize(v, 10.0, 5.0), "z_score_normalize": volumes.z_score, "ct_window": lambda v: volumes.clip(v, 5.0, 25.0)}[name]
    df = spark.createDataFrame([(RAMP.tolist(),)], "v array<float>")
    assert df.select(sql(F.col("v")).alias("o")).first()["o"] == pytest.approx(want, abs=1e-6)


def test_constant_volumes(spark):
    flat = np.full((1, 1, 3), 7, np.float32)
    assert volumes.np_min_max(flat, 2.0, 5.0).ravel().tolist() == [2, 2, 2]
    assert volumes.np_z_score(flat).ravel().tolist() == [0, 0, 0]
    df = spark.createDataFrame([([7.0, 7.0],)], "v array<float>")
    assert df.select(volumes.min_max(F.col("v"), 2.0, 5.0).alias("o")).first()["o"] == [2, 2]


def test_nearest_and_linear():
    eye = volumes.affine((1, 1, 1), (0, 0, 0), np.eye(3))
    back = volumes.affine((1, 1, 1), (-1, 0, 0), np.eye(3))
    assert volumes.resample(np.array([5, 9], np.int32).reshape(1, 1, 2), eye, back, (3, 1, 1), False).ravel().tolist() == [0, 5, 9]
    quarter = volumes.affine((1, 1, 1), (0.25, 0, 0), np.eye(3))
    assert volumes.resample(np.array([0, 4], np.float32).reshape(1, 1, 2), eye, quarter, (1, 1, 1), True).ravel().tolist() == [1.0]
    half = volumes.affine((1, 1, 1), (0.5, 0, 0), np.eye(3))
    assert volumes.resample(np.array([0, 3], np.int32).reshape(1, 1, 2), eye, half, (1, 1, 1), False).ravel().tolist() == [3]


def test_prefix_counts_against_sums():
    rng = np.random.default_rng(1)
    label = (rng.random((5, 6, 7)) > 0.6).astype(int)
    prefix = volumes.prefix_sums(label)
    for _ in range(60):
        size = [int(rng.integers(1, n + 1)) for n in (7, 6, 5)]
        start = [int(rng.integers(0, n - s + 1)) for n, s in zip((7, 6, 5), size, strict=True)]
        assert volumes.box_count(prefix, start, size) == label[start[2] : start[2] + size[2], start[1] : start[1] + size[1], start[0] : start[0] + size[0]].sum()


def test_pad_crop_and_box():
    x = np.arange(8, dtype=np.float32).reshape(2, 2, 2)
    out, shift = volumes.pad_crop(x, (4, 4, 4))
    assert shift == (1, 1, 1) and out[1:3, 1:3, 1:3].tolist() == x.tolist() and out.sum() == x.sum()
    assert volumes.pad_crop(out, (2, 2, 2))[0].tolist() == x.tolist()
    assert volumes.foreground_box(np.zeros((2, 2, 2))) is None
    label = np.zeros((4, 4, 4))
    label[1, 1, 1], label[2, 2, 2] = 1, 2
    assert volumes.foreground_box(label, (0, 0, 0)) == ((1, 1, 1), (3, 3, 3), 2)
    assert volumes.foreground_box(label, (5, 5, 5))[:2] == ((0, 0, 0), (4, 4, 4))


PLAN = """
[[ops]]
op = "resample"
spacing = [1.0, 1.0, 1.0]
[[ops]]
op = "ct_window"
min = -20.0
max = 20.0
[[ops]]
op = "min_max_normalize"
[[ops]]
op = "crop_foreground"
[[ops]]
op = "pad_crop"
size = [4, 4, 4]
"""


def test_plan_over_cases(spark):
    label = np.zeros((4, 4, 4), int)
    label[1, 1, 1], label[2, 2, 2] = 1, 2
    rows = [("a", [4, 4, 4], [1.0] * 3, [0.0] * 3, np.eye(3).ravel().tolist(), [list(map(float, range(-32, 32)))], label.ravel().tolist()), ("b", [2, 2, 2], [1.0] * 3, [0.0] * 3, np.eye(3).ravel().tolist(), [[float("nan")] * 8], None)]
    cases = spark.createDataFrame(rows, "case_id string, shape array<int>, spacing array<double>, origin array<double>, direction array<double>, channels array<array<float>>, label array<int>")
    plan = TransformPlan.from_toml(PLAN)
    got = {r["case_id"]: r for r in prepare(cases, plan).collect()}
    assert got["a"]["crop_origin"] == [1, 1, 1] and got["a"]["foreground"] == 2 and got["a"]["shape"] == [4, 4, 4]
    assert got["a"]["log"] == [o["op"] for o in plan.ops] and got["a"]["error"] is None
    assert got["b"]["error"]
    assert TransformPlan.from_toml(PLAN).hash == plan.hash != TransformPlan.from_toml(PLAN.replace("20.0", "21.0")).hash
    with pytest.raises(ValueError):
        TransformPlan.from_toml('[[ops]]\nop = "sharpen"')
    with pytest.raises(ValueError):
        TransformPlan((), label_interpolation="linear")


def test_prepared_volumes_padded_and_empty(spark, tmp_path):
    """Foreground at one face only is cropped to two voxels and padded by one; a volume without foreground has no row."""
    rows = [(i, [0.2 if n in at else 0.0 for n in range(64)], 0) for i, at in enumerate(((3, 15, 51), (0, 12, 48), (), (21,), (48, 63)))]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    got = catalogue.prepared_volumes(spark, str(tmp_path))
    want = sorted(db.execute(catalogue.SQL["prepared_volumes"]).fetchall())
    assert sorted(tuple(r) for r in got.collect()) == want
    assert [w[:2] for w in want] == [("0", "1,0,0"), ("1", "-1,0,0"), ("3", "0,0,0"), ("4", "0,0,1")]


def test_fit_pad_golden():
    out = images.fit_pad(np.tile(np.array([10, 20, 30, 40], np.uint8), (2, 1)), 8)
    assert out.shape == (8, 8) and not out[[0, 1, 6, 7]].any() and out[2].all()
    assert (images.fit_pad(np.full((5, 5), 9, np.uint8), 5) == 9).all()
    with pytest.raises(ValueError):
        images.fit_pad(np.zeros((0, 4), np.uint8), 8)


def test_heat_maps():
    mask = images.box_mask([(0.0, 0.0, 0.5, 0.5), (0.9, 0.9, 0.9, 0.9)], 4)
    assert mask[:2, :2].all() and mask[3, 3] and mask.sum() == 5
    heat = np.zeros((4, 4))
    heat[0, 1] = 2
    got = images.cam_metrics(images.normalize_heat(heat), mask, (0.05, 0.25))
    assert got["hit"] == 1 and got["iou_0.05"] == pytest.approx(1 / 5)
    assert images.top_mask(heat, 0.1).sum() == 2
    assert images.normalize_heat(np.full((2, 2), 3.0)).sum() == 0
    assert len(images.terminal_view(np.arange(64, dtype=np.uint8).reshape(8, 8), 8).split("\n")) == 4
