import struct

import numpy as np
import pytest
from test_sources import image

from voxelframe import cli
from voxelframe.operators import cache
from voxelframe.plans import ingest
from voxelframe.plans.config import Recipe, may_resume
from voxelframe.sources import dicom, nifti
from voxelframe.streaming import inventory as stream

RECIPE = """
name = "small"
[dicom]
modalities = ["CR", "DX"]
views = ["PA", "AP"]
[image]
size = [8, 8]
[labels]
targets = ["A", "B"]
missing = "zero"
[split]
train = 0.5
val = 0.25
test = 0.25
seed = 3
"""


def test_recipe():
    recipe = Recipe.from_toml(RECIPE)
    assert recipe.image.size == (8, 8) and recipe.dicom.modalities == ("CR", "DX") and recipe.labels.uncertain == "ignore"
    assert recipe.fingerprint == Recipe.from_toml(RECIPE).fingerprint != Recipe.from_toml(RECIPE.replace("seed = 3", "seed = 4")).fingerprint
    for bad in ('name = "x"', RECIPE.replace("[8, 8]", "[8, 9]"), RECIPE.replace('"zero"', '"maybe"'), RECIPE.replace("val = 0.25", "val = 0.5"), RECIPE.replace('name = "small"', 'name = " "')):
        with pytest.raises(ValueError):
            Recipe.from_toml(bad)
    assert may_resume({"a": "1"}, {"a": "1"}) and not may_resume({"a": "1"}, {"a": "2"}) and not may_resume(None, {})


def folder(path, n=8):
    T = dicom.TAGS
    path.mkdir()
    for i in range(n):
        more = {T["sop_instance_uid"]: ("UI", f"1.{i}".encode()), T["patient_id"]: ("LO", f"p{i}".encode()), T["study_instance_uid"]: ("UI", b"5.5"), T["modality"]: ("CS", b"MR" if i == 7 else b"CR")}
        (path / f"f{i}.dcm").write_bytes(image(bytes([i, 10, 20, 200]), more=more.items()))
    (path / "bad.dcm").write_bytes(b"junk")
    return path


def test_ingest(spark, tmp_path):
    root = folder(tmp_path / "in")
    (tmp_path / "l.csv").write_text("subject_id,study_id,A,C\n" + "\n".join(f"p{i},5.5,{i % 2},1" for i in range(6)))
    recipe = Recipe.from_toml(RECIPE)
    got = ingest.run(spark, recipe, str(root), str(tmp_path / "l.csv"), f"file://{tmp_path}/out")
    assert got.summary == {"scanned": 8, "unreadable": 1, "skipped": 1, "samples": 7, "problems": 0, "patients_in_two_splits": 0}
    assert got.status == "written" and got.tensors.count() == 7
    rows = spark.read.parquet(f"file://{tmp_path}/out/labels").collect()
    assert len(rows) == 14 and sum(r["mask"] for r in rows) == 14 and sum(r["label"] for r in rows) == 3
    again = ingest.run(spark, recipe, str(root), str(tmp_path / "l.csv"), f"file://{tmp_path}/out")
    assert again.status == "reused"
    assert "p7" not in (tmp_path / "out/report.md").read_text()
    dry = ingest.run(spark, recipe, str(root), str(tmp_path / "l.csv"), f"file://{tmp_path}/no", dry_run=True)
    assert dry.manifest.count() == 7 and not (tmp_path / "no").exists()
    one = got.tensors.orderBy("sample_id").first()
    assert len(one["tensor"]) == 64 and np.frombuffer(one["tensor"], np.uint8).max() == 255


def test_ingest_refuses_other_syntaxes(spark, tmp_path):
    root = folder(tmp_path / "in", 2)
    (root / "x.dcm").write_bytes(image(bytes(4), syntax="1.2.840.10008.1.2.4.90"))
    (tmp_path / "l.csv").write_text("subject_id,study_id,A\np0,5.5,1\n")
    with pytest.raises(Exception, match="not allowed"):
        ingest.run(spark, Recipe.from_toml(RECIPE), str(root), str(tmp_path / "l.csv"), f"file://{tmp_path}/o")


def test_streamed_inventory(spark, tmp_path):
    root = folder(tmp_path / "in", 2)
    target, checkpoint = str(tmp_path / "t"), str(tmp_path / "cp")
    stream.follow(spark, str(root), target, checkpoint).awaitTermination()
    assert stream.current(spark, target).count() == 3
    (root / "new.dcm").write_bytes(image(bytes(4)))
    (root / "no.txt").write_bytes(b"x")
    stream.follow(spark, str(root), target, checkpoint).awaitTermination()
    assert stream.current(spark, target).count() == 4


def test_command_line(spark, tmp_path, capsys):
    root = folder(tmp_path / "in", 3)
    assert cli.main(["dicom-inspect", str(root / "f0.dcm")]) == 0 and "(0010,0020)" in capsys.readouterr().out
    assert cli.main(["dicom-pixels", str(root / "f0.dcm"), "--explain"]) == 0 and "min-max" in capsys.readouterr().out
    assert cli.main(["dicom-pixels", str(root / "f1.dcm"), "--width", "4"]) == 0
    assert cli.main(["dicom-scan", str(root)]) == 0 and "missing_series_instance_uid" in capsys.readouterr().out
    assert cli.main(["dicom-inspect", str(tmp_path / "none")]) == 2 and "error" in capsys.readouterr().err
    data = tmp_path / "set"
    for d in ("imagesTr", "labelsTr"):
        (data / d).mkdir(parents=True)
    label = np.zeros(64)
    label[21] = 1
    (data / "imagesTr/a_0000.nii").write_bytes(nifti.build((4, 4, 4), np.arange(64)))
    (data / "labelsTr/a.nii").write_bytes(nifti.build((4, 4, 4), label, 512))
    (data / "labelsTr/b.nii").write_bytes(nifti.build((4, 4, 4), label, 512))
    assert cli.main(["dataset-validate", str(data)]) == 0
    assert "missing_image" in capsys.readouterr().out
    (tmp_path / "plan.toml").write_text('[[ops]]\nop = "min_max_normalize"\n[[ops]]\nop = "crop_foreground"\nmargin = 1\n')
    assert cli.main(["prepare", str(data), "--plan", str(tmp_path / "plan.toml"), "--out", f"file://{tmp_path}/p"]) == 0
    row = cache.read_table(spark, f"file://{tmp_path}/p").first()
    assert row["shape"] == [3, 3, 3] and row["foreground"] == 1 and row["error"] is None
    (tmp_path / "r.toml").write_text(RECIPE)
    assert cli.main(["ingest", str(root), "--recipe", str(tmp_path / "r.toml"), "--labels", "x", "--out", "o", "--dry-run"]) == 0
    assert "manifest: o/manifest" in capsys.readouterr().out
    assert cli.main(["query", "label_histogram", "/root/testdata/sf0.001"]) == 0 and "toxic" in capsys.readouterr().out
    assert struct.calcsize("<i") == 4
