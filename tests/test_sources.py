import gzip
import struct

import numpy as np
import pyarrow as pa
import pytest

from voxelframe.plans import files
from voxelframe.sources import challenge, dicom, nifti, sinks, tabular, telemetry


def test_nifti_header_orders_and_geometry():
    values = np.arange(24)
    for order in "<>":
        data = nifti.build((2, 3, 4), values, 4, (1.5, 2.0, 3.0), order, slope=2.0, intercept=1.0)
        header = nifti.parse_header(data)
        assert header.shape == (2, 3, 4) and header.order == order and header.spacing == (1.5, 2.0, 3.0)
        assert nifti.read_voxels(data, header).ravel().tolist() == (values * 2.0 + 1).tolist()
        spacing, origin, direction = nifti.split_affine(header.affine)
        assert spacing == [1.5, 2.0, 3.0] and origin == [0, 0, 0] and direction == np.eye(3).ravel().tolist()
    turned = np.array([[0, -2, 0, 5], [3, 0, 0, 6], [0, 0, 4, 7]], float)
    spacing, origin, direction = nifti.split_affine(nifti.parse_header(nifti.build((1, 1, 1), [0], sform=turned)).affine)
    assert spacing == [3, 2, 4] and origin == [5, 6, 7] and direction == [0, -1, 0, 1, 0, 0, 0, 0, 1]


def test_nifti_qform():
    data = bytearray(nifti.build((2, 2, 2), np.zeros(8), spacing=(1.0, 2.0, 3.0)))
    struct.pack_into("<2h", data, 252, 1, 0)
    struct.pack_into("<6f", data, 256, 0, 0, 1, 4, 5, 6)  # half a turn about z
    struct.pack_into("<f", data, 76, -1.0)
    affine = nifti.parse_header(bytes(data)).affine
    assert affine.tolist() == [[-1, 0, 0, 4], [0, -2, 0, 5], [0, 0, -3, 6], [0, 0, 0, 1]]


@pytest.mark.parametrize("at, kind, value", [(0, "i", 9), (344, "4s", b"nope"), (40, "h", 9), (42, "h", 0), (70, "h", 3), (80, "f", float("nan"))])
def test_nifti_rejections(at, kind, value):
    data = bytearray(nifti.build((2, 2, 2), np.zeros(8)))
    struct.pack_into("<" + kind, data, at, value)
    with pytest.raises(nifti.NiftiError):
        nifti.parse_header(bytes(data))


def test_nifti_labels_and_cut_files():
    header = lambda d: nifti.parse_header(d)
    for bad in ([0.5], [-1], [70000], [float("inf")]):
        data = nifti.build((1,), bad)
        with pytest.raises(nifti.NiftiError):
            nifti.read_labels(data, header(data))
    data = nifti.build((2, 2), [1, 2, 3, 4])
    assert nifti.read_labels(data, header(data)).ravel().tolist() == [1, 2, 3, 4]
    with pytest.raises(nifti.NiftiError):
        nifti.read_voxels(data[:-1], header(data))
    with pytest.raises(nifti.NiftiError):
        nifti.read_voxels(nifti.build((1, 1, 1, 2), [1, 2]), header(nifti.build((1, 1, 1, 2), [1, 2])))


def test_nifti_folder(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "case_0000.nii").write_bytes(nifti.build((2, 2, 2), np.arange(8)))
    (tmp_path / "sub/case_0001.nii.gz").write_bytes(gzip.compress(nifti.build((2, 2, 2), np.arange(8))))
    (tmp_path / "bad.nii").write_bytes(b"x" * 10)
    (tmp_path / "other.txt").write_bytes(b"")
    for name in ("a.hdr", "a.img", "a.img.gz", "b.hdr", "b.img.gz", "c.hdr"):
        (tmp_path / name).write_bytes(b".")
    got = {r["case_id"]: len(r["paths"]) for r in nifti.index(spark, str(tmp_path)).collect()}
    assert got == {"case": 2, "bad": 1}
    rows = nifti.scan_headers(spark, str(tmp_path)).collect()
    assert sorted(r["error"] is None for r in rows) == [False, True, True]
    volumes = nifti.load_volumes(spark, str(tmp_path)).where("error is null").collect()
    assert all(v["values"] == list(range(8)) for v in volumes) and len(volumes) == 2
    pairs = {r["header"].rsplit("/")[-1]: r["pixels"] and r["pixels"].rsplit("/")[-1] for r in nifti.detached_pairs(spark, str(tmp_path)).collect()}
    assert pairs == {"a.hdr": "a.img", "b.hdr": "b.img.gz", "c.hdr": None}


def image(pixels, rows=2, columns=2, syntax=dicom.EXPLICIT_LITTLE, bits=8, more=(), order="<"):
    u16 = lambda v: struct.pack(order + "H", v)
    T = dicom.TAGS
    elements = {
        T["sop_instance_uid"]: ("UI", b"1.2.3"), T["patient_id"]: ("LO", b"p1"), T["modality"]: ("CS", b"CR"), T["view_position"]: ("CS", b"PA"),
        T["rows"]: ("US", u16(rows)), T["columns"]: ("US", u16(columns)), T["samples_per_pixel"]: ("US", u16(1)), T["bits_allocated"]: ("US", u16(bits)), T["bits_stored"]: ("US", u16(bits)),
        T["pixel_representation"]: ("US", u16(0)), T["photometric_interpretation"]: ("CS", b"MONOCHROME2"), T["pixel_spacing"]: ("DS", b"0.5\\0.25"), T["pixel_data"]: ("OB", pixels),
    }
    return dicom.build(elements | dict(more), syntax)


@pytest.mark.parametrize("syntax, order", [(dicom.EXPLICIT_LITTLE, "<"), (dicom.IMPLICIT_LITTLE, "<"), (dicom.EXPLICIT_BIG, ">")])
def test_dicom_encodings(syntax, order):
    d = dicom.parse(image(bytes([0, 64, 128, 255]), syntax=syntax, order=order))
    row = dicom.inventory_row(d, "x")
    assert (row["patient_id"], row["rows"], row["pixel_spacing"], row["pixel_representation"]) == ("p1", 2, [0.5, 0.25], "unsigned")
    assert [w["code"] for w in row["warnings"]] == ["missing_study_instance_uid", "missing_series_instance_uid"]
    pixels, steps = dicom.present(d)
    assert pixels.ravel().tolist() == [0, 64, 128, 255] and steps[-1] == "min-max"


def test_dicom_errors_and_inspect():
    with pytest.raises(dicom.DicomError):
        dicom.parse(b"no")
    data = image(bytes(4))
    with pytest.raises(dicom.DicomError):
        dicom.parse(data[:-2])
    assert dicom.inspect(data)["(0008,0060)"] == "CR"


def test_dicom_sequences_are_skipped():
    item = struct.pack("<HHI", 0xFFFE, 0xE000, 4) + b"abcd" + struct.pack("<HHI", 0xFFFE, 0xE0DD, 0)
    data = image(bytes(4))
    at = data.index(struct.pack("<HH", 0x0028, 0x0002))
    sequence = struct.pack("<HH", 0x0020, 0x9999) + b"SQ\0\0" + struct.pack("<I", 0xFFFFFFFF) + item
    assert dicom.parse(data[:at] + sequence + data[at:]).number("rows") == 2


def test_rle_and_fragments():
    plane = bytes([3, 1, 2, 3, 4])  # four literal bytes
    rle = struct.pack("<16I", 1, 64, *[0] * 14) + plane
    assert dicom.unpack_rle(rle, 4, 1) == bytes([1, 2, 3, 4])
    high, low = bytes([253, 1]), bytes([3, 10, 20, 30, 40])
    two = struct.pack("<16I", 2, 64, 66, *[0] * 13) + high + low
    assert np.frombuffer(dicom.unpack_rle(two, 4, 2), "<u2").tolist() == [266, 276, 286, 296]
    body = struct.pack("<HHI", 0xFFFE, 0xE000, 0) + struct.pack("<HHI", 0xFFFE, 0xE000, len(rle)) + rle + struct.pack("<HHI", 0xFFFE, 0xE0DD, 0)
    data = image(b"", syntax=dicom.RLE)
    at = data.index(struct.pack("<HH", 0x7FE0, 0x0010))
    data = data[:at] + struct.pack("<HH", 0x7FE0, 0x0010) + b"OB\0\0" + struct.pack("<I", 0xFFFFFFFF) + body
    assert dicom.raw_pixels(dicom.parse(data)).ravel().tolist() == [1, 2, 3, 4]


def test_presentation():
    T = dicom.TAGS
    more = {T["rescale_slope"]: ("DS", b"2"), T["rescale_intercept"]: ("DS", b"-10"), T["window_center"]: ("DS", b"40"), T["window_width"]: ("DS", b"80"), T["photometric_interpretation"]: ("CS", b"MONOCHROME1")}
    pixels, steps = dicom.present(dicom.parse(image(bytes([0, 25, 30, 200]), more=more.items())))
    shown = dicom.window(np.array([-10, 40, 50, 390], np.float32), 40, 80)
    assert pixels.ravel().tolist() == (255 - shown).tolist() and steps[1:] == ["rescale", "window 40/80", "invert"]
    assert dicom.window(np.array([1.0, 2.0, 3.0]), 2, 1).tolist() == [0, 0, 255]
    signed = image(struct.pack("<4h", -5, 0, 5, 7), bits=16, more={T["pixel_representation"]: ("US", b"\1\0")}.items())
    assert dicom.raw_pixels(dicom.parse(signed)).ravel().tolist() == [-5, 0, 5, 7]
    with pytest.raises(dicom.DicomError):
        dicom.present(dicom.parse(image(bytes(4), syntax=dicom.JPEG_BASELINE)))


def java_jpeg(spark, pixels, colour=False):
    """A baseline file from the JVM's encoder."""
    jvm = spark._jvm
    kind = jvm.java.awt.image.BufferedImage.TYPE_INT_RGB if colour else jvm.java.awt.image.BufferedImage.TYPE_BYTE_GRAY
    h, w = pixels.shape
    picture = jvm.java.awt.image.BufferedImage(w, h, kind)
    for y in range(h):
        for x in range(w):
            v = int(pixels[y, x])
            if colour:
                picture.setRGB(x, y, v << 16 | v << 8 | v)
            else:
                picture.getRaster().setSample(x, y, 0, v)
    out = jvm.java.io.ByteArrayOutputStream()
    assert jvm.javax.imageio.ImageIO.write(picture, "jpg", out)
    return bytes(out.toByteArray())


@pytest.mark.parametrize("colour", [False, True])
def test_jpeg_pixels(spark, colour):
    y, x = np.mgrid[0:21, 0:27]
    pixels = (60 + 3 * x + 2 * y + 20 * ((x // 5 + y // 7) % 2)).astype(np.uint8)
    data = java_jpeg(spark, pixels, colour)
    d = dicom.parse(image(data, 21, 27, dicom.JPEG_BASELINE))
    shown = dicom.raw_pixels(d)
    assert shown.shape == (21, 27) and np.abs(shown - pixels.astype(int)).mean() < 4
    back = spark._jvm.javax.imageio.ImageIO.read(spark._jvm.java.io.ByteArrayInputStream(data)).getRaster()
    if not colour:
        want = np.array([[back.getSample(int(b), int(a), 0) for b in range(27)] for a in range(21)])
        assert np.abs(shown - want).max() <= 1
    with pytest.raises(dicom.DicomError):
        dicom.raw_pixels(dicom.parse(image(data, 20, 27, dicom.JPEG_BASELINE)))
    with pytest.raises(dicom.DicomError):
        dicom.raw_pixels(dicom.parse(image(data[:200], 21, 27, dicom.JPEG_BASELINE)))


def test_dicom_folder(spark, tmp_path):
    from voxelframe.operators import inventory

    data = image(bytes([1, 2, 3, 4]))
    (tmp_path / "a.dcm").write_bytes(data)
    (tmp_path / "b").write_bytes(data)
    (tmp_path / "c.dcm").write_bytes(image(bytes([9, 2, 3, 4]), more={dicom.TAGS["sop_instance_uid"]: ("UI", b"9.9")}.items()))
    (tmp_path / "d.txt").write_bytes(data)
    (tmp_path / "e.ima").write_bytes(b"junk")
    found, errors = dicom.scan(spark, str(tmp_path))
    assert found.count() == 3 and errors.count() == 1
    summary = inventory.scan_summary(found, ["sop_instance_uid", "pixel_hash"], __import__("pyspark").sql.functions.size("warnings")).first()
    assert (summary["records"], summary["duplicate_sop_instance_uid"], summary["duplicate_pixel_hash"]) == (3, 1, 1)
    twice = inventory.duplicates(found, "sop_instance_uid").first()
    assert twice["n"] == 2 and [p[-1] for p in twice["paths"]] == ["m", "b"]
    spacing = {r["field"]: r for r in inventory.spacing_summary(found).collect()}
    assert spacing["row_spacing"]["count"] == 3 and spacing["column_spacing"]["mean"] == 0.25


def test_label_tables(spark, tmp_path):
    (tmp_path / "l.csv").write_text("Subject_ID,study_id,Pneumonia,No Finding\n1,10,1,0\n2,20,0,1.0\n3,30,-1,\n3,30,-1.0,2\n")
    got = {(r["subject_id"], r["target"]): r["value"] for r in tabular.label_table(spark, str(tmp_path / "l.csv")).collect()}
    assert got == {("1", "Pneumonia"): 1, ("1", "No Finding"): 0, ("2", "Pneumonia"): 0, ("2", "No Finding"): 1, ("3", "Pneumonia"): -1, ("3", "No Finding"): None}
    maps = {r["subject_id"]: r["labels"] for r in tabular.label_maps(tabular.label_table(spark, str(tmp_path / "l.csv"))).collect()}
    assert maps["2"] == {"No Finding": 1, "Pneumonia": 0}
    (tmp_path / "z.csv.gz").write_bytes(gzip.compress(b"a,b\n1\n2, x \n"))
    rows = tabular.with_aliases(tabular.read_csv(spark, str(tmp_path / "z.csv.gz")), {"id": ["A"], "text": ["q", "B"]}).collect()
    assert [tuple(r) for r in rows] == [("1", None), ("2", "x")]


def test_files_and_documents(spark, tmp_path):
    for name in ("x/i1.png", "y/i1.jpg", "y/i2.jpeg", "y/i3.gif"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"12345")
    got = {r["image_id"]: r["image_path"][-8:] for r in tabular.image_listing(spark, str(tmp_path)).collect()}
    assert got == {"i1": "y/i1.jpg", "i2": "/i2.jpeg"}
    assert tabular.directory_bytes(spark, str(tmp_path)) == 20
    sinks.write_json(spark, str(tmp_path / "s.json"), {"train": ["b", "a"], "test": ["c"]})
    assert sorted(tuple(r) for r in tabular.split_lists(spark, str(tmp_path / "s.json")).collect()) == [("a", "train", 1), ("b", "train", 0), ("c", "test", 0)]
    df = spark.createDataFrame([(1, "a", None), (2, "b", 1.5)], "k long, t string, v double")
    assert sinks.verified_jsonl(df, str(tmp_path / "j"), "k") == 2
    with pytest.raises(ValueError):
        tabular.read_patches(spark, str(tmp_path / "none"), df.schema) if sinks.write_jsonl(df.where("false"), str(tmp_path / "none")) is None else None
    text = sinks.report("R", {"Facts": {"a": 1}, "Rows": df})
    assert "| 1 | a |  |" in text and "- a: 1" in text
    shards = sinks.tar_shards(spark.createDataFrame([(0, "p", bytearray(b"im"), 3), (1, "q", bytearray(b"in"), 4)], "shard long, key string, png binary, m long"), "key", "png", ["m"])
    members = {(r["key"], r["suffix"]): bytes(r["content"]) for r in sinks.read_shards(shards).collect()}
    assert members == {("p", "png"): b"im", ("p", "json"): b'{"m": 3}', ("q", "png"): b"in", ("q", "json"): b'{"m": 4}'}


def test_challenge_boxes(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([("-10", "5", "30", "10"), ("200", "5", "3", "3"), ("x", "1", "1", "1")], "x string, y string, w string, h string")
    got = [r["b"] for r in rows.select(challenge.clamp_box(F.col("x"), F.col("y"), F.col("w"), F.col("h"), F.lit("100"), F.lit("50")).alias("b")).collect()]
    assert got[1] is None and got[2] is None
    assert (got[0]["x1"], got[0]["width"], got[0]["area_fraction"], got[0]["center_x_fraction"]) == (0, 20, 0.04, 0.1)
    names = spark.createDataFrame([(["Normal"],), (["Lung Opacity", "Normal"],), (["?"],)], "n array<string>")
    assert [r[0] for r in names.select(challenge.final_label(F.col("n"))).collect()] == [0, 1, None]
    m = spark.createDataFrame([("a",), ("b",), ("c",), (None,)], "sop_uid string")
    rows = challenge.records(m, spark.createDataFrame([("a", 1), ("b", 0)], "sop_uid string, label int"), spark.createDataFrame([("a", "p"), ("c", "q")], "sop_uid string, path string"))
    assert {r["reason"]: r["n"] for r in challenge.skip_counts(rows).collect()} == {"kept": 1, "missing_file": 1, "missing_label": 1, "missing_uid": 1}


def test_telemetry(spark):
    text = ["7f00-7f10 rw-p 00000000 00:00 0 ", "Pss:   4 kB", "Private_Dirty:  3 kB", "8f00-8f10 r--p 0 08:01 12 /data/train-images.dat", "Pss:  10 kB", "Private_Clean: 1 kB"]
    lines = spark.createDataFrame([("p", i, t) for i, t in enumerate(text)], "process string, number int, text string")
    assert sorted(tuple(r) for r in telemetry.map_memory(lines).collect()) == [("anon", 4, 3), ("cache_images", 10, 1)]
    gpu = spark.createDataFrame([("55 %, 1024 MiB",), ("bad",)], "text string")
    assert [tuple(r) for r in telemetry.gpu_samples(gpu).collect()] == [(55.0, 1024.0)]


class Captured:
    """Rows whose function over Arrow batches is kept, to be run here."""

    def select(self, *_):
        return self

    where = drop = select

    def mapInArrow(self, run, schema):
        self.run = run
        return self


def test_files_of_a_batch_are_made_and_read_in_slices(spark):
    """However many files a batch holds, a worker makes objects of a small part of them, and sends that part before the next."""
    made, count = [], 1_000

    def make(doc_id, text):
        made.append(doc_id)
        return f"/f/{doc_id}.dcm", dicom.build({dicom.TAGS["pixel_data"]: ("OB", [text.encode()])}, dicom.JPEG_BASELINE)

    batch = pa.RecordBatch.from_pydict({"doc_id": range(count), "text": [f"text {i}" for i in range(count)]})
    parts, sizes = [], [0]
    for part in files.made(Captured(), make).run(iter([batch, batch])):
        sizes.append(len(made))
        parts.append(part)
    assert len(made) == 2 * count and max(b - a for a, b in zip(sizes, sizes[1:], strict=False)) <= 200
    whole = pa.Table.from_batches(parts).combine_chunks().to_batches()
    for read, filled in ((dicom.inventory_of, "pixel_hash"), (nifti.headers_of, "error")):
        captured = Captured()
        read(captured)
        got = list(captured.run(iter(whole)))
        table = pa.Table.from_batches(got)
        assert max(g.num_rows for g in got) <= 200 and None not in table[filled].to_pylist()
        assert table["path"].to_pylist() == whole[0]["path"].to_pylist()
