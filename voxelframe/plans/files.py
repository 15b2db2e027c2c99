"""Registered queries of the file formats: files are made from the tables' rows, then read by the sources.

A file is a row (path, content), as Spark's ``binaryFile`` gives them; which
variant of a format a row becomes, and which files are broken, goes by its
number, in the query and in its SQL alike.
"""

from __future__ import annotations

import gzip
import struct
import tempfile
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from voxelframe.functions import labels, text
from voxelframe.functions.arrow import slices
from voxelframe.operators import artifacts, dataset, images, sampling, splits, volumes
from voxelframe.plans import views
from voxelframe.plans.catalogue import query
from voxelframe.sources import challenge, dicom, nifti, sinks, tabular

FILE = "path string, content binary"


def made(rows: DataFrame, make: Callable[..., tuple[str, bytes]]) -> DataFrame:
    """(path, content) of each row by ``make(**row)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            files = [make(**row) for row in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in files], pa.string()), pa.array([f[1] for f in files], pa.binary())], ["path", "content"])

    return rows.mapInArrow(run, FILE)


def number(path) -> Any:
    """The row's number, which is the file's name."""
    return F.regexp_extract(path, r"(\d+)\.[a-z.]+$", 1).cast("long")


def folder(spark: SparkSession) -> str:
    """A new folder that all executors share."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        shared = "file://" + tempfile.mkdtemp(prefix="files-")
    return f"{shared.rstrip('/')}/{uuid.uuid4().hex}"


# NIfTI ---------------------------------------------------------------------------


def _header_file(vec_id: int, values: list[float]) -> tuple[str, bytes]:
    v = vec_id
    form: dict[str, Any] = {}
    if v % 3 == 1:
        form["sform"] = np.array([[2.0, 0, 0, v % 10], [0, 3, 0, -1], [0, 0, 4, 5], [0, 0, 0, 1]])
    elif v % 3 == 2:
        form["qform"] = (0.0, 0.0, 1.0, 1.0, 2.0, float(v % 10))  # half a turn about z
    data = nifti.build((4, 4, 4), np.abs(np.array(values)), (2, 4, 16, 64)[v % 4], (1.0 + v % 3, 2.0, 0.5), "<>"[v % 2], **form)
    data = data[:100] if v % 7 == 0 else data
    return (f"/data/case{v}.nii.gz", gzip.compress(data)) if v % 5 == 0 else (f"/data/case{v}.nii", data)


@query("""SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN NULL ELSE ['u8', 'i16', 'f32', 'f64'][1 + vec_id % 4] END AS dtype, CASE WHEN vec_id % 7 = 0 THEN NULL ELSE 64 END AS voxels,
    CASE WHEN vec_id % 7 = 0 THEN NULL WHEN vec_id % 3 = 1 THEN 2.0 WHEN vec_id % 3 = 2 THEN 3.0 ELSE 1.0 END AS spacing_x, CASE WHEN vec_id % 7 = 0 THEN NULL WHEN vec_id % 3 = 1 THEN 4.0 ELSE 0.5 END AS spacing_z,
    CASE WHEN vec_id % 7 = 0 THEN NULL WHEN vec_id % 3 = 1 THEN vec_id % 10 WHEN vec_id % 3 = 2 THEN 1.0 ELSE 0.0 END AS origin_x, CASE WHEN vec_id % 7 = 0 THEN NULL WHEN vec_id % 3 = 1 THEN 5.0 WHEN vec_id % 3 = 2 THEN vec_id % 10 ELSE 0.0 END AS origin_z,
    CASE WHEN vec_id % 7 = 0 THEN NULL WHEN vec_id % 3 = 2 THEN -1.0 ELSE 1.0 END AS direction_x, vec_id % 7 = 0 AS failed FROM embeddings""")
def nifti_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers of either byte order, packed or not, with an sform, a qform or neither; some are cut off."""
    files = made(views.volumes(spark, sf_dir).select("vec_id", "values"), _header_file)
    at = lambda c, i: F.round(F.get(c, F.lit(i)), 6)
    voxels = F.get("shape", F.lit(0)) * F.get("shape", F.lit(1)) * F.get("shape", F.lit(2))
    return nifti.headers_of(files).select(
        number("path").alias("vec_id"), "dtype", voxels.alias("voxels"), at("spacing", 0).alias("spacing_x"), at("spacing", 2).alias("spacing_z"),
        at("origin", 0).alias("origin_x"), at("origin", 2).alias("origin_z"), at("direction", 0).alias("direction_x"), F.col("error").isNotNull().alias("failed"),
    )


def _scaled_file(vec_id: int, values: list[float]) -> tuple[str, bytes]:
    return f"/data/{vec_id}.nii", nifti.build((4, 4, 4), np.floor(np.array(values, float) * 100), 4, order="<>"[vec_id % 2], slope=0.5 if vec_id % 3 else 0.0, intercept=3.0)


@query("""SELECT vec_id, count(*) AS voxels, CAST(sum(CASE WHEN vec_id % 3 = 0 THEN v ELSE v * 0.5 + 3 END) AS DOUBLE) AS total, CAST(max(CASE WHEN i = 6 THEN CASE WHEN vec_id % 3 = 0 THEN v ELSE v * 0.5 + 3 END END) AS DOUBLE) AS sixth
    FROM (SELECT vec_id, i, floor(CAST(embedding[i] AS DOUBLE) * 100) AS v FROM embeddings, range(1, 65) r(i)) GROUP BY vec_id""")
def nifti_voxels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """16-bit voxels of either byte order, scaled; a slope of zero means no scaling."""
    files = made(views.volumes(spark, sf_dir).select("vec_id", "values"), _scaled_file)
    total = F.aggregate("values", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return nifti.volumes_of(files).select(number("path").alias("vec_id"), F.size("values").cast("long").alias("voxels"), total.alias("total"), F.get("values", F.lit(5)).cast("double").alias("sixth"))


def _label_file(vec_id: int, values: list[float]) -> tuple[str, bytes]:
    found = np.floor(np.abs(np.array(values, float)) * 10)
    found[3] = {0: 0.5, 1: -1.0, 2: 70000.0, 3: np.nan}.get(vec_id % 11, found[3])
    return f"/labels/{vec_id}.nii", nifti.build((4, 4, 4), found, 16)


@query("""SELECT vec_id, vec_id % 11 < 4 AS failed, CASE WHEN vec_id % 11 < 4 THEN NULL ELSE CAST(sum(floor(abs(CAST(embedding[i] AS DOUBLE)) * 10)) AS BIGINT) END AS label_sum FROM embeddings, range(1, 65) r(i) GROUP BY vec_id""")
def nifti_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels must be whole numbers from 0 to 65535; other files are errors."""
    files = made(views.volumes(spark, sf_dir).select("vec_id", "values"), _label_file)
    total = F.aggregate("values", F.lit(0.0), lambda a, x: a + x.cast("double")).cast("long")
    return nifti.volumes_of(files, labels=True).select(number("path").alias("vec_id"), F.col("error").isNotNull().alias("failed"), total.alias("label_sum"))


NAMES = "SELECT '/data/' || source || '/case_' || CAST(doc_id % 37 AS VARCHAR) || '_000' || CAST(doc_id % 4 AS VARCHAR) || ['.nii', '.nii.gz', '.NII', '.txt', '.nii.gz.bak'][CAST(1 + doc_id // 37 % 5 AS INT)] AS path FROM documents"


def _named(spark: SparkSession, sf_dir: str) -> DataFrame:
    suffix = F.get(F.array(*[F.lit(s) for s in (".nii", ".nii.gz", ".NII", ".txt", ".nii.gz.bak")]), (F.floor(F.col("doc_id") / 37) % 5).cast("int"))
    documents = views.table(spark, sf_dir, "documents")
    return documents.select(F.concat(F.lit("/data/"), "source", F.lit("/case_"), (F.col("doc_id") % 37).cast("string"), F.lit("_000"), (F.col("doc_id") % 4).cast("string"), suffix).alias("path"))


@query(f"""WITH p AS ({NAMES}), s AS (SELECT path, regexp_replace(regexp_extract(path, '[^/]+$'), '\\.nii(\\.gz)?$', '', 'i') AS stem FROM p WHERE regexp_matches(lower(path), '\\.nii(\\.gz)?$'))
    SELECT regexp_extract(stem, '^(.+)_(0[0-9]{{3}})$', 1) AS case_id, string_agg(path, ' ' ORDER BY path) AS paths, count(*) AS files FROM s GROUP BY 1""")
def nifti_case_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of each case, channel numbers stripped; other files are left out."""
    return nifti.indexed(_named(spark, sf_dir)).select("case_id", F.array_join("paths", " ").alias("paths"), F.size("paths").cast("long").alias("files"))


@query("""SELECT '/d/s' || CAST(doc_id AS VARCHAR) || '.hdr' AS header, CASE doc_id % 4 WHEN 0 THEN '/d/s' || CAST(doc_id AS VARCHAR) || '.img' WHEN 1 THEN '/d/s' || CAST(doc_id AS VARCHAR) || '.img.gz' WHEN 2 THEN '/d/s' || CAST(doc_id AS VARCHAR) || '.img' END AS pixels FROM documents""")
def nifti_detached_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers with their plain or else packed pixels, some with both, some with none."""
    base = F.concat(F.lit("/d/s"), F.col("doc_id").cast("string"))
    rest = F.when(F.col("doc_id") % 4 == 0, F.array(F.lit(".img"))).when(F.col("doc_id") % 4 == 1, F.array(F.lit(".img.gz"))).when(F.col("doc_id") % 4 == 2, F.array(F.lit(".img"), F.lit(".img.gz"))).otherwise(F.array().cast("array<string>"))
    files = views.table(spark, sf_dir, "documents").select(base.alias("b"), F.explode(F.concat(F.array(F.lit(".hdr")), rest)).alias("s"))
    return nifti.pairs_of(files.select(F.concat("b", "s").alias("path")))


# DICOM ---------------------------------------------------------------------------

SYNTAXES = (dicom.IMPLICIT_LITTLE, dicom.EXPLICIT_LITTLE, dicom.EXPLICIT_BIG)


def _short(n: int, big: bool = False) -> tuple[str, bytes]:
    return "US", struct.pack(">H" if big else "<H", n)


def _dicom_file(doc_id: int, source: str | None, lang: str | None) -> tuple[str, bytes]:
    d, t, syntax = doc_id, dicom.TAGS, SYNTAXES[doc_id % 3]
    big = syntax == dicom.EXPLICIT_BIG
    e: dict = {t["modality"]: ("CS", b"CR" if d % 2 else b"DX"), t["rows"]: _short(d % 7, big), t["columns"]: _short(5, big), t["sop_instance_uid"]: ("UI", b"1.2.%d" % d), t["pixel_data"]: ("OB", b"%d" % d * 4)}
    e |= {t[n]: ("UI", b"1.%d" % (d % 5)) for n in ("study_instance_uid", "series_instance_uid")}
    if source is not None:
        e[t["patient_id"]] = ("LO", source.encode())
    if d % 4 == 0:
        e[t["patient_name"]] = ("PN", b"Doe^Jo")
    if d % 5 == 0:
        e[t["image_laterality"]] = ("CS", b"L")
    if d % 3 == 0:
        e[t["series_laterality"]] = ("CS", b"R")
    if d % 6:
        e[t["view_position"]] = ("CS", b"PA")
        e[t["pixel_spacing"]] = ("DS", b"0.5\\0.25")
    data = dicom.build(e, syntax)
    return f"/dicom/{d}.dcm", data[:90] if d % 13 == 0 else data


INVENTORY_SQL = """SELECT doc_id, ['1.2.840.10008.1.2', '1.2.840.10008.1.2.1', '1.2.840.10008.1.2.2'][CAST(1 + doc_id % 3 AS INT)] AS syntax, source AS patient_id, CASE WHEN doc_id % 2 = 1 THEN 'CR' ELSE 'DX' END AS modality, CAST(doc_id % 7 AS INT) AS rows,
    CASE WHEN doc_id % 5 = 0 THEN 'L' WHEN doc_id % 3 = 0 THEN 'R' END AS laterality, CASE WHEN doc_id % 6 > 0 THEN 0.25 END AS spacing_x, sha256(encode(repeat(CAST(doc_id AS VARCHAR), 4) || CASE WHEN length(CAST(doc_id AS VARCHAR)) * 4 % 2 = 1 THEN chr(0) ELSE '' END)) AS pixel_hash,
    array_to_string(list_filter([CASE WHEN doc_id % 4 = 0 THEN 'phi_patient_name' END, CASE WHEN source IS NULL THEN 'missing_patient_id' END, CASE WHEN doc_id % 6 = 0 THEN 'missing_view_position' END, CASE WHEN doc_id % 6 = 0 THEN 'missing_pixel_spacing' END, CASE WHEN doc_id % 7 = 0 THEN 'invalid_image_dimensions' END], lambda x: x IS NOT NULL), ',') AS warnings
    FROM documents WHERE doc_id % 13 > 0"""


def _scanned(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    files = made(views.table(spark, sf_dir, "documents").select("doc_id", "source", "lang"), _dicom_file)
    return dicom.inventory_of(dicom.candidates_of(files))


@query(INVENTORY_SQL)
def dicom_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part-10 files of three syntaxes as inventory rows, with their warnings."""
    rows = _scanned(spark, sf_dir)[0]
    return rows.select(
        number("path").alias("doc_id"), F.col("transfer_syntax_uid").alias("syntax"), "patient_id", "modality", F.col("rows").cast("int").alias("rows"), "laterality",
        F.get("pixel_spacing", F.lit(1)).cast("double").alias("spacing_x"), "pixel_hash", F.array_join(F.transform("warnings", lambda w: w["code"]), ",").alias("warnings"),
    )


@query("SELECT doc_id, '/dicom/' || CAST(doc_id AS VARCHAR) || '.dcm' AS path FROM documents WHERE doc_id % 13 = 0")
def dicom_scan_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that are cut off before their preamble ends are error rows."""
    return _scanned(spark, sf_dir)[1].select(number("path").alias("doc_id"), "path")


@query("""WITH p AS (SELECT '/f/' || CAST(doc_id AS VARCHAR) || ['.dcm', '.DC', '', '.dicom', '.ima', '.txt', '.jpg', '.dcm.gz'][CAST(1 + doc_id % 8 AS INT)] AS path FROM documents) SELECT path FROM p WHERE regexp_matches(path, '(?i)/[0-9]+(\\.(dc|dcm|dicom|ima))?$')""")
def dicom_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    suffix = F.get(F.array(*[F.lit(s) for s in (".dcm", ".DC", "", ".dicom", ".ima", ".txt", ".jpg", ".dcm.gz")]), (F.col("doc_id") % 8).cast("int"))
    return dicom.candidates_of(views.table(spark, sf_dir, "documents").select(F.concat(F.lit("/f/"), F.col("doc_id").cast("string"), suffix).alias("path")))


def _fragment_file(doc_id: int, text: str | None) -> tuple[str, bytes]:
    data = (text or "").encode()
    cut = len(data) // 3
    return f"/f/{doc_id}.dcm", dicom.build({dicom.TAGS["pixel_data"]: ("OB", [data[:cut], data[cut:]])}, dicom.JPEG_BASELINE)


@query("SELECT doc_id, sha256(encode(coalesce(text, ''))) AS pixel_hash FROM documents")
def dicom_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encapsulated pixel data: fragments are joined, the offset table is not part of them."""
    files = made(views.table(spark, sf_dir, "documents").select("doc_id", "text"), _fragment_file)
    return dicom.inventory_of(files)[0].select(number("path").alias("doc_id"), "pixel_hash")


def _display(spark: SparkSession, sf_dir: str, make: Callable[..., tuple[str, bytes]], show: Callable[[dicom.DataSet], np.ndarray]) -> DataFrame:
    """(vec_id, first, total, n) of the pixels that ``show`` makes of each file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = [show(dicom.parse(content)).astype(np.float64).ravel() for content in batch.column("content").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array([float(x[0]) for x in out]), pa.array([float(x.sum()) for x in out]), pa.array([len(x) for x in out], pa.int64())], ["path", "first", "total", "n"])

    files = made(views.volumes(spark, sf_dir).select("vec_id", "values"), make)
    return files.mapInArrow(run, "path string, first double, total double, n long").select(number("path").alias("vec_id"), F.round("first", 3).alias("first"), F.round("total", 3).alias("total"), "n")


def _pixels(values: list[float], scale: float, **more: tuple[str, bytes]) -> dict:
    """An 8 x 8 image of 16-bit samples, 12 of them stored, two's complement."""
    stored = np.floor(np.array(values, float) * scale).astype(np.int64) & 0xFFF
    t = dicom.TAGS
    e = {t["rows"]: _short(8), t["columns"]: _short(8), t["bits_allocated"]: _short(16), t["bits_stored"]: _short(12), t["pixel_representation"]: _short(1), t["pixel_data"]: ("OW", stored.astype("<u2").tobytes())}
    return e | {t[n]: v for n, v in more.items()}


@query("""SELECT vec_id, CAST(max(CASE WHEN i = 1 THEN v END) AS DOUBLE) AS first, CAST(sum(v) AS DOUBLE) AS total, count(*) AS n FROM (SELECT vec_id, i, floor(CAST(embedding[i] AS DOUBLE) * 1000) AS v FROM embeddings, range(1, 65) r(i)) GROUP BY vec_id""")
def dicom_signed_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twelve bits of sixteen, masked and sign-extended."""
    return _display(spark, sf_dir, lambda vec_id, values: (f"/p/{vec_id}.dcm", dicom.build(_pixels(values, 1000))), dicom.raw_pixels)


def _rle_file(vec_id: int, values: list[float]) -> tuple[str, bytes]:
    e = _pixels(values, 20)
    stored = np.frombuffer(e[dicom.TAGS["pixel_data"]][1], "<u2")
    planes = dicom.rle([(stored >> 8).astype(np.uint8).tobytes(), (stored & 255).astype(np.uint8).tobytes()])
    return f"/p/{vec_id}.dcm", dicom.build(e | {dicom.TAGS["pixel_data"]: ("OB", [planes])}, dicom.RLE)


@query("""SELECT vec_id, CAST(max(CASE WHEN i = 1 THEN v END) AS DOUBLE) AS first, CAST(sum(v) AS DOUBLE) AS total, count(*) AS n FROM (SELECT vec_id, i, floor(CAST(embedding[i] AS DOUBLE) * 20) AS v FROM embeddings, range(1, 65) r(i)) GROUP BY vec_id""")
def dicom_rle_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RLE Lossless: byte planes of runs and literals."""
    return _display(spark, sf_dir, _rle_file, dicom.raw_pixels)


def _window_file(vec_id: int, values: list[float]) -> tuple[str, bytes]:
    more = {"rescale_slope": ("DS", b"2"), "rescale_intercept": ("DS", b"-10"), "window_center": ("DS", b"40"), "window_width": ("DS", b"256 " if vec_id % 2 else b"1 "), "photometric_interpretation": ("CS", b"MONOCHROME1 " if vec_id % 3 == 0 else b"MONOCHROME2 ")}
    return f"/p/{vec_id}.dcm", dicom.build(_pixels(values, 300, **more))


@query("""WITH v AS (SELECT vec_id, i, floor(CAST(embedding[i] AS DOUBLE) * 300) * 2 - 10 AS v FROM embeddings, range(1, 65) r(i)),
    w AS (SELECT vec_id, i, CASE WHEN vec_id % 2 = 1 THEN least(greatest(v - 40 + 128, 0), 255) WHEN v > 40 THEN 255 ELSE 0 END AS w FROM v), o AS (SELECT vec_id, i, CASE WHEN vec_id % 3 = 0 THEN 255 - w ELSE w END AS o FROM w)
    SELECT vec_id, CAST(max(CASE WHEN i = 1 THEN o END) AS DOUBLE) AS first, CAST(sum(o) AS DOUBLE) AS total, count(*) AS n FROM o GROUP BY vec_id""")
def dicom_windowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Presentation: rescaled, a linear window or a threshold, inverted for MONOCHROME1."""
    return _display(spark, sf_dir, _window_file, lambda d: dicom.present(d)[0])


def _colour_file(vec_id: int, values: list[float]) -> tuple[str, bytes]:
    t = dicom.TAGS
    samples = np.floor(np.abs(np.array(values[:63], float)) * 200).clip(0, 255).astype(np.uint8)
    e = {t["rows"]: _short(7), t["columns"]: _short(3), t["samples_per_pixel"]: _short(3), t["bits_allocated"]: _short(8), t["photometric_interpretation"]: ("CS", b"YBR_FULL" if vec_id % 2 else b"RGB "), t["pixel_data"]: ("OB", samples.tobytes())}
    return f"/p/{vec_id}.dcm", dicom.build(e)


@query("""WITH v AS (SELECT vec_id, p, [least(floor(abs(CAST(embedding[3 * p + k] AS DOUBLE)) * 200), 255) for k in [1, 2, 3]] AS c FROM embeddings, range(0, 21) r(p)), l AS (SELECT vec_id, p, CASE WHEN vec_id % 2 = 1 THEN c[1] ELSE 0.299 * c[1] + 0.587 * c[2] + 0.114 * c[3] END AS y FROM v)
    SELECT vec_id, round(CAST(max(CASE WHEN p = 0 THEN y END) AS DOUBLE), 3) AS first, round(CAST(sum(round(y, 3)) AS DOUBLE), 3) AS total, count(*) AS n FROM l GROUP BY vec_id""")
def dicom_luma(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Colour to luma: weighted RGB, or the first sample of YBR."""
    return _display(spark, sf_dir, _colour_file, lambda d: np.round(dicom.to_luma(dicom.raw_pixels(d), d.text("photometric_interpretation")).astype(np.float64), 3))


def _inspected(doc_id: int, source: str | None, lang: str | None) -> tuple[str, bytes]:
    return f"/f/{doc_id}.dcm", dicom.build({dicom.TAGS["patient_id"]: ("LO", (source or "").encode()), dicom.TAGS["view_position"]: ("CS", (lang or "").encode()), dicom.TAGS["pixel_data"]: ("OB", b"x" * 70)})


@query("""SELECT doc_id, unnest(['(0002,0010)', '(0010,0020)', '(0018,5101)', '(7FE0,0010)']) AS tag, unnest(['1.2.840.10008.1.2.1', coalesce(source, ''), coalesce(lang, ''), '70 bytes']) AS shown FROM documents""")
def dicom_inspection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags of single files with their display text; long values by their size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = [(p, tag, shown) for p, c in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True) for tag, shown in dicom.inspect(c).items()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)] if rows else [pa.array([], pa.string())] * 3, ["path", "tag", "shown"])

    files = made(views.table(spark, sf_dir, "documents").select("doc_id", "source", "lang"), _inspected)
    return files.mapInArrow(run, "path string, tag string, shown string").select(number("path").alias("doc_id"), "tag", "shown")


# tables of text, JSON and tar ----------------------------------------------------------


@query("""SELECT CAST(doc_id AS VARCHAR) AS subject_id, t.target, CASE t.target WHEN 'quality' THEN quality ELSE toxic END AS value FROM labels CROSS JOIN (VALUES ('quality'), ('toxic')) t(target)""")
def csv_label_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A packed CSV with other spellings of its columns, as long labels; blank cells are null."""
    path = folder(spark)
    rows = views.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("Subject_ID"), F.concat(F.lit("s"), F.col("doc_id").cast("string")).alias("STUDY_ID"), "quality", "toxic")
    rows.write.csv(path, header=True, compression="gzip")
    return tabular.label_table(spark, path).select("subject_id", "target", F.col("value").cast("int").alias("value"))


@query("SELECT doc_id, source, sha256(encode(text)) AS text_hash FROM documents")
def jsonl_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packed JSON lines, verified and read again."""
    path, rows = folder(spark), views.table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    sinks.verified_jsonl(rows, path, "doc_id")
    return tabular.read_jsonl(spark, path, StructType(rows.schema.fields)).select("doc_id", "source", F.sha2("text", 256).alias("text_hash"))


@query("SELECT CAST(n_nationkey AS VARCHAR) AS sample_id, ['train', 'val', 'test'][CAST(1 + n_nationkey % 3 AS INT)] AS split, CAST(row_number() OVER (PARTITION BY n_nationkey % 3 ORDER BY n_name DESC) - 1 AS INT) AS ordinal FROM nation")
def json_split_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A JSON document with a list for each split, read in list order."""
    path, nations = folder(spark), views.table(spark, sf_dir, "nation").orderBy(F.desc("n_name")).collect()
    sinks.write_json(spark, f"{path}/splits.json", {name: [str(r["n_nationkey"]) for r in nations if r["n_nationkey"] % 3 == i] for i, name in enumerate(("train", "val", "test"))})
    return tabular.split_lists(spark, f"{path}/splits.json").select("sample_id", "split", "ordinal")


@query("SELECT n_nationkey AS case_id, n_name AS name FROM nation")
def json_manifest_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases of a manifest that is one JSON document."""
    path, nations = folder(spark), views.table(spark, sf_dir, "nation").collect()
    sinks.write_json(spark, f"{path}/manifest.json", {"version": 1, "cases": [{"case_id": r["n_nationkey"], "name": r["n_name"]} for r in nations]})
    return tabular.read_cases(spark, f"{path}/manifest.json").select(F.col("case_id").cast("int").alias("case_id"), "name")


@query("""SELECT CAST(vec_id AS VARCHAR) AS key, unnest(['png', 'json']) AS suffix, unnest([CAST(vec_id * 7 AS VARCHAR), '{"label": ' || CAST(label AS VARCHAR) || '}']) AS content FROM embeddings""")
def tar_shard_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tar shards of 64 rows each, read back member by member."""
    rows = views.volumes(spark, sf_dir).select(F.floor(F.col("vec_id") / 64).alias("shard"), F.col("vec_id").cast("string").alias("key"), (F.col("vec_id") * 7).cast("string").cast("binary").alias("image"), "label")
    return sinks.read_shards(sinks.tar_shards(rows, "key", "image", ["label"])).select("key", "suffix", F.col("content").cast("string").alias("content"))


@query("""WITH p AS (SELECT '/i/' || ['a', 'b'][CAST(1 + doc_id % 2 AS INT)] || '/img' || CAST(doc_id // 2 AS VARCHAR) || ['.jpg', '.PNG', '.jpeg', '.gif'][CAST(1 + doc_id % 4 AS INT)] AS path FROM documents)
    SELECT regexp_extract(path, '([^/]+)\\.[a-zA-Z]+$', 1) AS image_id, max(path) AS image_path FROM p WHERE regexp_matches(lower(path), '\\.(jpg|jpeg|png)$') GROUP BY 1""")
def raster_image_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raster images by stem; of equal stems the greatest path."""
    at = lambda names, i: F.get(F.array(*[F.lit(n) for n in names]), i.cast("int"))
    i = F.col("doc_id")
    path = F.concat(F.lit("/i/"), at("ab", i % 2), F.lit("/img"), F.floor(i / 2).cast("string"), at((".jpg", ".PNG", ".jpeg", ".gif"), i % 4))
    return tabular.images_of(views.table(spark, sf_dir, "documents").select(path.alias("path")))


# predicates, joins and kernels ------------------------------------------------------------


@query("SELECT doc_id, upper(coalesce(['pa', 'AP', 'lateral', 'LL', NULL][CAST(1 + doc_id % 5 AS INT)], '')) IN ('PA', 'AP') AS frontal FROM documents")
def frontal_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    view = F.get(F.array(*[F.lit(v) for v in ("pa", "AP", "lateral", "LL", None)]), (F.col("doc_id") % 5).cast("int"))
    return views.table(spark, sf_dir, "documents").select("doc_id", text.is_frontal(view).alias("frontal"))


@query("SELECT doc_id, CAST(toxic AS INT) AS toxic, CAST(NULL AS INT) AS absent, 2 AS targets FROM labels")
def projected_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label maps reduced to wanted targets; one that a map lacks is null."""
    maps = F.create_map(F.lit("quality"), F.col("quality").cast("int"), F.lit("toxic"), F.col("toxic").cast("int"))
    found = views.table(spark, sf_dir, "labels").select("doc_id", labels.project_targets(maps, ["toxic", "absent"]).alias("m"))
    return found.select("doc_id", F.col("m")["toxic"].alias("toxic"), F.col("m")["absent"].alias("absent"), F.size("m").alias("targets"))


@query("""WITH c AS (SELECT user_id AS case_id, count(*) FILTER (WHERE event_type = 'click') AS images, count(*) FILTER (WHERE event_type = 'view') AS labels FROM events GROUP BY user_id),
    p AS (SELECT case_id, array_to_string(list_filter([CASE WHEN images = 0 THEN 'missing_image' END, CASE WHEN labels = 0 THEN 'missing_label' END, CASE WHEN images > 1 THEN 'duplicate_image' END, CASE WHEN labels > 1 THEN 'duplicate_label' END], lambda x: x IS NOT NULL), ',') AS problems FROM c)
    SELECT case_id, problems, CASE WHEN problems = '' THEN 'valid' ELSE 'invalid' END AS status FROM p""")
def case_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A case is valid if and only if it has no problem."""
    events = views.table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("case_id")).agg(F.count_if(F.col("event_type") == "click").alias("images"), F.count_if(F.col("event_type") == "view").alias("labels"))
    return dataset.with_problems(events).select("case_id", F.array_join("problems", ",").alias("problems"), "status")


@query("SELECT CAST(doc_id AS VARCHAR) AS sample_id, doc_id * 7919 % 100003 AS ordinal, n_chars FROM documents")
def ordered_list_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifest rows of a list, in its order; an unknown sample would be an error."""
    documents = views.table(spark, sf_dir, "documents")
    wanted = documents.select(F.col("doc_id").cast("string").alias("sample_id"), (F.col("doc_id") * 7919 % 100003).alias("ordinal"))
    return splits.in_list_order(wanted, documents.select(F.col("doc_id").cast("string").alias("sample_id"), "n_chars"))


def _patches(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    cases = views.volumes(spark, sf_dir).select(F.col("vec_id").alias("case_id"), F.array(*[F.lit(4)] * 3).alias("shape"), "values")
    start = F.array(*[(F.floor(F.col("case_id") / k) % 3).cast("int") for k in (1, 3, 9)])
    return cases.select(F.col("case_id").alias("index"), "case_id", start.alias("patch_start"), F.array(*[F.lit(2)] * 3).alias("patch_size")), cases


PATCH = """WITH p AS (SELECT vec_id AS case_id, embedding, vec_id % 3 AS x, (vec_id // 3) % 3 AS y, (vec_id // 9) % 3 AS z FROM embeddings), v AS (SELECT case_id, CAST(embedding[CAST(1 + (x + dx) + 4 * (y + dy) + 16 * (z + dz) AS INT)] AS DOUBLE) AS v FROM p, range(0, 2) a(dx), range(0, 2) b(dy), range(0, 2) c(dz))
    SELECT case_id, count(*) AS voxels, CAST(count(*) FILTER (WHERE v > 0.1) AS INT) AS foreground, round(sum(v), 4) AS total FROM v GROUP BY case_id"""


def _patch_sums(patches: DataFrame) -> DataFrame:
    total = F.aggregate("patch", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return patches.select("case_id", F.size("patch").cast("long").alias("voxels"), F.size(F.filter("patch", lambda x: x.cast("double") > 0.1)).alias("foreground"), F.round(total, 4).alias("total"))


@query(PATCH)
def patch_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patches cut from whole volumes, with their foreground counts."""
    patches, cases = _patches(spark, sf_dir)
    return _patch_sums(sampling.extract_whole(patches, cases))


@query(PATCH)
def patch_extraction_chunked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same patches put together from chunks of 2 x 2 x 2."""
    patches, cases = _patches(spark, sf_dir)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cubes = batch.column("values").flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, 4, 4, 4)
            rows = [(case, x, y, z, cube[2 * z : 2 * z + 2, 2 * y : 2 * y + 2, 2 * x : 2 * x + 2].tobytes()) for case, cube in zip(batch.column("case_id").to_pylist(), cubes, strict=True) for z in (0, 1) for y in (0, 1) for x in (0, 1)]
            columns = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()), strict=True)], ["case_id", "cx", "cy", "cz", "block"])

    chunks = cases.select(F.col("case_id").cast("long").alias("case_id"), "values").mapInArrow(cut, "case_id long, cx int, cy int, cz int, block binary")
    patches = patches.withColumns({"case_id": F.col("case_id").cast("long"), "index": F.col("index").cast("long")})
    return _patch_sums(sampling.extract_chunked(patches, chunks, (2, 2, 2)))


@query("""SELECT CAST(d.doc_id AS VARCHAR) AS sop_uid, l.toxic AS label, CASE WHEN d.doc_id % 9 > 0 THEN '/p/' || CAST(d.doc_id AS VARCHAR) END AS path, CASE WHEN d.doc_id % 9 = 0 THEN 'missing_file' WHEN l.toxic IS NULL THEN 'missing_label' END AS skip
    FROM documents d LEFT JOIN labels l USING (doc_id)""")
def challenge_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mappings joined with labels and files, with the first reason to skip each."""
    uid = F.col("doc_id").cast("string").alias("sop_uid")
    documents = views.table(spark, sf_dir, "documents").select("doc_id")
    paths = documents.select(uid, F.when(F.col("doc_id") % 9 > 0, F.concat(F.lit("/p/"), F.col("doc_id").cast("string"))).alias("path"))
    found = challenge.records(documents.select(uid), views.table(spark, sf_dir, "labels").select(uid, F.col("toxic").alias("label")), paths)
    return found.select("sop_uid", "label", "path", "skip")


@query("""WITH v AS (SELECT vec_id, i - 1 AS i, greatest(CAST(embedding[i] AS DOUBLE), 0) AS h FROM embeddings, range(1, 65) r(i)), r AS (SELECT vec_id, i, h, row_number() OVER (PARTITION BY vec_id ORDER BY h DESC, i) AS r, i % 8 BETWEEN 2 AND 5 AND i // 8 BETWEEN 2 AND 5 AS boxed FROM v),
    m AS (SELECT vec_id, min(h) AS lo, max(h) AS hi FROM v GROUP BY vec_id)
    SELECT vec_id, CAST(max(CASE WHEN r = 1 AND boxed THEN 1 ELSE 0 END) AS DOUBLE) AS hit, round(count(*) FILTER (WHERE r <= 7 AND boxed) / count(*) FILTER (WHERE r <= 7 OR boxed), 6) AS iou, round(count(*) FILTER (WHERE r <= 7 AND boxed) / 16.0, 6) AS coverage,
    round(sum(CASE WHEN hi > lo THEN (h - lo) / (hi - lo) ELSE 0 END), 4) AS heat FROM r JOIN m USING (vec_id) GROUP BY vec_id""")
def cam_localization(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heat maps of 8 x 8 against a box: the peak's hit, overlap and coverage of the top tenth."""
    mask = images.box_mask([(0.25, 0.25, 0.75, 0.75)], 8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heats = [images.normalize_heat(h) for h in batch.column("values").flatten().to_numpy(zero_copy_only=False).reshape(-1, 8, 8)]
            got = [images.cam_metrics(h, mask, (0.1,)) for h in heats]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), *[pa.array([g[n] for g in got], pa.float64()) for n in ("hit", "iou_0.1", "coverage_0.1")], pa.array([float(h.sum()) for h in heats])], ["vec_id", "hit", "iou", "coverage", "heat"])

    rows = views.volumes(spark, sf_dir).select(F.col("vec_id").cast("long").alias("vec_id"), "values")
    found = rows.mapInArrow(run, "vec_id long, hit double, iou double, coverage double, heat double")
    return found.withColumns({"iou": F.round("iou", 6), "coverage": F.round("coverage", 6), "heat": F.round("heat", 4)})


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN 1 ELSE CAST(round((o_orderkey % 9) * (1.0 + o_orderkey % 4) / 2.5) + 1 AS INT) END AS n FROM orders")
def resampled_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of volumes at another spacing; a single slice stays one."""
    rows = views.table(spark, sf_dir, "orders")
    return rows.select("o_orderkey", volumes.resampled_shape(F.col("o_orderkey") % 9 + 1, F.lit(1.0) + F.col("o_orderkey") % 4, F.lit(2.5)).alias("n"))


@query("""SELECT 'r' || CAST(c_custkey AS VARCHAR) AS run_id, unnest(list_filter([CASE WHEN c_custkey % 7 = 0 THEN 'summary.samples' END, CASE WHEN c_custkey % 5 = 0 THEN 'provenance.seed' END, CASE WHEN c_custkey % 11 = 0 THEN 'summary.loader_samples_per_second' END,
    CASE WHEN c_custkey % 13 = 0 THEN 'manifest split sample total' END, CASE WHEN c_custkey % 17 = 0 THEN 'summary.quality_gate missing' END], lambda x: x IS NOT NULL)) AS rule FROM customer""")
def run_artifact_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run for each customer, its JSON documents checked against each other."""
    k = F.col("c_custkey")
    n, off = k % 100 + 10, lambda m: F.when(k % m == 0, 1).otherwise(0)
    train, val = n - 5, F.lit(5) + off(13)
    run = F.concat(F.lit("r"), k.cast("string"))
    doc = lambda name, *cells: F.struct(F.lit(name).alias("artifact"), F.to_json(F.struct(*cells)).alias("document"))
    counts, metadata = F.struct(train.alias("train"), val.alias("val")), F.struct(run.alias("run_id"), F.lit(1).alias("seed"))
    provenance = F.struct(run.alias("run_id"), n.alias("samples"), (F.lit(1) + off(5)).alias("seed"), counts.alias("splits"), F.struct(F.struct(train.alias("train")).alias("split_samples")).alias("cache"))
    rate = F.struct((F.round(k / 7, 3) + off(11)).alias("own"))
    gate = F.when(k % 17 > 0, F.struct(F.lit("ok").alias("status")))
    documents = F.array(
        doc("summary", run.alias("run_id"), (n + off(7)).alias("samples"), provenance.alias("provenance"), rate.alias("loader_samples_per_second"), gate.alias("quality_gate")).alias("d"),
        doc("metadata", run.alias("run_id"), F.lit(1).alias("seed")), doc("manifest", n.alias("samples")), doc("split", counts.alias("counts")),
        doc("cache", F.struct(F.struct(train.alias("samples")).alias("train")).alias("splits")), doc("environment", metadata.alias("run_metadata")), doc("loader", F.struct((k / 7).alias("samples_per_second")).alias("own")),
    )
    rows = views.table(spark, sf_dir, "customer").select(run.alias("run_id"), F.explode(documents).alias("d")).select("run_id", "d.artifact", "d.document")
    return artifacts.run_errors(rows)
