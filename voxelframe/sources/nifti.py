"""NIfTI-1 files: headers, geometry and voxels, as rows.

Files are read by Spark's ``binaryFile``; the parser works on bytes, so it
runs wherever the rows are.  A file that cannot be read gives an error row.
"""

from __future__ import annotations

import gzip
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelframe.functions.arrow import slices
from voxelframe.functions.text import case_id, channel_index, strip_nifti

#: Data types of the standard (fixed values): code -> (name, NumPy type).
DATATYPES = {1: ("bool", None), 2: ("u8", "u1"), 4: ("i16", "i2"), 8: ("i32", "i4"), 16: ("f32", "f4"), 64: ("f64", "f8"), 256: ("i8", "i1"), 512: ("u16", "u2"), 768: ("u32", "u4")}
HEADER = 348


class NiftiError(ValueError):
    pass


@dataclass(frozen=True)
class Header:
    order: str
    shape: tuple[int, ...]
    datatype: int
    spacing: tuple[float, ...]
    offset: int
    slope: float
    intercept: float
    detached: bool
    affine: np.ndarray


def plain(data: bytes) -> bytes:
    return gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data


def parse_header(data: bytes) -> Header:
    if len(data) < HEADER:
        raise NiftiError("the header is shorter than 348 bytes")
    order = next((o for o in "<>" if struct.unpack_from(o + "i", data)[0] == HEADER), None)
    if order is None:
        raise NiftiError("sizeof_hdr is not 348")
    get = lambda kind, at: struct.unpack_from(order + kind, data, at)
    magic = data[344:348]
    if magic not in (b"n+1\0", b"ni1\0"):
        raise NiftiError("no NIfTI-1 magic")
    dims = get("8h", 40)
    if not 1 <= dims[0] <= 7:
        raise NiftiError(f"{dims[0]} dimensions")
    shape = dims[1 : 1 + dims[0]]
    if any(n <= 0 for n in shape):
        raise NiftiError(f"dimensions {shape}")
    datatype = get("h", 70)[0]
    if datatype not in DATATYPES:
        raise NiftiError(f"datatype {datatype}")
    pixdim = get("8f", 76)
    spacing = tuple(abs(p) for p in pixdim[1 : 1 + min(dims[0], 3)])
    if any(not (0 < s < float("inf")) for s in spacing):
        raise NiftiError(f"spacing {spacing}")
    slope, intercept = get("2f", 112)
    if slope == 0 or not np.isfinite(slope):
        slope, intercept = 1.0, 0.0
    return Header(order, shape, datatype, spacing, int(get("f", 108)[0]), slope, intercept, magic == b"ni1\0", geometry(data, order, pixdim))


def geometry(data: bytes, order: str, pixdim: tuple[float, ...]) -> np.ndarray:
    """Voxel-to-world matrix: the sform if it is set, else the qform, else the spacing alone."""
    qform, sform = struct.unpack_from(order + "2h", data, 252)
    out = np.eye(4)
    if sform > 0:
        out[:3] = np.array(struct.unpack_from(order + "12f", data, 280)).reshape(3, 4)
    elif qform > 0:
        b, c, d, *shift = struct.unpack_from(order + "6f", data, 256)
        a = np.sqrt(max(0.0, 1 - b * b - c * c - d * d))
        turn = np.array([[a * a + b * b - c * c - d * d, 2 * (b * c - a * d), 2 * (b * d + a * c)], [2 * (b * c + a * d), a * a + c * c - b * b - d * d, 2 * (c * d - a * b)], [2 * (b * d - a * c), 2 * (c * d + a * b), a * a + d * d - b * b - c * c]])
        scale = np.array([pixdim[1], pixdim[2], pixdim[3] * (-1.0 if pixdim[0] < 0 else 1.0)])
        out[:3, :3], out[:3, 3] = turn * scale, shift
    else:
        out[[0, 1, 2], [0, 1, 2]] = [p if p > 0 else 1.0 for p in pixdim[1:4]]
    return out


def split_affine(affine: np.ndarray) -> tuple[list[float], list[float], list[float]]:
    """(spacing, origin, row-major direction)."""
    spacing = np.linalg.norm(affine[:3, :3], axis=0)
    if (spacing <= 0).any() or not np.isfinite(affine).all():
        raise NiftiError("a direction of no length")
    return spacing.tolist(), affine[:3, 3].tolist(), (affine[:3, :3] / spacing).ravel().tolist()


def read_voxels(data: bytes, header: Header, pixels: bytes | None = None) -> np.ndarray:
    """Scaled voxels as 32-bit floats in shape (z, y, x)."""
    if header.datatype == 1:
        raise NiftiError("voxels of one bit are not read")
    shape = list(header.shape)
    if any(n != 1 for n in shape[3:]):
        raise NiftiError("only three dimensions may be longer than one")
    shape = (shape + [1, 1])[:3]
    if header.detached:
        if pixels is None:
            raise NiftiError("the voxels of a detached header are missing")
        body = pixels[max(header.offset, 0) :]
    else:
        if header.offset < 352:
            raise NiftiError("vox_offset is below 352")
        body = data[header.offset :]
    kind = np.dtype(header.order + DATATYPES[header.datatype][1])
    count = int(np.prod(shape))
    if len(body) < count * kind.itemsize:
        raise NiftiError("voxels are cut off")
    raw = np.frombuffer(body, kind, count).astype(np.float64)
    return (raw * header.slope + header.intercept).astype(np.float32).reshape(shape[::-1])


def read_labels(data: bytes, header: Header, pixels: bytes | None = None) -> np.ndarray:
    values = read_voxels(data, header, pixels)
    if not np.isfinite(values).all() or (values < 0).any() or (values > 65535).any() or (values != np.floor(values)).any():
        raise NiftiError("labels must be whole numbers from 0 to 65535")
    return values.astype(np.uint16)


def below(spark: SparkSession, path: str) -> DataFrame:
    """(path, content, ...) of all files below a folder; contents are read only if they are used."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)


def only_nifti(files: DataFrame) -> DataFrame:
    return files.where(F.lower("path").rlike(r"\.nii(\.gz)?$"))


def listing(spark: SparkSession, path: str) -> DataFrame:
    """(path, stem, case_id, channel) of the NIfTI files below a folder; contents are not read."""
    return listed(below(spark, path))


def listed(files: DataFrame) -> DataFrame:
    files = only_nifti(files.select("path"))
    stem = strip_nifti(F.substring_index("path", "/", -1))
    return files.select("path", stem.alias("stem"), case_id(stem).alias("case_id"), channel_index(stem).alias("channel"))


def index(spark: SparkSession, path: str) -> DataFrame:
    """(case_id, paths): sorted paths of each case."""
    return indexed(below(spark, path))


def indexed(files: DataFrame) -> DataFrame:
    return listed(files).groupBy("case_id").agg(F.sort_array(F.collect_list("path")).alias("paths"))


HEADERS = "path string, shape array<int>, dtype string, spacing array<double>, origin array<double>, direction array<double>, error string"


def scan_headers(spark: SparkSession, path: str) -> DataFrame:
    """One row for each file: its geometry, or the error."""
    return headers_of(below(spark, path))


def headers_of(files: DataFrame) -> DataFrame:
    """scan_headers() of rows (path, content)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                try:
                    header = parse_header(plain(content)[:HEADER])
                    rows.append((name, list(header.shape), DATATYPES[header.datatype][0], *split_affine(header.affine), None))
                except (NiftiError, OSError, EOFError) as error:
                    rows.append((name, None, None, None, None, None, str(error)))
            doubles = pa.list_(pa.float64())
            types = [pa.string(), pa.list_(pa.int32()), pa.string(), doubles, doubles, doubles, pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["path", "shape", "dtype", "spacing", "origin", "direction", "error"])

    return only_nifti(files).select("path", "content").mapInArrow(run, HEADERS)


def load_volumes(spark: SparkSession, path: str, labels: bool = False) -> DataFrame:
    """(path, shape, spacing, origin, direction, values, error) of whole files; values x fastest."""
    return volumes_of(below(spark, path), labels)


def volumes_of(files: DataFrame, labels: bool = False) -> DataFrame:
    """load_volumes() of rows (path, content)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doubles = pa.list_(pa.float64())
        for batch in batches:
            for i in range(batch.num_rows):  # volumes are large: a batch for each
                name, content = batch.column("path")[i].as_py(), batch.column("content")[i].as_py()
                try:
                    data = plain(content)
                    header = parse_header(data)
                    values = (read_labels if labels else read_voxels)(data, header)
                    row = (name, list(values.shape[::-1]), *split_affine(header.affine), values.ravel().astype(np.float32), None)
                except (NiftiError, OSError, EOFError) as error:
                    row = (name, None, None, None, None, None, str(error))
                types = [pa.string(), pa.list_(pa.int32()), doubles, doubles, doubles, pa.list_(pa.float32()), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(row, types, strict=True)], ["path", "shape", "spacing", "origin", "direction", "values", "error"])

    return only_nifti(files).select("path", "content").mapInArrow(run, "path string, shape array<int>, spacing array<double>, origin array<double>, direction array<double>, values array<float>, error string")


def detached_pairs(spark: SparkSession, path: str) -> DataFrame:
    """(header, pixels): ``.hdr`` files with their ``.img`` or, failing that, ``.img.gz``."""
    return pairs_of(below(spark, path))


def pairs_of(files: DataFrame) -> DataFrame:
    """detached_pairs() of rows (path)."""
    files = files.select("path")
    base = F.regexp_replace("path", r"(?i)\.(hdr|img)(\.gz)?$", "")
    named = files.withColumn("base", base)
    headers = named.where(F.lower("path").rlike(r"\.hdr(\.gz)?$")).select("base", F.col("path").alias("header"))
    plain_, packed = named.where(F.lower("path").rlike(r"\.img$")), named.where(F.lower("path").rlike(r"\.img\.gz$"))
    out = headers.join(plain_.select("base", F.col("path").alias("a")), "base", "left").join(packed.select("base", F.col("path").alias("b")), "base", "left")
    return out.select("header", F.coalesce("a", "b").alias("pixels"))


def build(shape: tuple[int, ...], values: np.ndarray, datatype: int = 16, spacing: tuple[float, ...] = (1.0, 1.0, 1.0), order: str = "<", slope: float = 0.0, intercept: float = 0.0, sform: np.ndarray | None = None, qform: tuple[float, ...] = ()) -> bytes:
    """A single-file image; for fixtures and exports."""
    out = bytearray(352)
    struct.pack_into(order + "i", out, 0, HEADER)
    struct.pack_into(order + "8h", out, 40, len(shape), *shape, *[1] * (7 - len(shape)))
    struct.pack_into(order + "h", out, 70, datatype)
    struct.pack_into(order + "8f", out, 76, 1.0, *spacing, *[0.0] * (7 - len(spacing)))
    struct.pack_into(order + "f", out, 108, 352.0)
    struct.pack_into(order + "2f", out, 112, slope, intercept)
    if sform is not None:
        struct.pack_into(order + "h", out, 254, 1)
        struct.pack_into(order + "12f", out, 280, *np.asarray(sform, float)[:3].ravel())
    if qform:  # quaternion b, c, d and the shift
        struct.pack_into(order + "h", out, 252, 1)
        struct.pack_into(order + "6f", out, 256, *qform)
    out[344:348] = b"n+1\0"
    return bytes(out) + np.asarray(values).astype(np.dtype(order + DATATYPES[datatype][1])).tobytes()
