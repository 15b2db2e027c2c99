"""DICOM Part-10 files: elements, inventory rows and presentation pixels.

The parser reads what the standard's basic encodings define: explicit and
implicit value representations in both byte orders, sequences (skipped over),
and encapsulated pixel data, whose fragments are joined without the offset
table.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelframe.functions.arrow import slices
from voxelframe.functions.text import extension
from voxelframe.schemas import INVENTORY
from voxelframe.sources import jpeg

#: Transfer syntaxes of the standard (fixed values).
IMPLICIT_LITTLE, EXPLICIT_LITTLE, EXPLICIT_BIG = "1.2.840.10008.1.2", "1.2.840.10008.1.2.1", "1.2.840.10008.1.2.2"
RLE, JPEG_BASELINE = "1.2.840.10008.1.2.5", "1.2.840.10008.1.2.4.50"
NATIVE = (IMPLICIT_LITTLE, EXPLICIT_LITTLE, EXPLICIT_BIG, RLE, JPEG_BASELINE)
#: Value representations whose length takes four bytes after two reserved ones.
LONG_VRS = (b"OB", b"OD", b"OF", b"OL", b"OV", b"OW", b"SQ", b"SV", b"UC", b"UN", b"UR", b"UT", b"UV")
#: Names of the elements that inventories read.
TAGS = {
    "patient_name": (0x0010, 0x0010), "birth_date": (0x0010, 0x0030), "patient_id": (0x0010, 0x0020), "study_instance_uid": (0x0020, 0x000D),
    "series_instance_uid": (0x0020, 0x000E), "sop_instance_uid": (0x0008, 0x0018), "modality": (0x0008, 0x0060), "body_part_examined": (0x0018, 0x0015),
    "view_position": (0x0018, 0x5101), "image_laterality": (0x0020, 0x0062), "series_laterality": (0x0020, 0x0060), "rows": (0x0028, 0x0010), "columns": (0x0028, 0x0011),
    "samples_per_pixel": (0x0028, 0x0002), "bits_allocated": (0x0028, 0x0100), "bits_stored": (0x0028, 0x0101), "high_bit": (0x0028, 0x0102),
    "pixel_representation": (0x0028, 0x0103), "photometric_interpretation": (0x0028, 0x0004), "pixel_spacing": (0x0028, 0x0030), "imager_pixel_spacing": (0x0018, 0x1164),
    "rescale_intercept": (0x0028, 0x1052), "rescale_slope": (0x0028, 0x1053), "window_center": (0x0028, 0x1050), "window_width": (0x0028, 0x1051), "pixel_data": (0x7FE0, 0x0010),
}
UNDEFINED = 0xFFFFFFFF


class DicomError(ValueError):
    pass


@dataclass
class DataSet:
    syntax: str
    elements: dict[tuple[int, int], tuple[str, bytes]] = field(default_factory=dict)
    sha256: str = ""

    @property
    def order(self) -> str:
        return ">" if self.syntax == EXPLICIT_BIG else "<"

    def raw(self, name: str) -> bytes | None:
        found = self.elements.get(TAGS[name])
        return found[1] if found else None

    def text(self, name: str) -> str | None:
        raw = self.raw(name)
        return None if raw is None else raw.decode("utf-8", "replace").strip("\0 \t\r\n") or None

    def number(self, name: str) -> int | None:
        raw = self.raw(name)
        return struct.unpack_from(self.order + "H", raw)[0] if raw and len(raw) >= 2 else None

    def decimals(self, name: str) -> list[float] | None:
        text = self.text(name)
        if text is None:
            return None
        try:
            return [float(p) for p in text.split("\\")]
        except ValueError:
            return None

    def decimal(self, name: str) -> float | None:
        found = self.decimals(name)
        return found[0] if found else None

    def pair(self, name: str) -> list[float] | None:
        found = self.decimals(name)
        return found[:2] if found and len(found) >= 2 else None


class Cursor:
    def __init__(self, data: bytes, at: int, order: str, explicit: bool):
        self.data, self.at, self.order, self.explicit = data, at, order, explicit

    def take(self, n: int) -> bytes:
        if self.at + n > len(self.data):
            raise DicomError("the file is truncated")
        self.at += n
        return self.data[self.at - n : self.at]

    def tag(self) -> tuple[int, int]:
        return struct.unpack(self.order + "HH", self.take(4))

    def length(self) -> int:
        return struct.unpack(self.order + "I", self.take(4))[0]

    def element(self) -> tuple[tuple[int, int], str, bytes]:
        tag = self.tag()
        if not self.explicit or tag[0] == 0xFFFE:
            vr, size = b"", self.length()
        else:
            vr = self.take(2)
            if vr in LONG_VRS:
                self.take(2)
                size = self.length()
            else:
                size = struct.unpack(self.order + "H", self.take(2))[0]
        if size == UNDEFINED:
            return tag, vr.decode("latin-1"), self.fragments() if tag == TAGS["pixel_data"] else self.skip_sequence()
        return tag, vr.decode("latin-1"), self.take(size)

    def fragments(self) -> bytes:
        out, first = [], True
        while True:
            tag, size = self.tag(), self.length()
            if tag == (0xFFFE, 0xE0DD):
                return b"".join(out)
            if tag != (0xFFFE, 0xE000):
                raise DicomError("a fragment was expected")
            part = self.take(size)
            if not first:
                out.append(part)
            first = False

    def skip_sequence(self) -> bytes:
        begin = self.at
        while True:
            tag, size = self.tag(), self.length()
            if tag == (0xFFFE, 0xE0DD):
                return self.data[begin : self.at - 8]
            if tag != (0xFFFE, 0xE000):
                raise DicomError("an item was expected")
            if size == UNDEFINED:
                while self.data[self.at : self.at + 4] != struct.pack(self.order + "HH", 0xFFFE, 0xE00D):
                    self.element()
                self.take(8)
            else:
                self.take(size)


def parse(data: bytes) -> DataSet:
    """The top-level elements of a Part-10 file."""
    if len(data) < 132 or data[128:132] != b"DICM":
        raise DicomError("no DICM after a preamble of 128 bytes")
    out = DataSet(EXPLICIT_LITTLE, sha256=hashlib.sha256(data).hexdigest())
    cursor = Cursor(data, 132, "<", True)
    while cursor.at + 8 <= len(data) and data[cursor.at : cursor.at + 2] == b"\x02\x00":
        tag, vr, value = cursor.element()
        out.elements[tag] = vr, value
        if tag == (0x0002, 0x0010):
            out.syntax = value.decode("latin-1").strip("\0 ")
    cursor.order, cursor.explicit = out.order, out.syntax != IMPLICIT_LITTLE
    while cursor.at + 8 <= len(data):
        tag, vr, value = cursor.element()
        out.elements[tag] = vr, value
    return out


def warnings_of(d: DataSet) -> list[dict[str, str]]:
    rules = [
        ("phi_patient_name", d.text("patient_name") is not None, "the patient's name is present"), ("phi_patient_birth_date", d.text("birth_date") is not None, "the date of birth is present"),
        ("unsupported_transfer_syntax", d.syntax not in NATIVE, f"transfer syntax {d.syntax} is not supported"),
        *[(f"missing_{n}", d.text(n) is None, f"{n} is missing") for n in ("patient_id", "study_instance_uid", "series_instance_uid", "sop_instance_uid", "view_position")],
        ("missing_pixel_spacing", d.pair("pixel_spacing") is None and d.pair("imager_pixel_spacing") is None, "both pixel spacings are missing"),
        ("invalid_image_dimensions", 0 in (d.number("rows"), d.number("columns")), "rows and columns must be above zero"),
    ]
    return [{"code": code, "message": message} for code, there, message in rules if there]


def inventory_row(d: DataSet, path: str) -> dict:
    out = {"path": path, "sha256": d.sha256, "transfer_syntax_uid": d.syntax, "decoder_backend": None, "decoder_version": None}
    out |= {n: d.text(n) for n in ("patient_id", "study_instance_uid", "series_instance_uid", "sop_instance_uid", "modality", "body_part_examined", "view_position", "photometric_interpretation")}
    out["laterality"] = d.text("image_laterality") or d.text("series_laterality")
    out |= {n: d.number(n) for n in ("rows", "columns", "samples_per_pixel", "bits_allocated", "bits_stored", "high_bit")}
    sign = d.number("pixel_representation")
    out["pixel_representation"] = None if sign is None else "signed" if sign else "unsigned"
    out |= {n: d.pair(n) for n in ("pixel_spacing", "imager_pixel_spacing")} | {n: d.decimal(n) for n in ("rescale_intercept", "rescale_slope", "window_center", "window_width")}
    pixels = d.raw("pixel_data")
    out["pixel_hash"] = None if pixels is None else hashlib.sha256(pixels).hexdigest()
    return out | {"warnings": warnings_of(d)}


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """Files that may be DICOM: by extension, or without one."""
    return candidates_of(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path))


def candidates_of(files: DataFrame) -> DataFrame:
    return files.where(extension(F.col("path")).isin("dc", "dcm", "dicom", "ima", ""))


def scan(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(inventory, errors): a row for each file, sorted by path when collected that way."""
    return inventory_of(candidates(spark, path))


def inventory_of(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """scan() of rows (path, content)."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StringType, StructField, StructType

    schema = StructType([*INVENTORY.fields, StructField("error", StringType())])
    schema = StructType([StructField(f.name, f.dataType, True) for f in schema.fields])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                try:
                    rows.append(inventory_row(parse(content), name) | {"error": None})
                except (DicomError, struct.error) as error:
                    rows.append({"path": name, "error": str(error)})
            yield pa.RecordBatch.from_pylist([{n: r.get(n) for n in arrow.names} for r in rows], schema=arrow)

    parsed = files.select("path", "content").mapInArrow(run, schema)
    return parsed.where("error is null").drop("error"), parsed.where("error is not null").select("path", "error")


def inspect(data: bytes) -> dict[str, str]:
    """Tag -> display text of one file."""
    found = parse(data)
    show = lambda v: v.decode("utf-8", "replace").strip("\0 ") if len(v) <= 64 else f"{len(v)} bytes"
    return {f"({g:04X},{e:04X})": show(v) for (g, e), (_, v) in sorted(found.elements.items())}


# pixels ---------------------------------------------------------------------------


def unpack_rle(data: bytes, count: int, bytes_each: int) -> bytes:
    """RLE Lossless to little-endian samples: byte planes, most significant first."""
    segments = struct.unpack_from("<I", data)[0]
    if segments < bytes_each or len(data) < 64:
        raise DicomError("RLE segments are missing")
    starts = [*struct.unpack_from(f"<{segments}I", data, 4), len(data)]
    planes = np.zeros((bytes_each, count), np.uint8)
    for plane in range(bytes_each):
        out, at, end = bytearray(), starts[plane], starts[plane + 1]
        while at < end and len(out) < count:
            n = data[at]
            at += 1
            if n < 128:
                out += data[at : at + n + 1]
                at += n + 1
            elif n > 128:
                out += data[at : at + 1] * (257 - n)
                at += 1
        if len(out) < count:
            raise DicomError("an RLE plane is too short")
        planes[plane] = np.frombuffer(bytes(out[:count]), np.uint8)
    return planes[::-1].T.tobytes()


def decode_jpeg(data: bytes, rows: int, columns: int, samples: int) -> np.ndarray:
    """The first component, which is the luma."""
    try:
        planes = jpeg.decode(data)
    except (jpeg.JpegError, KeyError, IndexError, struct.error) as error:
        raise DicomError(f"JPEG: {error}") from None
    if planes.shape[1:] != (rows, columns):
        raise DicomError(f"the JPEG image has {planes.shape[1:]} samples, the file says {(rows, columns)}")
    return planes[0].astype(np.int32)


#: Decoders of encapsulated syntaxes, by transfer syntax; callers may register more.
DECODERS: dict[str, Callable[..., np.ndarray]] = {JPEG_BASELINE: decode_jpeg}


def raw_pixels(d: DataSet) -> np.ndarray:
    """Stored samples, signed or not, as integers (rows, columns[, samples])."""
    rows, columns, data = d.number("rows"), d.number("columns"), d.raw("pixel_data")
    if not rows or not columns or data is None:
        raise DicomError("there are no pixels")
    samples, allocated = d.number("samples_per_pixel") or 1, d.number("bits_allocated") or 8
    stored = d.number("bits_stored") or allocated
    if d.syntax in DECODERS:
        return DECODERS[d.syntax](data, rows, columns, samples)
    if d.syntax not in (IMPLICIT_LITTLE, EXPLICIT_LITTLE, EXPLICIT_BIG, RLE):
        raise DicomError(f"transfer syntax {d.syntax} is not supported")
    if allocated not in (8, 16):
        raise DicomError(f"{allocated} bits allocated")
    count = rows * columns * samples
    order = d.order
    if d.syntax == RLE:
        if samples != 1:
            raise DicomError("RLE pixels of one sample only")
        data, order = unpack_rle(data, count, allocated // 8), "<"
    kind = np.dtype("u1" if allocated == 8 else order + "u2")
    if len(data) < count * kind.itemsize:
        raise DicomError("pixel data is cut off")
    values = np.frombuffer(data, kind, count).astype(np.int32) & ((1 << stored) - 1)
    if d.number("pixel_representation"):
        values = np.where(values >= 1 << (stored - 1), values - (1 << stored), values)
    return values.reshape((rows, columns, samples) if samples > 1 else (rows, columns))


def to_luma(values: np.ndarray, photometric: str | None) -> np.ndarray:
    """Colour to luma; the first sample of YBR is luma already."""
    if values.ndim == 2:
        return values.astype(np.float32)
    if photometric and photometric.startswith("YBR"):
        return values[..., 0].astype(np.float32)
    return (values[..., :3].astype(np.float32) * np.array([0.299, 0.587, 0.114], np.float32)).sum(axis=-1)


def window(values: np.ndarray, centre: float, width: float) -> np.ndarray:
    """The standard's linear VOI function to 8 bits; a width of one or less is a threshold."""
    if width <= 1:
        return np.where(values > centre, 255, 0).astype(np.uint8)
    ramp = ((values - np.float32(centre - 0.5)) / np.float32(width - 1) + np.float32(0.5)) * np.float32(255)
    return np.floor(np.clip(ramp, 0, 255) + 0.5).astype(np.uint8)


def stretch(values: np.ndarray) -> np.ndarray:
    span = max(float(values.max() - values.min()), 1e-6)
    return np.floor(np.clip((values - values.min()) / np.float32(span) * np.float32(255), 0, 255) + 0.5).astype(np.uint8)


def present(d: DataSet, rescale: bool = True, voi: str = "auto", invert_monochrome1: bool = True) -> tuple[np.ndarray, list[str]]:
    """8-bit pixels for display, and the steps that made them."""
    photometric = d.text("photometric_interpretation")
    values, steps = to_luma(raw_pixels(d), photometric), [f"decode {d.syntax}"]
    slope, intercept = d.decimal("rescale_slope"), d.decimal("rescale_intercept")
    if rescale and (slope is not None or intercept is not None):
        values = values * np.float32(1.0 if slope is None else slope) + np.float32(intercept or 0.0)
        steps.append("rescale")
    centre, width = d.decimal("window_center"), d.decimal("window_width")
    if voi in ("auto", "window") and centre is not None and width is not None:
        out = window(values, centre, width)
        steps.append(f"window {centre:g}/{width:g}")
    elif voi == "window":
        raise DicomError("there is no window")
    else:
        out = stretch(values)
        steps.append("min-max")
    if invert_monochrome1 and photometric == "MONOCHROME1":
        out = 255 - out
        steps.append("invert")
    return out, steps


def rle(planes: list[bytes]) -> bytes:
    """RLE Lossless of byte planes: runs of equal bytes, and literal bytes; for fixtures."""
    parts = []
    for plane in planes:
        out, at = bytearray(), 0
        while at < len(plane):
            run = 1
            while at + run < len(plane) and run < 128 and plane[at + run] == plane[at]:
                run += 1
            out += bytes([257 - run, plane[at]]) if run > 1 else bytes([0, plane[at]])
            at += run
        parts.append(bytes(out) + b"\0" * (len(out) % 2))
    starts = [64 + sum(map(len, parts[:i])) for i in range(len(parts))]
    return struct.pack("<16I", len(parts), *starts, *[0] * (15 - len(parts))) + b"".join(parts)


def build(elements: dict[tuple[int, int], tuple[str, bytes | list[bytes]]], syntax: str = EXPLICIT_LITTLE) -> bytes:
    """A Part-10 file of the given elements, lists being fragments of undefined length; for fixtures."""

    def write(tag: tuple[int, int], vr: str, value: bytes | list[bytes], order: str, explicit: bool) -> bytes:
        if isinstance(value, list):
            items = b"".join(struct.pack("<HHI", 0xFFFE, 0xE000, len(v)) + v for v in [b"", *value])
            return struct.pack("<HH", *tag) + vr.encode() + b"\0\0" + struct.pack("<I", UNDEFINED) + items + struct.pack("<HHI", 0xFFFE, 0xE0DD, 0)
        value += b"\0" * (len(value) % 2)
        head = struct.pack(order + "HH", *tag)
        if not explicit:
            return head + struct.pack(order + "I", len(value)) + value
        if vr.encode() in LONG_VRS:
            return head + vr.encode() + b"\0\0" + struct.pack(order + "I", len(value)) + value
        return head + vr.encode() + struct.pack(order + "H", len(value)) + value

    order, explicit = (">" if syntax == EXPLICIT_BIG else "<"), syntax != IMPLICIT_LITTLE
    meta = write((0x0002, 0x0010), "UI", syntax.encode(), "<", True)
    return b"\0" * 128 + b"DICM" + meta + b"".join(write(t, vr, v, order, explicit) for t, (vr, v) in sorted(elements.items()))
