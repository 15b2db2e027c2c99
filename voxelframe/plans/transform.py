"""Declarative preprocessing plans: an ordered list of operations, run in one Arrow pass."""

from __future__ import annotations

import tomllib
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from voxelframe.functions.hashing import stable_hash
from voxelframe.operators import volumes as V


@dataclass
class Pair:
    """Channels and a label of one case, on one grid."""

    channels: list[np.ndarray]
    label: np.ndarray | None
    spacing: tuple[float, ...]
    origin: tuple[float, ...]
    direction: tuple[float, ...]
    crop_origin: tuple[int, ...] = (0, 0, 0)
    log: tuple[str, ...] = ()

    @property
    def affine(self) -> np.ndarray:
        return V.affine(self.spacing, self.origin, self.direction)

    def moved(self, voxels: tuple[int, ...]) -> tuple[float, ...]:
        return tuple((self.affine @ [*voxels, 1.0])[:3].tolist())


def _each(kernel: Callable[..., np.ndarray], *names: str) -> Callable[[Pair, Mapping[str, Any]], None]:
    def run(pair: Pair, op: Mapping[str, Any]) -> None:
        pair.channels = [kernel(c, *[op[n] for n in names]).astype(np.float32) for c in pair.channels]

    return run


def _crop_foreground(pair: Pair, op: Mapping[str, Any]) -> None:
    box = V.foreground_box(pair.label, (op["margin"],) * 3) if pair.label is not None else None
    if box is None:
        return  # nothing to crop to; the operation is still logged
    start, end, _ = box
    pair.origin = pair.moved(start)
    pair.channels = [V.crop(c, start, end) for c in pair.channels]
    pair.label = V.crop(pair.label, start, end)
    pair.crop_origin = tuple(a + b for a, b in zip(pair.crop_origin, start, strict=True))


def _pad_crop(pair: Pair, op: Mapping[str, Any]) -> None:
    shift = V.pad_crop(pair.channels[0], op["size"])[1]
    pair.origin = pair.moved(tuple(-s for s in shift))
    pair.channels = [V.pad_crop(c, op["size"])[0] for c in pair.channels]
    pair.label = V.pad_crop(pair.label, op["size"])[0] if pair.label is not None else None


def _resample(pair: Pair, op: Mapping[str, Any]) -> None:
    size = pair.channels[0].shape[::-1]
    shape = [n if n == 1 else int((n - 1) * s / t + 0.5) + 1 for n, s, t in zip(size, pair.spacing, op["spacing"], strict=True)]
    target = V.affine(op["spacing"], pair.origin, pair.direction)
    pair.channels = [V.resample(c, pair.affine, target, shape, op.get("linear", True)) for c in pair.channels]
    pair.label = V.resample(pair.label, pair.affine, target, shape, False) if pair.label is not None else None
    pair.spacing = tuple(op["spacing"])


#: Operations by name, with their defaults; more can be registered.
OPERATIONS: dict[str, tuple[Callable[[Pair, Mapping[str, Any]], None], dict[str, Any]]] = {
    "ct_window": (_each(V.np_clip, "min", "max"), {}),
    "min_max_normalize": (_each(V.np_min_max, "output_min", "output_max"), {"output_min": 0.0, "output_max": 1.0}),
    "z_score_normalize": (_each(V.np_z_score, "epsilon"), {"epsilon": 1e-6}),
    "percentile_clip": (_each(V.np_percentile_clip, "lower", "upper"), {}),
    "dataset_mean_std_normalize": (_each(V.np_standardize, "mean", "std"), {}),
    "crop_foreground": (_crop_foreground, {"margin": 0}),
    "pad_crop": (_pad_crop, {}),
    "resample": (_resample, {}),
}


@dataclass(frozen=True)
class TransformPlan:
    ops: tuple[dict[str, Any], ...]
    image_interpolation: str = "linear"
    label_interpolation: str = "nearest"

    def __post_init__(self):
        if self.label_interpolation != "nearest":
            raise ValueError("labels are resampled by the nearest voxel only")
        for op in self.ops:
            if op.get("op") not in OPERATIONS:
                raise ValueError(f"unknown operation {op.get('op')!r}")

    @classmethod
    def from_toml(cls, text: str) -> TransformPlan:
        data = tomllib.loads(text)
        ops = data.get("ops", data.get("transform", []))
        return cls(tuple({**OPERATIONS[o["op"]][1], **o} if o.get("op") in OPERATIONS else o for o in ops), data.get("image_interpolation", "linear"), data.get("label_interpolation", "nearest"))

    @property
    def hash(self) -> str:
        return stable_hash({"ops": list(self.ops), "image": self.image_interpolation, "label": self.label_interpolation})

    def run(self, pair: Pair) -> Pair:
        if any(c.shape != pair.channels[0].shape for c in pair.channels) or pair.label is not None and pair.label.shape != pair.channels[0].shape:
            raise ValueError("channels and label differ in shape")
        for op in self.ops:
            kernel, defaults = OPERATIONS[op["op"]]
            kernel(pair, {**defaults, "linear": self.image_interpolation == "linear", **op})
            pair.log += (op["op"],)
            if not all(np.isfinite(c).all() for c in pair.channels):
                raise ValueError(f"{op['op']} made values that are not finite")
        return pair


PREPARED = "case_id string, shape array<int>, spacing array<double>, origin array<double>, crop_origin array<int>, channels array<array<float>>, label array<int>, foreground long, log array<string>, error string"


def prepare(cases: DataFrame, plan: TransformPlan) -> DataFrame:
    """Runs a plan over (case_id, shape, spacing, origin, direction, channels, label); a failing case gives an error row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ints, doubles = pa.list_(pa.int32()), pa.list_(pa.float64())
        types = [pa.string(), ints, doubles, doubles, ints, pa.list_(pa.list_(pa.float32())), ints, pa.int64(), pa.list_(pa.string()), pa.string()]
        names = [p.strip().split()[0] for p in PREPARED.split(", ")]
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in ("case_id", "shape", "spacing", "origin", "direction", "channels", "label")}
                try:
                    size = row["shape"][::-1]
                    label = np.asarray(row["label"], np.int32).reshape(size) if row["label"] is not None else None
                    pair = plan.run(Pair([np.asarray(c, np.float32).reshape(size) for c in row["channels"]], label, tuple(row["spacing"]), tuple(row["origin"]), tuple(row["direction"])))
                    out = (row["case_id"], list(pair.channels[0].shape[::-1]), list(pair.spacing), list(pair.origin), list(pair.crop_origin), [c.ravel() for c in pair.channels], pair.label.ravel() if pair.label is not None else None, int((pair.label > 0).sum()) if pair.label is not None else 0, list(pair.log), None)
                except ValueError as error:
                    out = (row["case_id"], *[None] * 8, str(error))
                yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(out, types, strict=True)], names)

    return cases.select("case_id", "shape", "spacing", "origin", "direction", "channels", "label").mapInArrow(run, PREPARED)
