"""Image kernels: fit-and-pad resizing, heat maps, box masks and terminal views."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def triangle_weights(source: int, target: int) -> np.ndarray:
    """(target, source) weights of a triangle filter, widened when shrinking so that it averages."""
    scale = source / target
    support = max(scale, 1.0)
    centres = (np.arange(target) + 0.5) * scale - 0.5
    distance = np.abs(np.arange(source)[None, :] - centres[:, None]) / support
    weights = np.maximum(0.0, 1.0 - distance)
    return weights / weights.sum(axis=1, keepdims=True)


def resize(image: np.ndarray, width: int, height: int) -> np.ndarray:
    out = triangle_weights(image.shape[0], height) @ image.astype(np.float64) @ triangle_weights(image.shape[1], width).T
    return np.floor(np.clip(out, 0, 255) + 0.5).astype(np.uint8)


def fit_pad(image: np.ndarray, size: int, pad: int = 0) -> np.ndarray:
    """The image as large as fits a square, its sides' ratio kept, in the middle of a canvas."""
    if size <= 0 or 0 in image.shape:
        raise ValueError("sizes must be above zero")
    height, width = image.shape
    scale = min(np.float32(size) / np.float32(width), np.float32(size) / np.float32(height))
    side = lambda n: int(min(max(math.floor(float(np.float32(n) * scale) + 0.5), 1), size))
    small = resize(image, side(width), side(height))
    out = np.full((size, size), pad, np.uint8)
    top, left = (size - small.shape[0]) // 2, (size - small.shape[1]) // 2
    out[top : top + small.shape[0], left : left + small.shape[1]] = small
    return out


def luma_images(images: DataFrame, size: int) -> DataFrame:
    """(path, pixels) of Spark's ``image`` source, as 8-bit luma fitted to a square; null where undecodable."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.column("image").to_pylist():
                channels, raw = row["nChannels"], np.frombuffer(row["data"], np.uint8)
                if row["height"] <= 0 or len(raw) != row["height"] * row["width"] * channels:
                    out.append(None)
                    continue
                pixels = raw.reshape(row["height"], row["width"], channels)
                luma = pixels[..., 0] if channels == 1 else np.floor(pixels[..., :3] @ np.array([0.114, 0.587, 0.299]) + 0.5).astype(np.uint8)  # stored as blue, green, red
                out.append(fit_pad(luma, size).tobytes())
            paths = [r["origin"] for r in batch.column("image").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(paths), pa.array(out, pa.binary())], ["path", "pixels"])

    return images.select("image").mapInArrow(run, "path string, pixels binary")


def normalize_heat(heat: np.ndarray) -> np.ndarray:
    heat = np.maximum(heat.astype(np.float64), 0)
    span = heat.max() - heat.min()
    return (heat - heat.min()) / span if span > 0 else np.zeros_like(heat)


def box_mask(boxes: Sequence[tuple[float, float, float, float]], size: int) -> np.ndarray:
    """Union of (x1, y1, x2, y2) boxes in fractions on a square grid; each covers at least one pixel."""
    out = np.zeros((size, size), bool)
    for x1, y1, x2, y2 in boxes:
        left, top = min(int(math.floor(x1 * size)), size - 1), min(int(math.floor(y1 * size)), size - 1)
        right, bottom = max(left + 1, min(int(math.ceil(x2 * size)), size)), max(top + 1, min(int(math.ceil(y2 * size)), size))
        out[max(top, 0) : bottom, max(left, 0) : right] = True
    return out


def top_mask(heat: np.ndarray, fraction: float) -> np.ndarray:
    """The ceil(n * fraction) highest pixels; of equal ones the first."""
    count = max(1, math.ceil(heat.size * fraction))
    out = np.zeros(heat.size, bool)
    out[np.argsort(-heat.ravel(), kind="stable")[:count]] = True
    return out.reshape(heat.shape)


def cam_metrics(heat: np.ndarray, mask: np.ndarray, fractions: Sequence[float] = (0.01, 0.05, 0.1, 0.2)) -> dict[str, float]:
    """Whether the peak lies in the boxes, and overlap and coverage at the highest pixels."""
    peak = np.unravel_index(int(heat.argmax()), heat.shape)
    out = {"hit": float(mask[peak])}
    for fraction in fractions:
        top = top_mask(heat, fraction)
        both, either = (top & mask).sum(), (top | mask).sum()
        out[f"iou_{fraction:g}"] = float(both / either) if either else 0.0
        out[f"coverage_{fraction:g}"] = float(both / mask.sum()) if mask.any() else 0.0
    return out


#: From dark to light (fixed values).
PALETTE = " .:-=+*#%@"


def terminal_view(image: np.ndarray, width: int = 64) -> str:
    """Characters for brightness; a character is about twice as high as wide."""
    height = max(1, round(image.shape[0] / image.shape[1] * width / 2))
    small = resize(image, width, height)
    return "\n".join("".join(PALETTE[int(v) * len(PALETTE) // 256] for v in row) for row in small)
