"""Volume kernels: intensity, geometry and prefix sums.

Each kernel exists as NumPy (32-bit, fused into one Arrow pass by a transform
plan) and, where that is natural, as array expressions (64-bit).
Arrays have x fastest: index = x + sx * (y + sy * z); in NumPy the shape is
(z, y, x).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON = np.float32(np.finfo(np.float32).eps)

# array expressions ------------------------------------------------------------


def bound(f: Callable[[Column], Column], **values: Column) -> Column:
    """f of a struct of values that are worked out once, not again for each element of an array."""
    return F.get(F.transform(F.array(F.struct(*[v.alias(n) for n, v in values.items()])), f), F.lit(0))


def clip(values: Column, low: float, high: float) -> Column:
    return F.transform(values, lambda x: F.least(F.greatest(x.cast("double"), F.lit(low)), F.lit(high)))


def min_max(values: Column, low: float = 0.0, high: float = 1.0) -> Column:
    def run(s: Column) -> Column:
        least, most = s["least"], s["most"]
        return F.transform(s["v"], lambda x: F.when(most - least <= float(EPSILON), F.lit(low)).otherwise(F.lit(low) + (x.cast("double") - least) / (most - least) * F.lit(high - low)))

    return bound(run, v=values, least=F.array_min(values).cast("double"), most=F.array_max(values).cast("double"))


def mean(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x.cast("double")) / F.size(values)


def z_score(values: Column, epsilon: float = 1e-6) -> Column:
    def spread(s: Column) -> Column:
        variance = F.aggregate(s["v"], F.lit(0.0), lambda a, x: a + (x.cast("double") - s["m"]) * (x.cast("double") - s["m"])) / F.size(s["v"])
        return F.struct(s["v"].alias("v"), s["m"].alias("m"), F.greatest(F.sqrt(variance), F.lit(epsilon)).alias("d"))

    parts = bound(spread, v=values, m=mean(values))
    return bound(lambda s: F.transform(s["p"]["v"], lambda x: (x.cast("double") - s["p"]["m"]) / s["p"]["d"]), p=parts)


def percentile(ranked: Column, percent: float) -> Column:
    at = F.lit(percent / 100) * (F.size(ranked) - 1)
    low = F.floor(at).cast("int")
    a, b = F.get(ranked, low).cast("double"), F.get(ranked, F.least(low + 1, F.size(ranked) - 1)).cast("double")
    return a + (b - a) * (at - low)


def percentile_clip(values: Column, low: float, high: float) -> Column:
    ends = bound(lambda s: F.struct(percentile(s["r"], low).alias("low"), percentile(s["r"], high).alias("high")), r=F.sort_array(values))
    return bound(lambda s: F.transform(s["v"], lambda x: F.least(F.greatest(x.cast("double"), s["e"]["low"]), s["e"]["high"])), v=values, e=ends)


def standardize(values: Column, middle: float, spread: float) -> Column:
    return F.transform(values, lambda x: (x.cast("double") - F.lit(middle)) / F.lit(spread))


def uint8_decode(values: Column, middle: float, spread: float) -> Column:
    """v * scale + bias, which is (v / 255 - mean) / std folded."""
    return F.transform(values, lambda v: v * F.lit(1.0 / (255.0 * spread)) - F.lit(middle / spread))


def resampled_shape(n: Column, spacing: Column, target: Column) -> Column:
    return F.when(n == 1, n).otherwise(F.round((n - 1) * spacing / target) + 1).cast("int")


# NumPy ---------------------------------------------------------------------------


def np_clip(x: np.ndarray, low: float, high: float) -> np.ndarray:
    return np.clip(x, np.float32(low), np.float32(high))


def np_min_max(x: np.ndarray, low: float = 0.0, high: float = 1.0) -> np.ndarray:
    least, most = x.min(), x.max()
    if most - least <= EPSILON:
        return np.full_like(x, low)
    return np.float32(low) + (x - least) / (most - least) * np.float32(high - low)


def np_z_score(x: np.ndarray, epsilon: float = 1e-6) -> np.ndarray:
    wide = x.astype(np.float64)
    spread = max(float(np.sqrt(wide.var())), epsilon)
    return ((x - np.float32(wide.mean())) / np.float32(spread)).astype(np.float32)


def np_percentile(x: np.ndarray, percent: float) -> np.float32:
    ranked = np.sort(x, axis=None)
    at = percent / 100 * (len(ranked) - 1)
    low = int(at)
    a, b = ranked[low], ranked[min(low + 1, len(ranked) - 1)]
    return np.float32(a + (b - a) * np.float32(at - low))


def np_percentile_clip(x: np.ndarray, low: float, high: float) -> np.ndarray:
    return np.clip(x, np_percentile(x, low), np_percentile(x, high))


def np_standardize(x: np.ndarray, middle: float, spread: float) -> np.ndarray:
    if not spread > 0:
        raise ValueError("the deviation must be above zero")
    return (x - np.float32(middle)) / np.float32(spread)


def foreground_box(label: np.ndarray, margin: Sequence[int] = (0, 0, 0)) -> tuple[tuple[int, int, int], tuple[int, int, int], int] | None:
    """(start, end, voxels) in x, y, z of the voxels above zero, widened and clamped; None without any."""
    at = np.nonzero(label)
    if not len(at[0]):
        return None
    lows, highs = [int(a.min()) for a in at[::-1]], [int(a.max()) + 1 for a in at[::-1]]
    size = label.shape[::-1]
    start = tuple(max(0, low - m) for low, m in zip(lows, margin, strict=True))
    end = tuple(min(s, high + m) for s, high, m in zip(size, highs, margin, strict=True))
    return start, end, len(at[0])


def crop(x: np.ndarray, start: Sequence[int], end: Sequence[int]) -> np.ndarray:
    return x[start[2] : end[2], start[1] : end[1], start[0] : end[0]]


def pad_crop(x: np.ndarray, size: Sequence[int]) -> tuple[np.ndarray, tuple[int, int, int]]:
    """The centre of a volume at the given size, zeros around; and where the old origin lands (negative: cropped)."""
    out = np.zeros(tuple(size[::-1]), x.dtype)
    shift = tuple((want - have) // 2 if want >= have else -((have - want) // 2) for want, have in zip(size, x.shape[::-1], strict=True))
    source = tuple(slice(max(0, -s), max(0, -s) + min(have, want)) for s, have, want in zip(shift[::-1], x.shape, out.shape, strict=True))
    target = tuple(slice(max(0, s), max(0, s) + min(have, want)) for s, have, want in zip(shift[::-1], x.shape, out.shape, strict=True))
    out[target] = x[source]
    return out, shift


def affine(spacing: Sequence[float], origin: Sequence[float], direction: Sequence[float]) -> np.ndarray:
    out = np.eye(4)
    out[:3, :3] = np.asarray(direction, float).reshape(3, 3) * np.asarray(spacing, float)
    out[:3, 3] = origin
    return out


def resample(x: np.ndarray, from_affine: np.ndarray, to_affine: np.ndarray, shape: Sequence[int], linear: bool) -> np.ndarray:
    """Values at the voxels of another grid; zero outside. Labels take the nearest voxel, halves away from zero."""
    edge = 1e-9
    grid = np.stack(np.meshgrid(*[np.arange(n, dtype=np.float64) for n in shape], indexing="ij"), axis=-1).reshape(-1, 3)
    map_ = np.linalg.inv(from_affine) @ to_affine
    at = grid @ map_[:3, :3].T + map_[:3, 3]
    size = np.array(x.shape[::-1])
    inside = ((at >= -edge) & (at <= size - 1 + edge)).all(axis=1)
    at = np.clip(at, 0, size - 1)
    if not linear:
        near = np.floor(at + 0.5).astype(np.int64)
        inside = inside & (near < size).all(axis=1)
        near = np.minimum(near, size - 1)
        values = x[near[:, 2], near[:, 1], near[:, 0]]
    else:
        low = np.minimum(np.floor(at).astype(np.int64), np.maximum(size - 2, 0))
        part = at - low
        high = np.minimum(low + 1, size - 1)
        values = np.zeros(len(at))
        for corner in range(8):
            pick = [high[:, a] if corner >> a & 1 else low[:, a] for a in range(3)]
            weight = np.prod([part[:, a] if corner >> a & 1 else 1 - part[:, a] for a in range(3)], axis=0)
            values += weight * x[pick[2], pick[1], pick[0]]
    values = np.where(inside, values, 0).astype(x.dtype)
    return values.reshape(tuple(shape)).transpose(2, 1, 0)


def prefix_sums(label: np.ndarray) -> np.ndarray:
    """Integral volume of the foreground, with a plane of zeros before each axis."""
    out = np.zeros(tuple(n + 1 for n in label.shape), np.uint32)
    out[1:, 1:, 1:] = (label > 0).astype(np.uint32).cumsum(0).cumsum(1).cumsum(2)
    return out


def box_count(prefix: np.ndarray, start: Sequence[int], size: Sequence[int]) -> int:
    """Foreground voxels of a box by its eight corners."""
    total = 0
    for corner in range(8):
        at = [start[a] + (size[a] if corner >> a & 1 else 0) for a in range(3)]
        total += int(prefix[at[2], at[1], at[0]]) * (1 if bin(corner).count("1") % 2 else -1)
    return total
