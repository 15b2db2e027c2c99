"""Patient-safe splits and their audits.

No patient is ever in two splits.  The hash split has a closed form, so it is
plain windows; the stratified split is greedy and runs over the compact table
of patients in one task.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxelframe.functions.hashing import stable_bucket

SPLITS = ("train", "val", "test")


def check_ratios(ratios: Sequence[float]) -> None:
    if len(ratios) != 3 or any(not (0 <= r < float("inf")) for r in ratios) or abs(sum(ratios) - 1) > 1e-6:
        raise ValueError(f"split ratios must be finite, not negative and add up to 1: {ratios}")


def half_away(x: float) -> int:
    return int(x + 0.5)


def patient_sizes(samples: DataFrame, seed: int) -> DataFrame:
    return samples.groupBy("patient_id").agg(F.count("*").alias("n")).withColumn("bucket", stable_bucket(F.col("patient_id"), seed))


def hash_split(samples: DataFrame, ratios: Sequence[float] = (0.8, 0.1, 0.1), seed: int = 0) -> DataFrame:
    """(patient_id, n, bucket, split): patients in bucket order fill train, then val, then test.

    A patient goes to train while the samples before it are fewer than the
    target, and likewise to val from where train ended.  The running count is
    taken within ranges of the (uniform) bucket and over the ranges' sums, so
    no task sorts all patients.
    """
    check_ratios(ratios)
    patients = patient_sizes(samples, seed).withColumn("_range", F.substring("bucket", 1, 2))
    sums = patients.groupBy("_range").agg(F.sum("n").alias("_n"))
    over = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    starts = sums.select("_range", F.coalesce(F.sum("_n").over(over), F.lit(0)).alias("_start"), F.sum("_n").over(everything).alias("_total"))
    inside = Window.partitionBy("_range").orderBy("bucket", "patient_id").rowsBetween(Window.unboundedPreceding, -1)
    placed = patients.withColumn("_inside", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(F.broadcast(starts), "_range")
    placed = placed.withColumn("_before", F.col("_inside") + F.col("_start"))
    target = lambda r: F.round(F.lit(float(r)) * F.greatest("_total", F.lit(1))).cast("long")
    train, val = target(ratios[0]), target(ratios[1])
    # the first count at which train is full: one number, found by an aggregate
    full = placed.where(F.col("_before") >= train).agg(F.min("_before").alias("_full"))
    placed = placed.crossJoin(F.broadcast(full))
    split = F.when(F.col("_before") < train, "train").when(F.col("_before") - F.col("_full") < val, "val").otherwise("test")
    return placed.select("patient_id", "n", "bucket", split.alias("split"))


def apply_patients(samples: DataFrame, patients: DataFrame) -> DataFrame:
    return samples.join(patients.select("patient_id", "split"), "patient_id")


def overlap_values(rows: DataFrame, value: str, split: str = "split") -> DataFrame:
    """Values found in two splits or more, each once."""
    return rows.where(F.col(value).isNotNull()).groupBy(value).agg(F.countDistinct(split).alias("splits")).where("splits > 1")


def overlap_pairs(rows: DataFrame, value: str, limit: int = 100) -> DataFrame:
    """(split_a, split_b, value) for each pair of splits that share a value, at most ``limit`` of each pair.

    Works on each value's set of splits (three at most), so nothing is joined.
    """
    sets = rows.where(F.col(value).isNotNull()).groupBy(value).agg(F.sort_array(F.collect_set("split")).alias("s")).where("size(s) > 1")
    pairs = F.flatten(F.transform("s", lambda a, i: F.transform(F.slice("s", i + 2, 10), lambda b: F.struct(a.alias("split_a"), b.alias("split_b")))))
    listed = sets.select(F.explode(pairs).alias("p"), F.col(value).alias("value")).select("p.split_a", "p.split_b", "value")
    rank = Window.partitionBy("split_a", "split_b").orderBy("value")
    return listed.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= limit).drop("rank")


def audit_membership(assigned: DataFrame, manifest: DataFrame) -> DataFrame:
    """Problems of a list (sample_id, split) against a manifest: unknown, multiple, omitted."""
    unknown = assigned.join(manifest, "sample_id", "left_anti").select("sample_id").distinct().withColumn("problem", F.lit("unknown"))
    multiple = assigned.groupBy("sample_id").count().where("count > 1").select("sample_id").withColumn("problem", F.lit("multiple"))
    omitted = manifest.join(assigned, "sample_id", "left_anti").select("sample_id").distinct().withColumn("problem", F.lit("omitted"))
    return unknown.unionByName(multiple).unionByName(omitted)


def in_list_order(assigned: DataFrame, manifest: DataFrame) -> DataFrame:
    """Manifest rows of (sample_id, ordinal), in list order; an id that is not there is an error."""
    found = assigned.join(manifest.withColumn("_there", F.lit(True)), "sample_id", "left")
    checked = F.when(F.col("_there").isNull(), F.raise_error(F.concat(F.lit("unknown sample "), "sample_id"))).otherwise(F.lit(True))
    return found.withColumn("_there", checked).where("_there").drop("_there").orderBy("ordinal")


#: Accepted names of stratify fields (fixed values).
FIELD_NAMES = {
    "labelsource": "label_source", "laterality": "laterality", "modality": "modality", "photometricinterpretation": "photometric_interpretation",
    "sourceformat": "source_format", "view": "view_position", "viewposition": "view_position", "viewpositioncode": "view_position",
}


def strata(samples: DataFrame, long: DataFrame, labels: Sequence[str] = (), fields: Sequence[str] = ()) -> DataFrame:
    """(sample_id, patient_id, stratum): ``label:T=positive`` and ``field=value``, lower-cased and trimmed."""
    positive = long.where((F.col("value") == 1) & F.col("target").isin(*labels)) if labels else long.where("false")
    parts = positive.select("sample_id", "patient_id", F.concat(F.lit("label:"), "target", F.lit("=positive")).alias("stratum"))
    for field in fields:
        name = FIELD_NAMES.get(field.lower().replace("_", ""))
        if name is None or name not in samples.columns:
            raise ValueError(f"unknown stratify target {field!r}")
        text = F.lower(F.trim(F.col(name)))
        parts = parts.unionByName(samples.where(text.isNotNull() & (text != "")).select("sample_id", "patient_id", F.concat(F.lit(f"{name}="), text).alias("stratum")))
    return parts


@dataclass(frozen=True)
class Weights:
    """Weights of the squared deviations (fixed values)."""

    label: float = 16.0
    field: float = 4.0
    size: float = 1.0
    tie: float = 1e-12


def greedy_split(patients: list[tuple[str, str, int, dict[str, int]]], ratios: Sequence[float], weights: Weights = Weights()) -> dict[str, str]:
    """patients: (patient, bucket, samples, samples by stratum) -> split of each.

    Patients with the rarest strata are placed first, each into the split where
    the squared relative deviations of its strata and of the size end lowest.
    """
    totals: dict[str, int] = {}
    for _, _, _, own in patients:
        for s, n in own.items():
            totals[s] = totals.get(s, 0) + n
    size = max(sum(p[2] for p in patients), 1)
    rarest = lambda own: min((totals[s] for s in own), default=1 << 62)
    order = sorted(patients, key=lambda p: (rarest(p[3]), -sum(p[3].values()), -p[2], p[1], p[0]))
    target = [r * size if r > 0 else 0.0 for r in ratios]
    count, by = [0, 0, 0], [dict.fromkeys(totals, 0) for _ in range(3)]

    def rise(split: int, own: dict[str, int], n: int) -> float:
        """How much the squared relative deviations of this split grow; the other splits' stay."""
        square = lambda have, add, want, whole: ((have + add - want) ** 2 - (have - want) ** 2) / whole**2
        total = weights.size * square(count[split], n, target[split], size)
        for s in sorted(own):
            weight = weights.label if s.startswith("label:") else weights.field
            total += weight * square(by[split][s], own[s], max(ratios[split], 0.0) * totals[s], max(totals[s], 1))
        return total

    out = {}
    for patient, _, n, own in order:
        rises = [rise(i, own, n) for i in range(3)]
        tied = [i for i in range(3) if rises[i] - min(rises) <= weights.tie]
        pick = min(tied, key=lambda i: ((count[i] + n) / max(target[i], 1.0), count[i], i))
        count[pick] += n
        for s, k in own.items():
            by[pick][s] += k
        out[patient] = SPLITS[pick]
    return out


def stratified_split(samples: DataFrame, strata_rows: DataFrame, ratios: Sequence[float] = (0.8, 0.1, 0.1), seed: int = 0) -> DataFrame:
    """(patient_id, split).  The greedy step sees one row for each patient."""
    check_ratios(ratios)
    counts = strata_rows.groupBy("patient_id", "stratum").agg(F.countDistinct("sample_id").alias("k"))
    own = counts.groupBy("patient_id").agg(F.map_from_entries(F.collect_list(F.struct("stratum", "k"))).alias("own"))
    table = patient_sizes(samples, seed).join(own, "patient_id", "left").withColumn("_all", F.lit(1))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = [(p, b, int(n), {s: int(k) for s, k in (dict(o) if o is not None else {}).items()}) for p, b, n, o in zip(pdf["patient_id"], pdf["bucket"], pdf["n"], pdf["own"], strict=True)]
        got = greedy_split(rows, ratios)
        return pd.DataFrame({"patient_id": list(got), "split": list(got.values())})

    return table.groupBy("_all").applyInPandas(run, "patient_id string, split string")


def capped_split(groups: list[tuple[str, int]], caps: Sequence[int], seed: int) -> dict[str, str]:
    """Shuffled patients into the split with room that is filled least; those that fit nowhere are left out."""
    import random

    order, count, out = sorted(groups), [0, 0, 0], {}
    random.Random(seed).shuffle(order)
    for patient, n in order:
        open_ = [i for i in range(3) if count[i] + n <= caps[i]]
        if open_:
            pick = min(open_, key=lambda i: (count[i] / max(caps[i], 1), i))
            count[pick] += n
            out[patient] = SPLITS[pick]
        if all(count[i] >= caps[i] for i in range(3)):
            break
    return out


def split_summary(samples: DataFrame) -> DataFrame:
    """Rows and patients of each split, zero where empty, and patients in two splits."""
    counts = samples.groupBy("split").agg(F.count("*").alias("samples"), F.countDistinct("patient_id").alias("patients"))
    names = samples.sparkSession.createDataFrame([(s,) for s in SPLITS], "split string")
    return names.join(counts, "split", "left").select("split", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("samples", "patients")])


