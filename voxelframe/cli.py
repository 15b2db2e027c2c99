"""Command line: validate, prepare, inspect, split and ingest.

Any error ends with status 2 and a message.
"""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def _session() -> SparkSession:
    return SparkSession.builder.config("spark.ui.showConsoleProgress", "false").getOrCreate()


def dataset_validate(a: argparse.Namespace) -> str:
    from voxelframe.operators import dataset
    from voxelframe.sources import nifti, sinks

    spark = _session()
    images, labels = (nifti.listing(spark, f"{a.root}/{d}") for d in (a.images, a.labels))
    cases = dataset.with_problems(dataset.pair(images.select("case_id").distinct() if a.layout == "nnunet" else images, labels))
    return sinks.report("Dataset", {"Summary": dataset.summary(cases), "Invalid": cases.where("status = 'invalid'").withColumn("problems", F.concat_ws(",", "problems"))})


def prepare(a: argparse.Namespace) -> str:
    from voxelframe.operators import cache
    from voxelframe.plans.transform import TransformPlan
    from voxelframe.plans.transform import prepare as run
    from voxelframe.sources import nifti

    spark = _session()
    plan = TransformPlan.from_toml(Path(a.plan).read_text())
    named = lambda p, labels: nifti.load_volumes(spark, p, labels).where("error is null").withColumn("case_id", nifti.case_id(nifti.strip_nifti(F.substring_index("path", "/", -1))))
    images = named(f"{a.root}/imagesTr", False).groupBy("case_id", "shape", "spacing", "origin", "direction").agg(F.transform(F.sort_array(F.collect_list(F.struct("path", "values"))), lambda c: c["values"]).alias("channels"))
    labels = named(f"{a.root}/labelsTr", True).select("case_id", F.transform("values", lambda v: v.cast("int")).alias("label"))
    status = cache.write_promoted(run(images.join(labels, "case_id", "left"), plan), a.out, {"plan": plan.hash}, ["case_id"])
    return f"{a.out}: {status}"


def dicom_scan(a: argparse.Namespace) -> str:
    from voxelframe.operators import inventory
    from voxelframe.sources import dicom, sinks

    found, errors = dicom.scan(_session(), a.root)
    return sinks.report("Inventory", {"Modality and view": inventory.categorical_counts(found, ["modality", "view_position"]), "Warnings": inventory.warning_counts(found.select(F.transform("warnings", lambda w: w["code"]).alias("warnings"))), "Unreadable": errors})


def dicom_inspect(a: argparse.Namespace) -> str:
    from voxelframe.sources import dicom

    return json.dumps(dicom.inspect(Path(a.file).read_bytes()), indent=2)


def dicom_pixels(a: argparse.Namespace) -> str:
    from voxelframe.operators.images import terminal_view
    from voxelframe.sources import dicom

    image, steps = dicom.present(dicom.parse(Path(a.file).read_bytes()))
    return "\n".join(steps) if a.explain else terminal_view(image, a.width)


def split(a: argparse.Namespace) -> str:
    from voxelframe.operators import splits

    rows = _session().read.parquet(a.manifest)
    out = splits.apply_patients(rows, splits.hash_split(rows, a.ratios, a.seed))
    out.write.mode("overwrite").parquet(a.out)
    return "\n".join(f"{r['split']}: {r['samples']} samples, {r['patients']} patients" for r in splits.split_summary(out).collect())


def ingest(a: argparse.Namespace) -> str:
    from voxelframe.plans import ingest as pipeline
    from voxelframe.plans.config import Recipe

    recipe = Recipe.from_toml(Path(a.recipe).read_text())
    if a.dry_run:
        return "\n".join(f"{step}: {target}" for step, target in pipeline.plan(recipe, a.out))
    return json.dumps(pipeline.run(_session(), recipe, a.root, a.labels, a.out).summary, indent=2)


def cache_inspect(a: argparse.Namespace) -> str:
    from voxelframe.operators import cache

    spark = _session()
    rows = cache.read_table(spark, a.path)
    return json.dumps({"metadata": cache.read_metadata(spark, a.path), "rows": rows.count()}, indent=2)


def query(a: argparse.Namespace) -> str:
    import voxelframe.plans.files  # noqa: F401  registers its queries
    from voxelframe.plans.catalogue import QUERIES

    return "\n".join(json.dumps(r.asDict(recursive=True), default=str) for r in QUERIES[a.name](_session(), a.sf_dir).limit(a.limit).collect())


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser("voxelframe")
    commands = top.add_subparsers(required=True)

    def add(name: str, run, *arguments: tuple) -> None:
        one = commands.add_parser(name)
        for flag, options in arguments:
            one.add_argument(flag, **options)
        one.set_defaults(run=run)

    text, number = {"required": True}, {"type": int}
    add("dataset-validate", dataset_validate, ("root", {}), ("--images", {"default": "imagesTr"}), ("--labels", {"default": "labelsTr"}), ("--layout", {"default": "flat", "choices": ["flat", "nnunet"]}))
    add("prepare", prepare, ("root", {}), ("--plan", text), ("--out", text))
    add("dicom-scan", dicom_scan, ("root", {}))
    add("dicom-inspect", dicom_inspect, ("file", {}))
    add("dicom-pixels", dicom_pixels, ("file", {}), ("--explain", {"action": "store_true"}), ("--width", {**number, "default": 64}))
    add("split", split, ("manifest", {}), ("--out", text), ("--seed", {**number, "default": 0}), ("--ratios", {"type": float, "nargs": 3, "default": [0.8, 0.1, 0.1]}))
    add("ingest", ingest, ("root", {}), ("--recipe", text), ("--labels", text), ("--out", text), ("--dry-run", {"action": "store_true"}))
    add("cache-inspect", cache_inspect, ("path", {}))
    add("query", query, ("name", {}), ("sf_dir", {}), ("--limit", {**number, "default": 20}))
    return top


def main(arguments: Sequence[str] | None = None) -> int:
    a = parser().parse_args(arguments)
    try:
        print(a.run(a))
    except Exception as error:
        print(f"error: {str(error).splitlines()[0] if str(error) else type(error).__name__}", file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main())
