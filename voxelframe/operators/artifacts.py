"""Consistency of a run's artifacts: JSON documents against each other, as rows of errors.

Artifacts are rows (run_id, artifact, document).  Each run becomes one row of
documents; every rule is an expression over it, and the broken ones are rows
(run_id, error).  A document that is absent or no JSON counts as null.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rules import violations

ARTIFACTS = (
    "summary", "metadata", "manifest", "split", "cache", "environment", "loader", "gpu", "quality", "profile", "predictions", "localization", "memory",
    "quality_gate", "consistency", "preflight", "train_order", "result",
)

#: Settings that a summary's provenance repeats from the run's metadata (fixed values).
SETTINGS = (
    "image_size", "cache_image_size", "cache_dtype", "cache_build_workers", "cache_key_mode", "cache_splits", "allow_destructive_cache", "batch_size", "drop_last_train", "workers",
    "prefetch_depth", "prefetch_read_workers", "shuffle_block_batches", "gpu_prefetch_batches", "gpu_prefetch_reuse_buffers", "sync_every_step", "channels_last", "torch_compile",
    "torch_compile_mode", "learning_rate", "amp_dtype", "model_init", "loss_kind", "loss_pos_weight", "loss_pos_weight_cap", "focal_gamma", "focal_alpha", "read_mode", "include_metadata",
    "quality_gate", "quality_min_eval_samples", "quality_min_metric_targets", "quality_min_macro_auroc", "quality_min_macro_auprc", "eval_predictions", "train_order_evidence",
    "paired_train_order", "profile_batches", "loader_batches", "warmup_batches", "max_train_batches", "max_eval_batches", "skip_eval", "seed",
)
#: Memory figures that each phase must report (fixed values).
MEMORY = ("psutil_pss_mb", "psutil_uss_mb", "smaps_pss_mb", "smaps_uss_mb", "smaps_pss_file_mb", "smaps_pss_anon_mb")
#: Values that two documents must agree in: (document, path) and (document, path) (fixed values).
EQUAL = (
    ("summary.run_id", "metadata.run_id"), ("summary.provenance.run_id", "metadata.run_id"), ("summary.dataset_loaded", "metadata.dataset_loaded"),
    ("manifest.dataset_loaded", "metadata.dataset_loaded"), ("summary.samples", "manifest.samples"), ("summary.provenance.samples", "manifest.samples"),
    ("summary.targets", "metadata.targets"), ("summary.provenance.targets", "metadata.targets"), ("summary.provenance.baselines", "metadata.baselines"),
    ("summary.provenance.splits", "split.counts"), ("cache.dtype", "metadata.cache_dtype"), ("cache.image_size", "metadata.cache_image_size"),
    ("cache.cache_key_mode", "metadata.cache_key_mode"), ("summary.provenance.cache.cache_identity", "cache.cache_identity"),
    ("summary.provenance.cache.transform_fingerprint", "cache.transform_fingerprint"), ("summary.provenance.cache.source_manifest_checksum", "cache.source_manifest_checksum"),
    ("environment.run_metadata", "metadata"), ("summary.memory", "memory"), ("summary.predictions", "predictions"), ("summary.localization_eval", "localization"),
)


def by_run(artifacts: DataFrame) -> DataFrame:
    """(run_id, a column of JSON text for each of ARTIFACTS); keys of objects are put in order, the last of equal keys wins.

    Texts are aggregated by sorting. Documents are dealt out by run first, so a
    task sorts its share of the runs, not all that it reads.
    """
    text = F.to_json(F.try_parse_json("document"))
    return artifacts.repartition("run_id").groupBy("run_id").pivot("artifact", list(ARTIFACTS)).agg(F.max(text))


def at(place: str) -> Column:
    """JSON text at ``document.path``; null if it is not there."""
    document, _, path = place.partition(".")
    if not path:
        return F.col(document)
    return F.to_json(F.try_variant_get(F.try_parse_json(document), "$." + path, "variant"))


def string(place: str) -> Column:
    document, _, path = place.partition(".")
    return F.try_variant_get(F.try_parse_json(document), "$." + path, "string")


def differ(a: Column, b: Column) -> Column:
    """Whether two JSON values differ; numbers go by value."""
    numbers = a.try_cast("double") == b.try_cast("double")
    return ~(a.eqNullSafe(b) | F.coalesce(numbers, F.lit(False)))


def fields(json: Column) -> Column:
    """The fields of a JSON object as a map of texts."""
    return F.from_json(json, "map<string,string>")


def _sorted(values: Column) -> Column:
    return F.array_sort(F.map_entries(values))


def _rounded(document: str, value: str, digits: int, only_ok: bool) -> Column:
    """{name: rounded value} of a document of reports by name, as sorted entries."""
    number = lambda report: F.get_json_object(report, f"$.{value}").try_cast("double")
    keep = (lambda _, r: F.get_json_object(r, "$.status") == "ok") if only_ok else (lambda _, r: number(r).isNotNull())
    return _sorted(F.transform_values(F.map_filter(fields(F.col(document)), keep), lambda _, r: F.round(number(r), digits)))


def _numbers(json: Column) -> Column:
    return _sorted(F.transform_values(fields(json), lambda _, v: v.try_cast("double")))


def _is_object(json: Column) -> Column:
    return F.coalesce(json.startswith("{"), F.lit(False))


def run_errors(artifacts: DataFrame) -> DataFrame:
    """(run_id, rule) for each way in which a run's summary does not agree with its other documents."""
    counts, cache_splits = fields(at("split.counts")), fields(at("cache.splits"))
    samples = F.transform_values(cache_splits, lambda _, d: F.get_json_object(d, "$.samples").try_cast("double"))
    expected = F.transform_values(cache_splits, lambda k, _: F.try_element_at(counts, k).try_cast("double"))
    total = F.aggregate(F.map_values(counts), F.lit(0.0), lambda a, v: a + F.coalesce(v.try_cast("double"), F.lit(0.0)))
    requested = F.coalesce(string("metadata.profile_batches").try_cast("double"), F.lit(0.0)) > 0
    reports = F.map_filter(fields(F.col("profile")), lambda _, r: F.get_json_object(r, "$.status") == "ok")
    profiles = F.transform_values(reports, lambda _, r: F.to_json(F.try_parse_json(F.get_json_object(r, "$.summary"))))
    run_ok = lambda name: F.get_json_object(F.try_element_at(fields(F.col("gpu")), name), "$.status") == "ok"
    baselines = F.from_json(at("metadata.baselines"), "array<string>")
    no_profile = F.exists(baselines, lambda b: F.coalesce(run_ok(b), F.lit(False)) & ~F.map_contains_key(reports, b))
    length = lambda r: F.json_array_length(F.get_json_object(r, "$.records"))
    batches = lambda r: F.get_json_object(r, "$.summary.profiled_batches").try_cast("double")
    path = lambda r: F.get_json_object(r, "$.summary.profile_artifact_path")
    any_report = lambda test: F.exists(F.map_values(reports), lambda r: F.coalesce(test(r), F.lit(True)))
    rules = {"provenance missing": ~_is_object(at("summary.provenance"))}
    rules |= {a if a.startswith("summary.provenance.") or a.startswith("summary.") else f"{a} / {b}": differ(at(a), at(b)) for a, b in EQUAL}
    rules |= {f"provenance.{s}": differ(at(f"summary.provenance.{s}"), at(f"metadata.{s}")) for s in SETTINGS}
    rules |= {
        "manifest split sample total": ~_is_object(at("split.counts")) | differ(total.cast("string"), at("manifest.samples")),
        "cache split samples": ~_is_object(at("cache.splits")) | ~_sorted(samples).eqNullSafe(_sorted(expected)),
        "provenance.cache.split_samples": ~_numbers(at("summary.provenance.cache.split_samples")).eqNullSafe(_sorted(samples)),
        "environment.run_metadata missing": ~_is_object(at("environment.run_metadata")),
        "summary.loader_samples_per_second": ~_numbers(at("summary.loader_samples_per_second")).eqNullSafe(_rounded("loader", "samples_per_second", 3, False)),
        "summary.train_samples_per_second": ~_numbers(at("summary.train_samples_per_second")).eqNullSafe(_rounded("gpu", "samples_per_second", 3, False)),
        "summary.quality_macro_auroc": ~_numbers(at("summary.quality_macro_auroc")).eqNullSafe(_rounded("quality", "macro_auroc", 5, True)),
        "summary.quality_gate missing": ~_is_object(at("summary.quality_gate")),
        "summary.profile": ~_sorted(F.transform_values(fields(at("summary.profile")), lambda _, v: F.to_json(F.try_parse_json(v)))).eqNullSafe(_sorted(profiles)),
        "profile report is not ok": requested & F.coalesce(no_profile, F.lit(False)),
        "profile records missing": requested & any_report(lambda r: length(r).isNull()),
        "profile artifact path": requested & any_report(lambda r: path(r) != "step-profile.json"),
        "profile batches": requested & any_report(lambda r: batches(r) != length(r)),
    }
    return violations(by_run(artifacts), ["run_id"], {k: F.coalesce(v, F.lit(True)) for k, v in rules.items()})


def row_errors(artifacts: DataFrame, rows: DataFrame, prefetching: Sequence[str] = ()) -> DataFrame:
    """(run_id, rule) for the rows (run_id, baseline, cache_dtype, read_mode, returncode) of a matrix of runs.

    prefetching: baselines whose phases must describe their pipeline.
    """
    there = lambda name: F.coalesce(F.length(name) > 2, F.lit(False))  # noqa: E731  an empty object counts as missing
    phase = lambda name: F.try_element_at(fields(F.col(name)), F.col("baseline"))
    get = lambda json, path: F.get_json_object(json, f"$.{path}")
    flag = lambda name: F.coalesce(string(f"metadata.{name}") == "true", F.lit(False))
    far = lambda a, b: F.coalesce(F.abs(a.try_cast("double") - b.try_cast("double")) > 1e-3, F.lit(False))
    rules = {f"missing {name}": ~there(name) for name in ("result", "summary", "loader", "gpu", "environment", "cache", "preflight", "consistency")}
    rules |= {
        "return code": F.col("returncode") != 0,
        "missing quality_gate": F.coalesce(at("metadata.quality_gate").isNotNull(), F.lit(False)) & ~there("quality_gate"),
        "result status": there("result") & differ(string("result.status"), F.lit("ok")),
        "summary run_id missing": there("summary") & string("summary.run_id").isNull(),
        "summary run_id": string("summary.run_id").isNotNull() & differ(string("summary.run_id"), F.col("run_id")),
        "quality gate status": flag("quality_gate") & differ(string("quality_gate.status"), F.lit("ok")),
        "quality baseline missing": there("quality") & ~_is_object(phase("quality")),
        "loader baseline missing": ~_is_object(phase("loader")),
        "gpu baseline missing": ~_is_object(phase("gpu")),
        "channels-last inactive": flag("channels_last") & (differ(get(phase("gpu"), "channels_last_active"), F.lit("true")) | differ(get(phase("gpu"), "channels_last_all_checked_batches"), F.lit("true"))),
        "compilation inactive": flag("torch_compile") & differ(get(phase("gpu"), "torch_compile_status"), F.lit("active")),
        "train samples/s": far(F.try_element_at(fields(at("summary.train_samples_per_second")), F.col("baseline")), get(phase("gpu"), "samples_per_second")),
        "loader samples/s": far(F.try_element_at(fields(at("summary.loader_samples_per_second")), F.col("baseline")), get(phase("loader"), "samples_per_second")),
    }
    for name in ("summary", "consistency", "predictions", "train_order"):
        copy = at(f"result.artifacts.{name}")
        rules[f"result's copy of {name}"] = there(name) & _is_object(copy) & differ(copy, F.col(name))
    for name in ("run_id", "cache_dtype", "read_mode"):
        rules[f"environment {name}"] = there("metadata") & differ(string(f"metadata.{name}"), F.col(name))
    for name in ("loader", "gpu"):
        status, pipeline, memory = get(phase(name), "status"), get(phase(name), "pipeline"), get(phase(name), "memory")
        rules[f"{name} status"] = status.isNotNull() & (status != "ok")
        rules[f"{name} memory missing"] = ~_is_object(memory)
        for figure in MEMORY:
            value = get(memory, figure).try_cast("double")
            rules[f"{name} memory {figure}"] = _is_object(memory) & ~F.coalesce((value >= 0) & (value < float("inf")), F.lit(False))
        rules[f"{name} memory sources"] = _is_object(memory) & ~F.coalesce(F.array_contains(F.from_json(get(memory, "sources"), "array<string>"), "/proc/self/smaps"), F.lit(False))
        rules[f"{name} pipeline missing"] = F.col("baseline").isin(*prefetching) & ~_is_object(pipeline)
        for field in ("cache_dtype", "read_mode"):
            rules[f"{name} pipeline {field}"] = _is_object(pipeline) & differ(get(pipeline, field), F.col(field))
    joined = rows.join(by_run(artifacts), "run_id", "left")
    return violations(joined, ["run_id"], {k: F.coalesce(v, F.lit(False)) for k, v in rules.items()})
