import json

from voxelframe.operators import artifacts

MEMORY = {n: 1.0 for n in artifacts.MEMORY} | {"sources": ["/proc/self/smaps"]}


def documents(run, **changes):
    """A run whose documents all agree; ``changes`` replace values, given as document__key."""
    metadata = {s: 1 for s in artifacts.SETTINGS} | {"run_id": run, "dataset_loaded": True, "targets": ["a"], "baselines": ["own"], "cache_dtype": "u8", "read_mode": "map", "cache_image_size": 8, "profile_batches": 2, "quality_gate": True, "channels_last": False, "torch_compile": False}
    report = {"status": "ok", "samples_per_second": 10.12349, "memory": MEMORY, "pipeline": {"cache_dtype": "u8", "read_mode": "map"}}
    profile = {"status": "ok", "records": [{}, {}], "summary": {"profiled_batches": 2, "profile_artifact_path": "step-profile.json"}}
    cache = {"dtype": "u8", "image_size": 8, "cache_key_mode": metadata["cache_key_mode"], "cache_identity": "i", "transform_fingerprint": "t", "source_manifest_checksum": "m", "splits": {"train": {"samples": 8}, "val": {"samples": 2}}}
    provenance = metadata | {"samples": 10, "splits": {"val": 2, "train": 8}, "cache": {"cache_identity": "i", "transform_fingerprint": "t", "source_manifest_checksum": "m", "split_samples": {"train": 8, "val": 2}}}
    summary = {
        "run_id": run, "dataset_loaded": True, "samples": 10, "targets": ["a"], "provenance": provenance, "loader_samples_per_second": {"own": 10.123}, "train_samples_per_second": {"own": 10.123},
        "quality_macro_auroc": {"own": 0.76543}, "memory": {"x": 1}, "predictions": {"n": 3}, "localization_eval": {}, "quality_gate": {"status": "ok"}, "profile": {"own": profile["summary"]},
    }
    out = {
        "summary": summary, "metadata": metadata, "manifest": {"dataset_loaded": True, "samples": 10}, "split": {"counts": {"train": 8, "val": 2}}, "cache": cache, "environment": {"run_metadata": metadata},
        "loader": {"own": report}, "gpu": {"own": report}, "quality": {"own": {"status": "ok", "macro_auroc": 0.765432}}, "profile": {"own": profile}, "predictions": {"n": 3}, "localization": {}, "memory": {"x": 1.0},
        "quality_gate": {"status": "ok"}, "consistency": {"status": "ok"}, "preflight": {"action": "reuse"}, "train_order": {"n": 1}, "result": {"status": "ok", "artifacts": {"consistency": {"status": "ok"}}},
    }
    out = json.loads(json.dumps(out))
    for name, value in changes.items():
        place, *path = name.split("__")
        if not path:
            out.pop(place) if value is None else out.update({place: value})
            continue
        at = out[place]
        for key in path[:-1]:
            at = at[key]
        at[path[-1]] = value
    return [(run, name, json.dumps(doc)) for name, doc in out.items()]


def found(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["run_id"], set()).add(r["rule"])
    return out


def test_run_errors(spark):
    cases = {
        "good": ({}, set()),
        "id": ({"summary__run_id": "x"}, {"summary.run_id"}),
        "total": ({"manifest__samples": 11}, {"summary.samples", "summary.provenance.samples", "manifest split sample total"}),
        "setting": ({"summary__provenance__seed": 2}, {"provenance.seed"}),
        "rate": ({"loader__own__samples_per_second": 11.0}, {"summary.loader_samples_per_second"}),
        "quality": ({"quality__own__macro_auroc": 0.7}, {"summary.quality_macro_auroc"}),
        "failed": ({"quality__own__status": "error"}, {"summary.quality_macro_auroc"}),
        "cache": ({"cache__splits__val__samples": 3}, {"cache split samples", "provenance.cache.split_samples"}),
        "records": ({"profile__own__records": [{}]}, {"profile batches"}),
        "profile": ({"profile__own__status": "error"}, {"summary.profile", "profile report is not ok"}),
        "environment": ({"environment": {}}, {"environment.run_metadata / metadata", "environment.run_metadata missing"}),
    }
    rows = [row for name, (changes, _) in cases.items() for row in documents(name, **changes)]
    got = found(artifacts.run_errors(spark.createDataFrame(rows, "run_id string, artifact string, document string")))
    assert got == {name: want for name, (_, want) in cases.items() if want}


def test_row_errors(spark):
    cases = {
        "good": ({}, set()),
        "result": ({"result__status": "failed"}, {"result status"}),
        "gone": ({"preflight": None}, {"missing preflight"}),
        "copy": ({"result__artifacts__consistency": {"status": "bad"}}, {"result's copy of consistency"}),
        "memory": ({"gpu__own__memory": MEMORY | {"smaps_pss_mb": -1, "sources": []}}, {"gpu memory smaps_pss_mb", "gpu memory sources"}),
        "pipeline": ({"loader__own__pipeline": {}, "gpu__own__pipeline__read_mode": "stream"}, {"loader pipeline cache_dtype", "loader pipeline read_mode", "gpu pipeline read_mode"}),
        "status": ({"loader__own__status": "error"}, {"loader status"}),
        "gate": ({"quality_gate__status": "error"}, {"quality gate status"}),
        "layout": ({"metadata__channels_last": True}, {"channels-last inactive"}),
        "rate": ({"gpu__own__samples_per_second": 12}, {"train samples/s"}),
        "code": ({}, {"return code"}),
    }
    rows = [row for name, (changes, _) in cases.items() for row in documents(name, **changes)]
    matrix = spark.createDataFrame([(name, "own", "u8", "map", int(name == "code")) for name in cases], "run_id string, baseline string, cache_dtype string, read_mode string, returncode int")
    got = found(artifacts.row_errors(spark.createDataFrame(rows, "run_id string, artifact string, document string"), matrix, prefetching=["own"]))
    assert got == {name: want for name, (_, want) in cases.items() if want}


def test_documents_are_dealt_out_before_they_are_sorted(spark):
    """Few small rows can hold very many documents; the task that reads them must not sort them all."""
    rows = spark.range(50, numPartitions=1).selectExpr("concat('r', id) run_id", "explode(array('summary', 'metadata')) artifact", "'{}' document")
    got = artifacts.by_run(rows)
    assert got.count() == 50 and got.where("summary = '{}' AND metadata = '{}' AND cache IS NULL").count() == 50
    before, exchange, reading = got._jdf.queryExecution().executedPlan().toString().partition("Exchange hashpartitioning(run_id")
    assert exchange and "Sort" in before and "Sort" not in reading and "Exchange" not in before


def test_unreadable_documents(spark):
    rows = spark.createDataFrame([("a", "summary", "{not json"), ("a", "metadata", None)], "run_id string, artifact string, document string")
    assert "provenance missing" in found(artifacts.run_errors(rows))["a"]
    assert artifacts.run_errors(rows.where("false")).count() == 0
