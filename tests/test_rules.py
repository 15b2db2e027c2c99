from pyspark.sql import functions as F

from voxelframe.operators import rules


def test_undecided_rules_are_broken(spark):
    df = spark.createDataFrame([(1, 5), (2, None), (3, -1)], "k int, v int")
    conditions = {"negative": F.col("v") < 0, "large": F.col("v") > 4}
    got = sorted(tuple(r) for r in rules.violations(df, ["k"], conditions).collect())
    assert got == [(1, "large"), (2, "large"), (2, "negative"), (3, "negative")]
    status = {r["k"]: r["status"] for r in rules.verdicts(df, ["k"], {"negative": F.col("v") < 0}, {"large": F.col("v") > 4}).collect()}
    assert status == {1: "warning", 2: "error", 3: "error"}


def test_preflight_and_claims(spark):
    df = spark.createDataFrame([(False, True, True, True), (True, True, True, False), (True, False, True, True), (True, True, False, False)], "a boolean, b boolean, c boolean, d boolean")
    assert [r[0] for r in df.select(rules.preflight(*[F.col(c) for c in "abcd"])).collect()] == ["build", "reuse", "rebuild", "blocked"]
    df = spark.createDataFrame([(2, "ok", "ok"), (3, "reject", "ok"), (3, "warn", "error"), (3, "ok", "ok")], "n int, s string, q string")
    assert [r[0] for r in df.select(rules.claim_eligibility(F.col("n"), F.col("s"), F.col("q"))).collect()] == ["too_few_repeats", "unstable", "quality_gate", "eligible"]


def test_fields_that_differ(spark):
    df = spark.createDataFrame([("a", 1, None), ("a", 1, "x"), ("b", 2, "y"), ("b", 2, "y")], "g string, p int, q string")
    assert [tuple(r) for r in rules.consistent(df, ["g"], ["p", "q"]).collect()] == [("a", "q", 2)]


def test_reconciliation(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0, 3.0), ("b", 1.0, None, 3.0)], "g string, x double, y double, w double")
    assert {r["g"]: r["agrees"] for r in rules.profile_reconciliation(df, ["g"], ["x", "y"], "w").collect()} == {"a": True, "b": False}
