"""Gates with strict and non-strict comparators, switches, missing values, and readiness of a written report."""

import pytest
from pyspark.sql import functions as F

from groundloom.operators import report as rp


@pytest.fixture(scope="module")
def good(spark):
    values = {g.name: g.limit for g in rp.PREVIEW} | {"validation_warning_rate": 0.09, "hobby_set_duplicate_rate": 0.0}
    return values, lambda v: spark.createDataFrame([(k, float(x) if x is not None else None) for k, x in v.items()], "metric string, value double")


def passed(frame):
    return {r.gate: r.passed for r in frame.collect()}


def test_limits_are_met_or_not(good):
    values, frame = good
    assert all(passed(rp.checked(frame(values), rp.PREVIEW)).values()) and len(passed(rp.checked(frame(values), rp.PREVIEW))) == 12
    strict = passed(rp.checked(frame(values | {"validation_warning_rate": 0.10, "hobby_set_duplicate_rate": 0.02}), rp.PREVIEW))
    assert {k for k, v in strict.items() if not v} == {"validation_warning_rate", "hobby_set_duplicate_rate"}
    worse = passed(rp.checked(frame(values | {"hobby_atom_top1_share": 0.36, "schema_pass_rate": 0.99, "joint_field_sex_age_pass": 0}), rp.PREVIEW))
    assert {k for k, v in worse.items() if not v} == {"hobby_atom_top1_share", "schema_pass_rate", "joint_field_sex_age_pass"}


def test_switches_and_missing_values(good):
    values, frame = good
    assert len(passed(rp.checked(frame(values), rp.PREVIEW, rp.PROFILES["fixed_eval_set"]))) == 9
    some = {k: v for k, v in values.items() if k not in ("generation_success_rate", "schema_pass_rate")} | {"validation_error_rate": None}
    told = passed(rp.checked(frame(some), rp.PREVIEW))
    assert "generation_success_rate" not in told and told["schema_pass_rate"] is False and told["validation_error_rate"] is False


def test_a_written_report_is_ready_for_its_configuration_only(spark, good, tmp_path):
    values, frame = good
    rp.report(frame(values), rp.PREVIEW, {"a": 1}).write.parquet(str(tmp_path / "good"))
    rp.report(frame(values | {"schema_pass_rate": 0}), rp.PREVIEW, {"a": 1}).write.parquet(str(tmp_path / "bad"))
    read = lambda name: spark.read.parquet(str(tmp_path / name))
    rp.ready(read("good"), {"a": 1})
    with pytest.raises(RuntimeError, match="changed"):
        rp.ready(read("good"), {"a": 2})
    with pytest.raises(RuntimeError, match="did not pass"):
        rp.ready(read("bad"), {"a": 1})
    with pytest.raises(RuntimeError, match="one verdict"):
        rp.ready(read("good").filter("kind = 'metric'"), {"a": 1})


def test_metrics_of_several_grains(spark):
    rows = spark.createDataFrame([(1, "x"), (2, "x"), (3, None)], "i long, t string")
    grains = [(rows, {"n": F.count("*"), "share": F.avg(F.col("t").isNull().cast("int"))}), (rows.groupBy("t").count(), {"groups": F.count("*")}), (rows.limit(0), {"none": F.sum("i")})]
    assert {r.metric: r.value for r in rp.measured(grains).collect()} == {"n": 3.0, "share": 1 / 3, "groups": 2.0, "none": None}
