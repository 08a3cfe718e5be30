"""One report of a run: metrics of several grains, gates over them, and the fingerprint of the configuration.

A grain is a table (rows, groups of equal texts, items, labels); all metrics of a grain are one aggregate over it, so a report takes as many
passes as there are grains. Metrics and gates come out as long rows.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .checks import assert_ready, fingerprint

COMPARATORS = {">=": lambda a, b: a >= b, ">": lambda a, b: a > b, "<=": lambda a, b: a <= b, "<": lambda a, b: a < b, "==": lambda a, b: a == b}


@dataclass(frozen=True)
class Gate:
    name: str
    comparator: str
    limit: float
    #: A gate may be switched off by the name of its switch, and one that isn't needed is left out where nothing was measured.
    switch: str | None = None
    needed: bool = True


# Names, comparators and limits of the preview's gates, in their order. Booleans are 0 and 1.
PREVIEW = [
    Gate("generation_success_rate", ">=", 1.0, needed=False),
    Gate("schema_pass_rate", ">=", 1.0),
    Gate("validation_error_rate", "<=", 0.0),
    Gate("validation_warning_rate", "<", 0.10),
    Gate("exact_duplicate_narrative_rows", "<=", 0.0),
    Gate("hobby_set_duplicate_rate", "<", 0.02),
    Gate("null_only_exposed_columns", "<=", 0.0),
    Gate("district_placeholder_rate", "<=", 0.0),
    Gate("hobby_atom_top1_share", "<=", 0.35),
    Gate("field_marginal_pass", "==", 1.0, "field_marginal"),
    Gate("joint_field_sex_age_pass", "==", 1.0, "joint"),
    Gate("fact_checks_failed", "==", 0.0, "fact_check"),
]
# What each profile switches off.
PROFILES = {"release_preview": (), "fixed_eval_set": ("field_marginal", "joint", "fact_check")}


def measured(grains: Iterable[tuple[DataFrame, dict[str, Column]]]) -> DataFrame:
    """metric, value of all grains: one aggregate each. A value without rows is null."""
    parts = []
    for rows, metrics in grains:
        one = rows.agg(*(c.cast("double").alias(k) for k, c in metrics.items()))
        parts.append(one.unpivot([], list(metrics), "metric", "value"))
    return reduce(DataFrame.unionByName, parts)


def checked(metrics: DataFrame, gates: list[Gate], off: Iterable[str] = ()) -> DataFrame:
    """place, gate, observed, comparator, threshold, passed: the gates that are not switched off. A needed gate without a value fails."""
    spark, kept = metrics.sparkSession, [(i, g) for i, g in enumerate(gates) if g.switch not in set(off)]
    table = spark.createDataFrame([(i, g.name, g.comparator, float(g.limit), g.needed) for i, g in kept], "place int, gate string, comparator string, threshold double, needed boolean")
    met = F.broadcast(table).join(metrics.select(F.col("metric").alias("gate"), F.col("value").alias("observed")), "gate", "left").filter("needed or observed is not null")
    holds = F.coalesce(*(F.when(F.col("comparator") == k, f(F.col("observed"), F.col("threshold"))) for k, f in COMPARATORS.items()), F.lit(False))
    return met.select("place", "gate", "observed", "comparator", "threshold", holds.alias("passed"))


def report(metrics: DataFrame, gates: list[Gate], config: dict, off: Iterable[str] = ()) -> DataFrame:
    """kind (metric, gate, verdict), name, value, comparator, threshold, passed, config: the whole report as rows."""
    checks = checked(metrics, gates, off)
    nothing = lambda kind: F.lit(None).cast(kind)
    rows = metrics.select(F.lit("metric").alias("kind"), F.col("metric").alias("name"), "value", nothing("string").alias("comparator"), nothing("double").alias("threshold"), nothing("boolean").alias("passed"))
    told = checks.select(F.lit("gate").alias("kind"), F.col("gate").alias("name"), F.col("observed").alias("value"), "comparator", "threshold", "passed")
    all_of = checks.agg(F.coalesce(F.bool_and("passed"), F.lit(False)).alias("passed"), F.count_if(~F.col("passed")).cast("double").alias("value"))
    verdict = all_of.select(F.lit("verdict").alias("kind"), F.lit("failed gates").alias("name"), "value", nothing("string").alias("comparator"), nothing("double").alias("threshold"), "passed")
    return rows.unionByName(told).unionByName(verdict).withColumn("config", F.lit(fingerprint(config)))


def ready(told: DataFrame, config: dict) -> None:
    """An error if a written report's verdict isn't good, or if the configuration is another one now."""
    rows = told.filter("kind = 'verdict'").select("passed", "config").limit(2).collect()
    if len(rows) != 1:
        raise RuntimeError("a report needs one verdict")
    assert_ready({"passed": rows[0]["passed"], "config": rows[0]["config"]}, config)
