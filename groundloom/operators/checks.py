"""Checks of whole rows and tables: columns, types, ranges, ids, categories, judge documents, readiness of a run."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def require(df: DataFrame, columns: list[str]) -> DataFrame:
    """The same rows; missing columns are an error when the plan is made."""
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"missing columns: {missing}")
    return df


def restricted(df: DataFrame, columns: list[str], unsupported: tuple[str, ...] = ()) -> DataFrame:
    """The declared columns in their order; absent and unsupported ones are null."""
    return df.select(*(F.lit(None).cast(dict(df.dtypes).get(c, "string")).alias(c) if c in unsupported or c not in df.columns else F.col(c) for c in columns))


def mapped(value: Column, names: dict[str, str]) -> Column:
    """The class of a value; one without a class is an error."""
    table = F.create_map(*(F.lit(x) for kv in names.items() for x in kv))
    found = F.try_element_at(table, value)
    return F.when(found.isNotNull() | value.isNull(), found).otherwise(F.raise_error(F.concat(F.lit("no class for "), value)).cast("string"))


@dataclass(frozen=True)
class Rule:
    """What a column must be: present unless nullable, within a range of numbers or lengths, one of some values."""

    column: str
    nullable: bool = False
    low: float | None = None
    high: float | None = None
    lengths: tuple[int, int] | None = None
    values: tuple[str, ...] = ()


def violations(df: DataFrame, rules: list[Rule]) -> Column:
    """The names of a row's faults, by rule: column:missing, :range, :length, :value; and of columns without a rule, :extra."""
    found = []
    for rule in rules:
        c = F.col(rule.column) if rule.column in df.columns else F.lit(None)
        if not rule.nullable:
            found.append(F.when(c.isNull(), F.lit(f"{rule.column}:missing")))
        if rule.low is not None or rule.high is not None:
            low, high = (float("-inf") if rule.low is None else rule.low), (float("inf") if rule.high is None else rule.high)
            found.append(F.when(~c.cast("double").between(low, high), F.lit(f"{rule.column}:range")))
        if rule.lengths:
            found.append(F.when(~F.char_length(c.cast("string")).between(*rule.lengths), F.lit(f"{rule.column}:length")))
        if rule.values:
            found.append(F.when(~c.cast("string").isin(*rule.values), F.lit(f"{rule.column}:value")))
    known = {rule.column for rule in rules}
    found += [F.lit(f"{c}:extra") for c in df.columns if c not in known]
    return F.array_compact(F.array(*found)) if found else F.array().cast("array<string>")


def pass_rate(df: DataFrame, rules: list[Rule], given: list[str]) -> DataFrame:
    """given, n, passed, pass_rate, faults: rows that break no rule."""
    marked = df.select(*given, F.size(violations(df, rules)).alias("faults"))
    return marked.groupBy(*given).agg(F.count("*").alias("n"), F.count_if(F.col("faults") == 0).alias("passed"), F.sum("faults").alias("faults")).withColumn("pass_rate", F.col("passed") / F.col("n"))


def id_differences(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """One row: n_left, n_right, only_left, only_right of the distinct ids; equal sets have no only_."""
    sides = left.select(key).distinct().withColumn("l", F.lit(1)).join(right.select(key).distinct().withColumn("r", F.lit(1)), key, "full")
    return sides.agg(F.count("l").alias("n_left"), F.count("r").alias("n_right"), F.count_if(F.col("r").isNull()).alias("only_left"), F.count_if(F.col("l").isNull()).alias("only_right"))


def joined_or_error(left: DataFrame, right: DataFrame, key: str, needed: str) -> DataFrame:
    """A left join in which every row must find ``needed``."""
    found = F.when(F.col(needed).isNotNull(), F.col(needed)).otherwise(F.raise_error(F.concat(F.lit(f"no {needed} for "), F.col(key).cast("string"))).cast(dict(right.dtypes)[needed]))
    return left.join(right, key, "left").withColumn(needed, found)


def set_differences(left: DataFrame, right: DataFrame, column: str) -> DataFrame:
    """value, side ("left" or "right") of the categories that only one side has."""
    a, b = (x.select(F.col(column).alias("value")).distinct() for x in (left, right))
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def judge_faults(document: Column, dimensions: list[str], low: int = 1, high: int = 5) -> Column:
    """Faults of a judge's JSON document {dimension: {score, reasoning}}: missing dimensions, scores out of range, empty reasons."""
    kind = "struct<" + ", ".join(f"`{d}`: struct<score: int, reasoning: string>" for d in dimensions) + ">"
    at = F.from_json(document, kind)
    found = []
    for d in dimensions:
        score, reason = at[d]["score"], at[d]["reasoning"]
        found += [F.when(at[d].isNull() | score.isNull(), F.lit(f"{d}:missing")), F.when(~score.between(low, high), F.lit(f"{d}:range")), F.when(score.isNotNull() & (F.trim(F.coalesce(reason, F.lit(""))) == ""), F.lit(f"{d}:reason"))]
    return F.array_compact(F.array(*found))


def fingerprint(config: dict) -> str:
    """SHA-256 of the canonical JSON: keys in order, no blanks, text as it is."""
    return hashlib.sha256(json.dumps(config, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def assert_ready(report: dict, config: dict) -> None:
    """A run may start if the preview's gate passed for the very same configuration."""
    if not report.get("passed"):
        raise RuntimeError("the preview's gate did not pass")
    if report.get("config") != fingerprint(config):
        raise RuntimeError("the configuration has changed since the preview")


def different_share(rows: DataFrame, fields: list[str]) -> DataFrame:
    """n, different, share: distinct texts over all rows and fields together."""
    every = rows.select(F.explode(F.array(*fields)).alias("value")).filter("value is not null")
    return every.groupBy("value").agg(F.count("*").alias("c")).agg(F.sum("c").alias("n"), F.count("*").alias("different")).withColumn("share", F.col("different") / F.col("n"))


def consolidated(parts: dict[str, DataFrame], key: str) -> DataFrame:
    """key, annotator, dimension, score (null if it isn't a whole number), reasoning (blank for none) of several annotators' tables."""
    out = None
    for name, rows in parts.items():
        one = rows.select(key, F.lit(name).alias("annotator"), "dimension", F.col("score").try_cast("int").alias("score"), F.coalesce("reasoning", F.lit("")).alias("reasoning"))
        out = one if out is None else out.unionByName(one)
    return out


def with_overall(annotations: DataFrame, key: str) -> DataFrame:
    """Adds a row ``_overall`` for each row and annotator: the mean of the scores, rounded half up; null if one is missing."""
    whole = annotations.groupBy(key, "annotator").agg(F.when(F.count("score") == F.count("*"), F.floor(F.avg("score") + 0.5).cast("int")).alias("score"))
    return annotations.unionByName(whole.select(key, "annotator", F.lit("_overall").alias("dimension"), "score", F.lit("").alias("reasoning")))


def corrected(rows: DataFrame, fixes: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The rows with corrections (keys, old_value, new_value) applied, and ``amended``.

    Two corrections of one key, one of another value than the current, and one that meets no row are errors."""
    one = fixes.groupBy(*keys).agg(F.count("*").alias("__n"), F.first("old_value").alias("__old"), F.first("new_value").alias("__new"))
    joined = rows.withColumn("__here", F.lit(True)).join(one, keys, "full")
    name = F.concat_ws("|", *keys)
    wrong = F.when(F.col("__n") > 1, F.lit("corrected twice: ")).when(F.col("__here").isNull(), F.lit("correction of no row: ")).when(F.col("__n").isNotNull() & ~F.col("__old").eqNullSafe(F.col(value)), F.lit("correction of another value: "))
    kind = dict(rows.dtypes)[value]
    new = F.when(wrong.isNotNull(), F.raise_error(F.concat(wrong, name)).cast(kind)).when(F.col("__n").isNotNull(), F.col("__new").cast(kind)).otherwise(F.col(value))
    return joined.withColumn(value, new).withColumn("amended", F.col("__n").isNotNull()).select(*rows.columns, "amended")


def release(runs: list[DataFrame], columns: list[str], key: str, expected: int, derived: dict[str, Column] | None = None) -> DataFrame:
    """The runs below each other, cut to the columns; a derived column is made in runs that lack it.

    Missing columns, another number of rows than expected, and repeated or null keys are errors."""
    whole = None
    for run in runs:
        made = run.withColumns({k: c for k, c in (derived or {}).items() if k not in run.columns})
        part = require(made, columns).select(*columns)
        whole = part if whole is None else whole.unionByName(part)
    if whole is None:
        raise ValueError("no runs")
    per_key = whole.groupBy(key).agg(F.count("*").alias("n"))
    n, repeated = per_key.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count_if((F.col("n") > 1) | F.col(key).isNull())).first()
    if n != expected:
        raise ValueError(f"{expected} rows expected, {n} found")
    if repeated:
        raise ValueError(f"{repeated} values of {key} are repeated or null")
    return whole
