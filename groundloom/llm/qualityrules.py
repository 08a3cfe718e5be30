"""Quality rules whose cutoffs are certified on labelled documents.

Five figures of each whole text (``signals``) give five shares; a rule rejects a document whose share lies beyond the rule's
cutoff. The cutoffs of all rules together form one path of ``LEVELS`` vectors, fixed beforehand, from lenient to strict. Labelled
good documents that pass the base rules are the holdout. In each stratum (language) the vectors are tested in that order: one
stands if the exact (Clopper-Pearson) upper bound of the share of good documents that any of its rules rejects is at most
``ALPHA``, at level ``DELTA`` over the number of strata, and all more lenient ones stand (fixed-sequence testing along the
path, Bonferroni across strata). So with probability 1 - DELTA no stratum loses more than ALPHA of its good documents to
the rules. A stratum is judged by the strictest vector that stands; where the holdout is too small for any certificate
(fewer than about ln(strata / DELTA) / ALPHA good documents), by none.

Cases: null text: all counts 0, fails the base rules. Null language is a stratum of its own. A document with
several labels is good only if all are 1. Repeated rows are judged alike; a repeated good row counts once in the holdout. Null
ids are judged but never labelled. Extra columns are ignored. No row: no row.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch

ALPHA, DELTA = 0.05, 0.05
#: share (thousandths) and a cutoff for each level of the path; "over" rejects above the cutoff, "under" below.
RULES = {
    "long_words": ("1000 * word_chars div n_words", "over", [16000, 14000, 12000, 11000, 10000, 9500, 9000, 8500, 8000, 7500, 7000, 6500]),
    "short_words": ("1000 * word_chars div n_words", "under", [1000, 1500, 2000, 2500, 2800, 3000, 3200, 3400, 3600, 3800, 4000, 4200]),
    "symbols": ("1000 * n_symbols div word_chars", "over", [500, 300, 200, 150, 100, 80, 60, 50, 40, 30, 20, 10]),
    "dup_lines": ("1000 * n_dup_lines div n_words", "over", [500, 300, 200, 150, 100, 80, 60, 40, 30, 20, 15, 10]),
    "repeats": ("1000 * n_repeat_words div n_words", "over", [195, 190, 185, 180, 170, 160, 150, 140, 130, 120, 110, 100]),
}
LEVELS = 12
_GAP = " \t\n\u000b\f\r"
_SPLIT = r"[\x20\x09-\x0D]+"


def signals(docs: DataFrame, *keep: str) -> DataFrame:
    """doc_id, the columns to keep, and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    solid = F.char_length(F.translate(text, _GAP, ""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    base = docs.select("doc_id", *keep, F.array_remove(F.split(text, _SPLIT), "").alias("words"), solid.cast("long").alias("word_chars"), (F.char_length(text) - F.char_length(F.translate(text, "#*$%&|<>", ""))).cast("long").alias("n_symbols"), lines.alias("lines"))
    base = base.withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))
    base = base.withColumn("windows", F.expr("if(size(hashes) < 5, array(), transform(sequence(0, size(hashes) - 5), i -> xxhash64(hashes[i], hashes[i + 1], hashes[i + 2], hashes[i + 3], hashes[i + 4])))"))
    counted = base.select("doc_id", *keep, F.size("words").cast("long").alias("n_words"), "word_chars", "n_symbols", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), F.expr("if(size(array_distinct(windows)) = size(windows), null, windows)").alias("windows"))
    placed = counted.withColumn("ordered", F.expr("sort_array(transform(windows, (h, i) -> named_struct('h', h, 'i', i)))"))
    placed = placed.withColumn("at", F.expr("sort_array(transform(filter(ordered, (x, k) -> coalesce(x.h = get(ordered, k - 1).h, false) or coalesce(x.h = get(ordered, k + 1).h, false)), x -> x.i))"))
    covered = F.expr("coalesce(aggregate(at, named_struct('last', -5, 'n', 0L), (a, p) -> named_struct('last', p, 'n', a.n + least(5, p - a.last)), a -> a.n), 0L)")
    return placed.select("doc_id", *keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", covered.alias("n_repeat_words"))


def base_failed() -> Column:
    return F.expr("n_words < 10 or 100 * n_repeat_words > 20 * n_words")


def log_binomial_cdf(n: str, k: str, p: float) -> str:
    """SQL for ln P(X <= k), X binomial(n, p): a running log-sum of the terms."""
    step = f"a.t + ln(({n} - i + 1) / i) + {math.log(p / (1 - p))!r}D"
    first = f"{n} * {math.log1p(-p)!r}D"
    zero = f"named_struct('t', {first}, 'm', {first}, 's', 1D)"
    merge = f"(a, i) -> named_struct('t', {step}, 'm', greatest(a.m, {step}), 's', a.s * exp(a.m - greatest(a.m, {step})) + exp({step} - greatest(a.m, {step})))"
    return f"aggregate(if({k} > 0, sequence(1L, {k}), array()), {zero}, {merge}, a -> a.m + ln(a.s))"


def spared() -> Column:
    """At how many levels, counted from the lenient end, no rule rejects the row."""
    each = (" + ".join(f"cast({share} {'<=' if way == 'over' else '>='} {c} as int)" for c in cuts) for share, way, cuts in RULES.values())
    return F.expr(f"least({', '.join(each)})")


def certified(measured: DataFrame, labels: DataFrame) -> DataFrame:
    """(stratum, level, good, lost) of the strictest level that stands, from measured rows (doc_id, stratum, counts)."""
    good = labels.groupBy("doc_id").agg(F.min("quality").alias("quality")).filter("quality = 1")
    held = measured.filter(~base_failed()).dropDuplicates(["doc_id"]).join(good, "doc_id", "left_semi")
    tally = held.select("stratum", spared().alias("spared")).groupBy("stratum", "spared").agg(F.count("*").alias("rows"))  # at most LEVELS + 1 rows a stratum
    tested = tally.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(LEVELS - 1)))).groupBy("stratum", "level").agg(F.sum("rows").alias("good"), F.sum(F.expr("if(spared <= level, rows, 0L)")).alias("lost"))
    strata = measured.select("stratum").distinct().count()
    bound = math.log(DELTA / max(1, strata))
    stands = tested.withColumn("stands", F.expr(f"if(lost > {ALPHA!r}D * good, false, {log_binomial_cdf('good', 'lost', ALPHA)} <= {bound!r}D)"))
    upto = Window.partitionBy("stratum").orderBy("level").rowsBetween(Window.unboundedPreceding, 0)
    stands = stands.withColumn("all_stand", F.min("stands").over(upto)).filter("all_stand")
    return stands.groupBy("stratum").agg(F.max("level").alias("level"), F.max("good").alias("good"), F.max_by("lost", "level").alias("lost"))


def judge(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, the five counts, base_failed, kept, and of the stratum: level (null: no certificate), good and lost holdouts at it."""
    scratch = Scratch(spark, "qualityrules")
    measured = signals(docs.select("doc_id", "text", F.coalesce("lang", F.lit("")).alias("stratum")), "stratum")
    measured = scratch.save(measured, "measured")
    found = scratch.save(certified(measured, labels), "certified")
    judged = measured.join(found, "stratum", "left").withColumn("base_failed", base_failed())
    kept = F.when(F.col("base_failed"), F.lit(False)).otherwise(F.coalesce(spared() > F.col("level"), F.lit(True)))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "level", "good", "lost")
