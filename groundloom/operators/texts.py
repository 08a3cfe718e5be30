"""Corpus measures of texts: self-BLEU, character TF-IDF, repeated sets, spans with context, cross-validated classifiers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..catalog import written
from ..functions import scalar as s
from . import chargrams, leads, ranking

#: What a precision without any match counts instead of zero (fixed value).
EPSILON = 0.1
#: Matches that are added up together.
CHUNK = 128


def self_bleu(rows: DataFrame, key: str, tokens: str) -> DataFrame:
    """key (whole numbers), score: BLEU-4 of each row against all others. Rows without tokens, or without another row, score 0.

    A gram's count is clipped by its greatest count in another row. That clips only the one row, if it is one, that holds
    the gram most often: by its lead over the second count. So each gram yields at most one deduction, and no
    gram is joined back to the rows (see ``leads``)."""
    rows = rows.select(F.col(key).alias("k"), F.col(tokens).alias("w"))
    parts = leads.lost_counts(rows, "k", "w", [[1, 2], [3], [4]])
    lost = reduce(DataFrame.unionByName, parts).groupBy("k").agg(*(F.sum(F.when(F.col("n") == n, F.col("lost"))).alias(f"lost{n}") for n in (1, 2, 3, 4)))
    sizes = written(rows.select("k", F.coalesce(F.size("w"), F.lit(0)).alias("len")), "sizes")
    by = Window.orderBy("len")  # over distinct lengths only
    near = sizes.groupBy("len").agg(F.count("*").alias("n")).select("len", F.when(F.col("n") > 1, F.col("len")).otherwise(_nearer(F.col("len"), F.lag("len").over(by), F.lead("len").over(by))).alias("ref"))
    joined = sizes.join(near, "len").join(lost, "k", "left")
    for n in (1, 2, 3, 4):
        total = F.greatest(F.col("len") - (n - 1), F.lit(0))
        joined = joined.withColumn(f"hit{n}", total - F.coalesce(f"lost{n}", F.lit(0))).withColumn(f"all{n}", F.greatest(total, F.lit(1)))
    logs = sum((F.log(F.when(F.col(f"hit{n}") > 0, F.col(f"hit{n}")).otherwise(EPSILON) / F.col(f"all{n}")) * 0.25 for n in (1, 2, 3, 4)), F.lit(0.0))
    brief = F.when(F.col("len") > F.col("ref"), 1.0).otherwise(F.exp(1 - F.col("ref") / F.col("len")))
    return joined.select(F.col("k").alias(key), F.when((F.col("len") > 0) & (F.col("hit1") > 0) & F.col("ref").isNotNull(), brief * F.exp(logs)).otherwise(0.0).alias("score"))


def _nearer(at: Column, below: Column, above: Column) -> Column:
    return F.when(above.isNull() | (at - below <= above - at), below).otherwise(above)


def turns_by_id(rows: DataFrame, key: str, text: str) -> DataFrame:
    """key, t: one text in lower case for each key; texts of one key follow each other."""
    return rows.groupBy(key).agg(F.concat_ws(" ", F.collect_list(chargrams.lowered(text))).alias("t"))


def char_weights(rows: DataFrame, key: str, text: str, low: int = 3, high: int = 5, min_df: int = 2, features: int = 20000) -> chargrams.Weights:
    """Weights of unit length: log-scaled counts times smoothed inverse document frequency, over the character grams inside
    blank-padded lower-case words. The vocabulary holds at most ``features`` grams (the commonest, ties by gram) and goes to all tasks."""
    return chargrams.Weights(chargrams.vocabulary(turns_by_id(rows, key, text), "t", low, high, min_df, features), rows.count(), low, high)


def row_cosines(pairs: DataFrame, rows: DataFrame, key: str, text: str, weights: chargrams.Weights) -> DataFrame:
    """a, b, cosine of the listed pairs of rows; rows without known grams have cosine 0. A pair that is listed more than once counts as often."""
    once = pairs.groupBy("a", "b").agg(F.count("*").alias("times"))
    found = chargrams.pair_cosines(once, turns_by_id(rows, key, text), key, "t", weights)
    return found.select("a", "b", (F.col("cosine") * F.col("times")).alias("cosine"), F.explode(F.array_repeat(F.lit(0), F.col("times").cast("int")))).drop("col")


def spans(text: Column, pattern: str) -> Column:
    """(start, match) of all matches, in order; start counts code points from 1.

    A start is a sum over what stands before it: of whole chunks of matches, which are added up once, and of the rest of its own chunk."""
    both = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("b"))
    total = lambda xs: F.aggregate(xs, F.lit(0), lambda n, x: n + x)
    once = lambda c, f: F.get(F.transform(F.array(c), f), F.lit(0))  # noqa: E731  as the argument of a lambda c is computed once

    def begun(x: Column, steps: Column) -> Column:
        chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / CHUNK).cast("int")), lambda c: total(F.slice(steps, c * CHUNK + 1, F.lit(CHUNK))))
        ahead = lambda sums: F.transform(sums, lambda _, c: total(F.slice(sums, F.lit(1), c)))
        start = lambda heads, i: 1 + F.get(heads, F.floor(i / CHUNK).cast("int")) + total(F.slice(steps, F.floor(i / CHUNK).cast("int") * CHUNK + 1, i % CHUNK + 1))
        return once(chunks, lambda sums: once(ahead(sums), lambda heads: F.transform(x["m"], lambda m, i: F.struct(start(heads, i).alias("start"), m.alias("match")))))

    def of(x: Column) -> Column:
        # how far a match begins behind the beginning of the one before it
        steps = F.transform(x["m"], lambda m, i: F.length(F.get(x["b"], i)) + F.when(i > 0, F.length(F.get(x["m"], i - 1))).otherwise(0))
        return F.when(F.size(x["m"]) > 0, once(steps, lambda s_: begun(x, s_))).otherwise(F.array().cast("array<struct<start:int,match:string>>"))

    return F.when(text.isNotNull(), once(both, of))


def context(text: Column, start: Column, length: Column, before: int, after: int) -> Column:
    """The span with what stands around it."""
    begin = F.greatest(start - before, F.lit(1))
    return F.substring(text, begin, start - begin + length + after)


def cross_validated(rows: DataFrame, key: str, label: str, features: list[str], folds: int = 5, seed: int = 42) -> DataFrame:
    """fold, n, accuracy, macro_f1, majority_accuracy of a class-balanced logistic regression on standardised features.

    Folds are ranks in hash order inside a class, modulo ``folds``. The models are fitted one fold after the other, each in distributed passes."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    kept = rows.select(key, F.col(label).cast("double").alias("y"), *(F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f) for f in features))
    dealt = VectorAssembler(inputCols=features, outputCol="features").transform(ranking.folds(kept, ["y"], key, folds, seed))
    out = []
    for k in range(folds):
        train = dealt.filter(F.col("fold") != k)
        sizes = train.groupBy("y").agg(F.count("*").alias("n"))  # one row a class
        total = sizes.agg(F.sum("n").alias("total"), F.count("*").alias("classes"), F.max_by("y", F.struct("n", "y")).alias("most"))
        weighed = train.join(F.broadcast(sizes), "y").crossJoin(F.broadcast(total)).withColumn("w", F.col("total") / (F.col("classes") * F.col("n")))
        model = LogisticRegression(labelCol="y", weightCol="w", regParam=1e-5, maxIter=50).fit(weighed)
        told = model.transform(dealt.filter(F.col("fold") == k)).select("y", F.col("prediction").alias("p")).crossJoin(F.broadcast(total.select("most")))
        f1 = [F.coalesce(2 * F.count_if((F.col("y") == c) & (F.col("p") == c)) / F.nullif(F.count_if(F.col("y") == c) + F.count_if(F.col("p") == c), F.lit(0)), F.lit(0.0)) for c in (0, 1)]
        out.append(told.agg(F.lit(k).alias("fold"), F.count("*").alias("n"), F.avg((F.col("y") == F.col("p")).cast("int")).alias("accuracy"), ((f1[0] + f1[1]) / 2).alias("macro_f1"), F.avg((F.col("y") == F.col("most")).cast("int")).alias("majority_accuracy")))
    return reduce(DataFrame.unionByName, out)
