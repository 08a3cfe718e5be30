"""Downstream tasks: pairs, retrieval by summed context, pair features, linear models with their instances."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import uniform
from . import chargrams
from .ranking import nested_candidates


def pair_dataset(rows: DataFrame, key: str, groups: list[str], seed: int, stage: str, anchor: str, text: str) -> DataFrame:
    """key, candidate, level, label, anchor, text: a row's anchor with its own text (1) and with that of another row (0).

    The other one is of the finest of the nested ``groups`` that has another row, else any (see ``ranking.nested_candidates``)."""
    pairs = nested_candidates(rows, key, groups, uniform(seed, F.col(key), stage), 2, seed, stage)
    anchors, texts = rows.select(key, F.col(anchor).alias("anchor")), rows.select(F.col(key).alias("candidate"), F.col(text).alias("text"))
    return pairs.join(anchors, key).join(texts, "candidate").select(key, "candidate", "level", (F.col("step") == 0).cast("int").alias("label"), "anchor", "text")


def retrieval_ranks(pairs: DataFrame, key: str, context: DataFrame, target: DataFrame, text: str, weights: chargrams.Weights) -> DataFrame:
    """key, rank of the true candidate; a candidate's score is its target's text against the sum of the key's context texts.

    Scores are compared to nine places; ties go to the smaller candidate."""
    scored = chargrams.summed_scores(pairs, key, context, target, text, weights).withColumn("s", F.round("s", 9))
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("s"), "candidate"))
    return scored.withColumn("rank", place).filter("truth").select(key, "rank")


def random_retrieval(k: Column) -> list[Column]:
    """What a random order of k candidates reaches in expectation: top1, top3, mrr, median_rank."""
    harmonic = F.aggregate(F.sequence(F.lit(1), k.cast("int")), F.lit(0.0), lambda t, i: t + F.lit(1.0) / i)
    return [(1 / k).alias("top1"), F.least(3 / k, F.lit(1.0)).alias("top3"), (harmonic / k).alias("mrr"), ((k + 1) / 2).alias("median_rank")]


def label_baselines(rows: DataFrame, key: str, label: str, held_out: str, seed: int) -> DataFrame:
    """key, truth, majority, stratified, uniform of the held-out rows: the commonest label of the others (ties: the smaller), one drawn by
    the others' shares, and one drawn evenly. Null labels take no part; draws depend on seed and key. The labels are a vocabulary, sent to all tasks as one row."""
    kept = rows.filter(F.col(label).isNotNull())
    tally = kept.filter(~F.col(held_out)).groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"))
    known = tally.agg(F.sort_array(F.collect_list(F.struct("label", "n"))).alias("labels"), F.min_by("label", F.struct(-F.col("n"), "label")).alias("majority"), F.sum("n").alias("total"))
    u = lambda stage: uniform(seed, F.col(key), stage)
    below = lambda x: F.aggregate(F.filter("labels", lambda y: y["label"] <= x["label"]), F.lit(0).cast("long"), lambda t, y: t + y["n"])
    drawn = F.get(F.filter("labels", lambda x: below(x) > u("stratified") * F.col("total")), F.lit(0))["label"]
    even = F.get("labels", F.floor(u("uniform") * F.size("labels")).cast("int"))["label"]
    return kept.filter(held_out).crossJoin(F.broadcast(known)).select(key, F.col(label).alias("truth"), "majority", drawn.alias("stratified"), even.alias("uniform"))


def pair_features(a: Column, b: Column) -> Column:
    """Both vectors, their products and their distances by component, one after the other."""
    x, y = a.cast("array<double>"), b.cast("array<double>")
    return F.concat(x, y, F.zip_with(x, y, lambda p, q: p * q), F.zip_with(x, y, lambda p, q: F.abs(p - q)))


def balanced(train: DataFrame, label: str) -> DataFrame:
    """Adds ``w``: each class weighs the same in all."""
    sizes = train.groupBy(label).agg(F.count("*").alias("_n"))  # a row a class
    total = sizes.agg(F.sum("_n").alias("_total"), F.count("*").alias("_classes"))
    return train.join(F.broadcast(sizes), label).crossJoin(F.broadcast(total)).withColumn("w", F.col("_total") / (F.col("_classes") * F.col("_n"))).drop("_n", "_total", "_classes")


def linear_head(rows: DataFrame, key: str, label: str, features: str, held_out: str) -> DataFrame:
    """key, label, score, predicted of the held-out rows: a class-balanced logistic regression on arrays of features."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector, vector_to_array

    x = rows.select(key, F.col(label).cast("double").alias("y"), array_to_vector(features).alias("v"), held_out)
    model = LogisticRegression(featuresCol="v", labelCol="y", weightCol="w", regParam=1e-3, maxIter=40).fit(balanced(x.filter(~F.col(held_out)), "y"))
    told = model.transform(x.filter(held_out))
    return told.select(key, F.col("y").cast("int").alias(label), F.element_at(vector_to_array("probability"), 2).alias("score"), F.col("prediction").cast("int").alias("predicted"))


def anchor_recovery(rows: DataFrame, key: str, text: str, target: str, held_out: str, features: int = 20000) -> DataFrame:
    """key, truth, predicted, majority of the held-out rows: a class-balanced linear model of a categorical column on character grams.

    Grams (3 to 5 characters inside words) of two or more of the other rows count, the commonest ``features`` of them, ties by gram; counts are
    not log-scaled here, unlike in ``texts.char_weights``. Texts are read twice: for the vocabulary, and for the counts, which are a table."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import IDF, IndexToString, Normalizer, StringIndexer

    x = rows.filter(F.col(target).isNotNull()).select(key, F.col(target).cast("string").alias("truth"), chargrams.lowered(text).alias("t"), held_out)
    known = chargrams.vocabulary(x.filter(~F.col(held_out)), "t", features=features)
    x = chargrams.count_vectors(x, "t", known)
    train, test = x.filter(~F.col(held_out)), x.filter(held_out)
    indexer = StringIndexer(inputCol="truth", outputCol="y", handleInvalid="keep").fit(train)
    model = Pipeline(stages=[IDF(inputCol="tf", outputCol="idf"), Normalizer(inputCol="idf", outputCol="v"), LogisticRegression(featuresCol="v", labelCol="y", weightCol="w", regParam=1e-3, maxIter=30), IndexToString(inputCol="prediction", outputCol="predicted", labels=indexer.labels)]).fit(balanced(indexer.transform(train), "y"))
    return model.transform(indexer.transform(test)).select(key, "truth", "predicted", F.lit(indexer.labels[0]).alias("majority"))
