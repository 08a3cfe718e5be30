"""From raw documents to packed training sequences, in five stages.

Each stage reads what its predecessor wrote. All but the last return the columns of ``documents``; the mixing
stage repeats a document as often as its fitted rate says, the last one returns the pieces of the
sequences.

Cases, in all stages: null and empty texts pass the quality stage only if the classifier accepts them, lose no line, are no
one's near duplicate, and pack as one end token each. A null id is never a holder of a line and is repeated once; it is
judged like others. Repeated rows of an id are judged alike. Extra columns are dropped by the
first stage; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundloom.llm import crfquality, linededup, mixing, neardup, packing
from groundloom.llm.common import Scratch, table
from groundloom.llm.queries import TARGETS, vocabulary_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Least similarity of near duplicates, in per cent.
SIMILAR = 80


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line classifier rejects go."""
    accepted = crfquality.accepted(spark, docs, table(spark, sf_dir, "labels"))
    return accepted.select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of recurring templates go; n_chars is counted anew."""
    left = linededup.drop_recurring_lines(spark, docs, keep=("lang", "source"))
    return left.select("doc_id", "text", "lang", "source", F.char_length("text").cast("long").alias("n_chars"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: that with the least id."""
    gone = neardup.near_duplicates(spark, docs, SIMILAR).filter("not kept").select("doc_id").distinct()
    return docs.select(*COLUMNS).join(gone, "doc_id", "left_anti").select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Languages are brought to their target shares of tokens by repeating documents; the budget is such that none need shrink."""
    rates = mixing.mix(spark, docs, docs.select("doc_id", F.col("lang").alias("domain")), TARGETS)
    changed = rates.filter("doc_id is not null and copies <> 1").select("doc_id", "copies")
    joined = docs.select(*COLUMNS).join(changed, "doc_id", "left")
    return joined.withColumn("turn", F.explode(F.array_repeat(F.lit(1), F.coalesce(F.col("copies"), F.lit(1)).cast("int")))).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 1024 tokens: where each piece of each document lies."""
    return packing.pack(spark, docs, vocabulary_path(), 1024, 2)


STAGES = [("quality classifier", quality), ("line dedup", lines), ("MinHash near-dedup", near_duplicates), ("mixing sources to target weights", mixture), ("best-fit packing", pack)]

#: Trained classifiers and packing by tokenizer can't be put in SQL; tests/llm/test_pipeline.py checks the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = scratch.save(stage(spark, docs, sf_dir), f"stage-{k}")
        if k:
            scratch.drop(f"stage-{k - 1}")
    return docs
