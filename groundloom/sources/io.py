"""Readers and writers of the table, document and manifest formats."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """CSV with a header; a byte order mark before the first name goes, doubled quotes are one."""
    reader = spark.read.option("header", True).option("encoding", "UTF-8").option("multiLine", True).option("escape", "\"")
    df = reader.schema(schema).csv(path) if schema else reader.csv(path)
    return df.toDF(*(c.lstrip("﻿") for c in df.columns))


def read_json_document(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def selected(rows: DataFrame, entries: DataFrame, key: str, position: str) -> DataFrame:
    """Rows by id in the order of the entries; an id without a row is an error."""
    joined = entries.join(rows.withColumn("__found", F.lit(True)), key, "left")
    checked = F.when(F.col("__found"), F.col(key)).otherwise(F.raise_error(F.lit("no such row")))
    return joined.withColumn(key, checked).orderBy(position).drop("__found")


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """path and SHA-256 of each file below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return files.select("path", F.sha2("content", 256).alias("sha256"))


def differing(found: DataFrame, expected: DataFrame) -> DataFrame:
    """Files that are missing, extra or changed."""
    joined = found.alias("f").join(expected.alias("e"), "path", "full")
    return joined.filter(~F.col("f.sha256").eqNullSafe(F.col("e.sha256"))).select("path", F.col("f.sha256").alias("found"), F.col("e.sha256").alias("expected"))


def without_done(todo: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What a resumed run has left to do."""
    return todo.join(done.select(key).distinct(), key, "left_anti")


def write_with_provenance(df: DataFrame, path: str, facts: dict) -> None:
    """A Parquet table, and beside it (path + ``_provenance``) one JSON row: its facts, its columns, its number of rows."""
    df.write.mode("overwrite").parquet(path)
    written = df.sparkSession.read.parquet(path)
    row = {**facts, "columns": written.columns, "n_rows": written.count()}
    df.sparkSession.createDataFrame([(json.dumps(row, sort_keys=True, ensure_ascii=False),)], "value string").coalesce(1).write.mode("overwrite").text(path.rstrip("/") + "_provenance")


def append_batches(df: DataFrame, path: str, order: str, size: int) -> None:
    """Rows are appended in batches, each a directory of its own (``batch=n``); what an earlier run has written isn't written again."""
    spark = df.sparkSession
    numbered = df.withColumn("batch", F.floor(F.col(order) / size))
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        numbered = numbered.join(spark.read.parquet(path).select("batch").distinct(), "batch", "left_anti")
    numbered.repartition("batch").write.mode("append").partitionBy("batch").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header, quotes doubled, nulls empty."""
    df.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').option("nullValue", "").csv(path)
