"""Stateful de-duplication of a file stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def dedupe_stream(spark: SparkSession, folder: str, names: str, schema: StructType, keys: list[str], out: str) -> DataFrame:
    """Runs the folder's files of those names through a stream that lets the first row of each key pass; returns the keys that passed.

    State is one entry a key; a stream without end needs a watermark to drop old ones."""
    rows = spark.readStream.schema(schema).option("pathGlobFilter", names).parquet(folder).select(*keys).dropDuplicates(keys)
    run = rows.writeStream.format("parquet").option("checkpointLocation", f"{out}/state").option("path", f"{out}/rows").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{out}/rows")
