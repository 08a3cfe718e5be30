"""Queries over the driver's tables, by operator, each beside the SQL that checks it."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}
#: What a query dealt between tasks is deleted at its end.
DROPPED = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
#: Decimal places in which both engines' doubles are compared.
PLACES = 6


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a function under its name, with its oracle."""

    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; a folder of this machine only where all run in one process."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    return "file://" + tempfile.mkdtemp(prefix="groundloom-")


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Settings of the session that hold for the writes inside only."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def written(df: DataFrame, what: str, schema: StructType | None = None) -> DataFrame:
    """The rows as a table in the shared folder, for plans that read them many times. What was dealt between tasks for it is deleted then.

    ``schema`` reads them with types of the same form, such as vectors."""
    path = f"{shared_folder(df.sparkSession)}/{what}-{uuid.uuid4().hex}"
    with settings(df.sparkSession, DROPPED):
        df.write.parquet(path)
    return df.sparkSession.read.schema(schema or df.schema).parquet(path)


def r(column: Column | str) -> Column:
    return F.round(F.col(column) if isinstance(column, str) else column, PLACES)


def _load() -> None:
    from . import queries_annotation, queries_batches, queries_checks, queries_generation, queries_grounding, queries_pairs, queries_report, queries_rows, queries_sampling, queries_terms, queries_texts  # noqa: F401


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_ORACLES)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["cond_share_segment_region"](spark, sf_dir)
