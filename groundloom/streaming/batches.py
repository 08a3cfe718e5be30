"""A batch loop with state: every micro-batch of a stream decides on a snapshot of what earlier ones did.

The rows of a batch don't see each other; what the batch did is merged into the state when it is over. State is kept in tables of the run's
folder: counters (a row a key, a version a batch), sets of keys (appended by batch), and lists of the latest keys. The stream's checkpoint says which batches are
done. A batch that is run again, because the run broke off before it was noted, reads the same snapshot and overwrites what it
wrote, so a run that breaks off and goes on ends like one that does not.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Kept:
    """What a run remembers, by name: the column whose values are counted, the column whose values are sets' keys, and (column, order, most) of the latest keys.

    Columns are those of the decided rows and may be arrays, whose elements count one by one. Nulls are not remembered. With ``accepted``, only rows for which that column is true are."""

    counters: dict[str, str] = field(default_factory=dict)
    sets: dict[str, str] = field(default_factory=dict)
    latest: dict[str, tuple[str, str, int]] = field(default_factory=dict)
    accepted: str | None = None


def folder_of(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


class Snapshot:
    """The state before a batch."""

    def __init__(self, spark: SparkSession, root: str, batch: int):
        self.spark, self.root, self.batch = spark, root, batch

    def _table(self, path: str, schema: str) -> DataFrame:
        fs, at = folder_of(self.spark, path)
        return self.spark.read.schema(schema).parquet(path) if fs.exists(at) else self.spark.createDataFrame([], schema)

    def counts(self, name: str) -> DataFrame:
        """key, n: how often earlier batches had each key."""
        return self._table(f"{self.root}/counts/{name}/version-{self.batch}", "key string, n long")

    def seen(self, name: str) -> DataFrame:
        """key: each key of earlier batches, once for each batch that had it."""
        return self._table(f"{self.root}/sets/{name}", "key string, batch long").filter(F.col("batch") < self.batch).select("key")

    def latest(self, name: str) -> DataFrame:
        """key, place: the latest keys, at most as many as were asked for."""
        return self._table(f"{self.root}/latest/{name}/version-{self.batch}", "key string, place long")

    def blocked(self, name: str, cap: int) -> DataFrame:
        """key: what has been used up."""
        return self.counts(name).filter(F.col("n") >= cap).select("key")


def write_batches(rows: DataFrame, batch: str, folder: str) -> None:
    """One file a batch, dated in the order of the batches, since a stream of files reads them by date."""
    spark = rows.sparkSession
    rows.repartition(batch).write.mode("overwrite").partitionBy(batch).parquet(folder)
    fs, at = folder_of(spark, folder)
    parts = sorted((int(p.getPath().getName().split("=")[1]), p.getPath()) for p in fs.listStatus(at) if "=" in p.getPath().getName())
    for number, part in parts:
        for file in fs.listStatus(part):
            fs.setTimes(file.getPath(), 1_600_000_000_000 + 1000 * number, -1)


def _elements(rows: DataFrame, column: str, *others: str) -> DataFrame:
    array = dict(rows.dtypes)[column].startswith("array")
    return rows.select((F.explode(column) if array else F.col(column)).cast("string").alias("key"), *others).filter("key is not null")


def run_batches(spark: SparkSession, folder: str, schema: str, root: str, decide: Callable[[DataFrame, Snapshot], DataFrame], kept: Kept) -> DataFrame:
    """Runs the folder's files, a batch each, through ``decide`` and returns all decided rows with their ``batch``.

    Call it again with the same ``root`` to go on after a break. Counters are rewritten by each batch, so their keys should be a vocabulary; sets
    are only appended to."""

    def step(rows: DataFrame, number: int) -> None:
        before = Snapshot(rows.sparkSession, root, number)
        here = f"{root}/rows/batch={number}"
        decide(rows, before).write.mode("overwrite").parquet(here)
        done = rows.sparkSession.read.parquet(here)
        done = done.filter(kept.accepted) if kept.accepted else done
        for name, column in kept.counters.items():
            more = _elements(done, column).groupBy("key").agg(F.count("*").alias("n"))
            before.counts(name).unionByName(more).groupBy("key").agg(F.sum("n").alias("n")).coalesce(1).write.mode("overwrite").parquet(f"{root}/counts/{name}/version-{number + 1}")
        for name, column in kept.sets.items():
            _elements(done, column).distinct().write.mode("overwrite").parquet(f"{root}/sets/{name}/batch={number}")
        for name, (column, order, most) in kept.latest.items():
            late = _elements(done, column, F.col(order).cast("long").alias("place")).unionByName(before.latest(name))
            late.orderBy(F.desc("place"), "key").limit(most).write.mode("overwrite").parquet(f"{root}/latest/{name}/version-{number + 1}")
        # a batch that is run again needs the version before it, never an older one
        for kind, names in (("counts", kept.counters), ("latest", kept.latest)):
            for name in names:
                fs, old = folder_of(spark, f"{root}/{kind}/{name}/version-{number - 1}")
                fs.delete(old, True)

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(folder)
    query = stream.writeStream.foreachBatch(step).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(f"{root}/rows")
