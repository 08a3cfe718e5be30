"""What the training-data operators share: input tables, shared scratch tables, Arrow limits, word hashing."""

from __future__ import annotations

import atexit
import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession

#: Rows that reach Python in one Arrow batch; documents may be long, so few.
BATCH_ROWS = 1000
#: Bytes of text that one vectorised pass holds; its arrays take about 60 times as much.
CHUNK_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's, else (tests, all in one process) one of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="groundloom-")
        spark.conf.set("spark.checkpoint.dir", found)
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def remove_tree(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


class Scratch:
    """Intermediate tables in the shared folder: they cut lineage and outlive the executors that wrote them.

    A table stays until ``drop`` or the end of the Python process, since the result that is handed
    out reads the last ones lazily.
    """

    def __init__(self, spark: SparkSession, what: str):
        self.spark, self.root = spark, f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"
        atexit.register(_forget, spark, self.root)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, name: str) -> None:
        remove_tree(self.spark, self.path(name))


def _forget(spark: SparkSession, root: str) -> None:
    if spark.sparkContext._jsc is not None:  # the session may have ended
        try:
            remove_tree(spark, root)
        except Exception:  # noqa: BLE001  the JVM may be on its way down
            pass


#: Rows of a few numbers that may be broadcast.
BROADCAST = 1_000_000


def sized(df: DataFrame) -> DataFrame:
    """Marked for broadcast if it has at most BROADCAST rows, else left to a shuffle."""
    from pyspark.sql import functions as F

    return F.broadcast(df) if df.limit(BROADCAST + 1).count() <= BROADCAST else df


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Bounds what one Arrow batch of documents holds in a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def literal(values, kind: str) -> str:
    """A list of numbers as a SQL array literal."""
    return f"array({', '.join(f'CAST({v!r} AS {kind})' for v in values)})"


# ---- word hashing over raw UTF-8, a block of texts at a time -------------------------------------

_MIX = np.uint64(0x9E3779B97F4A7C15)
_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers (xor-shift and odd multiplications)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


def chunks(texts: list[bytes]):
    """Index ranges of at most CHUNK_BYTES together (a longer text goes alone)."""
    start = size = 0
    for i, t in enumerate(texts):
        if i > start and size + len(t) > CHUNK_BYTES:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


def word_hashes(texts: list[bytes], lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts in order, and for each text where its words begin (one more entry ends the last)."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    if lower:
        data = _LOWER[data]
    space = _SPACE[data]
    starts = np.flatnonzero(~space & np.concatenate(([True], space[:-1])))
    ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
    first = np.searchsorted(starts, np.concatenate(([0], ends)))
    if not len(starts):
        return np.zeros(0, np.uint64), first
    begin = np.repeat(starts, np.diff(np.append(starts, len(data))))
    place = np.arange(starts[0], len(data)) - begin
    weight = mix64((place.astype(np.uint64) + np.uint64(1)) * _MIX) | np.uint64(1)
    part = _BYTE[data[starts[0] :]] * weight
    part[space[starts[0] :]] = 0
    return mix64(np.add.reduceat(part, starts - starts[0])), first


_STEP = [np.uint64(int(x) | 1) for x in _RNG.integers(1, 2**63, 64, dtype=np.uint64)]


def shingle_sets(texts: list[bytes], width: int = 5):
    """For each text the sorted distinct 64-bit hashes of its word shingles (see ``neardup``)."""
    for lo, hi in chunks(texts):
        words, first = word_hashes(texts[lo:hi])
        n = len(words)
        rolled = np.zeros(max(0, n - width + 1), np.uint64)
        for k in range(width):
            rolled += words[k : k + len(rolled)] * _STEP[k]
        rolled = mix64(rolled)
        for i in range(hi - lo):
            a, b = first[i], first[i + 1]
            if b - a >= width:
                yield np.unique(rolled[a : b - width + 1])
            elif b > a:
                few = sum(int(w) * int(_STEP[width + k]) for k, w in enumerate(words[a:b])) + int(b - a)
                yield mix64(np.array([few % 2**64], np.uint64))
            else:
                yield np.zeros(0, np.uint64)


# ---- folds and bounded samples for fitting --------------------------------------------------------


def fold(column: str, folds: int):
    """crc32 of an id written as text, modulo ``folds``; a null id counts as the empty text."""
    from pyspark.sql import functions as F

    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % folds


def sampled_texts(docs: DataFrame, labelled: DataFrame, label: str, most: int) -> list[tuple[str, object]]:
    """(text, label) of at most ``most`` documents: those with the least id hashes among ``labelled`` (doc_id, label)."""
    from pyspark.sql import functions as F

    order = F.xxhash64(F.col("doc_id"), F.lit(11))
    chosen = labelled.filter(f"doc_id is not null and {label} is not null").select("doc_id", F.col(label).alias("label")).orderBy(order, "doc_id", "label").limit(most)
    rows = docs.select("doc_id", "text").filter("text is not null").join(F.broadcast(chosen), "doc_id").orderBy(order, "doc_id").limit(most).collect()
    return [(r["text"], r["label"]) for r in rows]
