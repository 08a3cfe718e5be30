"""Best-fit-decreasing packing of tokenised documents into fixed-length sequences.

A document is its byte-level BPE ids and an end id. Only a document longer than a sequence is cut: into
full pieces behind a first piece that takes the remainder. Pieces are packed best-fit decreasing, over all
rows: a segment tree over remaining capacities finds the tightest open bin in logarithmic time.

The packing itself needs only how many pieces have each length (at most one count per token of a sequence),
so that histogram, and nothing else, goes to the driver; equal lengths are placed run by run, with the same
outcome as one at a time. A run says which bins the pieces of one length with ranks from..to go to; the runs (a
few per length) are broadcast, and each piece finds its place by its rank among pieces of its length. Ranks are
counted inside each task and shifted by the counts of earlier tasks.

Cases: null text packs like an empty one (the end id alone). Repeated rows are packed each. No row: no piece.
Null doc_id passes through. Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, small_batches

#: The pre-tokenising pattern of the byte-level BPE vocabularies (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: printable Latin-1 for itself, the rest from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class BpeEncoder:
    """Ids of whole texts as little-endian 32-bit bytes.

    In vocabularies whose merges are numbered in the order of their results' ids, a merge's rank is its id, so the faster
    encoder of tiktoken gives the ids of the file; that this holds is tested on ``PROBE`` and on the vocabulary's own pieces,
    and otherwise the file's own model encodes. It also encodes every text that holds the content of an added token."""

    PROBE = "Fünf  words,\n\n they're 12³ \u2028 naïve — ок ²x _y_ \t\r\n 日本語!! don't  <|endoftext|> \x1c a\u00a0b "

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.added = [t.content for t in self.model.get_added_tokens_decoder().values()]
        self.model.encode_special_tokens = True  # for the trials: the fast encoder knows no added tokens
        self.fast = None
        vocabulary = self.model.get_vocab(with_added_tokens=False)
        letters = byte_letters()
        if all(c in letters for word in vocabulary for c in word if not word.startswith("<|")):
            import tiktoken

            ranks = {bytes(letters[c] for c in word): i for word, i in vocabulary.items() if not word.startswith("<|")}
            fast = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
            trials = [self.PROBE] + [w.decode("utf-8", "replace") for w in list(ranks)[::97]]
            if all(fast.encode_ordinary(t) == self.slow(t) for t in trials):
                self.fast = fast
        self.model.encode_special_tokens = False

    def slow(self, text: str) -> list[int]:
        return self.model.encode(text, add_special_tokens=False).ids

    def __call__(self, text: str) -> bytes:
        fast = self.fast and not any(t in text for t in self.added)
        return np.array(self.fast.encode_ordinary(text) if fast else self.slow(text), "<u4").tobytes()


def cut(ids: int, length: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces."""
    first = ids % length or min(ids, length)
    return [(0, first)] + [(at, length) for at in range(first, ids, length)]


def tokenize(docs: DataFrame, vocabulary: str, length: int, end_id: int, with_ids: bool = False) -> DataFrame:
    """A row for each piece, with its rank among the pieces of its length in the same task."""
    shape = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, rank long" + ", ids array<long>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, seen, task = BpeEncoder(vocabulary), [0] * (length + 1), TaskContext.get().partitionId()
        tail = np.array([end_id], "<u4").tobytes()
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()] + [pa.list_(pa.int64())] * with_ids
        names = ["doc_id", "piece", "start", "length", "ids_crc32", "task", "rank"] + ["ids"] * with_ids
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                raw = encode(text.as_py() or "") + tail
                for k, (start, n) in enumerate(cut(len(raw) // 4, length)):
                    ids = raw[4 * start : 4 * (start + n)]
                    rows.append((doc_id, k, start, n, zlib.crc32(ids), task, seen[n]) + ((np.frombuffer(ids, "<u4").astype(np.int64),) if with_ids else ()))
                    seen[n] += 1
            columns = list(zip(*rows)) or [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    return docs.select("doc_id", "text").mapInArrow(run, shape)


class OpenBins:
    """Segment tree over remaining capacities 0..size: which of them open bins have."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.any = bytearray(2 * self.leaves)
        self.bins: list[list[tuple[int, int]]] = [[] for _ in range(size + 1)]  # (first bin, how many)

    def put(self, capacity: int, first: int, many: int) -> None:
        if many and capacity:
            self.bins[capacity].append((first, many))
            self._mark(capacity, 1)

    def take(self, capacity: int) -> tuple[int, int]:
        out = self.bins[capacity].pop()
        if not self.bins[capacity]:
            self._mark(capacity, 0)
        return out

    def _mark(self, capacity: int, value: int) -> None:
        at = capacity + self.leaves
        self.any[at] = value
        while at > 1:
            at //= 2
            self.any[at] = self.any[2 * at] | self.any[2 * at + 1]

    def tightest(self, need: int) -> int:
        """The least capacity of an open bin that is at least ``need``; 0 if there is none."""
        at = need + self.leaves
        if self.any[at]:
            return need
        while at > 1:
            if at % 2 == 0 and self.any[at + 1]:
                at += 1
                while at < self.leaves:
                    at = 2 * at if self.any[2 * at] else 2 * at + 1
                return at - self.leaves
            at //= 2
        return 0


def best_fit(counts: dict[int, int], size: int) -> list[tuple[int, int, int, int, int, int]]:
    """Runs (length, rank_from, rank_to, first_bin, per_bin, offset): rank r goes to bin first_bin + (r - rank_from) // per_bin,
    at offset + (r - rank_from) % per_bin * length."""
    bins, made, runs = OpenBins(size), 0, []
    for length in sorted((n for n in counts if counts[n]), reverse=True):
        rank, left = 0, counts[length]
        while left:
            capacity = bins.tightest(length)
            if capacity:
                first, many = bins.take(capacity)
            else:
                capacity, first = size, made
                many = -(-left // (size // length))
                made += many
            each = capacity // length
            full, rest = (many, 0) if left >= many * each else divmod(left, each)
            placed = full * each + rest
            runs.append((length, rank, rank + placed, first, each, size - capacity))
            bins.put(capacity - each * length, first, full)
            if rest:
                bins.put(capacity - rest * length, first + full, 1)
            bins.put(capacity, first + full + bool(rest), many - full - bool(rest))
            rank, left = rank + placed, left - placed
    return runs


def pack(spark: SparkSession, docs: DataFrame, vocabulary: str, length: int = 1024, end_id: int = 2, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids): every piece of every row in its sequence."""
    small_batches(spark, 256)
    scratch = Scratch(spark, "packing")
    pieces = scratch.save(tokenize(docs, vocabulary, length, end_id, with_ids), "pieces")
    tally = scratch.save(pieces.groupBy("task", "length").agg(F.count("*").alias("many")), "tally")
    counts = {r["length"]: r["many"] for r in tally.groupBy("length").agg(F.sum("many").alias("many")).collect()}  # one row a length at most
    before = tally.withColumn("before", F.sum("many").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)))
    runs = spark.createDataFrame(pd.DataFrame(best_fit(counts, length), columns=["length", "rank_from", "rank_to", "first_bin", "per_bin", "at"]).astype("int64")) if counts else spark.createDataFrame([], "length long, rank_from long, rank_to long, first_bin long, per_bin long, at long")
    ranked = pieces.join(before.select("task", "length", F.coalesce("before", F.lit(0)).alias("before")), ["task", "length"]).withColumn("rank", F.col("rank") + F.col("before"))
    placed = ranked.alias("p").join(F.broadcast(runs.alias("r")), F.expr("p.length = r.length and p.rank >= r.rank_from and p.rank < r.rank_to"))  # runs: some per length, whatever the input
    return placed.select("doc_id", "piece", "start", "p.length", "ids_crc32", F.expr("first_bin + (rank - rank_from) div per_bin").alias("sequence_id"), F.expr("at + (rank - rank_from) % per_bin * p.length").alias("offset"), *(["ids"] if with_ids else []))
