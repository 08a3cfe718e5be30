"""Which row holds a gram most often, and by how much: blocks of sorted hashes, packed before they are dealt.

Grams are compared by 64 bits of hash. A block of rows counts its own grams first, so a gram costs one entry a block: the step from the hash
before it, the holder's key, its count and the second count, in planes of bytes that compress well (about 8 bytes instead of a row).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..catalog import settings, written

#: Tokens of the rows that one block counts together.
BLOCK_TOKENS = 1 << 22
#: Leading bits of the hash that name the part of an entry: a task merges one part at a time.
PART_BITS = 11
#: Leads that a task keeps before it adds up those of equal keys.
KEPT = 1 << 22
#: Python gets few rows at a time, since they may be long.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20)}


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _merged(hashes: np.ndarray, best: np.ndarray, second: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, ...]:
    """One entry a hash of entries sorted by it: the greatest count, the next one of another key, and the first's key."""
    if not len(hashes):
        return hashes, best, second, keys
    new = np.flatnonzero(np.r_[True, hashes[1:] != hashes[:-1]])
    sizes = np.diff(np.r_[new, len(hashes)])
    most = np.maximum.reduceat(best, new)
    leads = best == np.repeat(most, sizes)
    next_one = np.maximum.reduceat(np.where(leads, second, best), new)
    next_one = np.where(np.add.reduceat(leads.astype(np.int64), new) > 1, most, next_one)
    first = np.flatnonzero(leads)
    first = first[np.searchsorted(first, new)]
    return hashes[new], most, next_one, keys[first]


def _counted(tokens: np.ndarray, keys: np.ndarray, lengths: np.ndarray, n: int) -> tuple[np.ndarray, ...]:
    """The entries of one block: the grams of each row are counted, then the rows compared."""
    grams = _mixed(tokens)
    row = np.repeat(np.arange(len(lengths)), lengths)
    for i in range(1, n):
        grams = _mixed(grams[:-1] * np.uint64(3) + tokens[i:] + np.uint64(i))
    many = len(tokens) - n + 1
    if many <= 0:
        return _merged(np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3)))
    inside = row[:many] == row[n - 1 :]
    grams, row = grams[inside], row[:many][inside]
    order = np.argsort(grams, kind="stable")  # rows stay in order inside a gram
    grams, row = grams[order], row[order]
    new = np.flatnonzero(np.r_[True, (grams[1:] != grams[:-1]) | (row[1:] != row[:-1])]) if len(grams) else np.zeros(0, np.int64)
    counts = np.diff(np.r_[new, len(grams)])
    return _merged(grams[new], counts, np.zeros(len(new), np.int64), keys[row[new]])


def _packed(columns: list[np.ndarray]) -> bytes:
    """Columns of whole numbers as planes of their bytes, without planes of zeros on top."""
    head, planes = [len(columns[0])], []
    for c in columns:
        b = np.ascontiguousarray(c).view(np.uint8).reshape(-1, 8)
        used = max((int(c.view(np.uint64).max()).bit_length() + 7) // 8, 1)
        head.append(used)
        planes.append(b[:, :used].T.tobytes())
    raw = np.array(head, np.int64).tobytes() + b"".join(planes)
    return np.int64(len(raw)).tobytes() + pa.compress(raw, codec="zstd", asbytes=True)


def _unpacked(data: bytes, columns: int) -> list[np.ndarray]:
    raw = pa.decompress(data[8:], int(np.frombuffer(data, np.int64, 1)[0]), codec="zstd", asbytes=True)
    head = np.frombuffer(raw, np.int64, columns + 1)
    n, at, out = int(head[0]), 8 * (columns + 1), []
    for used in map(int, head[1:]):
        b = np.zeros((n, 8), np.uint8)
        b[:, :used] = np.frombuffer(raw, np.uint8, n * used, at).reshape(used, n).T
        out.append(b.view(np.int64).reshape(-1))
        at += n * used
    return out


def _blocks(sizes: list[int]):
    def entries(tokens: list[np.ndarray], keys: list[np.ndarray], lengths: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        t, k, m = (np.concatenate(x) for x in (tokens, keys, lengths))
        for n in sizes:
            grams, best, second, held = _counted(t, k, m, n)
            cuts = np.searchsorted(grams >> np.uint64(64 - PART_BITS), np.arange((1 << PART_BITS) + 1, dtype=np.uint64))
            slots, data = [], []
            for part in range(1 << PART_BITS):
                a, b = cuts[part], cuts[part + 1]
                if a < b:
                    steps = np.diff(grams[a:b], prepend=np.uint64(0))
                    slots.append(part * 8 + n)
                    data.append(_packed([steps, held[a:b], best[a:b], second[a:b]]))
            yield pa.RecordBatch.from_arrays([pa.array(slots, pa.int32()), pa.array(data, pa.binary())], names=["slot", "data"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, keys, lengths, held = [], [], [], 0
        for batch in batches:
            lists = batch.column("t").combine_chunks() if isinstance(batch.column("t"), pa.ChunkedArray) else batch.column("t")
            tokens.append(lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64))
            lengths.append(np.diff(lists.offsets.to_numpy()))
            keys.append(batch.column("k").to_numpy(zero_copy_only=False))
            held += len(tokens[-1])
            if held >= BLOCK_TOKENS:
                yield from entries(tokens, keys, lengths)
                tokens, keys, lengths, held = [], [], [], 0
        if held:
            yield from entries(tokens, keys, lengths)

    return run


def _leading(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merges the blocks of a part, which stand one after the other; k, n, lost of the rows that hold a gram more often than all others."""
    kept: dict[int, list] = {}
    now, blocks = None, []

    def added(n: int) -> tuple[np.ndarray, np.ndarray]:
        k, at = np.unique(np.concatenate([x[0] for x in kept[n]]), return_inverse=True)
        return k, np.bincount(at, np.concatenate([x[1] for x in kept[n]]), len(k)).astype(np.int64)

    def finish() -> None:
        columns = [np.concatenate(c) for c in zip(*blocks)]
        order = np.argsort(columns[0], kind="stable")
        _, best, second, keys = _merged(*(c[order] for c in columns))
        ahead = best > second
        mine = kept.setdefault(now % 8, [])
        mine.append((keys[ahead], (best - second)[ahead]))
        if sum(len(x[0]) for x in mine) > KEPT:
            kept[now % 8] = [added(now % 8)]

    for batch in batches:
        for slot, data in zip(batch.column("slot").to_pylist(), batch.column("data").to_pylist()):
            if slot != now and blocks:
                finish()
                blocks = []
            now = slot
            steps, keys, best, second = _unpacked(data, 4)
            blocks.append((np.cumsum(steps.view(np.uint64), dtype=np.uint64), best, second, keys))
    if blocks:
        finish()
    for n in kept:
        k, lost = added(n)
        yield pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(np.full(len(k), n), pa.int32()), pa.array(lost, pa.int64())], names=["k", "n", "lost"])


def lost_counts(rows: DataFrame, key: str, tokens: str, turns: list[list[int]]) -> list[DataFrame]:
    """For each turn (lengths of grams, 1 to 7) a table k, n, lost: by how much a row's counts of grams exceed the greatest count in another row, in sum.

    Keys are different whole numbers. Every turn hashes the tokens anew, and what it dealt is gone when its table is written, so turns bound the disk."""
    hashed = rows.select(F.col(key).cast("long").alias("k"), F.transform(tokens, lambda w: F.xxhash64(w)).alias("t")).filter("size(t) > 0")
    out = []
    for sizes in turns:
        dealt = hashed.mapInArrow(_blocks(sizes), "slot int, data binary").repartition("slot").sortWithinPartitions("slot")
        lost = dealt.mapInArrow(_leading, "k long, n int, lost long").groupBy("k", "n").agg(F.sum("lost").alias("lost"))
        with settings(rows.sparkSession, BATCHES):
            out.append(written(lost, "leads"))
    return out
