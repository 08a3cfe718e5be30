"""Approximate nearest neighbours by multiprobe p-stable hashing, with exact reranking.

Each of ``TABLES`` tables hashes a vector to floor((a.x + b) / width) for ``HASHES`` Gaussian (2-stable)
directions. A query also visits perturbed buckets: moving coordinate i to the neighbouring cell succeeds the
likelier the nearer the query's projection lies to that boundary, and sets of moves are visited in order of the
expected sum of squared distances of their boundaries ("multiprobe", Lv et al. 2007), by a template over the
sorted distances. Largest inner product is reduced to least distance: rows are divided by the largest norm of their
range of norms (``RANGE``: the ratio of its ends) and get one more coordinate that brings them to norm one; queries are
normalised. A query visits the same buckets for all ranges. Long rows can be answers at any angle: of the rows whose norm is
over ``LONG`` medians, the about ``BLOCK`` longest lie in one bucket of the first table, which every query visits.

Buckets are dealt to blocks of about ``BLOCK`` rows; a fuller block is split by row, and queries reach every part.
A block compares its queries with its rows in one matrix product, masked by the buckets each query visits,
and keeps k candidates a query with exact double scores; the tables' candidates are then merged. The first table goes
ahead: the k-th score it finds for a query is a floor, and the other tables hand on only what reaches it.
Rows with equal vectors tie, and ties go to the smaller id, so k + 1 of them can be answers to anything; further ones
are left out of the index beforehand. A query that finds fewer than k rows in its buckets is compared with all.

Cases: vectors that are null, empty, zero or hold null or non-finite components take no part. Vectors of each length are searched
apart from the others: a query's candidates are those of its own length. Rows with a null id take no part. Of rows with one id the least
vector counts (compared component by component), among rows and queries alike. No vector: no row. Extra columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, mix64

#: WIDTH is in units of the distance between unit vectors.
TABLES, HASHES, WIDTH, PROBES = 4, 6, 1.44, 320
BLOCK, QUERY_BLOCK = 8192, 131_072
RANGE, LONG, LONG_BUCKET = 1.02, 1.1, 0


def template(hashes: int, probes: int) -> list[tuple[int, ...]]:
    """Sets of ranks (0: the nearest boundary) in the order of their expected squared distances; the empty set first.

    Ranks j and 2 * hashes - 1 - j are the two sides of one coordinate and never go together."""
    m = hashes
    cost = [(j + 1) * (j + 2) / (4 * (m + 1) * (m + 2)) if j < m else 1 - (2 * m - j) / (m + 1) + (2 * m - j) * (2 * m + 1 - j) / (4 * (m + 1) * (m + 2)) for j in range(2 * m)]
    out, heap = [()], [(cost[0], (0,))]
    while heap and len(out) < probes:
        score, moves = heapq.heappop(heap)
        if all(2 * m - 1 - j not in moves for j in moves):
            out.append(moves)
        last = moves[-1]
        if last + 1 < 2 * m:
            heapq.heappush(heap, (score - cost[last] + cost[last + 1], (*moves[:-1], last + 1)))
            heapq.heappush(heap, (score + cost[last + 1], (*moves, last + 1)))
    return out


class Hashing:
    def __init__(self, dimension: int, largest: float, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.largest = largest
        self.directions = rng.normal(size=(dimension + 1, TABLES * HASHES))
        self.shift = rng.uniform(0, 1, TABLES * HASHES)
        self.salt = rng.integers(1, 2**63, HASHES, dtype=np.uint64) | np.uint64(1)
        sets = template(HASHES, PROBES)
        self.moves = np.zeros((len(sets), 2 * HASHES), np.int64)
        for i, s in enumerate(sets):
            self.moves[i, list(s)] = 1

    def project(self, x: np.ndarray, query: bool) -> np.ndarray:
        """(rows, tables, hashes) in units of the cell width."""
        norm = np.linalg.norm(x, axis=1, keepdims=True)
        if query:
            x, rest = x / norm, np.zeros_like(norm)
        else:
            end = self.largest / RANGE ** np.floor(np.log(self.largest / norm) / np.log(RANGE))
            x, rest = x / end, np.sqrt(np.maximum(0, 1 - (norm / end) ** 2))
        return (np.hstack([x, rest]) @ self.directions / WIDTH + self.shift).reshape(len(x), TABLES, HASHES)

    def keys(self, cells: np.ndarray) -> np.ndarray:
        return mix64((cells.astype(np.int64).view(np.uint64) * self.salt).sum(-1, dtype=np.uint64)).view(np.int64)

    def rows(self, x: np.ndarray) -> np.ndarray:
        return self.keys(np.floor(self.project(x, False)))

    def probes(self, x: np.ndarray, tables: range) -> np.ndarray:
        """(rows, those tables, probes) bucket keys in the order of visits."""
        at = self.project(x, True)[:, tables.start : tables.stop]
        cell = np.floor(at)
        inside = at - cell
        # sorted distances: the nearer sides of all coordinates first, then their far sides mirrored
        near = np.minimum(inside, 1 - inside)
        way = np.where(inside < 0.5, -1, 1)
        order = np.argsort(near, axis=-1, kind="stable")
        delta = np.zeros((*at.shape[:2], len(self.moves), HASHES), np.int64)
        for rank in range(HASHES):
            hash_at = order[..., rank]
            side = np.take_along_axis(way, hash_at[..., None], -1)
            step = self.moves[None, None, :, rank] * side - self.moves[None, None, :, 2 * HASHES - 1 - rank] * side
            np.put_along_axis(delta, np.broadcast_to(hash_at[..., None, None], (*step.shape, 1)), step[..., None], -1)
        return self.keys(cell[:, :, None, :] + delta)


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, np.float64) for v in column])


def valid_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding of the rows that take part, one an id."""
    sound = F.expr("embedding is not null and size(embedding) > 0 and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('inf')) and exists(embedding, x -> x <> 0)")
    return vectors.select("vec_id", "embedding").filter("vec_id is not null").filter(sound).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))


def nearest(spark: SparkSession, vectors: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of largest inner product found for each of ``queries`` (same columns), never itself."""
    rows, asked = valid_vectors(vectors), valid_vectors(queries)
    squared = F.expr("aggregate(embedding, 0D, (s, x) -> s + double(x) * x)")
    sizes = rows.groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("n"), F.max(squared).alias("largest")).orderBy("d").collect()  # a row a length
    found = [_of_length(spark, rows, asked, k, squared, x) for x in sizes if x["n"] > 1]
    return reduce(DataFrame.unionByName, found, spark.createDataFrame([], "query_id long, rank int, vec_id long, score double"))


def _of_length(spark: SparkSession, rows: DataFrame, asked: DataFrame, k: int, squared: Column, sizes: Row) -> DataFrame:
    """``nearest`` for the vectors of one length; ``sizes`` holds it (d), their number (n) and the largest squared norm."""
    scratch = Scratch(spark, "ann")
    dimension, hashing = sizes["d"], Hashing(sizes["d"], float(np.sqrt(sizes["largest"])))
    n_queries = asked.filter(F.size("embedding") == dimension).count()
    blocks = max(1, -(-sizes["n"] // BLOCK))
    # of the queries that are expected at a block, so that the index is not copied the oftener the more blocks there are
    query_blocks = max(1, math.ceil(n_queries * min(1.0, PROBES / blocks) / QUERY_BLOCK))
    of_size = F.size("embedding") == dimension
    shares = [0.5, max(0.5, 1 - BLOCK / sizes["n"])]
    median, high = rows.filter(of_size).agg(F.percentile_approx(squared, shares, 10_000)).first()[0]
    long_over = max(LONG * float(np.sqrt(median)), float(np.sqrt(high)))
    same = Window.partitionBy(F.xxhash64("embedding")).orderBy("vec_id")
    rows = rows.filter(of_size).withColumn("place", F.row_number().over(same)).filter(F.col("place") <= k + 1).drop("place")

    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            if len(part):
                x = _matrix(part["embedding"])
                keys = hashing.rows(x)
                keys[np.linalg.norm(x, axis=1) > long_over, 0] = LONG_BUCKET
                for t in range(TABLES):
                    yield pd.DataFrame({"tbl": t, "block": keys[:, t].view(np.uint64) % np.uint64(blocks), "bucket": keys[:, t], "vec_id": part["vec_id"], "embedding": part["embedding"]})

    def visits(tables: range) -> DataFrame:
        """The blocks and buckets of these tables that each query visits."""

        def visit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for whole in batches:
                for lo in range(0, len(whole), 256):
                    part = whole.iloc[lo : lo + 256]
                    keys = hashing.probes(_matrix(part["embedding"]), tables)
                    out = []
                    for (i, e), of in zip(zip(part["vec_id"], part["embedding"]), keys):
                        for t, buckets in zip(tables, of):
                            buckets = np.append(buckets, LONG_BUCKET) if t == 0 else buckets
                            where = (buckets.view(np.uint64) % np.uint64(blocks)).astype(np.int64)
                            order = np.argsort(where, kind="stable")
                            cuts = np.flatnonzero(np.diff(where[order])) + 1
                            out += [(t, int(where[g[0]]), buckets[g], i, e) for g in np.split(order, cuts)]
                    yield pd.DataFrame(out, columns=["tbl", "block", "visits", "query_id", "query"])

        seen = asked.filter(of_size).mapInPandas(visit, "tbl int, block long, visits array<long>, query_id long, query array<double>")
        seen = seen.join(full, ["tbl", "block"]).withColumn("part", F.explode(F.expr("sequence(0L, parts - 1)")))
        return seen.withColumn("turn", F.expr(f"cast(pmod(xxhash64(query_id, 1), {query_blocks}) as int)")).select(*key, "visits", "query_id", "query")

    indexed = scratch.save(rows.mapInPandas(index, "tbl int, block long, bucket long, vec_id long, embedding array<double>"), "index")
    key = ["tbl", "block", "part", "turn"]
    full = indexed.groupBy("tbl", "block").agg(F.ceil(F.count("*") / F.lit(2 * BLOCK)).alias("parts"))
    left = indexed.join(full, ["tbl", "block"]).withColumn("part", F.expr("pmod(xxhash64(vec_id), parts)")).withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1)))).select(*key, "bucket", "vec_id", "embedding")
    def score(key: tuple, held: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        found: list[pd.DataFrame] = []
        if len(held) and len(wanted):
            x, ids = _matrix(held["embedding"]), held["vec_id"].to_numpy()
            names, bucket = np.unique(held["bucket"].to_numpy(), return_inverse=True)
            for lo in range(0, len(wanted), 128):
                some = wanted.iloc[lo : lo + 128]
                q, own = _matrix(some["query"]), some["query_id"].to_numpy()
                seen = np.zeros((len(some), len(names) + 1), bool)
                for i, v in enumerate(some["visits"]):
                    at = np.searchsorted(names, v)
                    if not len(v):  # a query that visits everything
                        seen[i] = True
                    seen[i, np.where(names[np.minimum(at, len(names) - 1)] == v, at, len(names))] = True
                floor = some["floor"].to_numpy(np.float64)[:, None]
                near = np.where(seen[:, bucket] & (ids[None, :] != own[:, None]), q @ x.T, -np.inf)
                near[near < floor - 1e-9 * np.abs(floor)] = -np.inf
                if near.shape[1] > k:
                    least = np.partition(near, near.shape[1] - k, axis=1)[:, near.shape[1] - k]
                    near[near < least[:, None] - 1e-9 * np.abs(least[:, None])] = -np.inf
                i, j = np.nonzero(near > -np.inf)
                found.append(pd.DataFrame({"query_id": own[i], "vec_id": ids[j], "score": (q[i] * x[j]).sum(axis=1)}))
        every = pd.concat(found) if found else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        return every.sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True]).groupby("query_id").head(k).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")

    no_floor = F.lit(float("-inf")).alias("floor")

    def scored(rows_: DataFrame, asked_: DataFrame) -> DataFrame:
        return rows_.groupBy(*key).cogroup(asked_.groupBy(*key)).applyInPandas(score, "query_id long, vec_id long, score double")

    def merged(pairs: DataFrame) -> DataFrame:
        once = pairs.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        return once.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    first = scratch.save(merged(scored(left.filter("tbl = 0"), visits(range(1)).select("*", no_floor))), "first")
    floors = first.filter(F.col("rank") == k).select("query_id", F.col("score").alias("reached"))
    later = visits(range(1, TABLES)).join(floors, "query_id", "left").select(*key, "visits", "query_id", "query", F.coalesce("reached", no_floor).alias("floor"))
    found = scratch.save(merged(first.select("query_id", "vec_id", "score").unionByName(scored(left.filter("tbl > 0"), later))), "found")
    held = indexed.filter("tbl = 0").count()
    full_lists = found.groupBy("query_id").agg(F.count("*").alias("n")).filter(F.col("n") >= min(k, held - 1)).select("query_id")
    short = asked.filter(of_size).select(F.col("vec_id").alias("query_id"), F.col("embedding").cast("array<double>").alias("query")).join(full_lists, "query_id", "left_anti")
    short = scratch.save(short, "short")
    if short.limit(1).count() == 0:
        return found
    # queries whose buckets held too few rows are compared with every block of one table
    every = full.filter("tbl = 0").select("tbl", F.expr("block + 0L").alias("block"), F.explode(F.expr("sequence(0L, parts - 1)")).alias("part"))
    again = short.withColumn("turn", F.expr(f"cast(pmod(xxhash64(query_id, 1), {query_blocks}) as int)")).withColumn("tbl", F.lit(0)).join(every, "tbl").select(*key, F.expr("cast(array() as array<long>)").alias("visits"), "query_id", "query", no_floor)
    exact = merged(scored(left.filter("tbl = 0"), again))
    return found.join(short.select("query_id"), "query_id", "left_anti").select("query_id", "rank", "vec_id", "score").unionByName(exact)
