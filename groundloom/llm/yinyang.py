"""Centroid clustering of integer vectors with Yinyang bounds.

Centroids are put into about k / ``PER_GROUP`` groups once, before the first round (Ding et al. 2015). A vector carries an
upper bound of its distance to its centroid and one lower bound a group: of its distances to the group's centroids other than
its own. After centroids have moved, the upper bound grows by how far its own centroid went, a lower bound falls by the longest way of its group.
Then three filters: a vector whose upper bound is below all its lower bounds stays (global filter); with the exact distance in place
of the upper bound, only groups whose lower bound isn't above it can hold a nearer centroid (group filter); their
centroids are compared exactly.

Components are integers, so squared distances are exact: bounds only save work, and the result is that of the
plain algorithm. Ties go to the smaller number, therefore a group is left out only if its bound is above, not if it is equal.
Roots are rounded outwards.

Each round is one pass over the table of vectors and bounds, which is written to the shared folder; the rounds' tasks depend on
nothing but that table and the k centroids. Sums change only by vectors that moved: tasks add those up, and what reaches
the driver is one row a centroid.

Cases: vectors that are null, of another length, or hold null or non-finite components take no part. A row with a null id
is clustered like others, but is no initial centroid. Repeated rows of an id are rows of their own (the initial order: hash, then components).
Fewer vectors than k: as many centroids. No vector: no row. A component of more than ``LARGEST`` after scaling is an error,
since squared distances would not fit 64 bits. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch

#: Centroids to a group, passes of the grouping, and the largest component for which a squared distance of 64 components fits 62 bits.
PER_GROUP, GROUPING_PASSES, LARGEST = 10, 5, 1 << 26
#: Up to this size a float64 matrix product of 64 components is exact.
_EXACT = 1 << 22
_ROWS = 4096
_STATE = "vec_id long, v array<int>, cluster int, was int, upper double, lower array<double>"


def integer_vectors(vectors: DataFrame, dimension: int = 64, scale: int = 256) -> DataFrame:
    """vec_id, v: floor(scale * x) of the vectors that take part."""
    sound = F.expr(f"embedding is not null and size(embedding) = {dimension} and forall(embedding, x -> x is not null and not isnan(x) and abs(double(x)) < double('inf'))")
    scaled = F.transform("embedding", lambda x: x.cast("double") * scale)
    fits = F.forall(scaled, lambda x: F.abs(x) <= LARGEST)
    whole = F.when(fits, F.transform(scaled, lambda x: F.floor(x).cast("int"))).otherwise(F.raise_error(F.lit(f"a component is larger than {LARGEST} after scaling")).cast("array<int>"))
    return vectors.select("vec_id", "embedding").filter(sound).select("vec_id", whole.alias("v"))


def initial(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k vectors with the least hashes of seed and id."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = vectors.filter("vec_id is not null").orderBy(key, "v").limit(k).select("v").collect()
    return np.array([r["v"] for r in rows], np.int64)


def grouped(centroids: np.ndarray) -> np.ndarray:
    """The group of each centroid, numbered without gaps: a few plain rounds over the centroids themselves."""
    n = max(1, round(len(centroids) / PER_GROUP))
    c = centroids.astype(np.float64)
    middle = c[:n].copy()
    for _ in range(GROUPING_PASSES):
        of = ((c[:, None, :] - middle[None]) ** 2).sum(-1).argmin(1)
        for g in range(n):
            if (of == g).any():
                middle[g] = c[of == g].mean(0)
    return np.unique(of, return_inverse=True)[1]


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows to all centroids."""
    high = max(int(np.abs(x).max(initial=0)), int(np.abs(c).max(initial=0)))
    products = np.rint(x.astype(np.float64) @ c.T.astype(np.float64)).astype(np.int64) if high <= _EXACT else x @ c.T
    return (x * x).sum(1)[:, None] - 2 * products + (c * c).sum(1)[None, :]


def own_squared(x: np.ndarray, c: np.ndarray, of: np.ndarray) -> np.ndarray:
    d = x - c[of]
    return (d * d).sum(1)


def _up(d: np.ndarray) -> np.ndarray:
    return np.sqrt(d.astype(np.float64)) * (1 + 1e-12)


def _down(d: np.ndarray) -> np.ndarray:
    return np.sqrt(d.astype(np.float64)) * (1 - 1e-12)


def scan_all(x: np.ndarray, c: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """cluster, upper, lower of rows without bounds."""
    d = squared(x, c)
    of = d.argmin(1)
    rows = np.arange(len(x))
    upper = _up(d[rows, of])
    rest = _down(d)
    rest[rows, of] = np.inf
    return of, upper, np.stack([rest[:, group == g].min(1) for g in range(group.max() + 1)], 1)


def reassign(x: np.ndarray, of: np.ndarray, upper: np.ndarray, lower: np.ndarray, c: np.ndarray, group: np.ndarray, moved: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """cluster, upper, lower after the centroids have moved by ``moved``; the last number counts the compared distances."""
    of, upper = of.copy(), (upper + moved[of]) * (1 + 1e-12)
    falls = np.array([moved[group == g].max() for g in range(group.max() + 1)])
    lower = np.where(np.isinf(lower), np.inf, (lower - falls) - np.abs(lower) * 1e-12)
    open_ = np.flatnonzero(lower.min(1) <= upper)
    compared = 0
    if len(open_):
        best = own_squared(x[open_], c, of[open_])
        upper[open_] = _up(best)
        reach = lower[open_] <= upper[open_, None]
        before, now, seen = of[open_].copy(), of[open_].copy(), best.copy()
        found: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for g in range(group.max() + 1):
            rows = np.flatnonzero(reach[:, g])
            members = np.flatnonzero(group == g)
            if len(rows):
                d = squared(x[open_[rows]], c[members])
                compared += d.size
                found[g] = (rows, members, d)
                at = d.argmin(1)
                low, name = d[np.arange(len(rows)), at], members[at]
                nearer = (low < seen[rows]) | ((low == seen[rows]) & (name < now[rows]))
                now[rows[nearer]], seen[rows[nearer]] = name[nearer], low[nearer]
        # bounds leave out the new centroid only: the old one counts among its group's others now
        fresh = lower[open_]
        changed = np.flatnonzero(now != before)
        fresh[changed, group[before[changed]]] = np.minimum(fresh[changed, group[before[changed]]], _down(best[changed]))
        for g, (rows, members, d) in found.items():
            others = _down(d)
            others[members[None, :] == now[rows, None]] = np.inf
            fresh[rows, g] = others.min(1)
        lower[open_], of[open_], upper[open_] = fresh, now, _up(seen)
    return of, upper, lower, compared


def _parts(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    for batch in batches:
        for lo in range(0, len(batch), _ROWS):
            part = batch.iloc[lo : lo + _ROWS]
            yield part, np.stack(part["v"].to_numpy()).astype(np.int64)


def _frame(part: pd.DataFrame, of, was, upper, lower) -> pd.DataFrame:
    return pd.DataFrame({"vec_id": part["vec_id"], "v": part["v"], "cluster": of.astype(np.int32), "was": was.astype(np.int32), "upper": upper, "lower": list(lower)}, index=part.index)


def _start(c: np.ndarray, group: np.ndarray):
    def start(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part, x in _parts(batches):
            of, upper, lower = scan_all(x, c, group)
            yield _frame(part, of, np.full(len(x), -1), upper, lower)

    return start


def _again(c: np.ndarray, group: np.ndarray, moved: np.ndarray):
    def again(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part, x in _parts(batches):
            was = part["cluster"].to_numpy(np.int64)
            of, upper, lower, _ = reassign(x, was, part["upper"].to_numpy(np.float64), np.stack(part["lower"].to_numpy()), c, group, moved)
            yield _frame(part, of, was, upper, lower)

    return again


def _distances(c: np.ndarray):
    def distances(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part, x in _parts(batches):
            of = part["cluster"].to_numpy(np.int64)
            yield pd.DataFrame({"vec_id": part["vec_id"], "cluster": of.astype(np.int32), "distance": own_squared(x, c, of)}, index=part.index)

    return distances


def _changes(state: DataFrame, k: int, dimension: int) -> tuple[np.ndarray, np.ndarray]:
    """By how much each cluster's sums and count differ from those of the round before: one row a cluster."""

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums, counts = np.zeros((k, dimension), np.int64), np.zeros(k, np.int64)
        for part, x in _parts(batches):
            of, was = part["cluster"].to_numpy(np.int64), part["was"].to_numpy(np.int64)
            np.add.at(sums, of, x)
            np.add.at(counts, of, 1)
            left = was >= 0
            np.subtract.at(sums, was[left], x[left])
            np.subtract.at(counts, was[left], 1)
        touched = np.flatnonzero(sums.any(1) | (counts != 0))
        if len(touched):
            yield pd.DataFrame({"cluster": touched.astype(np.int32), "n": counts[touched], "s": list(sums[touched])})

    parts = state.filter("cluster <> was").select("v", "cluster", "was").mapInPandas(add, "cluster int, n long, s array<long>")
    total = parts.groupBy("cluster").agg(F.sum("n").alias("n"), *(F.sum(F.get("s", F.lit(i))).alias(f"s{i}") for i in range(dimension)))
    sums, counts = np.zeros((k, dimension), np.int64), np.zeros(k, np.int64)
    for row in total.collect():  # at most k
        counts[row["cluster"]] = row["n"]
        sums[row["cluster"]] = row[2:]
    return sums, counts


def cluster(spark: SparkSession, vectors: DataFrame, k: int = 40, rounds: int = 5, seed: int = 2, dimension: int = 64, scale: int = 256) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance of each vector; the final centroids). The table lies in the shared folder."""
    scratch = Scratch(spark, "yinyang")
    whole = integer_vectors(vectors, dimension, scale)
    centroids = initial(whole, k, seed)
    if not len(centroids):
        # rows with null ids only have no initial centroid either
        return spark.createDataFrame([], "vec_id long, cluster int, distance long"), centroids
    group = grouped(centroids)
    state = scratch.save(whole.mapInPandas(_start(centroids, group), _STATE), "state-0")
    sums, counts = np.zeros_like(centroids), np.zeros(len(centroids), np.int64)
    for i in range(rounds):
        more, n = _changes(state, len(centroids), dimension)
        sums, counts = sums + more, counts + n
        full = counts > 0
        new = centroids.copy()
        new[full] = sums[full] // counts[full, None]
        moved = _up(own_squared(new, centroids, np.arange(len(new))))
        centroids = new
        state = scratch.save(state.mapInPandas(_again(centroids, group, moved), _STATE), f"state-{i + 1}")
        scratch.drop(f"state-{i}")
    told = scratch.save(state.select("vec_id", "v", "cluster").mapInPandas(_distances(centroids), "vec_id long, cluster int, distance long"), "told")
    scratch.drop(f"state-{rounds}")
    return told, centroids


def clusters(spark: SparkSession, vectors: DataFrame, k: int = 40, rounds: int = 5, seed: int = 2) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of each vector."""
    told, centroids = cluster(spark, vectors, k, rounds, seed)
    names = [(i, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(centroids.tolist())]
    each = told.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    each = each.join(F.broadcast(spark.createDataFrame(names, "cluster int, centroid_sha256 string")), "cluster")  # k rows
    each = each.crossJoin(F.broadcast(told.agg(F.sum("distance").alias("inertia"))))
    return told.join(F.broadcast(each), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
