"""Near-duplicate documents by one-permutation MinHash.

Words are what lies between ASCII white space after lower-casing A-Z; a document is the set of its distinct
five-word shingles (fewer words: the whole sequence is the one shingle; no word: the empty set, linked with
nothing). One hash a shingle: the high part of the hash chooses one of ``BANDS * ROWS`` bins, the least hash of a bin is its value, and
empty bins borrow from a bin chosen by a hash of (bin, attempt) ("optimal densification", Shrivastava 2017).
Runs of ROWS bins are bands; equal bands share a bucket.

Links are confirmed on full shingle sets. To bound the pairs, a bucket yields a star: each member with the
bucket's centre. In buckets that are not one component afterwards, members of different components are
compared too, so that no pair that shares a bucket and could still join two components stays untested: pair by
pair in buckets of at most ``CROWD`` members. Larger ones that overlap are taken together as a crowd, which is
cut into blocks of about ``BLOCK`` members; a task counts what the sets of two blocks have in common by matrix
products, and gives back only links that join components, never the pairs.

Equal sets are collapsed before anything else, so a group of copies of any size is one node with a number of its own. Links are
between nodes; ids only name the components that come out.

Cases: null, empty or blank text: n_shingles 0, component_id = doc_id, kept. Rows of one doc_id with different texts are documents
of their own: each is linked by its text, and the shared id alone links nothing. Repeated rows each come
back. Null doc_id: the row is linked like any other; component_id is the least non-null id of its component. Where a component has no
id at all, component_id is null and its rows are kept, since no id can name the one that stays. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, mix64, shingle_sets, small_batches

BANDS, ROWS, WIDTH = 40, 5, 5
CROWD, BLOCK = 24, 256

_BINS = BANDS * ROWS
_EDGES = (np.arange(_BINS, dtype=np.float64) * (2.0**64 / _BINS)).astype(np.uint64)
_SALT = mix64(np.arange(1, _BINS + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) | np.uint64(1)


def signature(shingles: np.ndarray) -> np.ndarray:
    """The bins' values of a sorted, non-empty set of hashes."""
    at = np.searchsorted(shingles, _EDGES)
    full = at < np.append(at[1:], len(shingles))
    value = shingles[np.minimum(at, len(shingles) - 1)]
    empty = np.flatnonzero(~full)
    attempt = 1
    while len(empty):
        donor = (mix64(empty.astype(np.uint64) * np.uint64(1_000_003) + np.uint64(attempt * 0x9E3779B97F4A7C15 % 2**64)) % np.uint64(_BINS)).astype(np.int64)
        found = full[donor]
        value[empty[found]] = value[donor[found]]
        empty, attempt = empty[~found], attempt + 1
    return value


def buckets(shingles: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band."""
    return mix64((signature(shingles) * _SALT).reshape(BANDS, ROWS).sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def _texts(column: pd.Series) -> list[bytes]:
    return [b"" if t is None else t.encode("utf-8", "replace") for t in column.astype(object).where(column.notna(), None)]


def _sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in batches:
        sizes, keys, bands = [], [], []
        for s in shingle_sets(_texts(part["text"]), WIDTH):
            sizes.append(len(s))
            keys.append(hashlib.md5(s.tobytes()).digest() if len(s) else None)
            bands.append(buckets(s) if len(s) else None)
        yield pd.DataFrame({"doc_id": part["doc_id"], "n_shingles": sizes, "set_key": keys, "buckets": bands, "row_key": part["row_key"]})


def _sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in batches:
        sets = list(shingle_sets(_texts(part["text"]), WIDTH))
        # another text may have the same 64-bit key
        same = [hashlib.md5(s.tobytes()).digest() == bytes(k) for s, k in zip(sets, part["set_key"])]
        yield pd.DataFrame({"rep": part["rep"][same], "shingles": [s.view(np.int64) for s, ok in zip(sets, same) if ok]})


def components(spark: SparkSession, edges: DataFrame, scratch: Scratch, tag: str) -> DataFrame:
    """(id, comp): the least id reachable, for every id of the edges (a, b). Labels spread to neighbours and then jump to their label's label."""
    both = scratch.save(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{tag}-both")
    labels = scratch.save(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.min("a")).alias("comp")), f"{tag}-0")
    step = 0
    while True:
        near = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("comp").alias("low"))
        told = labels.join(near, "id").select("id", F.least("comp", "low").alias("mid"), F.col("comp").alias("was"))
        jumped = told.join(labels.select(F.col("id").alias("mid"), F.col("comp").alias("far")), "mid", "left")
        step += 1
        new = scratch.save(jumped.select("id", F.least("mid", F.coalesce("far", "mid")).alias("comp"), (F.least("mid", F.coalesce("far", "mid")) < F.col("was")).alias("moved")), f"{tag}-{step}")
        moved = new.filter("moved").limit(1).count()
        scratch.drop(f"{tag}-{step - 1}")
        labels = new.select("id", "comp")
        if not moved:
            scratch.drop(f"{tag}-both")
            return labels


def by_stars(spark: SparkSession, edges: DataFrame, scratch: Scratch, tag: str) -> DataFrame:
    """What ``components`` returns, for edges that are many times the ids.

    Large and small stars in turn (Kiveris et al. 2014): what is above an id goes to its least neighbour, then what is below it does. A turn joins the
    edges (a >= b) it is given twice at most, not in both directions in every round, and hands on no more than it was given: links of one id that
    lead to the same one become one link. It ends when every component is a star."""
    edges = scratch.save(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{tag}-0")
    step = 0
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = scratch.save(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"), F.count_if(F.col("a") != F.col("b")).alias("links")), f"{tag}-near-{step}")
        scattered = near.filter("low < a and links > 1").limit(1).count()
        if not scattered:
            scratch.drop(f"{tag}-{step}")
            return near.select(F.col("a").alias("id"), F.col("low").alias("comp"))
        above = scratch.save(edges.join(near.select(F.col("a").alias("b"), "low"), "b").select("a", F.col("low").alias("b")).distinct(), f"{tag}-above-{step}")
        lows = above.groupBy("a").agg(F.min("b").alias("low"))
        below = above.join(lows, "a").filter("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
        step += 1
        edges = scratch.save(below.unionByName(lows.select("a", F.col("low").alias("b"))).distinct(), f"{tag}-{step}")
        for name in (f"{tag}-{step - 1}", f"{tag}-near-{step - 1}", f"{tag}-above-{step - 1}"):
            scratch.drop(name)


def near_duplicates(spark: SparkSession, docs: DataFrame, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id, kept; documents with 100 * intersection >= percent * union are linked."""
    small_batches(spark)
    scratch = Scratch(spark, "neardup")
    docs = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("row_key"))
    signed = scratch.save(docs.mapInPandas(_sign, "doc_id long, n_shingles long, set_key binary, buckets array<long>, row_key long"), "signed")
    least = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row_key")).alias("least")
    reps = signed.filter("set_key is not null").groupBy("set_key").agg(least, F.count("*").alias("copies"), F.any_value("n_shingles").alias("n"), F.any_value("buckets").alias("buckets"))
    # nodes get their numbers as they are written: whoever reads the table sees the same ones
    reps = scratch.save(reps.select(F.monotonically_increasing_id().alias("rep"), "set_key", "least.doc_id", "least.row_key", "copies", "n", "buckets"), "reps")
    named = reps.select("rep", "set_key", "row_key")
    bands = reps.select("rep", "n", F.explode("buckets").alias("bucket"))
    crowded = bands.groupBy("bucket").agg(F.min("rep").alias("centre"), F.count("*").alias("members")).filter("members > 1").drop("members")
    active = scratch.save(bands.join(crowded, "bucket").select("bucket", "rep", "n", "centre"), "active")

    centres = active.select(F.col("rep").alias("b"), F.col("n").alias("n_b"))
    pairs = active.filter("rep <> centre").select(F.col("rep").alias("a"), F.col("n").alias("n_a"), F.col("centre").alias("b")).distinct()
    pairs = pairs.join(centres.distinct(), "b")
    tested = scratch.save(_confirm(pairs, docs, named, percent), "tested-0")
    good = tested.filter("linked").select("a", "b")
    labels = by_stars(spark, good, scratch, "cc-0")
    known = active.join(labels.withColumnRenamed("id", "rep"), "rep", "left").select("bucket", "rep", "n", F.coalesce("comp", "rep").alias("comp"))
    split = known.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("members"), F.min("rep").alias("centre")).filter("lo < hi").drop("lo", "hi")
    known = scratch.save(known.join(split, "bucket"), "known")
    few = known.filter(F.col("members") <= CROWD)
    left = few.select("bucket", F.col("rep").alias("a"), F.col("n").alias("n_a"), F.col("comp").alias("comp_a"))
    right = few.select("bucket", F.col("rep").alias("b"), F.col("n").alias("n_b"), F.col("comp").alias("comp_b"))
    more = left.join(right, "bucket").filter("comp_a <> comp_b and a > b").filter(_close(percent)).select("a", "n_a", "b", "n_b").distinct()
    more = more.join(tested.select("a", "b"), ["a", "b"], "left_anti")
    fresh = scratch.save(_confirm(more, docs, named, percent), "tested-1")
    found = good.unionByName(fresh.filter("linked").select("a", "b")).unionByName(_crowds(spark, scratch, known.filter(F.col("members") > CROWD), docs, named, percent))
    labels = by_stars(spark, found, scratch, "cc-1")
    scratch.drop("known")

    joined = scratch.save(reps.join(labels.withColumnRenamed("id", "rep"), "rep", "left").filter("copies > 1 or comp is not null").select("set_key", "doc_id", "comp"), "joined")
    names = joined.filter("comp is not null").groupBy("comp").agg(F.min("doc_id").alias("name"))
    linked = joined.join(names, "comp", "left").select("set_key", F.coalesce("name", "doc_id").alias("comp"))
    out = signed.select("doc_id", "n_shingles", "set_key").join(linked, "set_key", "left")
    out = out.select("doc_id", "n_shingles", F.coalesce("comp", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))


def _crowds(spark: SparkSession, scratch: Scratch, known: DataFrame, docs: DataFrame, named: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that join components inside crowds of overlapping large buckets (rows bucket, rep, n, comp, centre)."""
    known = scratch.save(known, "crowded")
    if known.limit(1).count() == 0:
        return spark.createDataFrame([], "a long, b long")
    stars = known.filter("rep <> centre").select(F.col("rep").alias("a"), F.col("centre").alias("b")).distinct()
    crowd = by_stars(spark, stars, scratch, "crowd").select(F.col("id").alias("rep"), F.col("comp").alias("crowd"))
    members = known.select("rep", "n", "comp").distinct().join(crowd, "rep")
    sizes = members.groupBy("crowd").agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("blocks"))
    members = members.join(sizes, "crowd").withColumn("block", F.expr("cast(pmod(xxhash64(rep), blocks) as int)"))
    whole = scratch.save(members.join(_full_sets(members.select("rep"), docs, named), "rep"), "crowd-sets")
    dealt = whole.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("crowd", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "rep", "comp", "shingles")

    def compare(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        sides = [part[part["block"] == k] for k in (key[1], key[2])]
        common = overlap([np.concatenate(list(x["shingles"])) if len(x) else np.zeros(0, np.int64) for x in sides], [x["shingles"].map(len).to_numpy(np.int64) for x in sides])
        sizes = [x["shingles"].map(len).to_numpy(np.int64) for x in sides]
        i, j = np.nonzero(100 * common >= percent * (sizes[0][:, None] + sizes[1][None, :] - common))
        ids, comps = [x["rep"].to_numpy() for x in sides], [x["comp"].to_numpy() for x in sides]
        parent: dict[int, int] = {}

        def top(x: int) -> int:
            while (y := parent.get(x, x)) != x:
                x = y
            return x

        out = []
        for x, y in zip(i, j):
            a, b = top(int(comps[0][x])), top(int(comps[1][y]))
            if a != b:
                parent[max(a, b)] = min(a, b)
                out.append((int(ids[0][x]), int(ids[1][y])))
        return pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    return scratch.save(dealt.groupBy("crowd", "lo", "hi").applyInPandas(compare, "a long, b long"), "crowd-links")


def overlap(flat: list[np.ndarray], sizes: list[np.ndarray], width: int = 4096) -> np.ndarray:
    """Sizes of the intersections of all sets of one side with all of the other, from their members one after another."""
    shared = np.intersect1d(flat[0], flat[1])
    at = []
    for f, n in zip(flat, sizes):
        place = np.minimum(np.searchsorted(shared, f), max(len(shared) - 1, 0))
        hit = shared[place] == f if len(shared) else np.zeros(len(f), bool)
        at.append((np.repeat(np.arange(len(n)), n)[hit], place[hit]))
    out = np.zeros((len(sizes[0]), len(sizes[1])), np.float64)
    for lo in range(0, len(shared), width):
        dense = []
        for (row, place), n in zip(at, sizes):
            m = np.zeros((len(n), min(width, len(shared) - lo)), np.float32)
            use = (place >= lo) & (place < lo + width)
            m[row[use], place[use] - lo] = 1
            dense.append(m)
        out += dense[0] @ dense[1].T
    return np.rint(out).astype(np.int64)


def _close(percent: int) -> str:
    """Only sets of about the same size can be so similar."""
    return f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)"


def _full_sets(reps: DataFrame, docs: DataFrame, named: DataFrame) -> DataFrame:
    """rep, shingles of the nodes (rep): each made from one row that has its set."""
    wanted = named.join(reps.distinct(), "rep")
    texts = docs.select("text", "row_key").join(wanted, "row_key").groupBy("rep", F.xxhash64(F.lit(1), "text")).agg(F.any_value("text").alias("text"), F.any_value("set_key").alias("set_key"))
    return texts.mapInPandas(_sets, "rep long, shingles array<long>")


def _confirm(pairs: DataFrame, docs: DataFrame, named: DataFrame, percent: int) -> DataFrame:
    """(a, b, linked) of the pairs (a, n_a, b, n_b), on the full sets of shingles."""
    pairs = pairs.filter(_close(percent))
    sets = _full_sets(pairs.select(F.explode(F.array("a", "b")).alias("rep")), docs, named)
    with_a = pairs.join(sets.select(F.col("rep").alias("a"), F.col("shingles").alias("s_a")), "a")
    both = with_a.join(sets.select(F.col("rep").alias("b"), F.col("shingles").alias("s_b")), "b")
    common = both.select("a", "b", "n_a", "n_b", F.size(F.array_intersect("s_a", "s_b")).cast("long").alias("common"))
    return common.select("a", "b", (100 * F.col("common") >= percent * (F.col("n_a") + F.col("n_b") - F.col("common"))).alias("linked"))
