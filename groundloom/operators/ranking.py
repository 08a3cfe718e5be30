"""Gapless numbers inside groups of any size, nested candidate rings, and random pairs without repeats.

Order is always by a draw in [0, 1) (see ``functions.scalar.uniform``), ties by key. A group is cut into ranges of the draw, as many as its
size asks for, so no task sorts a whole group: a row's number is its place in its range plus what earlier ranges hold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import uniform

#: Rows of a group that one task sorts.
RANGE_ROWS = 200_000
#: Rows of a few numbers that may be broadcast.
BROADCAST_ROWS = 500_000
#: Rounds of the keyed permutation, and steps it may take to leave the numbers that stand for no pair.
ROUNDS, STEPS = 3, 64


def sized(rows: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """Marked for broadcast if it has at most ``most`` rows; else left to a shuffle, where adaptive execution splits hot keys."""
    return F.broadcast(rows) if rows.limit(most + 1).count() <= most else rows


def same(left: DataFrame, right: DataFrame, columns: list[str]) -> Column:
    """Equal columns, nulls included; without columns always true."""
    out = F.lit(True)
    for c in columns:
        out = out & left[c].eqNullSafe(right[f"__{c}"])
    return out


def attached(rows: DataFrame, table: DataFrame, columns: list[str]) -> DataFrame:
    """Inner join on columns that may be null; without columns the table is one row."""
    if not columns:
        return rows.crossJoin(F.broadcast(table.limit(1)))
    there = table.withColumnsRenamed({c: f"__{c}" for c in columns})
    return rows.join(there, same(rows, there, columns)).drop(*(f"__{c}" for c in columns))


def group_sizes(rows: DataFrame, group: list[str], out: str = "size") -> DataFrame:
    return rows.groupBy(*group).agg(F.count("*").alias(out))


def numbered(rows: DataFrame, group: list[str], draw: Column, key: str, place: str = "place", size: str = "size", range_rows: int | None = None) -> DataFrame:
    """Adds ``place`` (1, 2, ... without gaps, by draw and key) and ``size`` inside each group; a null is a group like others.

    Three passes over the rows' groups and draws (sizes, counts of ranges, places); rows that are dear to compute are better written first.
    Keys must differ inside a group, else rows with equal draws and keys are numbered in any order."""
    per = range_rows or RANGE_ROWS
    sizes = group_sizes(rows, group, size)
    dealt = attached(rows.withColumn("__u", draw), sized(sizes) if group else sizes, group)
    dealt = dealt.withColumn("__range", F.floor(F.col("__u") * F.ceil(F.col(size) / F.lit(per))))
    held = dealt.groupBy(*group, "__range").agg(F.count("*").alias("__n"))
    earlier = Window.partitionBy(*group).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # a row a range, not a row a member
    before = held.select(*group, "__range", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
    inside = Window.partitionBy(*group, "__range").orderBy("__u", key)
    placed = dealt.withColumn("__place", F.row_number().over(inside))
    joined = attached(placed, sized(before), [*group, "__range"])
    return joined.withColumn(place, F.col("__before") + F.col("__place")).drop("__u", "__range", "__place", "__before")


def folds(rows: DataFrame, stratum: list[str], key: str, count: int, seed: int, stage: str = "fold", out: str = "fold") -> DataFrame:
    """Adds the fold 0 to ``count`` - 1: places inside a stratum modulo ``count``, so folds of a stratum differ by a row at most."""
    return numbered(rows, stratum, uniform(seed, F.col(key), stage), key, "__p", "__s").withColumn(out, F.col("__p") % count).drop("__p", "__s")


def split_rows(rows: DataFrame, stratum: list[str], key: str, share: float, seed: int, stage: str = "split", out: str = "train") -> DataFrame:
    """Adds whether a row is among the first ``share`` of its stratum, rounded up."""
    return numbered(rows, stratum, uniform(seed, F.col(key), stage), key, "__p", "__s").withColumn(out, F.col("__p") <= F.ceil(F.lit(share) * F.col("__s"))).drop("__p", "__s")


def balanced_rows(rows: DataFrame, value: str, key: str, seed: int, cap: int = 1000, least: int = 50, stage: str = "balance") -> DataFrame:
    """As many rows of each value (null is one): the size of the rarest, at most ``cap``; fewer than ``least`` are an error."""
    rarest = group_sizes(rows, [value]).agg(F.least(F.min("size"), F.lit(cap)).alias("__most"))
    enough = F.when(F.col("__most") >= least, F.col("__most")).otherwise(F.raise_error(F.format_string(f"only %d rows per value of {value}; at least {least} are needed", F.col("__most"))).cast("long"))
    placed = numbered(rows, [value], uniform(seed, F.col(key), stage), key, "__p", "__s")
    return placed.crossJoin(F.broadcast(rarest.select(enough.alias("__most")))).filter("__p <= __most").drop("__p", "__s", "__most")


def nested_candidates(rows: DataFrame, key: str, levels: list[str], draw: Column, count: int, seed: int, stage: str = "ring") -> DataFrame:
    """key, candidate, step, level: each row itself (step 0, level 0) and ``count`` - 1 different others, from the finest group that has them.

    ``levels`` name columns from coarse to fine; the coarsest group is the whole table. The rows stand in one order, in which
    the groups of every level are intervals. Others come from around the ring of the finest group; where it is too small all of it is taken, and
    what lacks is spread evenly over the next coarser interval without the finer one, from a drawn start on. So a row gets ``count``
    candidates unless the whole table has fewer. ``level`` is 1 for the finest group. Nulls are a value like others. Keys must be
    different. A candidate is found by its number in the order, so hot groups are not hot keys. The sizes of the groups (a vocabulary) are summed in one task.
    """
    kept = numbered(rows.select(key, *levels), levels, draw, key, "__p", "__n1")
    sizes = group_sizes(kept, levels, "__n")
    # where each group begins in the whole order, and each of its coarser groups
    order = Window.orderBy(*(F.col(c).asc_nulls_first() for c in levels)).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("__a1", F.coalesce(F.sum("__n").over(order), F.lit(0)))
    bounds = ["__a1"]
    for k in range(len(levels) - 1, -1, -1):
        w = Window.partitionBy(*levels[:k]) if k else Window.partitionBy(F.lit(0))
        i = len(levels) - k + 1
        starts = starts.withColumn(f"__a{i}", F.min("__a1").over(w)).withColumn(f"__n{i}", F.sum("__n").over(w))
        bounds += [f"__a{i}", f"__n{i}"]
    placed = attached(kept, sized(starts.drop("__n")), levels).withColumn("__at", F.col("__a1") + F.col("__p") - 1)

    levels_up = len(levels) + 1
    n = lambda i: F.col(f"__n{i}")
    a = lambda i: F.col(f"__a{i}")
    need, taken, before = F.lit(count - 1), [], []
    for i in range(1, levels_up + 1):
        room = n(1) - 1 if i == 1 else n(i) - n(i - 1)
        took = F.least(need - sum(taken, F.lit(0)), room)
        before.append(sum(taken, F.lit(0)))
        taken.append(took)
        placed = placed.withColumn(f"__t{i}", took)
        taken[-1] = F.col(f"__t{i}")
    asked = placed.withColumn("step", F.explode(F.sequence(F.lit(0), sum(taken, F.lit(0)).cast("int"))))
    step = F.col("step")
    position, level = F.col("__at"), F.lit(0)
    for i in range(1, levels_up + 1):
        here = (step > before[i - 1]) & (step <= before[i - 1] + taken[i - 1])
        j = step - before[i - 1]
        if i == 1:
            at = a(1) + (F.col("__at") - a(1) + j) % n(1)
        else:
            free = n(i) - n(i - 1)
            start = F.floor(uniform(seed, F.col(key), f"{stage}{i}") * free)
            x = (start + F.floor((j - 1) * free / taken[i - 1])) % free
            at = a(i) + x + F.when(a(i) + x >= a(i - 1), n(i - 1)).otherwise(F.lit(0))
        position = F.when(here, at).otherwise(position)
        level = F.when(here, F.lit(i)).otherwise(level)
    asked = asked.select(key, "step", level.alias("level"), position.alias("__at"))
    there = placed.select(F.col(key).alias("candidate"), "__at")
    return asked.join(there, "__at").select(key, "candidate", "step", "level")


def shift_at(seed: int, k: Column, value: Column) -> Column:
    """60 bits of an md5 of seed, round and value."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.concat(F.lit(f"{seed}/"), k.cast("string")), value.cast("string"))), 1, 15), 16, 10).cast("long")


def pair_numbers(sizes: DataFrame, size: str, most: int, seed: int) -> DataFrame:
    """Adds turn, i, j for ``min(most, all)`` different unordered pairs of 0 to size - 1 of each row: no self-pairs, no repeats.

    A pair is (i, i + d modulo size) for one distance d up to half the size, so pairs are a rectangle (for an even size, half of its last
    line is left out). A keyed bijection of the rectangle sends the first numbers to pairs; where it hits the part left out it is applied again."""
    n = F.col(size)
    whole = F.floor(n / 2)
    every = F.when(n % 2 == 0, (whole - 1) * n + whole).otherwise(whole * n)
    turns = sizes.filter(n >= 2).withColumn("turn", F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.lit(most).cast("long"), every) - 1)))

    def once(p: Column) -> Column:
        # the sides are shifted in turn, each by a hash of the other
        return F.aggregate(F.sequence(F.lit(0), F.lit(2 * ROUNDS - 1)), p, lambda s, k: F.struct(
            F.when(k % 2 == 0, (s["x"] + shift_at(seed, k, s["y"])) % n).otherwise(s["x"]).alias("x"),
            F.when(k % 2 == 1, (s["y"] + shift_at(seed, k, s["x"])) % whole).otherwise(s["y"]).alias("y")))

    bad = lambda p: (n % 2 == 0) & (p["y"] == whole - 1) & (p["x"] >= whole)
    begin = F.struct((F.col("turn") % n).alias("x"), F.floor(F.col("turn") / n).alias("y"))
    walked = F.aggregate(F.sequence(F.lit(2), F.lit(STEPS)), once(begin), lambda p, _: F.when(bad(p), once(p)).otherwise(p))
    found = turns.withColumn("__p", walked)
    i = F.when(bad(F.col("__p")), F.raise_error(F.lit("the permutation did not leave the unused numbers")).cast("long")).otherwise(F.col("__p.x"))
    return found.withColumn("i", i).withColumn("j", (F.col("__p.x") + F.col("__p.y") + 1) % n).drop("__p")


def random_pairs(rows: DataFrame, key: str, group: list[str], most: int, seed: int, stage: str = "pairs") -> DataFrame:
    """group, turn, first, second: ``min(most, all)`` different unordered pairs of keys of each group. Groups of one row have none."""
    placed = numbered(rows.select(key, *group), group, uniform(seed, F.col(key), stage), key, "__at", "__n")
    wanted = pair_numbers(group_sizes(rows, group, "__n"), "__n", most, seed)
    for side, name in (("i", "first"), ("j", "second")):
        there = placed.select(*(F.col(c).alias(f"__{c}") for c in group), (F.col("__at") - 1).alias("__at"), F.col(key).alias(name))
        wanted = wanted.join(there, same(wanted, there, group) & (wanted[side] == there["__at"])).drop("__at", *(f"__{c}" for c in group))
    return wanted.select(*group, "turn", "first", "second")


def similarity_report(pairs: DataFrame, group: list[str], similarity: str, threshold: float) -> DataFrame:
    """group, pairs_compared, mean_similarity, max_similarity, pct_above_threshold (strictly above); without groups and pairs one row of zeros."""
    x = F.col(similarity)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return pairs.groupBy(*group).agg(F.count("*").alias("pairs_compared"), zero(F.avg(x)).alias("mean_similarity"), zero(F.max(x)).alias("max_similarity"), zero(F.avg((x > threshold).cast("double"))).alias("pct_above_threshold"))
