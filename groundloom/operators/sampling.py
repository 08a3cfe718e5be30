"""Weights, implied counts, chained draws from a specification, redraws, and ranked choices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import integer_in, pick, uniform, uniform_at
from ..plans.graph import Spec, ordered
from .grounding import draw

#: Redraws of an infeasible row before it is an error.
MOST_DRAWS = 64
#: Plans that a refresh looks at.
MOST_PLANS = 24


def normalised(rows: DataFrame, given: list[str], weight: str, out: str = "probability") -> DataFrame:
    """Weights as probabilities inside each group: negative and null ones count 0, a group without weight is uniform."""
    w = Window.partitionBy(*given)
    kept = rows.withColumn("__w", F.greatest(F.coalesce(F.col(weight), F.lit(0)), F.lit(0)).cast("double"))
    total, many = F.sum("__w").over(w), F.count("*").over(w)
    return kept.withColumn(out, F.when(total > 0, F.col("__w") / total).otherwise(F.lit(1.0) / many)).drop("__w")


def implied_count(total: Column, percent: Column) -> Column:
    """The count that a percentage stands for, halves to even."""
    return F.bround(total * percent / 100, 0).cast("long")


def flipped(rows: DataFrame, category: str, size: str, percent: str, field: str) -> DataFrame:
    """P(category | field) from percentages within categories of known size."""
    mass = F.col(size) * F.col(percent)
    return rows.withColumn("probability", mass / F.sum(mass).over(Window.partitionBy(field)))


def chained(first: DataFrame, second: DataFrame, on: list[str]) -> DataFrame:
    """P(a, b) as P(a) P(b | a); both have a column probability."""
    joined = first.withColumnRenamed("probability", "__p").join(second.withColumnRenamed("probability", "__q"), on)
    return joined.withColumn("probability", F.col("__p") * F.col("__q")).drop("__p", "__q")


def binary_share(first: Column, second: Column, rule: str) -> Column:
    """The share of "true" of a two-way variable: that of its first category, or of the first two, kept within 0 and 1."""
    share = {"first_only": first, "sum_first_two": first + second}[rule]
    return F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0))


def composite(*parts: str) -> Column:
    """The key of several columns; a null part is an empty one."""
    return F.concat_ws("|", *(F.coalesce(F.col(p).cast("string"), F.lit("")) for p in parts))


def parsed_spec(spec: list[dict]) -> list[dict]:
    """Checked stages in the order of their parents: name, table (of name, key, probability) and parents."""
    for s in spec:
        if not {"name", "table"} <= set(s):
            raise ValueError(f"a stage needs a name and a table: {sorted(s)}")
    return spec


def sampled(rows: DataFrame, row_id: str, spec: list[dict], seed: int) -> DataFrame:
    """Draws the columns of a specification one after another: each from the distribution of its parents' composite key.

    A stage is {name, table, parents}; its table has the columns key (of the parents, see ``composite``), the name, and
    probability. Parents may be columns of ``rows`` or other stages; unknown parents and cycles are errors."""
    by_name = {s["name"]: s for s in parsed_spec(spec)}
    for layer in ordered([Spec(s["name"], tuple(s.get("parents", ()))) for s in spec], tuple(rows.columns)):
        for stage in layer:
            s = by_name[stage.name]
            keyed = rows.withColumn("key", composite(*s["parents"]) if s.get("parents") else F.lit(""))
            rows = draw(keyed, s["table"], ["key"], stage.name, row_id, seed, stage.name, stage.name).drop("key")
    return rows


def feasible_ages(age_lo: Column, age_hi: Column, career_lo: Column, start: Column) -> tuple[Column, Column, Column]:
    """(lo, hi, whether any) of the ages in a band at which a career that began at ``start`` or later can have lasted ``career_lo`` years."""
    lo = F.greatest(age_lo, career_lo + start)
    return lo, age_hi, lo <= age_hi


def drawn_within(lo: Column, hi: Column, u: Column, what: str) -> Column:
    """An even draw among the whole numbers of an interval; an empty interval is an error, a missing end null."""
    return F.when(lo > hi, F.raise_error(F.format_string(f"no {what} between %d and %d", lo, hi)).cast("int")).otherwise(integer_in(lo, hi, u))


def career_years(lo: Column, hi: Column, most: Column, u: Column) -> Column:
    """Years in a career's band, not more than ``most``; a band that begins beyond is an error."""
    return drawn_within(lo, F.least(hi, F.coalesce(most, hi)), u, "career years")


def truncated_draw(rows: DataFrame, distribution: DataFrame, value: str, weight: str, lo: Column, hi: Column, u: Column, out: str) -> DataFrame:
    """Adds a draw from a distribution inside an interval of each row's own: the inverse of the part of the distribution that lies in it.

    No draw is made twice. An interval without weight is an error. The distribution is a vocabulary and is sent to all tasks as one row."""
    steps = distribution.filter(F.col(weight) > 0).agg(F.sort_array(F.collect_list(F.struct(F.col(value).alias("v"), F.col(weight).cast("double").alias("w")))).alias("__steps"))
    inside = F.filter("__steps", lambda x: (x["v"] >= F.col("__lo")) & (x["v"] <= F.col("__hi")))
    total = F.aggregate(F.col("__in"), F.lit(0.0), lambda t, x: t + x["w"])
    # the first value whose running weight exceeds the drawn share of the whole
    walk = F.aggregate("__in", F.struct(F.lit(0.0).alias("t"), F.lit(None).cast(dict(distribution.dtypes)[value]).alias("v")), lambda s, x: F.struct((s["t"] + x["w"]).alias("t"), F.when(s["v"].isNull() & (s["t"] + x["w"] > F.col("__u") * F.col("__total")), x["v"]).otherwise(s["v"]).alias("v")))["v"]
    held = rows.withColumns({"__lo": lo, "__hi": hi, "__u": u}).crossJoin(F.broadcast(steps)).withColumn("__in", inside).withColumn("__total", total)
    found = F.when(F.col("__total") > 0, walk).otherwise(F.raise_error(F.lit("no weight inside the interval")).cast(dict(distribution.dtypes)[value]))
    return held.withColumn(out, found).drop("__lo", "__hi", "__u", "__steps", "__in", "__total")


def first_feasible(candidate, feasible, most: int = MOST_DRAWS, early: int = 4) -> Column:
    """The first feasible one of ``most`` redrawn candidates (structs of the attempt's number); none is an error.

    ``early`` attempts are made first and the others only where they all fail."""
    def among(lo: int, hi: int) -> Column:
        return F.get(F.filter(F.transform(F.sequence(F.lit(lo), F.lit(hi)), candidate), feasible), F.lit(0))

    found = F.coalesce(among(0, early - 1), among(early, most - 1))
    return F.when(found.isNotNull(), found).otherwise(F.raise_error(F.lit(f"no feasible row in {most} draws")))


def cheapest(rows: DataFrame, given: list[str], blocked: Column, blocked_family: Column, used_family: Column, then: list[Column], keep: list[str]) -> DataFrame:
    """The least penalised candidate of each group: 100 for a blocked item, 100 for a blocked family, 10 for a used one; then the given order."""
    penalty = 100 * blocked.cast("int") + 100 * blocked_family.cast("int") + 10 * used_family.cast("int")
    best = rows.withColumn("penalty", penalty).groupBy(*given).agg(F.min_by(F.struct("penalty", *keep), F.struct("penalty", *then)).alias("best"))
    return best.select(*given, "best.*")


def conditional_facts(rows: DataFrame, row_id: str, facts: dict[str, list[tuple[Column | None, list[str]]]], seed: int) -> DataFrame:
    """Adds a column a fact: an even choice among the options of the first case that holds (None: the rest).

    Later facts may ask for earlier ones. A fact without a case that holds is null."""
    for name, cases in facts.items():
        u = uniform(seed, F.col(row_id), name)
        rows = rows.withColumn(name, F.coalesce(*(F.when(F.lit(True) if when is None else when, pick(options, u)) for when, options in cases)))
    return rows


def set_key(items: Column) -> Column:
    """One key for all orders of the same items."""
    return F.array_join(F.array_sort(F.array_distinct(items)), "\x1f")


def refreshed_plans(rows: DataFrame, row_id: str, pools: dict[str, list[tuple[str, str]]], seen: DataFrame, counts: DataFrame, seed: int, most: int = MOST_PLANS) -> DataFrame:
    """row_id, attempt, items, families, family_seen, exact_seen: the best of ``most`` plans, one (item, family) of each pool.

    The first plan whose set of items and set of families are both new is taken. Else sets of families count first,
    then sets of items, then how often the items were used (plus a draw below 1). ``seen`` holds the arrays items and families
    of earlier plans and meets the candidates in joins by the sets' keys; ``counts`` (item, n) is cut to the pools' items before it is sent to all tasks."""
    item = lambda i: [F.element_at(F.array(*(F.struct(F.lit(a).alias("item"), F.lit(b).alias("family")) for a, b in pool)), (F.floor(uniform_at(seed, F.col(row_id), name, i) * len(pool)) + 1).cast("int")) for name, pool in pools.items()]
    used = counts.filter(F.col("item").isin([a for pool in pools.values() for a, _ in pool])).groupBy("item").agg(F.sum("n").alias("n")).agg(F.map_from_entries(F.collect_list(F.struct("item", "n"))).alias("used"))
    tried = rows.select(row_id, F.explode(F.sequence(F.lit(0), F.lit(most - 1))).alias("attempt")).withColumn("x", F.array(*item(F.col("attempt"))))
    plans = tried.select(row_id, "attempt", F.col("x.item").alias("items"), F.col("x.family").alias("families")).withColumn("i", set_key(F.col("items"))).withColumn("f", set_key(F.col("families")))
    for key, sets, flag in (("i", "items", "exact_seen"), ("f", "families", "family_seen")):
        known = seen.select(set_key(F.col(sets)).alias(key)).distinct().withColumn(flag, F.lit(1))
        plans = plans.join(known, key, "left").fillna(0, [flag])
    pressure = F.aggregate("items", F.lit(0).cast("long"), lambda t, x: t + F.coalesce(F.try_element_at("used", x), F.lit(0)))
    cost = F.when((F.col("family_seen") == 0) & (F.col("exact_seen") == 0), F.col("attempt").cast("double")).otherwise(pressure + uniform_at(seed, F.col(row_id), "tie", F.col("attempt")))
    ranked = plans.crossJoin(F.broadcast(used)).withColumn("cost", cost)
    kept = ["attempt", "items", "families", "family_seen", "exact_seen"]
    best = ranked.groupBy(row_id).agg(F.min_by(F.struct(*kept), F.struct("family_seen", "exact_seen", "cost", "attempt")).alias("best"))
    return best.select(row_id, "best.*")


def in_top(labels: list[str], probabilities: list[str], truth: Column, k: int) -> Column:
    """Whether the true label is among the k likeliest; ties go to the earlier label in the list."""
    ranked = F.array_sort(F.array(*(F.struct((-F.col(p)).alias("minus"), F.lit(i).alias("place"), F.lit(name).alias("label")) for i, (name, p) in enumerate(zip(labels, probabilities)))))
    return F.array_contains(F.transform(F.slice(ranked, 1, k), lambda x: x["label"]), truth)


def shuffle_key(seed: int, row_id: str) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(row_id).cast("string")))


def shuffled(rows: DataFrame, row_id: str, seed: int) -> DataFrame:
    """A global order that depends on the seed and the ids only."""
    return rows.withColumn("shuffle_key", shuffle_key(seed, row_id)).orderBy("shuffle_key", row_id)


def sample_rows(rows: DataFrame, row_id: str, n: int, seed: int) -> DataFrame:
    """n rows with the least keys, in the order of their ids."""
    return rows.withColumn("shuffle_key", shuffle_key(seed, row_id)).orderBy("shuffle_key", row_id).limit(n).drop("shuffle_key").orderBy(row_id)
