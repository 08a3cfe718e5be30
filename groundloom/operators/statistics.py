"""Agreement, rank, goodness-of-fit, threshold and bootstrap statistics as one-pass aggregates where they allow it."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from ..functions import tails
from .ranking import attached, same


def pearson(a: str, b: str) -> Column:
    """Null where either side is constant."""
    x, y = F.col(a).cast("double"), F.col(b).cast("double")
    return F.when((F.min(x) < F.max(x)) & (F.min(y) < F.max(y)), F.corr(x, y))


def quadratic_kappa(a: str, b: str) -> Column:
    """Closed form of the quadratic weighted kappa for integer scores; null if all scores are one value."""
    n, x, y = F.count("*"), F.col(a).cast("double"), F.col(b).cast("double")
    den = F.sum(x * x) + F.sum(y * y) - 2 * F.sum(x) * F.sum(y) / n
    return F.when(den != 0, 1 - F.sum((x - y) * (x - y)) / den)


def agreement(a: str, b: str) -> list[Column]:
    d = F.col(a).cast("double") - F.col(b).cast("double")
    return [F.count("*").alias("n"), pearson(a, b).alias("pearson"), quadratic_kappa(a, b).alias("qwk"), F.avg(F.abs(d)).alias("mae"), F.avg(d).alias("bias"), F.avg((d == 0).cast("double")).alias("exact"), F.avg((F.abs(d) <= 1).cast("double")).alias("within_one")]


def average_ranks(rows: DataFrame, value: str, out: str, given: list[str]) -> DataFrame:
    """Ranks with ties averaged, inside groups. Ties are counted once a value before they are ranked, so only the distinct values of a group are sorted."""
    tally = rows.groupBy(*given, value).agg(F.count("*").alias("__n"))
    below = F.coalesce(F.sum("__n").over(Window.partitionBy(*given).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.join(tally.withColumn(out, below + (F.col("__n") + 1) / 2).drop("__n"), [*given, value])


def chi_square(counts: DataFrame, observed: str, expected_share: str, given: list[str] | None = None, alpha: float = 0.05, small: float = 0.05) -> DataFrame:
    """given, n, cells, chi2, Cramer's V, p_value, passed (p above ``alpha``, or V below ``small``) of a goodness-of-fit test for each group.

    Expected counts are shares of all observed ones; cells without an expected share are left out after that. Without any cell the
    statistic is 0 and the test passed; with one cell there is no degree of freedom and p_value is null."""
    given = given or []
    e = F.col("__n") * F.col(expected_share)
    gap = F.when(F.col(expected_share) > 0, F.try_divide((F.col(observed) - e) * (F.col(observed) - e), e))
    total = counts.groupBy(*given).agg(F.sum(observed).alias("__n"))
    chi = attached(counts, total, given).groupBy(*given).agg(F.max("__n").alias("n"), F.count_if(F.col(expected_share) > 0).alias("cells"), F.coalesce(F.sum(gap), F.lit(0.0)).alias("chi2"))
    told = chi.withColumn("cramers_v", F.sqrt(F.col("chi2") / F.greatest(F.col("n") * (F.col("cells") - 1), F.lit(1))))
    told = told.withColumn("p_value", F.when(F.col("cells") == 0, 1.0).otherwise(tails.chi_square_upper(F.col("chi2"), F.col("cells") - 1)))
    return told.withColumn("passed", F.coalesce(F.col("p_value") > alpha, F.lit(False)) | (F.col("cramers_v") < small))


def marginal_check(rows: DataFrame, column: str, vocabulary: DataFrame, given: list[str] | None = None) -> DataFrame:
    """``chi_square`` of a column's values against a vocabulary (value, share): other values are ignored, absent ones count 0."""
    given = given or []
    groups = rows.select(*given).distinct() if given else rows.select().limit(1)
    grid = groups.crossJoin(F.broadcast(vocabulary.select("value", "share")))  # a vocabulary
    seen = rows.groupBy(*given, F.col(column).alias("value")).agg(F.count("*").alias("__seen"))
    there = seen.withColumnsRenamed({c: f"__{c}" for c in [*given, "value"]})
    met = grid.join(there, same(grid, there, [*given, "value"]), "left")
    return chi_square(met.select(*given, F.coalesce("__seen", F.lit(0)).alias("observed"), "share"), "observed", "share", given)


def running(tally: DataFrame, value: str, columns: list[str], falling: bool = False, parts: int = 64) -> DataFrame:
    """Adds run_<column>: sums of the columns over all rows up to the value (with ``falling``: from the largest down to it).

    Values are dealt to ranges cut at approximate quantiles; a range is summed in itself, and what earlier ranges hold is added.
    So no task sees all values. The rows must have different values."""
    cuts = sorted(set(tally.approxQuantile(value, [i / parts for i in range(1, parts)], 0.005))) if parts > 1 else []
    at = F.size(F.filter(F.array(*(F.lit(float(c)) for c in cuts)).cast("array<double>"), lambda c: c < F.col(value)))
    dealt = tally.withColumn("__range", -at if falling else at)
    earlier = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # at most ``parts`` rows
    held = dealt.groupBy("__range").agg(*(F.sum(c).alias(f"__{c}") for c in columns))
    before = held.select("__range", *(F.coalesce(F.sum(f"__{c}").over(earlier), F.lit(0)).alias(f"__{c}") for c in columns))
    inside = Window.partitionBy("__range").orderBy(F.desc(value) if falling else F.asc(value)).rowsBetween(Window.unboundedPreceding, 0)
    summed = dealt.join(F.broadcast(before), "__range")
    return summed.withColumns({f"run_{c}": F.sum(c).over(inside) + F.col(f"__{c}") for c in columns}).drop("__range", *(f"__{c}" for c in columns))


def ks_distance(rows: DataFrame, value: str, first: Column, second: Column, alpha: float = 0.05, small: float = 0.05) -> DataFrame:
    """d, n_a, n_b, p_value, passed: the largest gap of two empirical distribution functions, over counts of distinct values.

    p by the limit distribution. An empty side passes with d 0 and p 1."""
    tally = rows.groupBy(value).agg(F.sum(first.cast("long")).alias("a"), F.sum(second.cast("long")).alias("b"))
    total = tally.agg(F.coalesce(F.sum("a"), F.lit(0)).alias("na"), F.coalesce(F.sum("b"), F.lit(0)).alias("nb"))
    steps = running(tally, value, ["a", "b"]).crossJoin(F.broadcast(total))
    found = steps.agg(F.max(F.abs(F.try_divide("run_a", "na") - F.try_divide("run_b", "nb"))).alias("d"), F.max("na").alias("n_a"), F.max("nb").alias("n_b"))
    told = found.select(F.coalesce("d", F.lit(0.0)).alias("d"), F.coalesce("n_a", F.lit(0)).alias("n_a"), F.coalesce("n_b", F.lit(0)).alias("n_b"))
    one = (F.col("n_a") == 0) | (F.col("n_b") == 0)
    told = told.withColumn("p_value", F.when(one, 1.0).otherwise(tails.kolmogorov_upper(F.sqrt(F.col("n_a") * F.col("n_b") / (F.col("n_a") + F.col("n_b"))) * F.col("d"))))
    return told.withColumn("passed", (F.col("p_value") > alpha) | (F.col("d") < small))


def signed_ranks(rows: DataFrame, difference: str, given: list[str]) -> DataFrame:
    """given, n, w_plus, w_minus, p_value of a paired signed-rank test: zero differences are left out, equal sizes share their mean rank.

    p by the normal limit with the correction for ties; null where there is no difference. Sizes are counted before they are ranked."""
    x = F.col(difference)
    tally = rows.filter(x != 0).groupBy(*given, F.abs(x).alias("__size")).agg(F.count_if(x > 0).alias("__up"), F.count("*").alias("__n"))
    below = F.coalesce(F.sum("__n").over(Window.partitionBy(*given).orderBy("__size").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = tally.withColumn("__rank", below + (F.col("__n") + 1) / 2)
    n, t = F.col("n"), F.col("__n").cast("double")
    found = ranked.groupBy(*given).agg(F.sum("__n").alias("n"), F.sum(F.col("__up") * F.col("__rank")).alias("w_plus"), F.sum((F.col("__n") - F.col("__up")) * F.col("__rank")).alias("w_minus"), F.sum(t * t * t - t).alias("__ties"))
    variance = n.cast("double") * (n + 1) * (2 * n + 1) / 24 - F.col("__ties") / 48
    z = F.abs(F.least("w_plus", "w_minus") - n.cast("double") * (n + 1) / 4) / F.sqrt(variance)
    return found.withColumn("p_value", F.when(variance > 0, F.least(2 * tails.normal_upper(z), F.lit(1.0)))).drop("__ties")


def ols(y: str, x: str) -> list[Column]:
    """Slope, intercept, standard error and t of a simple regression."""
    a, b = F.col(y).cast("double"), F.col(x).cast("double")
    slope, n = F.regr_slope(a, b), F.regr_count(a, b)
    sse = F.regr_syy(a, b) - slope * F.regr_sxy(a, b)
    se = F.sqrt(F.greatest(sse, F.lit(0.0)) / (n - 2) / F.regr_sxx(a, b))
    return [slope.alias("slope"), F.regr_intercept(a, b).alias("intercept"), se.alias("se"), F.try_divide(slope, se).alias("t")]


def ranked_classes(rows: DataFrame, score: str, label: str) -> DataFrame:
    """auc and average_precision of a score for a 0/1 label; tied scores count as one step."""
    tally = rows.groupBy(score).agg(F.sum(label).alias("p"), F.sum(1 - F.col(label)).alias("q"))
    steps = running(tally, score, ["p", "q"], falling=True).withColumnsRenamed({"run_p": "tp", "run_q": "fp"})
    steps = steps.crossJoin(F.broadcast(tally.agg(F.sum("p").alias("np"), F.sum("q").alias("nq"))))
    pairs = F.col("q") * (F.col("tp") - F.col("p") + F.col("p") / 2)
    return steps.agg((F.sum(pairs) / F.max("np") / F.max("nq")).alias("auc"), (F.sum(F.col("p") * F.col("tp") / (F.col("tp") + F.col("fp"))) / F.max("np")).alias("average_precision"))


def macro_f1(truth: Column, predicted: Column) -> Column:
    """Mean F1 of the classes 0 and 1; a class without rows or hits counts 0."""
    def f1(c: int) -> Column:
        tp = F.sum(((truth == c) & (predicted == c)).cast("long"))
        den = F.sum((truth == c).cast("long")) + F.sum((predicted == c).cast("long"))
        return F.when(den > 0, 2 * tp / den).otherwise(0.0)

    return (f1(0) + f1(1)) / 2


def stratified_bootstrap(rows: DataFrame, stratum: str, order: str, value: str, replicates: int, seed: int) -> DataFrame:
    """(replicate, mean) of resamples with replacement inside strata: slot i of a replicate takes the member that a hash names."""
    w = Window.partitionBy(stratum)
    members = rows.select(stratum, value, (F.row_number().over(w.orderBy(order)) - 1).alias("slot"), F.count("*").over(w).alias("size"))
    slots = members.select(stratum, "slot", "size").crossJoin(F.broadcast(rows.sparkSession.range(replicates).withColumnRenamed("id", "replicate")))
    from ..functions.scalar import uniform

    u = uniform(seed, F.concat_ws("/", F.col("replicate"), F.col(stratum), F.col("slot")), "boot")
    taken = slots.select("replicate", stratum, F.floor(u * F.col("size")).cast("int").alias("slot"))
    return taken.join(members.drop("size"), [stratum, "slot"]).groupBy("replicate").agg(F.avg(value).alias("mean"))


#: Distinct combinations of values that one resampling task holds, and replicates that it draws at a time.
CELLS, DRAWN = 2048, 256


def _seeded(*parts) -> np.random.Generator:
    return np.random.default_rng(list(hashlib.sha256(repr(parts).encode()).digest()))


def _share_of(seed: int, group: str, path: list, part: int, replicates: int) -> np.ndarray:
    """How many of a stratum's draws fall into one of its parts, for each replicate: down a tree of halves, by binomial draws.

    ``path`` holds (level, rows of the node of the part, rows of its sibling) from the root's children down. A node's draws
    depend on its place only, so whoever goes by a node sees the same ones."""
    path = sorted(path, key=lambda x: -x["level"])
    count = np.full(replicates, path[0]["own"] + path[0]["other"])
    for x in path:
        node, whole = part >> x["level"], x["own"] + x["other"]
        if whole:
            left = x["own"] if node % 2 == 0 else x["other"]
            drawn = _seeded(seed, group, x["level"], node >> 1).binomial(count, left / whole)
            count = drawn if node % 2 == 0 else count - drawn
    return count


def _drawn(seed: int, replicates: int, names: list[str], cells: pd.DataFrame, path: pd.DataFrame):
    """For one part of a stratum: its cells in order, and blocks of (first replicate, counts of each cell)."""
    cells = cells.sort_values(names, ignore_index=True)
    group, part = cells["__group"].iloc[0], int(cells["__part"].iloc[0])
    count = _share_of(seed, group, list(path["__path"].iloc[0]), part, replicates)
    n = cells["__n"].to_numpy(np.int64)
    rng = _seeded(seed, group, "part", part)
    return cells, ((lo, rng.multinomial(count[lo : lo + DRAWN], n / n.sum())) for lo in range(0, replicates, DRAWN))


def _cells(rows: DataFrame, given: list[str], stratum: str | None, columns: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(Counts of the distinct combinations of the columns' values in each stratum, dealt to parts of about ``CELLS``; the path of each part).

    Rows with a null or NaN value take no part. A path has a step for each halving of the parts, so it grows with the logarithm of the cells."""
    names = list(columns)
    kept = rows.select(*given, (F.col(stratum) if stratum else F.lit(0)).cast("string").alias("__stratum"), *(F.nanvl(c.cast("double"), F.lit(None)).alias(k) for k, c in columns.items())).dropna(subset=names)
    keys = F.concat_ws("|", *(F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("null")) for c in [*given, "__stratum"]))
    cells = kept.groupBy(*given, "__stratum", *names).agg(F.count("*").alias("__n")).withColumn("__group", keys).drop("__stratum")
    # a power of two of parts, one level at least
    many = cells.groupBy("__group").agg(F.greatest(F.ceil(F.log2(F.count("*") / F.lit(CELLS))), F.lit(1)).cast("int").alias("__depth"))
    dealt = attached(cells, many, ["__group"]).withColumn("__part", F.expr(f"pmod(xxhash64({', '.join(names)}), shiftleft(1L, __depth))"))
    held = dealt.groupBy("__group", "__depth", "__part").agg(F.sum("__n").alias("__sum"))
    steps = held.withColumn("level", F.explode(F.expr("sequence(0, __depth - 1)"))).withColumn("__node", F.expr("shiftright(__part, level)"))
    nodes = steps.groupBy("__group", "level", "__node").agg(F.sum("__sum").alias("own"))
    sibling = nodes.select("__group", "level", F.expr("__node ^ 1L").alias("__node"), F.col("own").alias("other"))
    met = steps.select("__group", "__part", "level", "__node").join(nodes, ["__group", "level", "__node"]).join(sibling, ["__group", "level", "__node"], "left")
    paths = met.groupBy("__group", "__part").agg(F.collect_list(F.struct("level", "own", F.coalesce("other", F.lit(0)).alias("other"))).alias("__path"))
    return dealt.drop("__depth"), paths


def _in_parts(draw, cells: DataFrame, paths: DataFrame, schema: StructType) -> DataFrame:
    other = paths.select(F.col("__group").alias("__g"), F.col("__part").alias("__q"), "__path")
    return cells.groupBy("__group", "__part").cogroup(other.groupBy("__g", "__q")).applyInPandas(draw, schema)


def resampled_sums(rows: DataFrame, given: list[str], stratum: str | None, features: dict[str, Column], replicates: int, seed: int) -> DataFrame:
    """given, replicate, n and the sums of the features over resamples with replacement (inside strata, if there are any).

    Rows of a stratum with equal features are one cell; resampling the rows is a multinomial draw of the cells' counts. A stratum's cells are dealt to
    parts, each replicate's draws are split among the parts down a tree, and a task draws inside its part. So there may be any number
    of cells, and a replicate costs as much as there are cells, whatever the number of rows. Rows with a null or NaN feature take no
    part. A replicate's draws depend on the seed, its number and the cells only."""
    names = list(features)
    schema = StructType([*rows.select(*given).schema.fields, StructField("replicate", LongType()), StructField("n", LongType()), *(StructField(k, DoubleType()) for k in names)])

    def draw(cells: pd.DataFrame, path: pd.DataFrame) -> pd.DataFrame:
        cells, blocks = _drawn(seed, replicates, names, cells, path)
        x, out = cells[names].to_numpy(np.float64), []
        for lo, counts in blocks:
            sums = counts @ x
            out.append(pd.DataFrame({"replicate": np.arange(lo, lo + len(counts)), "n": counts.sum(1), **{k: sums[:, i] for i, k in enumerate(names)}}))
        told = pd.concat(out, ignore_index=True)
        for c in given:
            told[c] = pd.Series([cells[c].iloc[0]] * len(told), dtype=cells[c].dtype)
        return told[schema.names]

    drawn = _in_parts(draw, *_cells(rows, given, stratum, features), schema)
    return drawn.groupBy(*given, "replicate").agg(F.sum("n").alias("n"), *(F.sum(k).alias(k) for k in names))


def resampled_cells(rows: DataFrame, given: list[str], stratum: str | None, columns: dict[str, Column], replicates: int, seed: int) -> DataFrame:
    """given, replicate, the columns and w: how often each combination of values was drawn, over all strata (only those that were)."""
    names = list(columns)
    schema = StructType([*rows.select(*given).schema.fields, StructField("replicate", LongType()), *(StructField(k, DoubleType()) for k in names), StructField("w", LongType())])

    def draw(cells: pd.DataFrame, path: pd.DataFrame) -> pd.DataFrame:
        cells, blocks = _drawn(seed, replicates, names, cells, path)
        out = []
        for lo, counts in blocks:
            at, cell = np.nonzero(counts)
            told = cells[[*given, *names]].iloc[cell].reset_index(drop=True)
            out.append(told.assign(replicate=at + lo, w=counts[at, cell]))
        return pd.concat(out, ignore_index=True)[schema.names]

    drawn = _in_parts(draw, *_cells(rows, given, stratum, columns), schema)
    return drawn.groupBy(*given, "replicate", *names).agg(F.sum("w").alias("w"))


def weighted_spearman(cells: DataFrame, given: list[str], a: str, b: str, weight: str = "w") -> DataFrame:
    """given, spearman: the correlation of mean ranks of rows that ``weight`` counts; null where a side is constant.

    Ranks come from the counts of each side's values, so no row is repeated."""
    met = cells
    for side in (a, b):
        tally = cells.groupBy(*given, side).agg(F.sum(weight).alias("__n"))
        below = F.coalesce(F.sum("__n").over(Window.partitionBy(*given).orderBy(side).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        met = attached(met, tally.withColumn(f"__rank_{side}", below + (F.col("__n") + 1) / 2).drop("__n"), [*given, side])
    w, x, y = F.col(weight), F.col(f"__rank_{a}"), F.col(f"__rank_{b}")
    middle = (F.col("__w") + 1) / 2  # the mean of ranks
    centred = attached(met, cells.groupBy(*given).agg(F.sum(weight).alias("__w")), given).withColumn("__x", x - middle).withColumn("__y", y - middle)
    sums = centred.groupBy(*given).agg(F.sum(w * F.col("__x") * F.col("__y")).alias("__xy"), F.sum(w * F.col("__x") * F.col("__x")).alias("__xx"), F.sum(w * F.col("__y") * F.col("__y")).alias("__yy"))
    spread = (F.col("__xx") > 0) & (F.col("__yy") > 0)
    return sums.select(*given, F.when(spread, F.col("__xy") / F.sqrt(F.col("__xx") * F.col("__yy"))).alias("spearman"))


def pair_sums(a: str, b: str) -> dict[str, Column]:
    """The features whose sums ``agreement_of_sums`` reads."""
    x, y = F.col(a).cast("double"), F.col(b).cast("double")
    return {"x": x, "y": y, "xx": x * x, "yy": y * y, "xy": x * y, "gap": F.abs(x - y), "exact": (x == y).cast("double")}


def agreement_of_sums() -> dict[str, Column]:
    """Agreement of two scores from the sums of ``pair_sums`` and n; null where it isn't defined."""
    c = F.col
    vx, vy, cov = c("xx") - c("x") * c("x") / c("n"), c("yy") - c("y") * c("y") / c("n"), c("xy") - c("x") * c("y") / c("n")
    den = c("xx") + c("yy") - 2 * c("x") * c("y") / c("n")
    # sums of small integers: what is not 0 is at least 1 / n
    spread = F.least(vx, vy) > 0.5 / c("n")
    return {"pearson": F.when(spread, cov / F.sqrt(vx * vy)), "qwk": F.when(den > 0.5 / c("n"), 1 - (c("xx") + c("yy") - 2 * c("xy")) / den), "mae": c("gap") / c("n"), "exact_share": c("exact") / c("n")}


def intervals(replicated: DataFrame, given: list[str], measures: dict[str, Column], share: float = 0.95) -> DataFrame:
    """given, measure, lower, upper, replicates: percentile intervals; replicates without a value are left out."""
    tail = (1 - share) / 2
    long = replicated.select(*given, F.explode(F.array(*(F.struct(F.lit(k).alias("measure"), c.alias("v")) for k, c in measures.items()))).alias("m")).select(*given, "m.*")
    return long.groupBy(*given, "measure").agg(F.percentile("v", tail).alias("lower"), F.percentile("v", 1 - tail).alias("upper"), F.count("v").alias("replicates"))


def pairwise_cosine_moments(vectors: DataFrame, vector: str) -> DataFrame:
    """n, mean and population standard deviation of the cosine over all pairs i < j, without listing pairs.

    With unit rows x_i: sum of x_i.x_j is |sum x|^2, and of (x_i.x_j)^2 the squared Frobenius norm of sum x x^T. A
    task adds up its batches and hands on one matrix. Null and zero vectors take no part; the others have one length."""

    def gram(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count, total, products = 0, None, None
        for batch in batches:
            x = np.array([v for v in batch[vector] if v is not None and len(v)], np.float64)
            if len(x):
                norm = np.linalg.norm(x, axis=1)
                x = x[norm > 0] / norm[norm > 0, None]
                count += len(x)
                total = x.sum(0) + (0 if total is None else total)
                products = x.T @ x + (0 if products is None else products)
        if count:
            yield pd.DataFrame({"n": [count], "s": [total], "g": [products.ravel()]})

    parts = vectors.select(F.col(vector).cast("array<double>").alias(vector)).mapInPandas(gram, "n long, s array<double>, g array<double>")
    squared = lambda c: parts.select(F.posexplode(c).alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v")).agg(F.sum(F.col("v") * F.col("v")).alias(c))
    joined = parts.agg(F.sum("n").alias("n")).crossJoin(squared("s")).crossJoin(squared("g"))  # one row each
    pairs = F.col("n") * (F.col("n") - 1)
    mean = (F.col("s") - F.col("n")) / pairs
    return joined.select("n", mean.alias("mean"), F.sqrt(F.greatest((F.col("g") - F.col("n")) / pairs - mean * mean, F.lit(0.0))).alias("sd"))
