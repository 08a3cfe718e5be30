"""Distributions from counts, iterative proportional fitting, and reproducible categorical draws."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import uniform
from .ranking import BROADCAST_ROWS

#: What a zero seed counts (fixed value), and parts of the unit interval for distributions that aren't broadcast.
LEAST_SEED, PARTS = 1e-12, 64


def conditional_share(rows: DataFrame, given: list[str], keys: list[str], weight: Column | None = None) -> DataFrame:
    """P(keys | given) as long rows: given, keys, n, probability. Groups without weight are dropped."""
    counted = rows.groupBy(*given, *keys).agg((F.sum(weight) if weight is not None else F.count("*")).alias("n"))
    total = F.sum("n").over(Window.partitionBy(*given)) if given else None
    if total is None:  # one small aggregate instead of a window without keys
        counted = counted.crossJoin(F.broadcast(counted.agg(F.sum("n").alias("total"))))
    else:
        counted = counted.withColumn("total", total)
    return counted.filter("total > 0").withColumn("probability", F.col("n") / F.col("total")).drop("total")


def full_grid(counted: DataFrame, keys: list[str], value: str = "n") -> DataFrame:
    """Every combination of the keys' values, absent ones with 0. The values must be few: they are vocabularies."""
    grid = counted.select(keys[0]).distinct()
    for k in keys[1:]:
        grid = grid.crossJoin(F.broadcast(counted.select(k).distinct()))
    return grid.join(counted, keys, "left").withColumn(value, F.coalesce(value, F.lit(0)))


def marginal_gap(observed: DataFrame, expected: DataFrame, keys: list[str]) -> DataFrame:
    """Full outer join of two probability tables: keys, p, q, abs_diff, rel_diff (null where q is 0)."""
    joined = observed.select(*keys, F.col("probability").alias("p")).join(expected.select(*keys, F.col("probability").alias("q")), keys, "full")
    joined = joined.select(*keys, F.coalesce("p", F.lit(0.0)).alias("p"), F.coalesce("q", F.lit(0.0)).alias("q"))
    return joined.withColumn("abs_diff", F.abs(F.col("p") - F.col("q"))).withColumn("rel_diff", F.when(F.col("q") > 0, F.col("abs_diff") / F.col("q")))


def ipf_sweeps(seed: DataFrame, group: list[str], row: str, column: str, value: str, row_target: str, column_target: str, sweeps: int) -> DataFrame:
    """Two-way proportional fitting inside each group: ``sweeps`` times rows to their targets, then columns. Zero seeds count as 1e-12.

    A sweep is two window sums, so a matrix may be as large as a group of rows may be."""
    out = seed.withColumn(value, F.greatest(F.col(value).cast("double"), F.lit(1e-12)))
    for _ in range(sweeps):
        for axis, target in ((row, row_target), (column, column_target)):
            out = out.withColumn(value, F.col(value) * F.col(target) / F.sum(value).over(Window.partitionBy(*group, axis)))
    return out


def fit_matrix(seed, row_target, column_target, most: int = 200, close: float = 1e-10):
    """Proportional fitting of one numpy matrix until both marginals agree: (matrix, sweeps, largest relative error, converged)."""
    import numpy as np

    m, r, c = np.maximum(np.asarray(seed, float), 1e-12), np.asarray(row_target, float), np.asarray(column_target, float)
    error = float("inf")
    for sweep in range(1, most + 1):
        s = m.sum(1)
        m = m * np.divide(r, s, out=np.zeros_like(r), where=s > 0)[:, None]
        s = m.sum(0)
        m = m * np.divide(c, s, out=np.zeros_like(c), where=s > 0)[None, :]
        gap = lambda a, b: float(np.max(np.abs(a - b) / np.maximum(np.abs(b), 1e-12)))
        error = max(gap(m.sum(1), r), gap(m.sum(0), c))
        if error < close:
            return m, sweep, error, True
    return m, most, error, False


def fit_axes(cells: DataFrame, axes: list[str], value: str, targets: dict[str, DataFrame], most: int = 100, close: float = 1e-8, sweeps: int | None = None, strict: bool = False) -> tuple[DataFrame, int, float, bool]:
    """Proportional fitting of a table of cells in any number of dimensions: (the cells with ``fitted``, sweeps, largest error, converged).

    ``targets`` has a table (axis, target) for each axis. The cells stay where they are: what changes is one factor for each value of an axis, and a cell is its seed times its
    factors. An update is one sum over the cells; after each sweep the sums of all axes are tested in one pass (grouping sets). The
    axes' values are vocabularies: more than ``BROADCAST_ROWS`` are an error. With ``sweeps`` exactly so many are made; with ``strict`` not to converge is an error.
    Zero and null seeds count as ``LEAST_SEED``. A value without a target gets the factor 0. The cells are read again and again, so they should be a written table."""
    spark = cells.sparkSession
    kept = cells.select(*axes, F.greatest(F.coalesce(F.col(value).cast("double"), F.lit(0.0)), F.lit(LEAST_SEED)).alias("__seed"))
    schema = {a: kept.select(a).schema.fields[0].dataType.simpleString() for a in axes}
    wanted = {a: {r[a]: float(r["target"]) for r in targets[a].select(a, "target").limit(BROADCAST_ROWS + 1).collect()} for a in axes}
    if too := [a for a in axes if len(wanted[a]) > BROADCAST_ROWS]:
        raise ValueError(f"more than {BROADCAST_ROWS} values of {too}")
    factors: dict[str, dict] = {a: {} for a in axes}

    def with_factors(without: str | None = None) -> DataFrame:
        rows, weight = kept, F.col("__seed")
        for a in axes:
            if a != without and factors[a]:
                there = F.broadcast(spark.createDataFrame(list(factors[a].items()), f"__k {schema[a]}, __f_{a} double"))
                rows = rows.join(there, rows[a].eqNullSafe(there["__k"]), "left").drop("__k")
                weight = weight * F.coalesce(F.col(f"__f_{a}"), F.lit(0.0))
        return rows.withColumn("__w", weight)

    error, done, made = float("inf"), False, 0
    for made in range(1, (sweeps or most) + 1):
        for a in axes:
            sums = {r[a]: r["s"] for r in with_factors(a).groupBy(a).agg(F.sum("__w").alias("s")).collect()}
            factors[a] = {k: wanted[a].get(k, 0.0) / s if s > 0 else 0.0 for k, s in sums.items()}
        told = with_factors().groupingSets([[F.col(a)] for a in axes], *axes).agg(F.grouping_id(*axes).alias("g"), F.sum("__w").alias("s")).collect()
        whole = (1 << len(axes)) - 1
        error = max((abs(r["s"] - wanted[a].get(r[a], 0.0)) for r in told for i, a in enumerate(axes) if r["g"] == whole ^ (1 << (len(axes) - 1 - i))), default=0.0)
        done = error < close
        if done and sweeps is None:
            break
    if strict and not done:
        raise ValueError(f"no convergence in {made} sweeps: error {error}")
    fitted = with_factors()
    return fitted.select(*axes, F.col("__w").alias("fitted")), made, error, done


def cumulative(distribution: DataFrame, given: list[str], key: str) -> DataFrame:
    """Adds lo and hi: the part of [0, 1) that stands for each key, in key order. The last part reaches 1."""
    w = Window.partitionBy(*given).orderBy(key)
    upto = F.sum("probability").over(w.rowsBetween(Window.unboundedPreceding, 0))
    last = F.row_number().over(Window.partitionBy(*given).orderBy(F.desc(key))) == 1
    return distribution.withColumn("lo", upto - F.col("probability")).withColumn("hi", F.when(last, F.lit(1.0)).otherwise(upto))


def draw(rows: DataFrame, distribution: DataFrame, given: list[str], key: str, row_id: str, seed: int, stage: str, out: str) -> DataFrame:
    """A categorical draw for each row from its parents' distribution; rows whose parents have none raise an error."""
    cdf = cumulative(distribution, given, key).select(*(F.col(g).alias(f"__{g}") for g in given), F.col(key).alias(out), "lo", "hi")
    u = rows.withColumn("__u", uniform(seed, F.col(row_id), stage))
    match = (F.col("__u") >= F.col("lo")) & (F.col("__u") < F.col("hi"))
    for g in given:
        match = match & (F.col(g) == F.col(f"__{g}"))
    if cdf.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        cdf = F.broadcast(cdf)
    else:
        # too many to send to all tasks: parts of the unit interval are a key of the join, so that rows of common parents spread
        cdf = cdf.withColumn("__part", F.explode(F.sequence(F.floor(F.col("lo") * PARTS), F.least(F.floor(F.col("hi") * PARTS), F.lit(PARTS - 1)))))
        u = u.withColumn("__of", F.floor(F.col("__u") * PARTS))
        match = match & (F.col("__of") == F.col("__part"))
    drawn = u.join(cdf, match, "left")
    checked = F.when(F.col(out).isNull(), F.raise_error(F.lit(f"no distribution for {stage}")).cast("string")).otherwise(F.col(out))
    return drawn.withColumn(out, checked).drop("__u", "lo", "hi", "__part", "__of", *(f"__{g}" for g in given))


def total_variation(pairs: DataFrame, given: list[str]) -> DataFrame:
    """Half the summed absolute difference of p and q, with the largest and the mean cell difference."""
    d = F.abs(F.col("p") - F.col("q"))
    return pairs.groupBy(*given).agg((F.sum(d) / 2).alias("tv"), F.max(d).alias("max_diff"), F.avg(d).alias("mean_diff"))
