import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from groundloom.functions.scalar import uniform
from groundloom.operators import grounding as g
from groundloom.operators import sampling as sm


@settings(max_examples=30, deadline=None)
@given(st.integers(2, 5), st.integers(2, 5), st.integers(0, 1000))
def test_matrix_reaches_both_marginals(rows, columns, seed):
    rng = np.random.default_rng(seed)
    target = rng.uniform(0.1, 1, (rows, columns))
    m, _, error, ok = g.fit_matrix(rng.uniform(0.1, 1, (rows, columns)), target.sum(1), target.sum(0))
    assert ok and error < 1e-10
    assert np.allclose(m.sum(1), target.sum(1)) and np.allclose(m.sum(0), target.sum(0))


def plain_fit(seed, targets, sweeps):
    m = np.maximum(seed, 1e-12)
    for _ in range(sweeps):
        for k, t in enumerate(targets):
            sums = m.sum(axis=tuple(j for j in range(m.ndim) if j != k))
            m = m * (t / sums).reshape([-1 if j == k else 1 for j in range(m.ndim)])
    return m


@pytest.fixture(scope="module")
def three_axes(spark):
    rng = np.random.default_rng(1)
    seed, target = rng.uniform(0, 1, (3, 4, 5)), rng.uniform(0.1, 1, (3, 4, 5))
    seed[0, 0, 0] = 0
    names = [None, "a", "b"]
    cells = spark.createDataFrame([(names[i], j, k, float(seed[i, j, k]) or None) for i, j, k in np.ndindex(3, 4, 5)], "x string, y int, z long, v double")
    sums = [target.sum((1, 2)), target.sum((0, 2)), target.sum((0, 1))]
    frames = {"x": spark.createDataFrame(list(zip(names, sums[0].tolist())), "x string, target double"), "y": spark.createDataFrame(list(enumerate(sums[1].tolist())), "y int, target double"), "z": spark.createDataFrame(list(enumerate(sums[2].tolist())), "z long, target double")}
    return seed, sums, names, cells, frames


def test_axes_are_fitted_like_an_array(three_axes):
    seed, sums, names, cells, frames = three_axes
    fitted, sweeps, error, done = g.fit_axes(cells, ["x", "y", "z"], "v", frames)
    assert done and error < 1e-8
    want = plain_fit(seed, sums, sweeps)
    got = {(r.x, r.y, r.z): r.fitted for r in fitted.collect()}
    assert len(got) == 60 and all(abs(got[names[i], j, k] - want[i, j, k]) < 1e-12 for i, j, k in np.ndindex(3, 4, 5))


def test_no_convergence_is_an_error_where_asked(three_axes):
    _, _, _, cells, frames = three_axes
    _, sweeps, error, done = g.fit_axes(cells, ["x", "y", "z"], "v", frames, sweeps=1)
    assert sweeps == 1 and not done and error > 1e-8
    with pytest.raises(ValueError, match="no convergence"):
        g.fit_axes(cells, ["x", "y", "z"], "v", frames, most=1, strict=True)


def test_draws_joined_by_parts_equal_broadcast_ones(spark, monkeypatch):
    shares = spark.createDataFrame([(p, f"k{k}", w) for p in "ab" for k, w in enumerate([0.1, 0.0, 0.55, 0.35])], "p string, k string, probability double")
    rows = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(400)], "id long, p string")
    draw = lambda: sorted((r.id, r.k) for r in g.draw(rows, shares, ["p"], "k", "id", 1, "k", "k").collect())
    first = draw()
    monkeypatch.setattr(g, "BROADCAST_ROWS", 3)
    assert draw() == first and len(first) == 400 and {k for _, k in first} == {"k0", "k2", "k3"}


def test_feasible_intervals_and_truncated_draws(spark):
    rows = spark.createDataFrame([(i, i % 7, i % 7 + 3) for i in range(300)], "id long, lo int, hi int")
    shares = spark.createDataFrame([(v, float(v % 4)) for v in range(12)], "v int, w double")
    got = sm.truncated_draw(rows, shares, "v", "w", F.col("lo"), F.col("hi"), uniform(1, F.col("id"), "u"), "x").collect()
    assert all(r.lo <= r.x <= r.hi and r.x % 4 for r in got)
    low = [r.x for r in got if r.lo == 0]
    assert abs(sum(x == 3 for x in low) / len(low) - 0.5) < 0.25 and set(low) == {1, 2, 3}
    with pytest.raises(Exception, match="no weight"):
        sm.truncated_draw(rows, shares, "v", "w", F.lit(4), F.lit(4), F.lit(0.5), "x").collect()
    lo, hi, some = sm.feasible_ages(F.col("a"), F.col("b"), F.col("c"), F.lit(15))
    bands = spark.createDataFrame([(20, 29, 0), (20, 29, 10), (20, 29, 20)], "a int, b int, c int")
    assert [tuple(r) for r in bands.select(lo.alias("lo"), hi.alias("hi"), some.alias("some")).collect()] == [(20, 29, True), (25, 29, True), (35, 29, False)]
    with pytest.raises(Exception, match="no age between 35 and 29"):
        bands.select(sm.drawn_within(lo, hi, F.lit(0.5), "age")).collect()
    years = bands.select(sm.career_years(F.col("c"), F.col("c") + 9, F.lit(22), F.lit(0.999)).alias("y")).collect()
    assert [r.y for r in years] == [9, 19, 22]
    with pytest.raises(Exception, match="no career years"):
        bands.select(sm.career_years(F.col("c"), F.col("c") + 9, F.lit(12), F.lit(0.5))).collect()
