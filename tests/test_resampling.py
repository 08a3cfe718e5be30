import numpy as np
import pytest
from pyspark.sql import functions as F

from groundloom.operators import sampling as sm
from groundloom.operators import statistics as st
from groundloom.operators import tasks


@pytest.fixture(scope="module")
def scored(spark):
    rng = np.random.default_rng(3)
    human = rng.integers(1, 6, 300)
    score = np.clip(human + rng.integers(-1, 2, 300), 1, 5)
    year = rng.integers(0, 3, 300)
    return human, score, year, spark.createDataFrame(list(zip(year.tolist(), human.tolist(), score.tolist())), "yr long, human long, score long")


def test_cells_resample_like_rows(scored):
    human, score, year, df = scored
    got = st.intervals(st.resampled_sums(df, [], "yr", st.pair_sums("human", "score"), 2000, 1), [], st.agreement_of_sums()).toPandas().set_index("measure")
    rng, parts = np.random.default_rng(9), [np.flatnonzero(year == y) for y in range(3)]
    plain = {"pearson": [], "mae": [], "qwk": [], "exact_share": []}
    for _ in range(2000):
        i = np.concatenate([rng.choice(p, len(p)) for p in parts])
        x, y = human[i].astype(float), score[i].astype(float)
        plain["pearson"].append(np.corrcoef(x, y)[0, 1])
        plain["mae"].append(np.abs(x - y).mean())
        plain["exact_share"].append((x == y).mean())
        plain["qwk"].append(1 - ((x - y) ** 2).sum() / ((x[:, None] - y[None, :]) ** 2).sum() * len(x))
    assert (got["replicates"] == 2000).all()
    for k, v in plain.items():
        lo, hi = np.percentile(v, [2.5, 97.5])
        assert abs(got.loc[k, "lower"] - lo) < 0.15 * (hi - lo) and abs(got.loc[k, "upper"] - hi) < 0.15 * (hi - lo)


def test_draws_do_not_depend_on_the_partitions(scored):
    df = scored[3]
    a, b = (sorted(map(tuple, st.resampled_sums(x, ["yr"], None, {"v": F.col("score")}, 20, 7).collect())) for x in (df.repartition(1), df.repartition(7)))
    assert a == b and len(a) == 60


def test_missing_values_and_empty_rows(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("a", float("nan")), (None, 2.0)], "g string, v double")
    got = st.resampled_sums(df, [], "g", {"v": F.col("v")}, 5, 1).collect()
    assert [(x.n, x.v) for x in got] == [(2, 3.0)] * 5, got
    assert st.resampled_sums(df.limit(0), [], None, {"v": F.col("v")}, 5, 1).count() == 0


def test_any_number_of_cells(spark, monkeypatch):
    monkeypatch.setattr(st, "CELLS", 10)
    rows = spark.createDataFrame([(i % 3, float(i), float(i * i % 97)) for i in range(500)], "g long, v double, y double")
    sums = st.resampled_sums(rows, [], "g", {"v": F.col("v"), "one": F.lit(1.0)}, 400, 1).toPandas()
    assert (sums["n"] == 500).all() and (sums["one"] == 500).all() and sorted(sums["replicate"]) == list(range(400))
    plain = np.random.default_rng(1)
    strata = [np.arange(g, 500, 3) for g in range(3)]
    want = [sum(plain.choice(x, len(x)).sum() for x in strata) for _ in range(4000)]
    assert abs(sums["v"].mean() - np.mean(want)) < 4 * np.std(want) / 20 and 0.85 < sums["v"].std() / np.std(want) < 1.15
    cells = st.resampled_cells(rows, ["g"], None, {"v": F.col("v"), "y": F.col("y")}, 30, 1).toPandas()
    assert (cells.groupby(["g", "replicate"])["w"].sum().unstack().T == [167, 167, 166]).all().all()
    # first replicates don't depend on how many there are
    again = st.resampled_sums(rows, [], "g", {"v": F.col("v"), "one": F.lit(1.0)}, 30, 1).toPandas().sort_values("replicate")
    assert (again["v"].to_numpy() == sums.sort_values("replicate")["v"].to_numpy()[:30]).all()


def test_rank_correlation_of_counted_cells(spark):
    rng = np.random.default_rng(2)
    x, y, w, g = rng.integers(0, 6, 80), rng.integers(0, 9, 80), rng.integers(1, 5, 80), rng.integers(0, 2, 80)
    frame = spark.createDataFrame(list(zip(g.tolist(), x.tolist(), y.tolist(), w.tolist())) + [(7, 1, 1, 3), (None, 1, 2, 1), (None, 2, 1, 1)], "g long, x long, y long, w long")
    got = {r.g: r.spearman for r in st.weighted_spearman(frame, ["g"], "x", "y").collect()}

    def ranks(v):
        order = np.sort(v)
        return (np.searchsorted(order, v) + np.searchsorted(order, v, "right") + 1) / 2

    for k in (0, 1):
        a, b = np.repeat(x[g == k], w[g == k]), np.repeat(y[g == k], w[g == k])
        assert abs(got[k] - np.corrcoef(ranks(a), ranks(b))[0, 1]) < 1e-12
    assert got[7] is None and got[None] == -1


def test_tails(spark):
    import math

    from groundloom.functions import tails

    def gamma_upper(a, x):
        return 1 - sum(math.exp(a * math.log(x) - x + n * math.log(x) - math.lgamma(a + n + 1)) for n in range(2000))

    z = [-4.0, -1.5, 0.0, 0.3, 1.96, 2.999, 3.0, 5.5, 9.0]
    got = spark.createDataFrame([(v,) for v in z], "z double").select("z", tails.normal_upper(F.col("z")).alias("p")).collect()
    assert all(abs(r.p - math.erfc(r.z / math.sqrt(2)) / 2) <= 1e-9 * math.erfc(r.z / math.sqrt(2)) for r in got)
    cases = [(x, k) for x in (0.01, 0.8, 3.84, 18.3, 60.0, 900.0) for k in (1, 2, 3, 4, 7, 10, 51, 1000)]
    got = spark.createDataFrame(cases, "x double, k int").select("x", "k", tails.chi_square_upper(F.col("x"), F.col("k")).alias("p")).collect()
    assert all(abs(r.p - gamma_upper(r.k / 2, r.x / 2)) < 1e-9 for r in got)
    got = spark.createDataFrame([(0.0, 3), (5.0, 0), (-1.0, 2)], "x double, k int").select(tails.chi_square_upper(F.col("x"), F.col("k")).alias("p")).collect()
    assert [r.p for r in got] == [1.0, None, 1.0]
    # percentage points of the Kolmogorov distribution
    points = {0.0: 1.0, 0.2: 1.0, 0.8276: 0.5, 1.2238: 0.1, 1.3581: 0.05, 1.6276: 0.01}
    got = spark.createDataFrame([(v,) for v in points], "x double").select("x", tails.kolmogorov_upper(F.col("x")).alias("p")).collect()
    assert all(abs(r.p - points[r.x]) < 5e-5 for r in got)


def test_tests_of_distributions(spark):
    counts = spark.createDataFrame([("a", 48, 0.5), ("a", 52, 0.5), ("a", 3, 0.0), ("b", 10, 0.9), ("b", 90, 0.1), ("c", 5, 0.0), ("d", 7, 1.0)], "g string, o long, e double")
    got = {r.g: r for r in st.chi_square(counts, "o", "e", ["g"]).collect()}
    assert (got["a"].n, got["a"].cells, got["a"].passed) == (103, 2, True) and abs(got["a"].chi2 - (3.5**2 + 0.5**2) / 51.5) < 1e-12
    assert not got["b"].passed and got["b"].p_value < 1e-9
    assert (got["c"].chi2, got["c"].p_value, got["c"].passed) == (0, 1, True) and got["d"].p_value is None and got["d"].passed
    rows = spark.createDataFrame([("x", "u")] * 30 + [("x", "v")] * 34 + [("x", "other")] * 9 + [("y", "other")], "g string, v string")
    words = spark.createDataFrame([("u", 0.45), ("v", 0.45), ("w", 0.1)], "value string, share double")
    got = {r.g: r for r in st.marginal_check(rows, "v", words, ["g"]).collect()}
    assert (got["x"].n, got["x"].cells) == (64, 3) and abs(got["x"].chi2 - (1.2**2 / 28.8 + 5.2**2 / 28.8 + 6.4)) < 1e-9 and got["y"].n == 0
    sides = spark.createDataFrame([(float(i), i % 2) for i in range(200)], "v double, s int")
    near = st.ks_distance(sides, "v", F.col("s") == 0, F.col("s") == 1).first()
    assert near.passed and near.p_value > 0.99
    far = st.ks_distance(sides, "v", F.col("v") < 60, F.col("v") >= 60).first()
    assert not far.passed and far.d == 1 and far.p_value < 1e-12
    empty = st.ks_distance(sides, "v", F.col("s") == 0, F.col("s") == 5).first()
    assert (empty.d, empty.p_value, empty.passed, empty.n_b) == (0, 1, True, 0)
    paired = spark.createDataFrame([("a", d) for d in (1, 1, -1, 2, 3, 0, 4, -2, 5, 6)] + [("z", 0)], "g string, d long")
    got = st.signed_ranks(paired, "d", ["g"]).collect()
    # sizes 1 1 1 2 2 3 4 5 6: mean ranks 2, 4.5, 6, 7, 8, 9
    assert [(r.g, r.n, r.w_plus, r.w_minus) for r in got] == [("a", 9, 38.5, 6.5)]
    from math import erfc, sqrt

    z = (22.5 - 6.5) / sqrt(9 * 10 * 19 / 24 - (24 + 6) / 48)
    assert abs(got[0].p_value - erfc(z / sqrt(2))) < 1e-12


def test_random_retrieval_is_the_mean_over_all_places(spark):
    got = spark.createDataFrame([(k,) for k in (1, 2, 7)], "k long").select("k", *tasks.random_retrieval(F.col("k"))).collect()
    for x in got:
        places = np.arange(1, x.k + 1)
        assert np.allclose([x.top1, x.top3, x.mrr, x.median_rank], [(places == 1).mean(), (places <= 3).mean(), (1 / places).mean(), np.median(places)])


def test_label_baselines(spark):
    rows = spark.createDataFrame([(i, None if i % 11 == 0 else "ab"[i % 4 == 0], i % 2 == 1 or i % 4 == 0 and i % 8 == 0) for i in range(4000)], "id long, y string, held boolean")
    got = tasks.label_baselines(rows, "id", "y", "held", 5).toPandas()
    train = rows.filter("not held and y is not null").toPandas()["y"]
    assert len(got) == rows.filter("held and y is not null").count() and set(got["majority"]) == {train.mode()[0]}
    assert abs((got["stratified"] == "a").mean() - (train == "a").mean()) < 0.05 and abs((got["uniform"] == "a").mean() - 0.5) < 0.05


def test_plans_avoid_what_was_seen(spark):
    pools = {"p": [("p0", "f0"), ("p1", "f1")], "q": [("q0", "g0"), ("q1", "g0")]}
    seen = spark.createDataFrame([(["q0", "p0"], ["g0", "f0"])], "items array<string>, families array<string>")
    counts = spark.createDataFrame([("p0", 5), ("q0", 1)], "item string, n long")
    got = sm.refreshed_plans(spark.range(50), "id", pools, seen, counts, 3).collect()
    assert len(got) == 50 and all(x["items"][0] == "p1" and x.family_seen == x.exact_seen == 0 for x in got)
    every = spark.createDataFrame([([a, b], [f, g]) for a, f in pools["p"] for b, g in pools["q"]], "items array<string>, families array<string>")
    got = sm.refreshed_plans(spark.range(50), "id", pools, every, counts, 3).collect()
    assert all(x["items"] == ["p1", "q1"] and x.exact_seen == 1 for x in got)


def test_facts_of_the_first_case_that_holds(spark):
    rows = spark.createDataFrame([(i, i % 3) for i in range(60)], "id long, k long")
    got = sm.conditional_facts(rows, "id", {"a": [(F.col("k") == 0, ["x"]), (F.col("k") < 2, ["y", "z"])], "b": [(F.col("a") == "x", ["w"]), (None, ["v"])]}, 1).collect()
    assert all((r.a == "x") if r.k == 0 else (r.a in "yz") if r.k == 1 else r.a is None for r in got)
    assert all(r.b == ("w" if r.k == 0 else "v") for r in got) and {r.a for r in got} == {"x", "y", "z", None}
