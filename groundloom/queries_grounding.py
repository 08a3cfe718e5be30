"""Grounding: conditional shares, crosstabs, fitting, draws, marginal checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import query, r, table, written
from .functions.scalar import banded, integer_in, uniform, uniform_at
from .operators import grounding as g
from .operators import statistics as st

BANDS = ([0.0, 3000.0, 6000.0], ["under0", "under3000", "under6000", "above"])
_BAND_SQL = "CASE WHEN c_acctbal IS NULL THEN NULL WHEN c_acctbal <= 0 THEN 'under0' WHEN c_acctbal <= 3000 THEN 'under3000' WHEN c_acctbal <= 6000 THEN 'under6000' ELSE 'above' END"
_U = "CAST('0x' || substr(md5(concat_ws('|', '{seed}', CAST({id} AS VARCHAR), '{stage}')), 1, 8) AS BIGINT) / 4294967296.0"


def u_sql(seed: int, key: str, stage: str) -> str:
    return "(" + _U.format(seed=seed, id=key, stage=stage) + ")"


def _orders(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").join(table(spark, d, "customer").withColumnRenamed("c_custkey", "o_custkey"), "o_custkey")


@query("""SELECT c_mktsegment, r_name, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY c_mktsegment), 6) AS probability
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY c_mktsegment, r_name""")
def cond_share_segment_region(spark, d):
    rows = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return g.conditional_share(rows, ["c_mktsegment"], ["r_name"]).withColumn("probability", r("probability"))


@query("""SELECT year(o_orderdate) AS yr, o_orderstatus, o_orderpriority, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY year(o_orderdate)), 6) AS probability FROM orders GROUP BY year(o_orderdate), o_orderstatus, o_orderpriority""")
def cond_joint_two_key(spark, d):
    rows = table(spark, d, "orders").withColumn("yr", F.year("o_orderdate").cast("long"))
    return g.conditional_share(rows, ["yr"], ["o_orderstatus", "o_orderpriority"]).withColumn("probability", r("probability"))


@query(f"""WITH b AS (SELECT c_mktsegment, {_BAND_SQL} AS band, o_orderstatus FROM orders JOIN customer ON o_custkey = c_custkey),
c AS (SELECT c_mktsegment, band, count(*) FILTER (o_orderstatus = 'P') AS n FROM b GROUP BY ALL),
g AS (SELECT * FROM (SELECT DISTINCT c_mktsegment FROM b) CROSS JOIN (SELECT DISTINCT band FROM b)),
f AS (SELECT g.c_mktsegment, g.band, coalesce(c.n, 0) AS n FROM g LEFT JOIN c USING (c_mktsegment, band))
SELECT *, round(CASE WHEN sum(n) OVER w > 0 THEN n / sum(n) OVER w ELSE 0 END, 6) AS share FROM f WINDOW w AS (PARTITION BY c_mktsegment)""")
def grid_zero_fill_matrix(spark, d):
    from pyspark.sql import Window

    rows = _orders(spark, d).withColumn("band", banded(F.col("c_acctbal"), *BANDS))
    counted = rows.groupBy("c_mktsegment", "band").agg(F.count_if(F.col("o_orderstatus") == "P").alias("n"))
    total = F.sum("n").over(Window.partitionBy("c_mktsegment"))
    return g.full_grid(counted, ["c_mktsegment", "band"]).withColumn("share", r(F.when(total > 0, F.col("n") / total).otherwise(0.0)))


@query("""WITH p AS (SELECT c_mktsegment, count(*) / sum(count(*)) OVER () AS p FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1),
q AS (SELECT c_mktsegment, count(*) / sum(count(*)) OVER () AS q FROM customer GROUP BY 1)
SELECT c_mktsegment, round(coalesce(p, 0), 6) AS p, round(coalesce(q, 0), 6) AS q, round(abs(coalesce(p, 0) - coalesce(q, 0)), 6) AS abs_diff, round(abs(coalesce(p, 0) - q) / q, 6) AS rel_diff FROM p FULL JOIN q USING (c_mktsegment)""")
def marginal_crosscheck(spark, d):
    gap = g.marginal_gap(g.conditional_share(_orders(spark, d), [], ["c_mktsegment"]), g.conditional_share(table(spark, d, "customer"), [], ["c_mktsegment"]), ["c_mktsegment"])
    return gap.select("c_mktsegment", *(r(c).alias(c) for c in ("p", "q", "abs_diff", "rel_diff")))


@query("""SELECT o_orderpriority, round(avg(CAST(o_orderstatus = 'F' AS INT)), 6) AS f, round(avg(CAST(o_orderstatus = 'O' AS INT)), 6) AS o, round(avg(CAST(o_orderstatus = 'P' AS INT)), 6) AS p FROM orders WHERE o_orderstatus IS NOT NULL GROUP BY 1""")
def crosstab_row_normalized(spark, d):
    share = g.conditional_share(table(spark, d, "orders").filter("o_orderstatus is not null"), ["o_orderpriority"], ["o_orderstatus"])
    wide = share.groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.max("probability"))
    return wide.select("o_orderpriority", *(r(F.coalesce(c, F.lit(0.0))).alias(c.lower()) for c in "FOP"))


@query("""WITH p AS (SELECT o_orderpriority, o_orderstatus, year(o_orderdate) AS yr, count(*) / sum(count(*)) OVER () AS p FROM orders GROUP BY 1, 2, 3),
q AS (SELECT o_orderpriority, o_orderstatus, year(o_orderdate) AS yr, count(*) / sum(count(*)) OVER () AS q FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2, 3),
j AS (SELECT abs(coalesce(p, 0) - coalesce(q, 0)) AS x FROM p FULL JOIN q USING (o_orderpriority, o_orderstatus, yr))
SELECT count(*) AS cells, round(avg(x), 6) AS mean_diff, round(max(x), 6) AS max_diff, avg(x) < 0.02 AS passed FROM j""")
def joint_deviation_outer(spark, d):
    keys = ["o_orderpriority", "o_orderstatus", "yr"]
    orders = table(spark, d, "orders").withColumn("yr", F.year("o_orderdate"))
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")).join(orders, "o_orderkey")
    gap = g.marginal_gap(g.conditional_share(orders, [], keys), g.conditional_share(lines, [], keys), keys)
    return gap.agg(F.count("*").alias("cells"), r(F.avg("abs_diff")).alias("mean_diff"), r(F.max("abs_diff")).alias("max_diff"), (F.avg("abs_diff") < 0.02).alias("passed"))


BASELINE = {("under0", "F"): 0.5, ("under3000", "F"): 0.5, ("under6000", "O"): 0.4, ("above", "P"): 0.1, ("above", "X"): 0.0}


@query(f"""WITH b AS (SELECT {_BAND_SQL} AS band, o_orderstatus AS s FROM orders JOIN customer ON o_custkey = c_custkey),
p AS (SELECT band, s, count(*) / sum(count(*)) OVER (PARTITION BY band) AS p FROM b GROUP BY band, s),
e(band, s, target) AS (VALUES {', '.join(f"('{a}', '{b}', {v})" for (a, b), v in BASELINE.items())})
SELECT e.band, e.s AS status, round(coalesce(p, 0), 6) AS observed, CAST(target AS DOUBLE) AS target, abs(coalesce(p, 0) - target) <= 0.05 AS passed FROM e LEFT JOIN p ON p.band = e.band AND p.s = e.s""")
def crosstab_vs_baseline_checks(spark, d):
    rows = _orders(spark, d).select(banded(F.col("c_acctbal"), *BANDS).alias("band"), F.col("o_orderstatus").alias("status"))
    baseline = spark.createDataFrame([(*k, v) for k, v in BASELINE.items()], "band string, status string, target double")
    joined = baseline.join(g.conditional_share(rows, ["band"], ["status"]), ["band", "status"], "left").withColumn("observed", F.coalesce("probability", F.lit(0.0)))
    return joined.select("band", "status", r("observed").alias("observed"), "target", (F.abs(F.col("observed") - F.col("target")) <= 0.05).alias("passed"))


FACTS = {"returned": ("l_returnflag = 'R'", 0.25), "shipped": ("l_linestatus = 'F'", 0.5), "discounted": ("l_discount > 0.05", 0.45), "large": ("l_quantity >= 26", 0.5)}


@query("\nUNION ALL\n".join(f"SELECT '{k}' AS fact, round(avg(CAST({c} AS INT)), 6) AS observed, {t} :: DOUBLE AS target, round(greatest(0.05, 1.96 * sqrt({t} * (1 - {t}) / count(*))), 6) AS tolerance, abs(avg(CAST({c} AS INT)) - {t}) < greatest(0.05, 1.96 * sqrt({t} * (1 - {t}) / count(*))) AS passed FROM lineitem" for k, (c, t) in FACTS.items()))
def proportion_fact_checks(spark, d):
    lines = table(spark, d, "lineitem").agg(F.count("*").alias("n"), *(F.avg(F.expr(c).cast("double")).alias(k) for k, (c, _) in FACTS.items()))
    long = lines.unpivot(["n"], list(FACTS), "fact", "observed").join(F.broadcast(spark.createDataFrame([(k, t) for k, (_, t) in FACTS.items()], "fact string, target double")), "fact")
    tolerance = F.greatest(F.lit(0.05), 1.96 * F.sqrt(F.col("target") * (1 - F.col("target")) / F.col("n")))
    return long.select("fact", r("observed").alias("observed"), "target", r(tolerance).alias("tolerance"), (F.abs(F.col("observed") - F.col("target")) < tolerance).alias("passed"))


@query(f"""WITH b AS (SELECT c_mktsegment AS f, {_BAND_SQL} AS a, o_orderpriority AS c FROM orders JOIN customer ON o_custkey = c_custkey),
w AS (SELECT f, count(*) / sum(count(*)) OVER () AS w FROM b GROUP BY f),
pa AS (SELECT f, a, count(*) / sum(count(*)) OVER (PARTITION BY f) AS pa FROM b GROUP BY f, a),
pc AS (SELECT f, c, count(*) / sum(count(*)) OVER (PARTITION BY f) AS pc FROM b GROUP BY f, c),
q AS (SELECT a, c, sum(w * pa * pc) AS q FROM w JOIN pa USING (f) JOIN pc USING (f) GROUP BY a, c),
p AS (SELECT a, c, count(*) / sum(count(*)) OVER () AS p FROM b GROUP BY a, c)
SELECT round(sum(abs(coalesce(p, 0) - coalesce(q, 0))) / 2, 6) AS tv, round(max(abs(coalesce(p, 0) - coalesce(q, 0))), 6) AS max_diff, round(avg(abs(coalesce(p, 0) - coalesce(q, 0))), 6) AS mean_diff FROM p FULL JOIN q USING (a, c)""")
def holdout_reconstruction_tv(spark, d):
    b = _orders(spark, d).select(F.col("c_mktsegment").alias("f"), banded(F.col("c_acctbal"), *BANDS).alias("a"), F.col("o_orderpriority").alias("c"))
    w = g.conditional_share(b, [], ["f"]).select("f", F.col("probability").alias("w"))
    pa = g.conditional_share(b, ["f"], ["a"]).select("f", "a", F.col("probability").alias("pa"))
    pc = g.conditional_share(b, ["f"], ["c"]).select("f", "c", F.col("probability").alias("pc"))
    q = w.join(pa, "f").join(pc, "f").groupBy("a", "c").agg(F.sum(F.col("w") * F.col("pa") * F.col("pc")).alias("probability"))
    return g.total_variation(g.marginal_gap(g.conditional_share(b, [], ["a", "c"]), q, ["a", "c"]), []).select(*(r(c).alias(c) for c in ("tv", "max_diff", "mean_diff")))


_SWEEPS = 4
_ROW_T, _COL_T = {"F": 0.5, "O": 0.3, "P": 0.2}, {"1-URGENT": 0.3, "2-HIGH": 0.25, "3-MEDIUM": 0.2, "4-NOT SPECIFIED": 0.15, "5-LOW": 0.1}


def _ipf_sql() -> str:
    case = lambda k, t: "CASE " + k + " " + " ".join(f"WHEN '{a}' THEN {v}" for a, v in t.items()) + " ELSE 0.0 END"
    steps = ["m0 AS (SELECT c_mktsegment, o_orderstatus AS a, o_orderpriority AS c, greatest(CAST(count(*) AS DOUBLE), 1e-12) AS m FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)"]
    for i in range(2 * _SWEEPS):
        axis, target = ("a", case("a", _ROW_T)) if i % 2 == 0 else ("c", case("c", _COL_T))
        steps.append(f"m{i + 1} AS (SELECT c_mktsegment, a, c, m * {target} / sum(m) OVER (PARTITION BY c_mktsegment, {axis}) AS m FROM m{i})")
    return "WITH " + ",\n".join(steps) + f"\nSELECT c_mktsegment, a AS status, c AS priority, round(m, 6) AS share FROM m{2 * _SWEEPS}"


def _seeded(spark, d):
    literal = lambda t: F.create_map(*(F.lit(x) for kv in t.items() for x in kv))
    rows = _orders(spark, d).groupBy("c_mktsegment", F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority")).agg(F.count("*").alias("share"))
    return rows.withColumn("rt", F.coalesce(F.try_element_at(literal(_ROW_T), "status"), F.lit(0.0))).withColumn("ct", F.coalesce(F.try_element_at(literal(_COL_T), "priority"), F.lit(0.0)))


@query(_ipf_sql())
def ipf_two_way_fixed_sweeps(spark, d):
    return g.ipf_sweeps(_seeded(spark, d), ["c_mktsegment"], "status", "priority", "share", "rt", "ct", _SWEEPS).select("c_mktsegment", "status", "priority", r("share").alias("share"))


@query()
def ipf_converged_marginals(spark, d):
    """Fits each segment's matrix to convergence; a group holds one cell a status and priority."""

    def fit(part):
        import pandas as pd

        m = part.pivot_table(index="status", columns="priority", values="share", fill_value=0)
        rt = part.groupby("status")["rt"].first().reindex(m.index)
        ct = part.groupby("priority")["ct"].first().reindex(m.columns)
        fitted, sweeps, error, ok = g.fit_matrix(m.to_numpy(), rt / rt.sum(), ct / ct.sum())
        out = pd.DataFrame(fitted, m.index, m.columns).stack().rename("share").reset_index()
        return out.assign(c_mktsegment=part["c_mktsegment"].iloc[0], sweeps=sweeps, error=error, converged=ok)[["c_mktsegment", "status", "priority", "share", "sweeps", "error", "converged"]]

    return _seeded(spark, d).groupBy("c_mktsegment").applyInPandas(fit, "c_mktsegment string, status string, priority string, share double, sweeps int, error double, converged boolean")


def gamma_sql(freedom: str, x: str) -> str:
    """The upper tail of the chi-square distribution by the series of the incomplete gamma function."""
    return f"1 - list_sum(list_transform(range(0, 1000), lambda i: exp(({freedom} / 2.0 + i) * ln(greatest({x} / 2.0, 1e-300)) - {x} / 2.0 - lgamma({freedom} / 2.0 + i + 1))))"


@query(f"""WITH c AS (SELECT o_orderpriority, count(*) AS o FROM orders GROUP BY 1), t AS (SELECT sum(o) AS n, count(*) AS k FROM c),
x AS (SELECT CAST(n AS BIGINT) AS n, k AS cells, sum((o - n / 5) * (o - n / 5) / (n / 5)) AS chi2 FROM c, t GROUP BY n, k), v AS (SELECT *, sqrt(chi2 / greatest(n * (cells - 1), 1)) AS v, {gamma_sql('(cells - 1)', 'chi2')} AS p FROM x)
SELECT n, cells, round(chi2, 6) AS chi2, round(v, 6) AS cramers_v, round(p, 6) AS p_value, p > 0.05 OR v < 0.05 AS passed FROM v""")
def chi_square_gof(spark, d):
    counts = table(spark, d, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("observed")).withColumn("share", F.lit(0.2))
    return st.chi_square(counts, "observed", "share").select("n", "cells", r("chi2").alias("chi2"), r("cramers_v").alias("cramers_v"), r("p_value").alias("p_value"), "passed")


@query(f"""WITH v AS (SELECT o_orderpriority AS value, count(*) / (SELECT count(*) FROM orders WHERE o_orderpriority <> '5-LOW') AS share FROM orders WHERE o_orderpriority <> '5-LOW' GROUP BY 1 UNION ALL SELECT '6-NONE', 0.0),
g AS (SELECT c_mktsegment, value, share, coalesce(o, 0) AS o FROM (SELECT DISTINCT c_mktsegment FROM customer JOIN orders ON o_custkey = c_custkey) CROSS JOIN v LEFT JOIN (SELECT c_mktsegment, o_orderpriority AS value, count(*) AS o FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL) USING (c_mktsegment, value)),
t AS (SELECT *, sum(o) OVER (PARTITION BY c_mktsegment) AS n FROM g), x AS (SELECT c_mktsegment, CAST(max(n) AS BIGINT) AS n, count(*) FILTER (share > 0) AS cells, sum(CASE WHEN share > 0 THEN (o - n * share) * (o - n * share) / (n * share) END) AS chi2 FROM t GROUP BY 1),
y AS (SELECT *, sqrt(chi2 / greatest(n * (cells - 1), 1)) AS v, {gamma_sql('(cells - 1)', 'chi2')} AS p FROM x)
SELECT c_mktsegment, n, cells, round(chi2, 6) AS chi2, round(v, 6) AS cramers_v, round(p, 6) AS p_value, p > 0.05 OR v < 0.05 AS passed FROM y""")
def marginal_checks(spark, d):
    """Each segment's order priorities against those of all, without the lowest (so that it is unseen) and with one that no order has."""
    orders = _orders(spark, d).select("c_mktsegment", "o_orderpriority")
    share = g.conditional_share(table(spark, d, "orders").filter("o_orderpriority <> '5-LOW'"), [], ["o_orderpriority"])
    words = share.select(F.col("o_orderpriority").alias("value"), F.col("probability").alias("share")).unionByName(spark.range(1).select(F.lit("6-NONE").alias("value"), F.lit(0.0).alias("share")))
    found = st.marginal_check(orders, "o_orderpriority", words, ["c_mktsegment"])
    return found.select("c_mktsegment", "n", "cells", r("chi2").alias("chi2"), r("cramers_v").alias("cramers_v"), r("p_value").alias("p_value"), "passed")


@query("""WITH t AS (SELECT l_extendedprice AS v, count(*) FILTER (l_returnflag = 'R') AS a, count(*) FILTER (l_returnflag = 'N') AS b FROM lineitem GROUP BY 1),
s AS (SELECT sum(a) OVER w AS ca, sum(b) OVER w AS cb, sum(a) OVER () AS na, sum(b) OVER () AS nb FROM t WINDOW w AS (ORDER BY v ROWS UNBOUNDED PRECEDING)),
k AS (SELECT max(abs(ca / na - cb / nb)) AS d, max(na) AS na, max(nb) AS nb, sqrt(max(na) * max(nb) / (max(na) + max(nb))) AS e FROM s),
p AS (SELECT *, least(1, 2 * list_sum(list_transform(range(1, 400), lambda i: CASE WHEN i % 2 = 1 THEN 1 ELSE -1 END * exp(-2 * i * i * e * e * d * d)))) AS p FROM k)
SELECT round(d, 6) AS d, CAST(na AS BIGINT) AS n_a, CAST(nb AS BIGINT) AS n_b, round(p, 6) AS p_value, p > 0.05 OR d < 0.05 AS passed FROM p""")
def ks_two_sample_d(spark, d):
    return st.ks_distance(table(spark, d, "lineitem"), "l_extendedprice", F.col("l_returnflag") == "R", F.col("l_returnflag") == "N").withColumn("d", r("d")).withColumn("p_value", r("p_value"))


@query(f"""WITH p AS (SELECT c_mktsegment AS s, o_orderpriority AS k, count(*) / sum(count(*)) OVER (PARTITION BY c_mktsegment) AS p FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment, o_orderpriority),
c AS (SELECT *, round(sum(p) OVER (PARTITION BY s ORDER BY k) - p, 9) AS lo, CASE WHEN k = max(k) OVER (PARTITION BY s) THEN 1 ELSE round(sum(p) OVER (PARTITION BY s ORDER BY k), 9) END AS hi FROM p),
x AS (SELECT c_custkey, c_mktsegment, {u_sql(42, 'c_custkey', 'priority')} AS u, {u_sql(42, 'c_custkey', 'years')} AS v FROM customer)
SELECT c_custkey, c.k AS priority, CAST(18 + floor(v * 53) AS INT) AS age FROM x JOIN c ON c.s = x.c_mktsegment AND u >= lo AND u < hi""")
def hash_categorical_draws(spark, d):
    share = g.conditional_share(_orders(spark, d), ["c_mktsegment"], ["o_orderpriority"]).select("c_mktsegment", "o_orderpriority", "probability")
    drawn = g.draw(table(spark, d, "customer"), share, ["c_mktsegment"], "o_orderpriority", "c_custkey", 42, "priority", "priority")
    return drawn.select("c_custkey", "priority", integer_in(F.lit(18), F.lit(70), uniform(42, F.col("c_custkey"), "years")).alias("age"))


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN o_totalprice > 100000 END AS uses_contract, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'high' WHEN o_orderpriority = '3-MEDIUM' THEN 'middle' ELSE 'low' END AS level,
split_part(o_orderpriority, '-', 1) AS rank_text, substr(o_orderpriority, 3) AS rank_name FROM orders""")
def conditional_null_expression(spark, d):
    level = F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "high").when(F.col("o_orderpriority") == "3-MEDIUM", "middle").otherwise("low")
    parts = F.split("o_orderpriority", "-", 2)
    return table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice") > 100000).alias("uses_contract"), level.alias("level"), parts[0].alias("rank_text"), parts[1].alias("rank_name"))


_AXES, _SWEEPS = ["o_orderpriority", "o_orderstatus", "c_mktsegment"], 5


def _axes_sql() -> str:
    steps, before = [], "c"
    for i in range(_SWEEPS):
        for a in _AXES:
            steps.append(f"w{len(steps)} AS (SELECT {', '.join(_AXES)}, v * t.target / sum(v) OVER (PARTITION BY {a}) AS v FROM {before} JOIN t_{a} t USING ({a}))")
            before = f"w{len(steps) - 1}"
    targets = ", ".join(f"t_{a} AS (SELECT {a}, (SELECT sum(v) FROM c) * sqrt(sum(v)) / sum(sqrt(sum(v))) OVER () AS target FROM c GROUP BY {a})" for a in _AXES)
    return f"WITH c AS (SELECT {', '.join(_AXES)}, count(*) :: DOUBLE AS v FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL), {targets}, {', '.join(steps)} SELECT {', '.join(_AXES)}, round(v, 6) AS fitted FROM {before}"


@query(_axes_sql())
def ipf_three_axes(spark, d):
    """A three-way table of orders fitted to levelled marginals of all three axes."""
    cells = written(_orders(spark, d).groupBy(*_AXES).agg(F.count("*").cast("double").alias("v")), "cells")
    total = cells.agg(F.sum("v").alias("total"))

    def target(a):
        sums = cells.groupBy(a).agg(F.sqrt(F.sum("v")).alias("root"))
        return sums.crossJoin(F.broadcast(sums.agg(F.sum("root").alias("roots")))).crossJoin(F.broadcast(total)).select(a, (F.col("total") * F.col("root") / F.col("roots")).alias("target"))

    fitted, *_ = g.fit_axes(cells, _AXES, "v", {a: target(a) for a in _AXES}, sweeps=_SWEEPS)
    return fitted.withColumn("fitted", r("fitted"))
