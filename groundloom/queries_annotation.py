"""Annotations: scores of several judges against a human score, and label-based metrics.

Stand-ins: an order's human score is its priority's digit; its judges are the five-level bins of its lines' means.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .catalog import query, r, table
from .functions.scalar import dot, half_up_score, uniform
from .operators.checks import corrected
from .operators import ranking as rk
from .operators import statistics as st
from .operators import tasks
from .queries_grounding import gamma_sql, u_sql
from .queries_pairs import nested_sql

JUDGES = {"quantity": ("l_quantity", 10.0), "discount": ("l_discount", 0.02), "tax": ("l_tax", 0.016), "price": ("l_extendedprice", 20000.0)}


def scores(spark: SparkSession, d: str) -> DataFrame:
    """o_orderkey, yr, human, and a score 1..5 for each judge; complete cases only."""
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(*(F.avg(c).alias(j) for j, (c, _) in JUDGES.items()))
    human = table(spark, d, "orders").select("o_orderkey", F.year("o_orderdate").cast("long").alias("yr"), F.substring("o_orderpriority", 1, 1).try_cast("int").alias("human"))
    return human.join(lines, "o_orderkey").select("o_orderkey", "yr", "human", *(F.least(F.floor(F.col(j) / F.lit(w)) + 1, F.lit(5)).cast("int").alias(j) for j, (_, w) in JUDGES.items())).dropna()


_SCORES = "s AS (SELECT o_orderkey, year(o_orderdate) AS yr, CAST(substr(o_orderpriority, 1, 1) AS INT) AS human, " + ", ".join(f"CAST(least(floor(avg({c}) / {w}) + 1, 5) AS INT) AS {j}" for j, (c, w) in JUDGES.items()) + " FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2, 3)"
_LONG = _SCORES + ", g AS (" + " UNION ALL ".join(f"SELECT o_orderkey, yr, human, '{j}' AS judge, {j} AS score FROM s" for j in JUDGES) + ")"
_PEARSON = "CASE WHEN min({a}) < max({a}) AND min({b}) < max({b}) THEN round(corr({a}, {b}), 6) END"
_QWK = "round(CASE WHEN sum({a}*{a}) + sum({b}*{b}) - 2.0*sum({a})*sum({b})/count(*) <> 0 THEN 1 - sum(({a}-{b})*({a}-{b})) / (sum({a}*{a}) + sum({b}*{b}) - 2.0*sum({a})*sum({b})/count(*)) END, 6)"


def long(spark: SparkSession, d: str) -> DataFrame:
    return scores(spark, d).unpivot(["o_orderkey", "yr", "human"], list(JUDGES), "judge", "score")


@query(f"WITH {_SCORES} SELECT * FROM s")
def score_pivot_complete_cases(spark, d):
    return long(spark, d).groupBy("o_orderkey", "yr", "human").pivot("judge", list(JUDGES)).agg(F.max("score")).dropna()


@query(f"""WITH {_LONG}, k AS (SELECT *, rank() OVER (PARTITION BY judge ORDER BY human) + (count(*) OVER (PARTITION BY judge, human) - 1) / 2 AS rh, rank() OVER (PARTITION BY judge ORDER BY score) + (count(*) OVER (PARTITION BY judge, score) - 1) / 2 AS rs FROM g)
SELECT judge, count(*) AS n, {_PEARSON.format(a='human', b='score')} AS pearson, {_QWK.format(a='human', b='score')} AS qwk, round(avg(abs(human - score)), 6) AS mae, round(avg(human - score), 6) AS bias, round(avg(CAST(human = score AS INT)), 6) AS exact, round(avg(CAST(abs(human - score) <= 1 AS INT)), 6) AS within_one, {_PEARSON.format(a='rh', b='rs')} AS spearman FROM k GROUP BY judge""")
def agreement_metrics(spark, d):
    ranked = st.average_ranks(st.average_ranks(long(spark, d), "human", "rh", ["judge"]), "score", "rs", ["judge"])
    out = ranked.groupBy("judge").agg(*st.agreement("human", "score"), st.pearson("rh", "rs").alias("spearman"))
    return out.select("judge", "n", *(r(c).alias(c) for c in ("pearson", "qwk", "mae", "bias", "exact", "within_one", "spearman")))


@query(f"WITH {_LONG} SELECT a.judge AS first, b.judge AS second, {_QWK.format(a='a.score', b='b.score')} AS qwk FROM g a JOIN g b ON a.o_orderkey = b.o_orderkey AND a.judge < b.judge GROUP BY 1, 2")
def pairwise_judge_qwk(spark, d):
    names = sorted(JUDGES)
    pairs = F.array(*(F.struct(F.lit(a).alias("first"), F.lit(b).alias("second"), F.col(a).alias("x"), F.col(b).alias("y")) for i, a in enumerate(names) for b in names[i + 1 :]))
    rows = scores(spark, d).select(F.explode(pairs).alias("p")).select("p.*")  # a row's own pairs: no self-join
    return rows.groupBy("first", "second").agg(r(st.quadratic_kappa("x", "y")).alias("qwk"))


PANELS = {"all": list(JUDGES), **{f"without_{j}": [k for k in JUDGES if k != j] for j in JUDGES}}


@query(f"WITH {_SCORES}, p AS (" + " UNION ALL ".join(f"SELECT '{p}' AS panel, human, ({' + '.join(m)}) / {len(m)}.0 AS mean, greatest({', '.join(m)}) - least({', '.join(m)}) AS spread FROM s" for p, m in PANELS.items()) + f""") SELECT panel, round(avg(mean), 6) AS mean, round(avg(spread), 6) AS spread, {_PEARSON.format(a='human', b='mean')} AS pearson, {_QWK.format(a='human', b='least(greatest(CAST(floor(mean + 0.5) AS INT), 1), 5)')} AS qwk FROM p GROUP BY panel""")
def panel_drop_robustness(spark, d):
    def panel(name, m):
        total = sum((F.col(j) for j in m[1:]), F.col(m[0]))
        return F.struct(F.lit(name).alias("panel"), (total / float(len(m))).alias("mean"), (F.greatest(*m) - F.least(*m)).alias("spread"))

    rows = scores(spark, d).select("human", F.explode(F.array(*(panel(p, m) for p, m in PANELS.items()))).alias("x")).select("human", "x.*").withColumn("rounded", half_up_score(F.col("mean")))
    return rows.groupBy("panel").agg(r(F.avg("mean")).alias("mean"), r(F.avg("spread")).alias("spread"), r(st.pearson("human", "mean")).alias("pearson"), r(st.quadratic_kappa("human", "rounded")).alias("qwk"))


@query(f"WITH {_LONG} SELECT judge, round(avg(score - human), 6) AS bias, round(stddev_samp(score - human), 6) AS sd, round(avg(score - human) - 1.96 * stddev_samp(score - human), 6) AS lower, round(avg(score - human) + 1.96 * stddev_samp(score - human), 6) AS upper FROM g GROUP BY judge")
def bland_altman(spark, d):
    diff = long(spark, d).withColumn("x", (F.col("score") - F.col("human")).cast("double")).groupBy("judge").agg(F.avg("x").alias("bias"), F.stddev_samp("x").alias("sd"))
    return diff.select("judge", r("bias").alias("bias"), r("sd").alias("sd"), r(F.col("bias") - 1.96 * F.col("sd")).alias("lower"), r(F.col("bias") + 1.96 * F.col("sd")).alias("upper"))


@query(f"""WITH {_LONG}, x AS (SELECT judge, yr :: DOUBLE AS b, (score - human) :: DOUBLE AS y FROM g), m AS (SELECT judge, regr_slope(y, b) AS slope, regr_intercept(y, b) AS intercept, sqrt(greatest(regr_syy(y, b) - regr_slope(y, b) * regr_sxy(y, b), 0) / (count(*) - 2) / regr_sxx(y, b)) AS se FROM x GROUP BY judge)
SELECT judge, round(slope, 6) AS slope, round(intercept, 3) AS intercept, round(se, 6) AS se, round(slope / se, 3) AS t FROM m""")
def batch_drift_ols(spark, d):
    fitted = long(spark, d).withColumn("y", F.col("score") - F.col("human")).groupBy("judge").agg(*st.ols("y", "yr"))
    return fitted.select("judge", r("slope").alias("slope"), F.round("intercept", 3).alias("intercept"), r("se").alias("se"), F.round("t", 3).alias("t"))


_MEAN = "(quantity + discount + tax + price) / 4.0"


@query(f"""WITH {_SCORES} SELECT human, count(*) AS n, round(avg({_MEAN} - human), 6) AS bias, round(quantile_cont(abs({_MEAN} - human), 0.95), 6) AS p95, round(avg(CAST(abs({_MEAN} - human) >= 1.5 AS INT)), 6) AS large, round(avg(greatest(quantity, discount, tax, price) - least(quantity, discount, tax, price)), 6) AS spread FROM s GROUP BY human""")
def calibration_consensus_flags(spark, d):
    gap = F.expr(f"{_MEAN.replace('4.0', '4D')} - human")
    rows = scores(spark, d).select("human", gap.alias("gap"), (F.greatest(*JUDGES) - F.least(*JUDGES)).alias("spread"))
    return rows.groupBy("human").agg(F.count("*").alias("n"), r(F.avg("gap")).alias("bias"), r(F.percentile(F.abs("gap"), 0.95)).alias("p95"), r(F.avg((F.abs("gap") >= 1.5).cast("int"))).alias("large"), r(F.avg("spread")).alias("spread"))


@query(f"""WITH {_LONG}, x AS (SELECT judge, score - human AS y FROM g WHERE score <> human), k AS (SELECT judge, y, rank() OVER (PARTITION BY judge ORDER BY abs(y)) + (count(*) OVER (PARTITION BY judge, abs(y)) - 1) / 2 AS rk FROM x),
t AS (SELECT judge, sum(c * c * c - c) AS ties FROM (SELECT judge, count(*) :: DOUBLE AS c FROM x GROUP BY judge, abs(y)) GROUP BY judge),
w AS (SELECT judge, count(*) AS n, coalesce(sum(rk) FILTER (y > 0), 0) AS w_plus, coalesce(sum(rk) FILTER (y < 0), 0) AS w_minus FROM k GROUP BY judge),
z AS (SELECT *, abs(least(w_plus, w_minus) - n * (n + 1) / 4.0) / sqrt(n * (n + 1.0) * (2 * n + 1) / 24 - ties / 48) AS z FROM w JOIN t USING (judge))
SELECT judge, n, round(w_plus, 3) AS w_plus, round(w_minus, 3) AS w_minus, CASE WHEN z > 20 THEN 0.0 ELSE round({gamma_sql('1', 'z * z')}, 6) END AS p_value FROM z""")
def wilcoxon_w_statistic(spark, d):
    x = long(spark, d).withColumn("y", F.col("score") - F.col("human"))
    return st.signed_ranks(x, "y", ["judge"]).select("judge", "n", F.round("w_plus", 3).alias("w_plus"), F.round("w_minus", 3).alias("w_minus"), r("p_value").alias("p_value"))


@query(f"WITH {_LONG} SELECT judge, round(avg(score), 6) AS mean, round(median(score), 6) AS median, round(avg(CAST(score <= 2 AS INT)), 6) AS low, round(avg(CAST(score >= 4 AS INT)), 6) AS high, " + ", ".join(f"round(avg(CAST(score = {k} AS INT)), 6) AS share_{k}" for k in range(1, 6)) + " FROM g GROUP BY judge")
def score_distribution_table(spark, d):
    share = lambda c: r(F.avg(c.cast("int")))
    s = F.col("score")
    return long(spark, d).groupBy("judge").agg(r(F.avg("score")).alias("mean"), r(F.median("score")).alias("median"), share(s <= 2).alias("low"), share(s >= 4).alias("high"), *(share(s == k).alias(f"share_{k}") for k in range(1, 6)))


@query(f"""WITH {_LONG} SELECT o_orderkey, judge, score, human <> score AS amended FROM g""")
def amendment_overlay(spark, d):
    """The human's scores, corrected to the judge's wherever they differ; what can't be applied is an error."""
    rows = long(spark, d)
    fixes = rows.filter("human <> score").select("o_orderkey", "judge", F.col("human").alias("old_value"), F.col("score").alias("new_value"))
    return corrected(rows.select("o_orderkey", "judge", F.col("human").alias("score")), fixes, ["o_orderkey", "judge"], "score")


@query(f"WITH {_LONG} SELECT judge, count(*) AS n, count(DISTINCT o_orderkey) AS ids, count(*) FILTER (score IS NULL OR score NOT BETWEEN 1 AND 5) AS out_of_range, count(*) - count(DISTINCT o_orderkey) AS repeated FROM g GROUP BY judge")
def coverage_and_range_checks(spark, d):
    bad = F.col("score").isNull() | ~F.col("score").between(1, 5)
    return long(spark, d).groupBy("judge").agg(F.count("*").alias("n"), F.count_distinct("o_orderkey").alias("ids"), F.count_if(bad).alias("out_of_range"), (F.count("*") - F.count_distinct("o_orderkey")).alias("repeated"))


@query(f"""WITH b AS (SELECT o_orderpriority AS s, o_totalprice AS v, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) - 1 AS slot, count(*) OVER (PARTITION BY o_orderpriority) AS size FROM orders),
x AS (SELECT rep, s, CAST(floor({u_sql(11, "concat_ws('/', rep, s, slot)", 'boot')} * size) AS INT) AS slot FROM b, range(20) AS t(rep)),
m AS (SELECT rep, avg(v) AS m FROM x JOIN b USING (s, slot) GROUP BY rep)
SELECT round(quantile_cont(m, 0.025), 3) AS lower, round(quantile_cont(m, 0.975), 3) AS upper, count(*) AS replicates FROM m""")
def stratified_bootstrap_ci(spark, d):
    means = st.stratified_bootstrap(table(spark, d, "orders"), "o_orderpriority", "o_orderkey", "o_totalprice", 20, 11)
    return means.agg(F.round(F.percentile("mean", 0.025), 3).alias("lower"), F.round(F.percentile("mean", 0.975), 3).alias("upper"), F.count("*").alias("replicates"))


def labelled(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "source", "n_chars").join(table(spark, d, "labels"), "doc_id")


@query("""WITH x AS (SELECT n_chars AS v, quality AS y FROM documents JOIN labels USING (doc_id)), t AS (SELECT DISTINCT unnest(quantile_cont(v, list_transform(range(0, 91), lambda i: 0.05 + i * 0.01))) AS threshold FROM x),
f AS (SELECT threshold, 2.0 * count(*) FILTER (y = 1 AND v >= threshold) / (count(*) FILTER (y = 1) + count(*) FILTER (v >= threshold)) AS f1, 2.0 * count(*) FILTER (y = 0 AND v < threshold) / (count(*) FILTER (y = 0) + count(*) FILTER (v < threshold)) AS f0 FROM x, t GROUP BY threshold)
SELECT round(threshold, 3) AS threshold, round((f1 + f0) / 2, 6) AS macro_f1 FROM f ORDER BY (f1 + f0) DESC, threshold LIMIT 1""")
def best_threshold_macro_f1(spark, d):
    rows = labelled(spark, d).select("n_chars", "quality")
    cuts = rows.agg(F.percentile("n_chars", F.array(*(F.lit(0.05 + i * 0.01) for i in range(91)))).alias("c")).select(F.explode(F.array_distinct("c")).alias("threshold"))
    counted = rows.crossJoin(F.broadcast(cuts)).groupBy("threshold").agg(st.macro_f1(F.col("quality"), (F.col("n_chars") >= F.col("threshold")).cast("int")).alias("macro_f1"))  # 91 cuts
    best = counted.agg(F.max_by(F.struct("threshold", "macro_f1"), F.struct("macro_f1", -F.col("threshold"))).alias("b"))
    return best.select(F.round("b.threshold", 3).alias("threshold"), r("b.macro_f1").alias("macro_f1"))


@query("""WITH x AS (SELECT n_chars AS v, quality AS y FROM documents JOIN labels USING (doc_id)), k AS (SELECT y, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2 AS rk FROM x),
a AS (SELECT (sum(rk) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * (count(*) - sum(y))) AS auc FROM k),
t AS (SELECT v, sum(y) AS p, count(*) AS n FROM x GROUP BY v), s AS (SELECT p, sum(p) OVER w AS tp, sum(n) OVER w AS n, sum(p) OVER () AS np FROM t WINDOW w AS (ORDER BY v DESC ROWS UNBOUNDED PRECEDING))
SELECT round((SELECT auc FROM a), 6) AS auc, round(sum(p / np * tp / n), 6) AS average_precision FROM s""")
def auc_average_precision(spark, d):
    return st.ranked_classes(labelled(spark, d), "n_chars", "quality").select(r("auc").alias("auc"), r("average_precision").alias("average_precision"))


@query(f"""SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY {u_sql(3, 'doc_id', 'split')}, doc_id) <= ceil(0.8 * count(*) OVER (PARTITION BY source)) AS train FROM documents""")
def stratified_split(spark, d):
    return rk.split_rows(table(spark, d, "documents").select("doc_id", "source"), ["source"], "doc_id", 0.8, 3)


@query(f"""WITH x AS (SELECT doc_id, quality FROM labels), n AS (SELECT min(c) AS n FROM (SELECT count(*) AS c FROM x GROUP BY quality)), k AS (SELECT *, row_number() OVER (PARTITION BY quality ORDER BY {u_sql(5, 'doc_id', 'balance')}, doc_id) AS rk FROM x)
SELECT doc_id, quality FROM k, n WHERE rk <= least(n, 1000)""")
def balanced_sample(spark, d):
    return rk.balanced_rows(table(spark, d, "labels").select("doc_id", "quality"), "quality", "doc_id", 5, cap=1000, least=10)


@query("""WITH u AS (SELECT label, unnest(range(0, 64)) AS i, embedding FROM embeddings), m AS (SELECT label, i, avg(embedding[i + 1] :: DOUBLE) AS m, count(*) AS n FROM u GROUP BY label, i),
c AS (SELECT label, list(m ORDER BY i) AS m, max(n) AS n FROM m GROUP BY label),
s AS (SELECT e.vec_id, e.label, c.label AS other, c.n, list_dot_product(e.embedding :: DOUBLE[], c.m) AS d, list_dot_product(e.embedding :: DOUBLE[], e.embedding :: DOUBLE[]) AS own FROM embeddings e, c),
a AS (SELECT vec_id, max(CASE WHEN label = other AND n > 1 THEN 1 - (d * n - own) / (n - 1) END) AS a, min(CASE WHEN label <> other THEN 1 - d END) AS b FROM s GROUP BY vec_id)
SELECT round(avg(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette, count(*) AS n FROM a""")
def silhouette_cosine(spark, d):
    """Mean cosine distances to clusters follow from the clusters' mean vectors when rows are of unit length, so no pairs are listed."""
    e = table(spark, d, "embeddings")
    mean = e.select("label", F.posexplode("embedding").alias("i", "v")).groupBy("label", "i").agg(F.avg(F.col("v").cast("double")).alias("m"), F.count("*").alias("n"))
    centres = mean.groupBy(F.col("label").alias("other")).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "m"))), lambda x: x["m"]).alias("m"), F.max("n").alias("n"))
    near = e.crossJoin(F.broadcast(centres)).select("vec_id", "label", "other", "n", dot(F.col("embedding"), F.col("m")).alias("d"), dot(F.col("embedding"), F.col("embedding")).alias("own"))  # one row a cluster
    own = F.max(F.when((F.col("label") == F.col("other")) & (F.col("n") > 1), 1 - (F.col("d") * F.col("n") - F.col("own")) / (F.col("n") - 1)))
    ab = near.groupBy("vec_id").agg(own.alias("a"), F.min(F.when(F.col("label") != F.col("other"), 1 - F.col("d"))).alias("b"))
    return ab.agg(r(F.avg(F.when(F.col("a").isNull(), 0.0).otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b")))).alias("silhouette"), F.count("*").alias("n"))


@query("""WITH x AS (SELECT vec_id, embedding :: DOUBLE[] AS v FROM embeddings), p AS (SELECT list_cosine_similarity(a.v, b.v) AS c FROM x a JOIN x b ON a.vec_id < b.vec_id)
SELECT (SELECT count(*) FROM x) AS n, round(avg(c), 6) AS mean, round(stddev_pop(c), 6) AS sd FROM p""")
def cosine_all_pairs_stats(spark, d):
    return st.pairwise_cosine_moments(table(spark, d, "embeddings"), "embedding").select("n", r("mean").alias("mean"), r("sd").alias("sd"))


@query(f"""WITH {nested_sql('embeddings', 'vec_id', ['label'], 13, 'ring', 11)},
c AS (SELECT c.vec_id, c.candidate, c.step = 1 AS truth, list_dot_product(a.embedding :: DOUBLE[], b.embedding :: DOUBLE[]) AS s FROM cand c JOIN embeddings a USING (vec_id) JOIN embeddings b ON b.vec_id = c.candidate WHERE c.step > 0),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, candidate) AS rk FROM c)
SELECT count(*) AS n, round(avg(CAST(rk = 1 AS INT)), 6) AS top1, round(avg(CAST(rk <= 3 AS INT)), 6) AS top3, round(avg(1.0 / rk), 6) AS mrr, round(median(rk), 6) AS median_rank FROM r WHERE truth""")
def candidate_lists_and_mrr(spark, d):
    """Ten candidates a query: the next ten around the ring of its label, others where the label has fewer; the first counts as the true one."""
    ranked = _candidate_ranks(spark, d)
    return ranked.agg(F.count("*").alias("n"), r(F.avg((F.col("rk") == 1).cast("int"))).alias("top1"), r(F.avg((F.col("rk") <= 3).cast("int"))).alias("top3"), r(F.avg(1 / F.col("rk"))).alias("mrr"), r(F.median("rk")).alias("median_rank"))


def _candidate_ranks(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    c = rk.nested_candidates(e, "vec_id", ["label"], uniform(13, F.col("vec_id"), "ring"), 11, 13).filter("step > 0")
    met = c.join(e.select("vec_id", "embedding"), "vec_id").join(e.select(F.col("vec_id").alias("candidate"), F.col("embedding").alias("other")), "candidate")
    scored = met.select("vec_id", "candidate", (F.col("step") == 1).alias("truth"), dot(F.col("embedding"), F.col("other")).alias("s"))
    return scored.withColumn("rk", F.row_number().over(Window.partitionBy("vec_id").orderBy(F.desc("s"), "candidate"))).filter("truth")


@query(f"""WITH f AS (SELECT c_mktsegment, row_number() OVER (ORDER BY c_mktsegment) - 1 AS p, count(*) OVER () AS n FROM (SELECT DISTINCT c_mktsegment FROM customer)),
x AS (SELECT c_custkey, c.c_mktsegment, f.p, f.n, 1 + CAST(floor({u_sql(17, 'c_custkey', 'flip')} * (f.n - 1)) AS INT) AS step FROM customer c JOIN f USING (c_mktsegment))
SELECT c_custkey, x.c_mktsegment AS original, g.c_mktsegment AS changed FROM x JOIN f g ON g.p = (x.p + step) % x.n""")
def counterfactual_pairs(spark, d):
    """Each row's value is changed to another one of the pool."""
    rows = table(spark, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("original"))
    pool = rows.agg(F.array_sort(F.collect_set("original")).alias("pool"))  # a vocabulary
    step = 1 + F.floor(uniform(17, F.col("c_custkey"), "flip") * (F.size("pool") - 1))
    at = (F.array_position("pool", F.col("original")) - 1 + step) % F.size("pool")
    return rows.crossJoin(F.broadcast(pool)).select("c_custkey", "original", F.get("pool", at.cast("int")).alias("changed"))


@query()
def bootstrap_agreement_ci(spark, d):
    """Intervals of each judge's agreement with the human: 10,000 resamples inside the years, 1,000 for the rank correlation."""
    rows = long(spark, d)
    sums = st.resampled_sums(rows, ["judge"], "yr", st.pair_sums("human", "score"), 10_000, 42)
    cells = st.resampled_cells(rows, ["judge"], "yr", {"human": F.col("human"), "score": F.col("score")}, 1000, 42)
    ranks = st.weighted_spearman(cells, ["judge", "replicate"], "human", "score")
    both = st.intervals(sums, ["judge"], st.agreement_of_sums()).unionByName(st.intervals(ranks, ["judge"], {"spearman": F.col("spearman")}))
    return both.select("judge", "measure", r("lower").alias("lower"), r("upper").alias("upper"), "replicates")


@query()
def panel_bootstrap_ci(spark, d):
    """The same of the panels' mean scores, with all judges and with each left out."""
    total = lambda m: sum((F.col(j) for j in m[1:]), F.col(m[0])) / float(len(m))
    panels = F.array(*(F.struct(F.lit(p).alias("panel"), total(m).alias("mean")) for p, m in PANELS.items()))
    rows = scores(spark, d).select("yr", "human", F.explode(panels).alias("x")).select("yr", "human", "x.*")
    columns = {"human": F.col("human"), "mean": F.col("mean")}
    cells = st.resampled_cells(rows, ["panel"], "yr", columns, 1000, 43)
    ranks = st.weighted_spearman(cells, ["panel", "replicate"], "human", "mean")
    sums = st.resampled_sums(rows, ["panel"], "yr", st.pair_sums("human", "mean"), 1000, 43)
    both = st.intervals(sums, ["panel"], st.agreement_of_sums() | {"bias": (F.col("y") - F.col("x")) / F.col("n")}).unionByName(st.intervals(ranks, ["panel"], {"spearman": F.col("spearman")}))
    return both.select("panel", "measure", r("lower").alias("lower"), r("upper").alias("upper"), "replicates")


@query()
def plain_bootstrap_ci(spark, d):
    """Intervals of a retrieval's mean reciprocal rank, and of a threshold's macro-F1 and its gain over the commoner class: 1,000 resamples each."""
    ranks = st.resampled_sums(_candidate_ranks(spark, d), [], None, {"reciprocal": 1 / F.col("rk")}, 1000, 42)
    mrr = st.intervals(ranks, [], {"mrr": F.col("reciprocal") / F.col("n")})
    y, p = F.col("quality"), (F.col("n_chars") >= 400).cast("int")
    told = st.resampled_sums(labelled(spark, d), [], None, {"t1": y, "p1": p, "hit1": y * p}, 1000, 42)
    n, t1, p1, hit1 = (F.col(c) for c in ("n", "t1", "p1", "hit1"))
    f1 = lambda hit, size: F.when(size > 0, 2 * hit / size).otherwise(0.0)
    macro = (f1(hit1, t1 + p1) + f1(n - t1 - p1 + hit1, 2 * n - t1 - p1)) / 2
    commoner = F.greatest(t1, n - t1)
    rest = st.intervals(told, [], {"macro_f1": macro, "gain": macro - commoner / (n + commoner)})
    return mrr.unionByName(rest).select("measure", r("lower").alias("lower"), r("upper").alias("upper"), "replicates")


@query("""WITH k AS (SELECT conv_id, count(*) AS candidates FROM conversations GROUP BY 1)
SELECT candidates, count(*) AS queries, round(1.0 / candidates, 6) AS top1, round(least(3.0 / candidates, 1.0), 6) AS top3, round(list_sum(list_transform(range(1, candidates + 1), lambda i: 1.0 / i)) / candidates, 6) AS mrr, round((candidates + 1) / 2, 6) AS median_rank FROM k GROUP BY candidates""")
def retrieval_random_baselines(spark, d):
    """What guessing a turn of a conversation reaches, by the number of its turns."""
    k = table(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("candidates")).groupBy("candidates").agg(F.count("*").alias("queries"))
    told = k.select("candidates", "queries", *tasks.random_retrieval(F.col("candidates")))
    return told.select("candidates", "queries", *(r(c).alias(c) for c in ("top1", "top3", "mrr", "median_rank")))


@query(f"""WITH x AS (SELECT doc_id, lang, doc_id % 5 = 0 AS held_out FROM documents WHERE lang IS NOT NULL), t AS (SELECT lang, count(*) AS n FROM x WHERE NOT held_out GROUP BY 1),
c AS (SELECT lang, sum(n) OVER (ORDER BY lang) AS hi, sum(n) OVER (ORDER BY lang) - n AS lo, sum(n) OVER () AS total, row_number() OVER (ORDER BY lang) - 1 AS p, count(*) OVER () AS k FROM t)
SELECT doc_id, x.lang AS truth, (SELECT lang FROM t ORDER BY n DESC, lang LIMIT 1) AS majority, a.lang AS stratified, b.lang AS uniform FROM x JOIN c a ON {u_sql(43, 'doc_id', 'stratified')} * a.total >= a.lo AND {u_sql(43, 'doc_id', 'stratified')} * a.total < a.hi
JOIN c b ON b.p = CAST(floor({u_sql(43, 'doc_id', 'uniform')} * b.k) AS INT) WHERE held_out""")
def label_baselines(spark, d):
    """Guesses of the language of every fifth document: the commonest, by shares, and even."""
    rows = table(spark, d, "documents").select("doc_id", "lang", (F.col("doc_id") % 5 == 0).alias("held_out"))
    return tasks.label_baselines(rows, "doc_id", "lang", "held_out", 43)
