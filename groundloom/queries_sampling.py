"""Weights, implied counts, chained draws, redraws, ranked choices and samples over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .catalog import query, r, table
from .functions import scalar as s
from .functions.scalar import uniform_at
from .operators import sampling as sm
from .operators.grounding import conditional_share
from .queries_grounding import u_sql


def _u(stage: str) -> str:
    return f"CAST('0x' || substr(md5(concat_ws('|', '7', CAST(c_custkey AS VARCHAR), '{stage}' || i)), 1, 8) AS BIGINT) / 4294967296.0"


@query(f"""WITH u AS (SELECT c_custkey, CAST(i AS INT) AS attempt, CAST(15 + floor({_u('age')} * 66) AS INT) AS age, CAST(floor({_u('career')} * 50) AS INT) AS career FROM customer, range({sm.MOST_DRAWS}) AS t(i)),
k AS (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY attempt) AS rn FROM u WHERE career <= age - 15)
SELECT c.c_custkey, attempt, age, career FROM customer c LEFT JOIN k ON k.c_custkey = c.c_custkey AND rn = 1""")
def rejection_feasible_rows(spark, d):
    """Whole chains are redrawn until feasible; every row gets one, or the query fails."""
    u = lambda stage, i: uniform_at(7, F.col("c_custkey"), stage, i)
    chain = lambda i: F.struct(i.alias("attempt"), (15 + F.floor(u("age", i) * 66)).cast("int").alias("age"), F.floor(u("career", i) * 50).cast("int").alias("career"))
    first = sm.first_feasible(chain, lambda x: x["career"] <= x["age"] - 15)
    return table(spark, d, "customer").select("c_custkey", first.alias("x")).select("c_custkey", "x.attempt", "x.age", "x.career")


@query("""WITH w AS (SELECT c_nationkey, c_mktsegment, sum(CASE WHEN c_nationkey % 5 = 0 THEN -1 ELSE c_acctbal END) AS weight FROM customer GROUP BY ALL),
g AS (SELECT *, greatest(weight, 0) AS k FROM w)
SELECT c_nationkey, c_mktsegment, round(CASE WHEN sum(k) OVER p > 0 THEN k / sum(k) OVER p ELSE 1.0 / count(*) OVER p END, 6) AS probability FROM g WINDOW p AS (PARTITION BY c_nationkey)""")
def weight_normalization(spark, d):
    """Balances by nation and segment as probabilities; a fifth of the nations has no weight and is uniform."""
    w = table(spark, d, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.sum(F.when(F.col("c_nationkey") % 5 == 0, -1).otherwise(F.col("c_acctbal"))).alias("weight"))
    return sm.normalised(w, ["c_nationkey"], "weight").select("c_nationkey", "c_mktsegment", r("probability").alias("probability"))


@query("""WITH t AS (SELECT c_mktsegment, count(*) AS total FROM customer GROUP BY 1), p AS (SELECT *, unnest([0.5, 12.5, 33.0, 50.0, 99.5]) AS percent FROM t)
SELECT c_mktsegment, CAST(percent AS DOUBLE) AS percent, CAST(round_even(total * percent / 100, 0) AS BIGINT) AS implied FROM p""")
def implied_counts_half_even(spark, d):
    t = table(spark, d, "customer").groupBy("c_mktsegment").agg(F.count("*").alias("total"))
    p = t.withColumn("percent", F.explode(F.array(*map(F.lit, [0.5, 12.5, 33.0, 50.0, 99.5]))))
    return p.select("c_mktsegment", "percent", sm.implied_count(F.col("total").cast("decimal(20,0)"), F.col("percent").cast("decimal(10,1)")).alias("implied"))


@query("""WITH s AS (SELECT o_orderpriority AS category, o_orderstatus AS field, count(*) AS n FROM orders GROUP BY ALL),
p AS (SELECT *, sum(n) OVER (PARTITION BY category) AS size, 100.0 * n / sum(n) OVER (PARTITION BY category) AS percent FROM s)
SELECT category, field, round(size * percent / sum(size * percent) OVER (PARTITION BY field), 6) AS probability FROM p""")
def bayes_flip(spark, d):
    """Percentages of statuses within priorities become shares of priorities within statuses."""
    s = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("category"), F.col("o_orderstatus").alias("field")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("category")
    p = s.withColumn("size", F.sum("n").over(w)).withColumn("percent", 100.0 * F.col("n") / F.col("size"))
    return sm.flipped(p, "category", "size", "percent", "field").select("category", "field", r("probability").alias("probability"))


@query("""WITH a AS (SELECT o_orderstatus, count(*) / sum(count(*)) OVER () AS p FROM orders GROUP BY 1), b AS (SELECT o_orderstatus, o_orderpriority, count(*) / sum(count(*)) OVER (PARTITION BY o_orderstatus) AS q FROM orders GROUP BY 1, 2)
SELECT o_orderstatus, o_orderpriority, round(p * q, 6) AS probability FROM a JOIN b USING (o_orderstatus)""")
def two_table_chain(spark, d):
    """P(status, priority) as the product of a marginal and a conditional table."""
    o = table(spark, d, "orders")
    marginal, conditional = conditional_share(o, [], ["o_orderstatus"]).select("o_orderstatus", "probability"), conditional_share(o, ["o_orderstatus"], ["o_orderpriority"]).select("o_orderstatus", "o_orderpriority", "probability")
    return sm.chained(marginal, conditional, ["o_orderstatus"]).select("o_orderstatus", "o_orderpriority", r("probability").alias("probability"))


@query("""WITH s AS (SELECT c_mktsegment, avg(CASE WHEN c_acctbal <= 0 THEN 1.0 ELSE 0 END) AS a, avg(CASE WHEN c_acctbal > 0 THEN 1.0 ELSE 0 END) + 0.1 AS b FROM customer GROUP BY 1)
SELECT c_mktsegment, 'first_only' AS rule, round(least(greatest(a, 0), 1), 6) AS share FROM s UNION ALL SELECT c_mktsegment, 'sum_first_two', round(least(greatest(a + b, 0), 1), 6) FROM s""")
def binary_rule_shares(spark, d):
    s = table(spark, d, "customer").groupBy("c_mktsegment").agg(F.avg((F.col("c_acctbal") <= 0).cast("double")).alias("a"), (F.avg((F.col("c_acctbal") > 0).cast("double")) + 0.1).alias("b"))
    both = F.array(*(F.struct(F.lit(rule).alias("rule"), r(sm.binary_share(F.col("a"), F.col("b"), rule)).alias("share")) for rule in ("first_only", "sum_first_two")))
    return s.select("c_mktsegment", F.explode(both).alias("x")).select("c_mktsegment", "x.*")


_POPULATION = {"AFRICA": 1460, "AMERICA": 1040, "ASIA": 4780, "EUROPE": 740, "MIDDLE EAST": 490}


@query(f"""WITH p AS (SELECT * FROM (VALUES {', '.join(f"('{k}', {v})" for k, v in _POPULATION.items())}) AS t(r_name, population))
SELECT r_name, CAST(population AS BIGINT) AS population, round(population / (SELECT sum(population) FROM p), 6) AS probability FROM p JOIN region USING (r_name)""")
def constant_population_marginal(spark, d):
    """A marginal from constants, for the regions that the table knows."""
    p = spark.createDataFrame(list(_POPULATION.items()), "r_name string, population long")
    return conditional_share(p, [], ["r_name"], F.col("population")).select("r_name", F.col("n").alias("population"), r("probability").alias("probability")).join(table(spark, d, "region").select("r_name"), "r_name")


def _cdf_sql(name: str, key: str, value: str) -> str:
    return f"""{name}_n AS (SELECT {key} AS k, {value} AS v, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey GROUP BY ALL),
{name}_c AS (SELECT k, v, coalesce(sum(n) OVER (PARTITION BY k ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / sum(n) OVER (PARTITION BY k) AS lo, sum(n) OVER (PARTITION BY k ORDER BY v ROWS UNBOUNDED PRECEDING) / sum(n) OVER (PARTITION BY k) AS hi FROM {name}_n)"""


@query(f"""WITH {_cdf_sql('a', "''", 'c_mktsegment')}, {_cdf_sql('b', 'c_mktsegment', 'o_orderstatus')}, {_cdf_sql('c', "c_mktsegment || '|' || o_orderstatus", 'o_orderpriority')},
r AS (SELECT c_custkey FROM customer),
x AS (SELECT c_custkey, a_c.v AS segment FROM r JOIN a_c ON {u_sql(31, 'c_custkey', 'segment')} >= lo AND {u_sql(31, 'c_custkey', 'segment')} < hi),
y AS (SELECT c_custkey, segment, b_c.v AS status FROM x JOIN b_c ON k = segment AND {u_sql(31, 'c_custkey', 'status')} >= lo AND {u_sql(31, 'c_custkey', 'status')} < hi)
SELECT c_custkey, segment, status, c_c.v AS priority FROM y JOIN c_c ON k = segment || '|' || status AND {u_sql(31, 'c_custkey', 'priority')} >= lo AND {u_sql(31, 'c_custkey', 'priority')} < hi""")
def sampled_rows(spark, d):
    """A synthetic row for each id: segment, status given segment, priority given both, drawn along a checked graph of stages."""
    o = table(spark, d, "orders").join(table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("segment")), "o_custkey").select("segment", F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"))

    def shares(name, *parents):
        keyed = o.withColumn("key", sm.composite(*parents) if parents else F.lit(""))
        return conditional_share(keyed, ["key"], [name]).select("key", name, "probability")

    spec = [{"name": "priority", "table": shares("priority", "segment", "status"), "parents": ("segment", "status")}, {"name": "status", "table": shares("status", "segment"), "parents": ("segment",)}, {"name": "segment", "table": shares("segment")}]
    return sm.sampled(table(spark, d, "customer").select("c_custkey"), "c_custkey", spec, 31)


@query("""WITH l AS (SELECT l_orderkey, l_linenumber, l_quantity > 40 AS b, l_returnflag = 'R' AS f, l_linestatus = 'O' AS u FROM lineitem),
k AS (SELECT *, 100 * CAST(b AS INT) + 100 * CAST(f AS INT) + 10 * CAST(u AS INT) AS penalty FROM l)
SELECT l_orderkey, penalty, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY penalty, l_linenumber) AS rn FROM k) WHERE rn = 1""")
def penalty_ranked_choice(spark, d):
    """One line an order: blocked items and families cost 100, used families 10; then the line's number."""
    return sm.cheapest(table(spark, d, "lineitem"), ["l_orderkey"], F.col("l_quantity") > 40, F.col("l_returnflag") == "R", F.col("l_linestatus") == "O", [F.col("l_linenumber")], ["l_linenumber"])


@query("""WITH t AS (SELECT p_partkey, p_size % 4 AS truth, [p_retailprice % 7, p_retailprice % 11, p_retailprice % 13, p_retailprice % 3] AS p FROM part),
k AS (SELECT p_partkey, truth, list_transform(range(1, 5), lambda i: CAST(list_sum(list_transform(range(1, 5), lambda j: CAST(p[j] > p[i] OR (p[j] = p[i] AND j < i) AS INT))) AS INT)) AS above FROM t)
SELECT p_partkey, above[truth + 1] < 3 AS in_top3, above[truth + 1] < 1 AS in_top1 FROM k""")
def top_k_labels(spark, d):
    """Is the true label among the three likeliest of four?"""
    p = table(spark, d, "part").select("p_partkey", (F.col("p_size") % 4).cast("string").alias("truth"), *((F.col("p_retailprice") % m).alias(f"p{i}") for i, m in enumerate((7, 11, 13, 3))))
    top = lambda k: sm.in_top(list("0123"), ["p0", "p1", "p2", "p3"], F.col("truth"), k)
    return p.select("p_partkey", top(3).alias("in_top3"), top(1).alias("in_top1"))


@query("""WITH m AS (SELECT c_nationkey AS k, avg(c_acctbal) AS v FROM customer GROUP BY 1), p AS (SELECT a.k AS a, b.k AS b, round(abs(a.v - b.v), 4) AS gap FROM m a JOIN m b ON a.k < b.k)
SELECT * FROM (SELECT 'top' AS side, a, b, gap FROM p ORDER BY gap DESC, a, b LIMIT 10) UNION ALL SELECT * FROM (SELECT 'bottom' AS side, a, b, gap FROM p ORDER BY gap, a, b LIMIT 10)""")
def top_and_bottom_pairs(spark, d):
    """The ten pairs of nations that are farthest apart and the ten nearest; pairs are of 25 nations' means."""
    m = table(spark, d, "customer").groupBy("c_nationkey").agg(F.avg("c_acctbal").alias("v"))
    a, b = (m.select(F.col("c_nationkey").alias(x), F.col("v").alias(f"v_{x}")) for x in "ab")
    p = a.join(F.broadcast(b), F.col("a") < F.col("b")).select("a", "b", F.round(F.abs(F.col("v_a") - F.col("v_b")), 4).alias("gap"))
    return p.orderBy(F.desc("gap"), "a", "b").limit(10).withColumn("side", F.lit("top")).unionByName(p.orderBy("gap", "a", "b").limit(10).withColumn("side", F.lit("bottom")))


@query("SELECT c_custkey, c_name, md5(concat_ws('|', '42', CAST(c_custkey AS VARCHAR))) AS shuffle_key FROM customer")
def seeded_shuffle(spark, d):
    return sm.shuffled(table(spark, d, "customer").select("c_custkey", "c_name"), "c_custkey", 42)


@query("SELECT c_custkey, c_name FROM customer ORDER BY md5(concat_ws('|', '42', CAST(c_custkey AS VARCHAR))), c_custkey LIMIT 100")
def seeded_sample(spark, d):
    """A hundred rows by seed, in the order of the table: the limit is what the operator is for."""
    return sm.sample_rows(table(spark, d, "customer").select("c_custkey", "c_name"), "c_custkey", 100, 42)


@query("""WITH e AS (SELECT user_id, event_id, value AS v, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events),
n AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY v, event_id) AS a, row_number() OVER (PARTITION BY user_id ORDER BY k, event_id) AS b FROM e)
SELECT user_id, count(*) AS n, round(corr(a, b), 6) AS spearman FROM n GROUP BY 1""")
def spearman_naive_ranks(spark, d):
    """Ranks by value and place, ties not averaged, and their correlation, user by user."""
    e = table(spark, d, "events").select("user_id", "event_id", F.col("value").alias("v"), F.get_json_object("props", "$.k").cast("long").alias("k"))
    at = lambda c: F.row_number().over(Window.partitionBy("user_id").orderBy(c, "event_id"))
    n = e.withColumn("a", at("v")).withColumn("b", at("k"))
    return n.groupBy("user_id").agg(F.count("*").alias("n"), r(F.corr("a", "b")).alias("spearman"))


@query(f"""WITH u AS (SELECT c_custkey, c_acctbal, c_mktsegment, {u_sql(37, 'c_custkey', 'budget')} AS a, {u_sql(37, 'c_custkey', 'support')} AS b, {u_sql(37, 'c_custkey', 'pace')} AS c FROM customer),
f AS (SELECT *, CASE WHEN c_acctbal < 0 THEN ['counts every cost', 'plans ahead'][CAST(floor(a * 2) AS INT) + 1] WHEN c_acctbal > 5000 THEN ['keeps a reserve', 'spends on space', 'spends on time'][CAST(floor(a * 3) AS INT) + 1] ELSE ['weighs fixed costs', 'adjusts month by month'][CAST(floor(a * 2) AS INT) + 1] END AS budget FROM u)
SELECT c_custkey, budget, ['space', 'time', 'money'][CAST(floor(b * 3) AS INT) + 1] AS support, CASE WHEN budget = 'plans ahead' THEN ['slow', 'steady'][CAST(floor(c * 2) AS INT) + 1] WHEN c_mktsegment = 'BUILDING' THEN ['brisk', 'steady'][CAST(floor(c * 2) AS INT) + 1] END AS pace FROM f""")
def conditional_facts(spark, d):
    """Facts of a row, drawn evenly among what its columns and earlier facts allow."""
    balance = F.col("c_acctbal")
    facts = {
        "budget": [(balance < 0, ["counts every cost", "plans ahead"]), (balance > 5000, ["keeps a reserve", "spends on space", "spends on time"]), (None, ["weighs fixed costs", "adjusts month by month"])],
        "support": [(None, ["space", "time", "money"])],
        "pace": [(F.col("budget") == "plans ahead", ["slow", "steady"]), (F.col("c_mktsegment") == "BUILDING", ["brisk", "steady"])],
    }
    return sm.conditional_facts(table(spark, d, "customer"), "c_custkey", facts, 37).select("c_custkey", *facts)


_POOLS = {name: [(f"{name}{k}", f"{name}-{k % 2}") for k in range(4)] for name in ("body", "craft", "local", "mind", "rest")}


def _plan_sql(key: str, attempt: str) -> str:
    """Numbers of the items of each pool, as a list."""
    return "[" + ", ".join(f"CAST(floor(CAST('0x' || substr(md5(concat_ws('|', '41', CAST({key} AS VARCHAR), '{name}' || {attempt})), 1, 8) AS BIGINT) / 4294967296.0 * 4) AS INT)" for name in _POOLS) + "]"


_NAMES = "['" + "', '".join(_POOLS) + "']"
_ITEMS, _FAMILIES = (f"list_transform(range(1, 6), lambda j: {_NAMES}[j] || {end})" for end in ("k[j]", "'-' || k[j] % 2"))


@query(f"""WITH o AS (SELECT {_plan_sql("'old' || s_suppkey", '0')} AS k FROM supplier), s AS (SELECT array_to_string({_ITEMS}, ',') AS i, array_to_string({_FAMILIES}, ',') AS f FROM o),
n AS (SELECT item, count(*) AS n FROM (SELECT unnest({_ITEMS}) AS item FROM o) GROUP BY 1),
p AS (SELECT c_custkey, CAST(a AS INT) AS attempt, {_plan_sql('c_custkey', 'a')} AS k FROM customer, range(24) AS t(a)),
q AS (SELECT c_custkey, attempt, array_to_string({_ITEMS}, ',') AS i, array_to_string({_FAMILIES}, ',') AS f, {_ITEMS} AS items FROM p),
w AS (SELECT c_custkey, attempt, sum(coalesce(n, 0)) AS pressure FROM (SELECT c_custkey, attempt, unnest(items) AS item FROM q) LEFT JOIN n USING (item) GROUP BY ALL),
x AS (SELECT q.*, CAST(f IN (SELECT f FROM s) AS INT) AS family_seen, CAST(i IN (SELECT i FROM s) AS INT) AS exact_seen, pressure + CAST('0x' || substr(md5(concat_ws('|', '41', CAST(c_custkey AS VARCHAR), 'tie' || attempt)), 1, 8) AS BIGINT) / 4294967296.0 AS pressure FROM q JOIN w USING (c_custkey, attempt)),
y AS (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY family_seen, exact_seen, CASE WHEN family_seen + exact_seen = 0 THEN attempt ELSE pressure END, attempt) AS rn FROM x)
SELECT c_custkey, attempt, i AS plan, family_seen, exact_seen FROM y WHERE rn = 1""")
def activity_plan_refresh(spark, d):
    """Five activities a customer, one of each pool, unlike those of the suppliers' plans as far as 24 tries allow."""
    old = table(spark, d, "supplier").select(F.array(*(F.floor(uniform_at(41, F.concat(F.lit("old"), "s_suppkey"), name, F.lit(0)) * 4).cast("int") for name in _POOLS)).alias("k"))
    at = lambda x: F.array(*(F.element_at(F.array(*(F.lit(e[x]) for e in pool)), F.col("k")[j] + 1) for j, pool in enumerate(_POOLS.values())))
    seen = old.select(at(0).alias("items"), at(1).alias("families"))
    counts = seen.select(F.explode("items").alias("item")).groupBy("item").agg(F.count("*").alias("n"))
    best = sm.refreshed_plans(table(spark, d, "customer"), "c_custkey", _POOLS, seen, counts, 41)
    return best.select("c_custkey", "attempt", F.array_join("items", ",").alias("plan"), "family_seen", "exact_seen")


_FEASIBLE = """x AS (SELECT c_custkey, 20 + c_nationkey % 5 * 10 AS age_lo, 29 + c_nationkey % 5 * 10 AS age_hi, CAST(ascii(c_mktsegment) % 5 * 5 AS INT) AS career_lo, CAST(ascii(c_mktsegment) % 5 * 5 + 4 AS INT) AS career_hi, CAST(15 + c_custkey % 4 AS INT) AS start FROM customer),
f AS (SELECT *, greatest(age_lo, career_lo + start) AS lo FROM x)"""


@query(f"""WITH {_FEASIBLE}, a AS (SELECT *, lo + CAST(floor({u_sql(61, 'c_custkey', 'age')} * (age_hi - lo + 1)) AS INT) AS age FROM f WHERE lo <= age_hi),
y AS (SELECT *, least(career_hi, age - start) AS hi FROM a), q AS (SELECT CAST(l_quantity AS INT) AS v, count(*) AS w FROM lineitem GROUP BY 1),
c AS (SELECT c_custkey, v, sum(w) OVER (PARTITION BY c_custkey ORDER BY v) AS upto, sum(w) OVER (PARTITION BY c_custkey) AS total FROM y JOIN q ON v BETWEEN age % 40 AND age % 40 + 9)
SELECT y.c_custkey, age, career_lo + CAST(floor({u_sql(61, 'c_custkey', 'years')} * (hi - career_lo + 1)) AS INT) AS years, (SELECT min(v) FROM c WHERE c.c_custkey = y.c_custkey AND upto > {u_sql(61, 'y.c_custkey', 'quantity')} * total) AS quantity FROM y""")
def feasible_career_draws(spark, d):
    """Ages that leave room for a career, years that the age leaves room for, and a quantity drawn inside an interval of the row's own."""
    n, key = F.col("c_nationkey"), F.col("c_custkey")
    career = F.ascii("c_mktsegment") % 5 * 5
    rows = table(spark, d, "customer").select("c_custkey", (20 + n % 5 * 10).alias("age_lo"), (29 + n % 5 * 10).alias("age_hi"), career.alias("career_lo"), (career + 4).alias("career_hi"), (15 + key % 4).cast("int").alias("start"))
    lo, hi, some = sm.feasible_ages(*(F.col(c) for c in ("age_lo", "age_hi", "career_lo", "start")))
    aged = rows.filter(some).withColumn("age", sm.drawn_within(lo, hi, s.uniform(61, key, "age"), "age"))
    aged = aged.withColumn("years", sm.career_years(F.col("career_lo"), F.col("career_hi"), F.col("age") - F.col("start"), s.uniform(61, key, "years")))
    quantities = table(spark, d, "lineitem").groupBy(F.col("l_quantity").cast("int").alias("v")).agg(F.count("*").alias("w"))
    drawn = sm.truncated_draw(aged, quantities, "v", "w", F.col("age") % 40, F.col("age") % 40 + 9, s.uniform(61, key, "quantity"), "quantity")
    return drawn.select("c_custkey", "age", "years", "quantity")
