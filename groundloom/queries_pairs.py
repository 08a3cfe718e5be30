"""Candidates, partners and random pairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from .catalog import query, r, table
from .functions import scalar as s
from .operators import ranking as rk
from .queries_grounding import u_sql


def nested_sql(rows: str, key: str, levels: list[str], seed: int, stage: str, count: int) -> str:
    """CTEs ending in ``cand`` (key, candidate, step, level): see ``ranking.nested_candidates``."""
    order = ", ".join(f"{c} NULLS FIRST" for c in levels)
    depth, parts = len(levels) + 1, []
    for i in range(1, depth + 1):
        over = f"PARTITION BY {', '.join(levels[: depth - i])}" if i < depth else ""
        parts.append(f"count(*) OVER ({over}) AS n{i}, min(spot) OVER ({over}) AS a{i}")
    need = [f"least({count - 1}{''.join(f' - t{j}' for j in range(1, i))}, {'n1 - 1' if i == 1 else f'n{i} - n{i - 1}'}) AS t{i}" for i in range(1, depth + 1)]
    cases, levels_of = [], []
    for i in range(1, depth + 1):
        before = " + ".join(["0", *(f"t{j}" for j in range(1, i))])
        here = f"step > {before} AND step <= {before} + t{i}"
        if i == 1:
            spot = "a1 + (spot - a1 + step) % n1"
        else:
            free = f"(n{i} - n{i - 1})"
            x = f"(CAST(floor({u_sql(seed, key, f'{stage}{i}')} * {free}) AS BIGINT) + (step - ({before}) - 1) * {free} // t{i}) % {free}"
            spot = f"a{i} + {x} + CASE WHEN a{i} + {x} >= a{i - 1} THEN n{i - 1} ELSE 0 END"
        cases.append(f"WHEN {here} THEN {spot}")
        levels_of.append(f"WHEN {here} THEN {i}")
    total = " + ".join(f"t{i}" for i in range(1, depth + 1))
    return f"""placed AS (SELECT *, row_number() OVER (ORDER BY {order}, {u_sql(seed, key, stage)}, {key}) - 1 AS spot FROM {rows}),
bounds AS (SELECT *, {', '.join(parts)} FROM placed), needs AS (SELECT *, {', '.join(need)} FROM bounds),
asked AS (SELECT {key}, step, CASE {' '.join(levels_of)} ELSE 0 END AS level, CASE {' '.join(cases)} ELSE spot END AS goal FROM needs, range(0, {count}) AS steps(step) WHERE step <= {total}),
cand AS (SELECT asked.{key}, placed.{key} AS candidate, step, level FROM asked JOIN placed ON placed.spot = asked.goal)"""


def pairs_sql(rows: str, key: str, group: str | None, most: int, seed: int, stage: str = "pairs") -> str:
    """CTEs ending in ``pairs`` (g, turn, first, second): see ``ranking.random_pairs``. The WITH before them must be recursive."""
    g = group or "0"
    shift = lambda k, v: f"CAST('0x' || substr(md5('{seed}/{k}|' || {v}), 1, 15) AS BIGINT)"

    def once(source: str) -> str:
        for k in range(2 * rk.ROUNDS):
            x, y = (f"(x + {shift(k, 'y')}) % n", "y") if k % 2 == 0 else ("x", f"(y + {shift(k, 'x')}) % h")
            source = f"(SELECT g, n, h, turn, {x} AS x, {y} AS y FROM {source})"
        return source

    bad = "n % 2 = 0 AND y = h - 1 AND x >= h"
    return f"""numbers AS (SELECT {key} AS key, {g} AS g, row_number() OVER (PARTITION BY {g} ORDER BY {u_sql(seed, key, stage)}, {key}) - 1 AS spot FROM {rows}),
counts AS (SELECT g, count(*) AS n, count(*) // 2 AS h FROM numbers GROUP BY g HAVING count(*) > 1),
turns AS (SELECT g, n, h, unnest(range(0, least({most}, n * (n - 1) // 2))) AS turn FROM counts),
begun AS (SELECT g, n, h, turn, turn % n AS x, turn // n AS y FROM turns),
walk AS (SELECT * FROM {once('begun')} UNION ALL SELECT * FROM {once(f'(SELECT * FROM walk WHERE {bad})')}),
chosen AS (SELECT g, turn, x AS i, (x + y + 1) % n AS j FROM walk WHERE NOT ({bad})),
pairs AS (SELECT c.g, c.turn, a.key AS first, b.key AS second FROM chosen c JOIN numbers a ON a.g IS NOT DISTINCT FROM c.g AND a.spot = c.i JOIN numbers b ON b.g IS NOT DISTINCT FROM c.g AND b.spot = c.j)"""


@query(f"""WITH {nested_sql('customer', 'c_custkey', ['c_mktsegment', 'c_nationkey'], 9, 'ring', 2)}
SELECT c_custkey, candidate AS partner, level FROM cand WHERE step = 1""")
def hard_negative_partner(spark, d):
    """Another row of the same segment and nation, else of the same segment, else any; never the row itself."""
    rows = table(spark, d, "customer")
    found = rk.nested_candidates(rows, "c_custkey", ["c_mktsegment", "c_nationkey"], s.uniform(9, F.col("c_custkey"), "ring"), 2, 9)
    return found.filter("step = 1").select("c_custkey", F.col("candidate").alias("partner"), "level")


@query(f"""WITH x AS (SELECT p_partkey, p_brand, p_size FROM part), {nested_sql('x', 'p_partkey', ['p_brand', 'p_size'], 19, 'cand', 10)}
SELECT p_partkey, candidate, step, level FROM cand""")
def nested_candidate_lists(spark, d):
    """Each part with nine others: of its brand and size as long as there are, then of its brand, then any."""
    return rk.nested_candidates(table(spark, d, "part"), "p_partkey", ["p_brand", "p_size"], s.uniform(19, F.col("p_partkey"), "cand"), 10, 19, "cand")


_SET = "list_distinct(regexp_extract_all(lower({}), '[가-힣a-z0-9]+'))"
_REPORT = "count(*) AS pairs_compared, round(coalesce(avg(x), 0), 6) AS mean_similarity, round(coalesce(max(x), 0), 6) AS max_similarity, round(coalesce(avg(CAST(x > 0.85 AS INT)), 0), 6) AS pct_above_threshold"


def _rounded(report, *keep):
    return report.select(*keep, "pairs_compared", *(r(c).alias(c) for c in ("mean_similarity", "max_similarity", "pct_above_threshold")))


@query(f"""WITH RECURSIVE {pairs_sql('documents', 'doc_id', 'source', 500, 3)},
j AS (SELECT p.g, {_SET.format('a.text')} AS s, {_SET.format('b.text')} AS t FROM pairs p JOIN documents a ON a.doc_id = p.first JOIN documents b ON b.doc_id = p.second),
v AS (SELECT g, CASE WHEN len(s) + len(t) = 0 THEN 1.0 ELSE len(list_intersect(s, t)) / len(list_distinct(list_concat(s, t))) END AS x FROM j)
SELECT g AS source, {_REPORT} FROM v GROUP BY g""")
def random_pair_similarity(spark, d):
    """Token overlap of 500 random pairs of documents of each source."""
    docs = table(spark, d, "documents")
    pairs = rk.random_pairs(docs, "doc_id", ["source"], 500, 3)
    # ids first: only texts of drawn pairs are cut into tokens
    drawn = pairs.select(F.explode(F.array("first", "second")).alias("doc_id")).distinct()
    tokens = docs.join(rk.sized(drawn), "doc_id", "left_semi").select("doc_id", s.token_set(F.coalesce(F.col("text"), F.lit(""))).alias("t"))
    met = pairs.join(tokens.select(F.col("doc_id").alias("first"), F.col("t").alias("a")), "first").join(tokens.select(F.col("doc_id").alias("second"), F.col("t").alias("b")), "second")
    return _rounded(rk.similarity_report(met.select("source", s.jaccard(F.col("a"), F.col("b")).alias("x")), ["source"], "x", 0.85), "source")


@query(f"""WITH RECURSIVE {pairs_sql('embeddings', 'vec_id', None, 1000, 5)},
v AS (SELECT list_cosine_similarity(a.embedding :: DOUBLE[], b.embedding :: DOUBLE[]) AS x FROM pairs p JOIN embeddings a ON a.vec_id = p.first JOIN embeddings b ON b.vec_id = p.second)
SELECT {_REPORT} FROM v""")
def random_pair_cosine(spark, d):
    """Cosines of 1,000 random pairs of vectors."""
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    pairs = rk.random_pairs(e, "vec_id", [], 1000, 5)
    met = rk.sized(pairs).join(e.select(F.col("vec_id").alias("first"), F.col("v").alias("a")), "first").join(e.select(F.col("vec_id").alias("second"), F.col("v").alias("b")), "second")
    norm = lambda c: F.sqrt(s.dot(F.col(c), F.col(c)))
    return _rounded(rk.similarity_report(met.select((s.dot(F.col("a"), F.col("b")) / norm("a") / norm("b")).alias("x")), [], "x", 0.85))
