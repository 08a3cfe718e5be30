"""Rows and texts: phrases, rules, duplicates, fill rates, coverage, JSON fields, windows over events, releases, gates, streams."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from .catalog import query, r, shared_folder, table
from .functions import scalar as s
from .streaming.dedupe import dedupe_stream

PHRASES = {"license": "licensed under", "phone": r"\+1 \(", "pipes": r" \| ", "long_number": "[0-9]{9,}"}


@query("SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{k}' AS phrase, CAST(coalesce(sum(len(regexp_extract_all(lower(text), '{p}'))), 0) AS BIGINT) AS hits, round(avg(CAST(regexp_matches(lower(text), '{p}') AS INT)), 6) AS row_share, round(coalesce(sum(len(regexp_extract_all(lower(text), '{p}'))), 0) / count(*), 6) AS hits_per_row FROM documents" for k, p in PHRASES.items()) + ")")
def phrase_hits_and_frequency(spark, d):
    """Hits and the share of rows with a hit, for every phrase in one scan."""
    low = table(spark, d, "documents").select(F.lower("text").alias("t"))
    counts = low.select(*(F.regexp_count("t", F.lit(p)).alias(k) for k, p in PHRASES.items()))
    long = counts.unpivot([], list(PHRASES), "phrase", "n")
    return long.groupBy("phrase").agg(F.sum("n").cast("long").alias("hits"), r(F.avg((F.col("n") > 0).cast("int"))).alias("row_share"), r(F.avg("n")).alias("hits_per_row"))


RULES = {"TOO_SHORT": ("error", "n_chars < 60"), "LOW_QUALITY": ("warning", "quality = 0"), "TOXIC": ("error", "toxic = 1"), "NO_LANGUAGE": ("warning", "lang is null"), "ODD_LENGTH": ("info", "n_chars > 20000")}


@query("WITH x AS (SELECT * FROM documents LEFT JOIN labels USING (doc_id)), i AS (" + " UNION ALL ".join(f"SELECT doc_id, '{k}' AS code, '{sev}' AS severity FROM x WHERE {c}" for k, (sev, c) in RULES.items()) + ") SELECT code, severity, count(*) AS issues, count(DISTINCT doc_id) AS docs FROM i GROUP BY 1, 2")
def rule_issue_counts(spark, d):
    """Each rule yields an issue struct or nothing; a row's issues are one array in rule order."""
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    issues = F.array_compact(F.array(*(F.when(F.expr(c), F.struct(F.lit(sev).alias("severity"), F.lit(k).alias("code"))) for k, (sev, c) in RULES.items())))
    return rows.select("doc_id", F.explode(issues).alias("x")).groupBy("x.code", "x.severity").agg(F.count("*").alias("issues"), F.count_distinct("doc_id").alias("docs"))


@query("SELECT doc_id, md5(regexp_replace(regexp_replace(text, 'licensed|license|public', '[FIELD]', 'g'), '[0-9]+', '[NUMBER]', 'g')) AS masked FROM documents")
def label_masking(spark, d):
    text = F.regexp_replace(s.masked(F.col("text"), ["license", "public", "licensed"], "[FIELD]"), "[0-9]+", "[NUMBER]")
    return table(spark, d, "documents").select("doc_id", F.md5(text).alias("masked"))


_TOKENS = "list_distinct(regexp_extract_all(lower(text), '[가-힣a-z0-9]+'))"


@query(f"""WITH k AS (SELECT doc_id, source, {_TOKENS} AS t FROM documents), p AS (SELECT source, t, lead(t) OVER (PARTITION BY source ORDER BY doc_id) AS o FROM k),
j AS (SELECT source, CASE WHEN len(t) + len(o) = 0 THEN 1.0 ELSE len(list_intersect(t, o)) / len(list_distinct(list_concat(t, o))) END AS x FROM p WHERE o IS NOT NULL)
SELECT source, count(*) AS pairs, round(avg(x), 6) AS mean, round(max(x), 6) AS max, round(avg(CAST(x > 0.85 AS INT)), 6) AS share_above FROM j GROUP BY source""")
def token_jaccard_pairs(spark, d):
    """Similarity of documents that follow each other within a source."""
    docs = table(spark, d, "documents")
    # ids alone go through the window; the texts meet by joins
    partner = docs.select("source", "doc_id", F.lead("doc_id").over(Window.partitionBy("source").orderBy("doc_id")).alias("other")).filter("other is not null")
    tokens = docs.select("doc_id", s.token_set(F.col("text")).alias("t"))
    met = partner.join(tokens, "doc_id").join(tokens.select(F.col("doc_id").alias("other"), F.col("t").alias("o")), "other")
    pairs = met.select("source", s.jaccard(F.col("t"), F.col("o")).alias("x"))
    return pairs.groupBy("source").agg(F.count("*").alias("pairs"), r(F.avg("x")).alias("mean"), r(F.max("x")).alias("max"), r(F.avg((F.col("x") > 0.85).cast("int"))).alias("share_above"))


@query("SELECT count(*) AS n_rows, CAST(sum(n - 1) AS BIGINT) AS extras, CAST(sum(CASE WHEN n > 1 THEN n ELSE 0 END) AS BIGINT) AS in_groups, max(n) AS largest, count(*) AS texts FROM (SELECT text, count(*) AS n FROM documents GROUP BY text)".replace("count(*) AS n_rows", "CAST(sum(n) AS BIGINT) AS n_rows"))
def exact_duplicates(spark, d):
    groups = table(spark, d, "documents").groupBy(F.sha2("text", 256).alias("k")).agg(F.count("*").alias("n"))
    return groups.agg(F.sum("n").alias("n_rows"), F.sum(F.col("n") - 1).alias("extras"), F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)).alias("in_groups"), F.max("n").alias("largest"), F.count("*").alias("texts"))


@query("""WITH a AS (SELECT trim(unnest(string_split(text, ','))) AS atom FROM documents), c AS (SELECT atom, count(*) AS n FROM a WHERE atom <> '' GROUP BY 1)
SELECT atom, n, round(n / (SELECT sum(n) FROM c), 6) AS share FROM c ORDER BY n DESC, atom LIMIT 10""")
def atom_topk_share(spark, d):
    atoms = table(spark, d, "documents").select(F.explode(F.split("text", ",")).alias("a")).select(F.trim("a").alias("atom")).filter("atom <> ''")
    counts = atoms.groupBy("atom").agg(F.count("*").alias("n"))
    return counts.crossJoin(F.broadcast(counts.agg(F.sum("n").alias("total")))).select("atom", "n", r(F.col("n") / F.col("total")).alias("share")).orderBy(F.desc("n"), "atom").limit(10)


_FILLED = ["text", "lang", "source", "n_chars", "quality", "toxic"]


@query(" UNION ALL ".join(f"SELECT '{c}' AS field, round(avg(CAST({c} IS NOT NULL AS INT)), 6) AS fill_rate FROM documents LEFT JOIN labels USING (doc_id)" for c in _FILLED))
def fill_rates_unpivot(spark, d):
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    return rows.agg(*(r(F.avg(F.col(c).isNotNull().cast("int"))).alias(c) for c in _FILLED)).unpivot([], _FILLED, "field", "fill_rate")


@query("SELECT round(avg(CAST(regexp_matches(lower(html), 'placeholder|lorem|todo|track\\(0\\)') AS INT)), 6) AS rate, count(*) AS n FROM pages")
def placeholder_rate(spark, d):
    return table(spark, d, "pages").agg(r(F.avg(F.lower("html").rlike(r"placeholder|lorem|todo|track\(0\)").cast("int"))).alias("rate"), F.count("*").alias("n"))


_VOC = "SELECT DISTINCT unnest(list_filter(regexp_split_to_array(lower(text), '[^a-z]+'), lambda x: length(x) >= 6)) AS term FROM benchmark"


@query(f"""WITH v AS ({_VOC}), t AS (SELECT DISTINCT source, unnest(regexp_split_to_array(lower(text), '[^a-z]+')) AS term FROM documents)
SELECT source, count(v.term) AS used, round(count(v.term) / (SELECT count(*) FROM v), 6) AS coverage FROM t LEFT JOIN v USING (term) GROUP BY source""")
def vocabulary_coverage(spark, d):
    terms = lambda name: table(spark, d, name).select("*", F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("term"))
    vocabulary = terms("benchmark").filter(F.length("term") >= 6).select("term").distinct().withColumn("known", F.lit(1))
    used = terms("documents").select("source", "term").distinct().join(vocabulary, "term", "left").groupBy("source").agg(F.count("known").alias("used"))
    return used.crossJoin(F.broadcast(vocabulary.agg(F.count("*").alias("size")))).select("source", "used", r(F.col("used") / F.col("size")).alias("coverage"))


@query("""WITH w AS (SELECT list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT n, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) AS g FROM w, range(1, 4) AS t(n))
SELECT CAST(n AS INT) AS n, count(*) AS grams, count(DISTINCT g) AS different, round(count(DISTINCT g) / count(*), 6) AS distinct_n FROM g GROUP BY n""")
def distinct_n(spark, d):
    """Grams are counted by 96 bits of hashes of their words, so no text is shuffled."""
    w = table(spark, d, "documents").select(F.transform(s.words(F.col("text")), lambda x: F.xxhash64(x)).alias("w"))
    window = lambda n: f"transform(sequence(0, greatest(size(w) - {n}, -1)), i -> struct({n} as n, xxhash64({', '.join(f'w[i + {k}]' for k in range(n))}) as g, hash({', '.join(f'w[i + {k}]' for k in range(n))}) as h))"
    every = F.concat(*(F.expr(f"if(size(w) >= {n}, {window(n)}, array())") for n in (1, 2, 3)))
    grams = w.select(F.explode(every).alias("x")).select("x.*")
    counts = grams.groupBy("n", "g", "h").agg(F.count("*").alias("c")).groupBy("n").agg(F.sum("c").alias("grams"), F.count("*").alias("different"))
    return counts.withColumn("distinct_n", r(F.col("different") / F.col("grams")))


@query("SELECT event_type, count(*) AS n, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS total FROM events GROUP BY 1")
def json_props_extract(spark, d):
    k = F.from_json(s.json_block(F.col("props")), "k long")["k"]
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum(k).alias("total"))


@query("""WITH x AS (SELECT event_id, user_id, event_type, count(*) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 23 PRECEDING AND CURRENT ROW) AS held, count(*) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS nth FROM events)
SELECT event_id, held, nth > 4 AS capped FROM x""")
def recent_window_caps(spark, d):
    """How many of a user's last 24 events are held, and whether the user's quota of the type is used up."""
    user = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-23, 0)
    kind = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, d, "events").select("event_id", F.count("*").over(user).alias("held"), (F.count("*").over(kind) > 4).alias("capped"))


@query("SELECT DISTINCT user_id, event_type, props FROM events")
def stream_quota_dedupe(spark, d):
    """The events table as a stream: the first of each (user, type, props) passes."""
    out = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    return dedupe_stream(spark, d, "events.parquet", table(spark, d, "events").schema, ["user_id", "event_type", "props"], out)


@query("""WITH u AS (SELECT o_orderkey AS id, 'first' AS run FROM orders WHERE o_orderstatus <> 'P' UNION ALL SELECT o_orderkey, 'second' FROM orders WHERE o_orderstatus <> 'O'),
k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY run) AS rn FROM u) SELECT run, count(*) AS kept, count(*) FILTER (rn > 1) AS dropped FROM k GROUP BY run""")
def release_union_dedupe(spark, d):
    orders = table(spark, d, "orders")
    part = lambda run, out: orders.filter(F.col("o_orderstatus") != out).select(F.col("o_orderkey").alias("id"), F.lit(run).alias("run"))
    ranked = part("first", "P").unionByName(part("second", "O")).withColumn("rn", F.row_number().over(Window.partitionBy("id").orderBy("run")))
    return ranked.groupBy("run").agg(F.count("*").alias("kept"), F.count_if(F.col("rn") > 1).alias("dropped"))


@query("SELECT doc_id, sha256(text) AS digest FROM documents")
def manifest_sha256(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))


GATES = {"toxic_rate": ("avg(toxic)", "<=", 0.2), "quality_rate": ("avg(quality)", ">=", 0.7), "labelled": ("count(*)", ">", 10)}


@query(" UNION ALL ".join(f"SELECT '{k}' AS gate, round(({e}) :: DOUBLE, 6) AS observed, {t} :: DOUBLE AS threshold, ({e}) {c} {t} AS passed FROM labels" for k, (e, c, t) in GATES.items()))
def gate_checks(spark, d):
    seen = table(spark, d, "labels").agg(*(F.expr(e).cast("double").alias(k) for k, (e, _, _) in GATES.items()))
    checks = F.array(*(F.struct(F.lit(k).alias("gate"), r(k).alias("observed"), F.lit(float(t)).alias("threshold"), F.expr(f"{k} {c} {t}").alias("passed")) for k, (_, c, t) in GATES.items()))
    return seen.select(F.explode(checks).alias("x")).select("x.*")
