"""Checks of rows and tables, text joins, keys, judge documents, bundles and deltas over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from .catalog import query, r, table
from .operators import checks as ck
from .operators.statistics import quadratic_kappa

_RULES = [ck.Rule("c_custkey", low=1), ck.Rule("c_name", lengths=(10, 30)), ck.Rule("c_nationkey", low=0, high=24), ck.Rule("c_acctbal", low=0, high=9000), ck.Rule("c_mktsegment", values=("AUTOMOBILE", "BUILDING", "FURNITURE", "MACHINERY"))]


@query("""WITH f AS (SELECT c_nationkey, CAST(NOT (c_custkey >= 1) AS INT) + CAST(length(c_name) NOT BETWEEN 10 AND 30 AS INT) + CAST(c_nationkey NOT BETWEEN 0 AND 24 AS INT) + CAST(c_acctbal NOT BETWEEN 0 AND 9000 AS INT)
+ CAST(c_mktsegment NOT IN ('AUTOMOBILE', 'BUILDING', 'FURNITURE', 'MACHINERY') AS INT) AS faults FROM customer)
SELECT c_nationkey, count(*) AS n, count(*) FILTER (faults = 0) AS passed, CAST(sum(faults) AS BIGINT) AS faults, round(count(*) FILTER (faults = 0) / count(*), 6) AS pass_rate FROM f GROUP BY 1""")
def schema_pass_rate(spark, d):
    """Rows that keep all declared types, ranges, lengths and values, by nation."""
    c = ck.require(table(spark, d, "customer"), ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"])
    return ck.pass_rate(c, _RULES, ["c_nationkey"]).withColumn("pass_rate", r("pass_rate"))


@query("""WITH f AS (SELECT list_filter([CASE WHEN c_custkey < 1 THEN 'c_custkey:range' END, CASE WHEN c_acctbal NOT BETWEEN 0 AND 9000 THEN 'c_acctbal:range' END, CASE WHEN c_mktsegment NOT IN ('AUTOMOBILE', 'BUILDING', 'FURNITURE', 'MACHINERY') THEN 'c_mktsegment:value' END], lambda x: x IS NOT NULL) AS codes FROM customer), e AS (SELECT unnest(codes) AS code FROM f)
SELECT code, count(*) AS n FROM e GROUP BY code""")
def schema_fault_codes(spark, d):
    c = table(spark, d, "customer")
    return c.select(F.explode(ck.violations(c, _RULES)).alias("code")).groupBy("code").agg(F.count("*").alias("n"))


@query("""SELECT count(DISTINCT c_custkey) AS n_left, (SELECT count(DISTINCT o_custkey) FROM orders) AS n_right, count(*) FILTER (c_custkey NOT IN (SELECT o_custkey FROM orders)) AS only_left, (SELECT count(DISTINCT o_custkey) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)) AS only_right FROM customer""")
def id_set_equality(spark, d):
    return ck.id_differences(table(spark, d, "customer").select(F.col("c_custkey").alias("id")), table(spark, d, "orders").select(F.col("o_custkey").alias("id")), "id")


@query("SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON r_regionkey = n_regionkey")
def context_join_or_error(spark, d):
    """Every nation must find its region."""
    regions = table(spark, d, "region").select(F.col("r_regionkey").alias("n_regionkey"), "r_name")
    return ck.joined_or_error(table(spark, d, "nation"), F.broadcast(regions), "n_regionkey", "r_name").select("n_nationkey", "n_name", "r_name")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)")
def semi_join_ids(spark, d):
    wanted = table(spark, d, "orders").filter("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").join(wanted, "c_custkey", "left_semi").select("c_custkey", "c_name")


@query("""WITH a AS (SELECT DISTINCT CAST(c_nationkey AS INT) AS value FROM customer WHERE c_acctbal > 9900), b AS (SELECT DISTINCT s_nationkey AS value FROM supplier)
SELECT value, 'left' AS side FROM a WHERE value NOT IN (SELECT value FROM b) UNION ALL SELECT value, 'right' FROM b WHERE value NOT IN (SELECT value FROM a)""")
def category_set_difference(spark, d):
    rich = table(spark, d, "customer").filter("c_acctbal > 9900").select(F.col("c_nationkey").alias("n"))
    return ck.set_differences(rich, table(spark, d, "supplier").select(F.col("s_nationkey").alias("n")), "n")


_CLASSES = {"1-URGENT": "high", "2-HIGH": "high", "3-MEDIUM": "middle", "4-NOT SPECIFIED": "low", "5-LOW": "low"}


@query("SELECT o_orderkey, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'high' WHEN o_orderpriority = '3-MEDIUM' THEN 'middle' ELSE 'low' END AS class FROM orders")
def mapped_classes(spark, d):
    """Priorities by class; one without a class would fail the query."""
    return table(spark, d, "orders").select("o_orderkey", ck.mapped(F.col("o_orderpriority"), _CLASSES).alias("class"))


@query("""SELECT c_custkey, c_name || ' ' || CASE WHEN c_acctbal > 0 THEN c_mktsegment ELSE '' END || ' ' || '' AS kept, CASE WHEN c_acctbal > 0 THEN c_name || ' ' || c_mktsegment ELSE c_name END AS stripped, CAST(NULL AS VARCHAR) AS unsupported FROM customer""")
def text_joins(spark, d):
    """Columns joined with blanks kept, and stripped with empty ones dropped; a column that isn't supported is null."""
    c = table(spark, d, "customer").withColumn("b", F.when(F.col("c_acctbal") > 0, F.col("c_mktsegment"))).withColumn("e", F.lit("  ")).withColumn("unsupported", F.lit("x"))
    cols = [F.coalesce(F.col(x), F.lit("")) for x in ("c_name", "b", "unsupported_")]
    c = c.withColumn("unsupported_", F.lit(None).cast("string"))
    stripped = F.array_join(F.filter(F.transform(F.array("c_name", "b", "e"), lambda x: F.trim(F.coalesce(x, F.lit("")))), lambda x: x != ""), " ")
    return ck.restricted(c.withColumn("kept", F.concat_ws(" ", *cols)).withColumn("stripped", stripped), ["c_custkey", "kept", "stripped", "unsupported"], ("unsupported",))


@query("""SELECT page_id, substr(trim(regexp_replace(html, '\\s+', ' ', 'g')), 1, 100) AS excerpt, replace(replace(replace(url, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS escaped FROM pages""")
def excerpts_and_escapes(spark, d):
    one_line = F.trim(F.regexp_replace("html", r"\s+", " "))
    escaped = F.replace(F.replace(F.replace(F.col("url"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return table(spark, d, "pages").select("page_id", F.substring(one_line, 1, 100).alias("excerpt"), escaped.alias("escaped"))


@query("""WITH e AS (SELECT event_id, event_type, CAST(json_extract_string(props, '$.k') AS INT) % 12 AS score FROM events)
SELECT event_type, round(avg(score), 6) AS mean, round(avg(CAST(score < 5 AS INT)), 6) AS low_share, round(avg(CAST(score >= 8 AS INT)), 6) AS high_share, count(*) FILTER (score = 0) AS issues FROM e GROUP BY 1""")
def score_list_statistics(spark, d):
    """Mean, share below 5, share of 8 and more, rows with an issue."""
    e = table(spark, d, "events").withColumn("score", F.get_json_object("props", "$.k").cast("int") % 12)
    return e.groupBy("event_type").agg(r(F.avg("score")).alias("mean"), r(F.avg((F.col("score") < 5).cast("int"))).alias("low_share"), r(F.avg((F.col("score") >= 8).cast("int"))).alias("high_share"), F.count_if(F.col("score") == 0).alias("issues"))


@query("""WITH t AS (SELECT role, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS n FROM conversations)
SELECT role, count(*) AS calls, CAST(sum(n) AS BIGINT) AS tokens, round(sum(n) * CASE WHEN role = 'assistant' THEN 3 ELSE 1 END / 1000.0, 6) AS cost FROM t GROUP BY role""")
def token_and_cost_totals(spark, d):
    t = table(spark, d, "conversations").withColumn("n", F.size(F.array_remove(F.split("text", r"\s+"), "")))
    price = F.when(F.col("role") == "assistant", 3).otherwise(1)
    return t.groupBy("role").agg(F.count("*").alias("calls"), F.sum("n").alias("tokens")).withColumn("cost", r(F.col("tokens") * price / 1000.0))


@query("SELECT a.vec_id, round(list_sum(list_transform(range(1, len(a.embedding) + 1), lambda i: CAST(a.embedding[i] AS DOUBLE) * b.embedding[i])), 5) AS dot FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def embedding_similarity(spark, d):
    """Inner products of each vector with the next one's."""
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("a"))
    pairs = e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("b")), "vec_id")
    return pairs.select("vec_id", F.round(F.expr("aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x)"), 5).alias("dot"))


@query("""WITH v AS (SELECT c_name AS value FROM customer UNION ALL SELECT c_mktsegment FROM customer)
SELECT count(*) AS n, count(DISTINCT value) AS different, round(count(DISTINCT value) / count(*), 6) AS share FROM v""")
def global_uniqueness(spark, d):
    return ck.different_share(table(spark, d, "customer"), ["c_name", "c_mktsegment"]).withColumn("share", r("share"))


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'old' ELSE 'new' END AS form, CAST(json_extract_string(props, '$.k') AS INT) AS key FROM events""")
def key_alias_repair(spark, d):
    """Answers name a field by an alias or by its name; the repaired one is found under either."""
    raw = F.when(F.col("event_id") % 3 == 0, F.regexp_replace("props", '"k"', '"kk"')).otherwise(F.col("props"))
    at = F.from_json(raw, "kk int, k int")
    return table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 3 == 0, "old").otherwise("new").alias("form"), F.coalesce(at["k"], at["kk"]).alias("key"))


@query("""SELECT doc_id, regexp_matches(text, '[0-9]') AS cites, length(substr(trim(regexp_replace(text, '[ \\n]+', ' ', 'g')), 1, 500)) AS kept_chars FROM documents""")
def anchored_reasons(spark, d):
    """Does a reason cite an anchor (a number here), and how long is it once it is compressed to 500 characters?"""
    short = F.substring(F.trim(F.regexp_replace("text", "[ \n]+", " ")), 1, 500)
    return table(spark, d, "documents").select("doc_id", F.rlike("text", F.lit("[0-9]")).alias("cites"), F.char_length(short).cast("long").alias("kept_chars"))


@query("""SELECT c_custkey, 'Judge the row.' || chr(10) || 'name: ' || c_name || chr(10) || 'segment: ' || c_mktsegment || chr(10) || 'Answer with a score from 1 to 5 and a reason.' AS prompt FROM customer""")
def judge_prompts(spark, d):
    fields = [F.concat(F.lit("name: "), F.col("c_name")), F.concat(F.lit("segment: "), F.col("c_mktsegment"))]
    return table(spark, d, "customer").select("c_custkey", F.concat_ws("\n", F.lit("Judge the row."), *fields, F.lit("Answer with a score from 1 to 5 and a reason.")).alias("prompt"))


@query("""WITH s AS (SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) % 8 AS score FROM events)
SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'style:missing' ELSE concat_ws(',', CASE WHEN score NOT BETWEEN 1 AND 5 THEN 'style:range' END, CASE WHEN event_id % 7 = 0 THEN 'style:reason' END) END AS faults FROM s""")
def judge_document_faults(spark, d):
    """Judges' documents made of the events: a dimension may be missing, out of range or without a reason."""
    score = F.get_json_object("props", "$.k").cast("int") % 8
    body = F.to_json(F.struct(F.struct(score.alias("score"), F.when(F.col("event_id") % 7 == 0, " ").otherwise("fine").alias("reasoning")).alias("style")))
    document = F.when(F.col("event_id") % 5 == 0, F.lit("{}")).otherwise(body)
    return table(spark, d, "events").select("event_id", F.array_join(ck.judge_faults(document, ["style"]), ",").alias("faults"))


_SCORES = """s AS (SELECT l_orderkey * 10 + l_linenumber AS id, 'quantity' AS annotator, 'a' AS dimension, CASE WHEN l_tax < 0.01 THEN NULL ELSE CAST(1 + l_quantity % 5 AS INT) END AS score FROM lineitem UNION ALL
SELECT l_orderkey * 10 + l_linenumber, 'line', 'b', CASE WHEN l_tax < 0.02 THEN NULL ELSE CAST(1 + l_linenumber % 5 AS INT) END FROM lineitem UNION ALL SELECT l_orderkey * 10 + l_linenumber, 'line', 'c', CAST(1 + l_quantity % 5 AS INT) FROM lineitem)"""


def _annotations(spark, d):
    n = table(spark, d, "lineitem").withColumn("id", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    quantity, line = F.expr("cast(cast(1 + l_quantity % 5 as int) as string)"), F.expr("cast(1 + l_linenumber % 5 as string)")

    def rows(dimension, score):
        return n.select("id", F.lit(dimension).alias("dimension"), score.alias("score"), F.lit(None).cast("string").alias("reasoning"))

    return ck.consolidated({"quantity": rows("a", F.when(F.col("l_tax") < 0.01, "n/a").otherwise(quantity)), "line": rows("b", F.when(F.col("l_tax") < 0.02, "").otherwise(line)).unionByName(rows("c", quantity))}, "id")


@query(f"WITH {_SCORES} SELECT annotator, dimension, count(*) AS n, count(score) AS scored, CAST(sum(score) AS BIGINT) AS total FROM s GROUP BY ALL")
def annotation_consolidation(spark, d):
    """Scores of several annotators as one typed table; what isn't a whole number is null."""
    return _annotations(spark, d).groupBy("annotator", "dimension").agg(F.count("*").alias("n"), F.count("score").alias("scored"), F.sum("score").alias("total"))


@query(f"""WITH {_SCORES}, o AS (SELECT id, annotator, '_overall' AS dimension, CASE WHEN count(score) = count(*) THEN CAST(floor(avg(score) + 0.5) AS INT) END AS score FROM s GROUP BY id, annotator), u AS (SELECT * FROM s UNION ALL SELECT * FROM o)
SELECT annotator, dimension, count(*) AS n, count(*) FILTER (score IS NULL) AS nulls, CAST(sum(score) AS BIGINT) AS total FROM u GROUP BY ALL""")
def release_bundle(spark, d):
    """The annotations with their overall rows, and the null scores of each part."""
    every = ck.with_overall(_annotations(spark, d), "id")
    return every.groupBy("annotator", "dimension").agg(F.count("*").alias("n"), F.count_if(F.col("score").isNull()).alias("nulls"), F.sum("score").alias("total"))


@query("""WITH p AS (SELECT l_returnflag, l_linestatus, avg(l_quantity) AS before, avg(CASE WHEN l_discount > 0.05 THEN l_quantity - 1 ELSE l_quantity END) AS after, count(*) FILTER (l_discount > 0.05) AS amended FROM lineitem GROUP BY ALL)
SELECT l_returnflag, l_linestatus, round(before, 6) AS mean_before, round(after, 6) AS mean_after, round(after - before, 6) AS delta, amended FROM p""")
def amendment_deltas(spark, d):
    """Metrics before and after amendments, merged on their keys with suffixes, and the difference."""
    n = table(spark, d, "lineitem")
    amended = n.withColumn("l_quantity", F.when(F.col("l_discount") > 0.05, F.col("l_quantity") - 1).otherwise(F.col("l_quantity")))
    keys = ["l_returnflag", "l_linestatus"]
    before, after = (x.groupBy(*keys).agg(F.avg("l_quantity").alias(name)) for x, name in ((n, "b"), (amended, "a")))
    changed = n.groupBy(*keys).agg(F.count_if(F.col("l_discount") > 0.05).alias("amended"))
    return before.join(after, keys).join(changed, keys).select(*keys, r("b").alias("mean_before"), r("a").alias("mean_after"), r(F.col("a") - F.col("b")).alias("delta"), "amended")


@query("""WITH s AS (SELECT l_returnflag AS judge, 1 + l_linenumber % 5 AS own, 1 + CAST(l_quantity AS BIGINT) % 5 AS other FROM lineitem),
a AS (SELECT judge, count(*) AS n, avg(own) AS mo, avg(other) AS mt, avg(CAST(own = 5 AS INT)) AS mx, sum((own - other) ** 2) AS d, sum(own * own) + sum(other * other) - 2.0 * sum(own) * sum(other) / count(*) AS e FROM s GROUP BY 1)
SELECT judge, n, round(mo, 6) AS mean_own, round(mt, 6) AS mean_other, round(mo - mt, 6) AS delta, round(mx, 6) AS max_share, round(1 - d / e, 6) AS qwk FROM a""")
def self_preference(spark, d):
    """How a judge scores its own rows against what others score them."""
    s = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("judge"), (1 + F.col("l_linenumber") % 5).alias("own"), (1 + F.col("l_quantity").cast("long") % 5).alias("other"))
    return s.groupBy("judge").agg(F.count("*").alias("n"), r(F.avg("own")).alias("mean_own"), r(F.avg("other")).alias("mean_other"), r(F.avg("own") - F.avg("other")).alias("delta"), r(F.avg((F.col("own") == 5).cast("int"))).alias("max_share"), r(quadratic_kappa("own", "other")).alias("qwk"))


@query("""SELECT sha256('{"columns":["doc_id","lang","n_chars","source","text"],"rows":' || count(*) || ',"sources":["' || string_agg(DISTINCT source, '","' ORDER BY source) || '"]}') AS fingerprint, true AS ready FROM documents""")
def config_fingerprint(spark, d):
    """A run over the documents is ready if its preview passed for the same columns, rows and sources."""
    docs = table(spark, d, "documents")
    seen = docs.agg(F.count("*").alias("rows"), F.array_sort(F.collect_set("source")).alias("sources")).first()  # a vocabulary
    config = {"columns": sorted(docs.columns), "rows": seen["rows"], "sources": seen["sources"]}
    mark = ck.fingerprint(config)
    ck.assert_ready({"passed": True, "config": mark}, config)
    return docs.limit(1).select(F.lit(mark).alias("fingerprint"), F.lit(True).alias("ready"))


@query("""SELECT o_orderkey, CAST(year(o_orderdate) AS INT) AS yr, o_orderstatus FROM orders""")
def release_assembly(spark, d):
    """Two runs as one release: the second lacks a column that follows from another; counts and keys are checked."""
    orders = table(spark, d, "orders")
    first = orders.filter("o_orderstatus = 'F'").withColumn("yr", F.year("o_orderdate"))
    second = orders.filter("o_orderstatus <> 'F' or o_orderstatus is null")
    return ck.release([first, second], ["o_orderkey", "yr", "o_orderstatus"], "o_orderkey", orders.count(), {"yr": F.year("o_orderdate")})
