"""Generation runs, prompts, issue handling, specifications and downstream tasks over the driver's tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from .catalog import query, r, shared_folder, table
from .functions import scalar as s
from .operators import generation as g
from .operators import prompts, rules, tasks, texts
from .operators.grounding import conditional_share
from .operators.ranking import nested_candidates
from .queries_grounding import u_sql
from .queries_pairs import nested_sql
from .sources import distributions

CAP = 20


@query(f"""WITH e AS (SELECT event_id, event_type AS item, user_id, CAST(ts AS DATE) AS day FROM events), c AS (SELECT item, user_id % 50 AS who, day, count(*) AS n FROM e GROUP BY ALL),
u AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY item, who ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM c)
SELECT CAST(day AS VARCHAR) AS day, count(*) AS items, CAST(sum(n) AS BIGINT) AS n_rows, CAST(max(used) AS BIGINT) AS most_used, count(*) FILTER (used >= {CAP}) AS blocked FROM u GROUP BY day""")
def batch_quota_state(spark, d):
    """Days are batches: an item that earlier days have used up is blocked; a day doesn't see itself."""
    e = table(spark, d, "events").select(F.col("event_type").alias("item"), (F.col("user_id") % 50).alias("who"), F.to_date("ts").alias("day"))
    used = g.used_before(e, ["item", "who"], "day")
    n = e.groupBy("item", "who", "day").agg(F.count("*").alias("n"))
    return used.join(n, ["item", "who", "day"]).groupBy(F.col("day").cast("string").alias("day")).agg(F.count("*").alias("items"), F.sum("n").alias("n_rows"), F.max("used").alias("most_used"), F.count_if(F.col("used") >= CAP).alias("blocked"))


@query("""WITH l AS (SELECT l_orderkey AS k, l_orderkey // 100 AS batch, list_sort(list_distinct(list(l_shipmode))) AS items FROM (SELECT l_orderkey, l_suppkey % 4 AS l_shipmode FROM lineitem) GROUP BY l_orderkey),
f AS (SELECT items, min(batch) AS first FROM l GROUP BY items) SELECT batch, count(*) AS n, count(*) FILTER (first < batch) AS seen FROM l JOIN f USING (items) GROUP BY batch""")
def batch_seen_sets(spark, d):
    """Orders whose set of suppliers' quarters an earlier batch of orders had."""
    rows = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.collect_set((F.col("l_suppkey") % 4).cast("string")).alias("items")).withColumn("batch", F.expr("k div 100"))
    return rows.select("k", "batch").join(g.seen_sets(rows, "k", "items"), "k").groupBy("batch").agg(F.count("*").alias("n"), F.count_if("seen").alias("seen"))


_DRAWS = ", ".join(u_sql(23, "c_custkey", f"try{i}") for i in range(5))


@query(f"""WITH t AS (SELECT c_custkey, [{_DRAWS}] AS v FROM customer), a AS (SELECT c_custkey, v, list_position(list_transform(v, lambda x: x < 0.4), true) AS i FROM t)
SELECT c_custkey, CAST(i - 1 AS INT) AS attempt, round(v[i], 6) AS value, round(greatest(0.2, 0.8 - (i - 1) * 0.25), 6) AS temperature FROM a""")
def retry_until_accepted(spark, d):
    """Up to five attempts a row, cooler each time; rows without an accepted one have nulls."""
    hit = g.first_accepted(4, lambda a: s.uniform_at(23, F.col("c_custkey"), "try", a), lambda v: v < 0.4)
    rows = table(spark, d, "customer").select("c_custkey", hit.alias("x"))
    return rows.select("c_custkey", "x.attempt", r("x.value").alias("value"), r(g.temperature(F.col("x.attempt"), 0.8, 0.25, 0.2)).alias("temperature"))


TEMPLATES = {
    "_": "Customer {{ name }} of nation {{ nation }}.{% if rich %} Balance {{ balance }}.{% else %} No balance.{%- endif %} Seed {{ word | default(\"day\") }}.",
    "BUILDING": "Builder {{ name }}: {{ \"in credit\" if rich else \"in debt\" }}.",
}


@query("""SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 'Builder ' || c_name || ': ' || CASE WHEN c_acctbal > 0 THEN 'in credit' ELSE 'in debt' END || '.'
ELSE 'Customer ' || c_name || ' of nation ' || c_nationkey || '.' || CASE WHEN c_acctbal > 0 THEN ' Balance ' || CAST(floor(c_acctbal) AS BIGINT) || '.' ELSE ' No balance.' END || ' Seed day.' END AS prompt FROM customer""")
def prompt_rendering(spark, d):
    """Templates by segment with a fallback, rendered as expressions."""
    known = {"name": F.col("c_name"), "nation": F.col("c_nationkey"), "rich": F.col("c_acctbal") > 0, "balance": F.floor("c_acctbal")}
    return table(spark, d, "customer").select("c_custkey", prompts.chosen(TEMPLATES, F.col("c_mktsegment"), known, "_").alias("prompt"))


FIELDS = {"TOO_SHORT": ["body", "title"], "TOXIC": ["body"], "NO_LANGUAGE": ["meta"]}


@query("""WITH x AS (SELECT d.doc_id, n_chars < 300 AS a, coalesce(toxic = 1, false) AS b, lang IS NULL AS c, coalesce(quality = 0, false) AS e FROM documents d LEFT JOIN labels l USING (doc_id))
SELECT doc_id, CASE WHEN a AND c THEN 'body,title,meta' WHEN a THEN 'body,title' WHEN b AND c THEN 'body,meta' WHEN b THEN 'body' WHEN c THEN 'meta' ELSE 'title,body,meta' END AS fields,
CAST(a AS INT) + CAST(c AS INT) AS n_blocking, b AS rejected, array_to_string(list_filter([CASE WHEN a THEN 'TOO_SHORT: short' END, CASE WHEN b THEN 'TOXIC: toxic' END, CASE WHEN c THEN 'NO_LANGUAGE: unknown' END, CASE WHEN e THEN 'LOW_QUALITY: low' END], lambda v: v IS NOT NULL), '; ') AS feedback FROM x""")
def issue_handling(spark, d):
    """What a row's issues lead to: fields to rewrite, blocking warnings, rejection, feedback lines."""
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    issues = F.concat(rules.issue(F.col("n_chars") < 300, "warning", "TOO_SHORT", "text", F.lit("short")), rules.issue(F.col("toxic") == 1, "error", "TOXIC", "text", F.lit("toxic")), rules.issue(F.col("lang").isNull(), "warning", "NO_LANGUAGE", "lang", F.lit("unknown")), rules.issue(F.col("quality") == 0, "warning", "LOW_QUALITY", "text", F.lit("low")))
    x = rows.select("doc_id", issues.alias("i"))
    i, codes = F.col("i"), F.transform("i", lambda v: v["code"])
    return x.select("doc_id", F.array_join(rules.fields_to_rewrite(codes, FIELDS, ["title", "body", "meta"]), ",").alias("fields"), F.size(rules.blocking(i, ["TOO_SHORT", "NO_LANGUAGE"])).alias("n_blocking"), rules.rejected(i, F.lit(0)).alias("rejected"), F.array_join(rules.feedback(i, F.array().cast("array<string>")), "; ").alias("feedback"))


@query("""WITH a AS (SELECT o_orderkey AS id, o_orderstatus AS given, o_orderpriority AS key FROM orders), s AS (SELECT given, key, count(*) / sum(count(*)) OVER (PARTITION BY given) AS p FROM a GROUP BY given, key), m AS (SELECT given, count(*) / sum(count(*)) OVER () AS p FROM a GROUP BY given)
SELECT 'P_priority_given_status' AS distribution, given AS field, key, round(p, 6) AS probability FROM s UNION ALL SELECT 'P_status', '', given, round(p, 6) FROM m""")
def distribution_long_export(spark, d):
    orders = table(spark, d, "orders")
    joint, whole = conditional_share(orders, ["o_orderstatus"], ["o_orderpriority"]), conditional_share(orders, [], ["o_orderstatus"])
    share = [c for c in joint.columns if c not in ("o_orderstatus", "o_orderpriority", "n")][0]
    out = distributions.long_format({"P_priority_given_status": (joint, ["o_orderstatus"], ["o_orderpriority"], share), "P_status": (whole, [], ["o_orderstatus"], share)})
    return out.withColumn("probability", r("probability"))


_TFIDF = """x AS (SELECT conv_id * 100000 + turn AS id, conv_id, turn, lower(coalesce(text, '')) AS t FROM conversations),
w AS (SELECT id, unnest(list_filter(regexp_split_to_array(t, '\\s+'), lambda v: v <> '')) AS w FROM x), p AS (SELECT id, ' ' || w || ' ' AS p FROM w),
g AS (SELECT id, unnest(list_transform(range(1, length(p) - n + 2), lambda i: substring(p, i, n))) AS g FROM p, range(3, 6) AS t(n) WHERE length(p) >= n),
tf AS (SELECT id, g, count(*) AS tf FROM g GROUP BY ALL), v AS (SELECT g, count(*) AS df, sum(tf) AS cf FROM tf GROUP BY g HAVING count(*) >= 2 ORDER BY cf DESC, g LIMIT 20000),
y AS (SELECT id, g, (1 + ln(tf)) * (ln((1 + (SELECT count(*) FROM x)) / (1 + df)) + 1) AS y FROM tf JOIN v USING (g)), u AS (SELECT id, g, y / sqrt(sum(y * y) OVER (PARTITION BY id)) AS y FROM y)"""


@query(f"""WITH {_TFIDF}, h AS (SELECT conv_id, max(turn) AS held, conv_id % 3 AS grp FROM x GROUP BY conv_id),
q AS (SELECT x.conv_id, u.g, sum(u.y) AS y FROM x JOIN h USING (conv_id) JOIN u ON u.id = x.id WHERE x.turn < h.held GROUP BY ALL), t AS (SELECT x.conv_id, u.g, u.y FROM x JOIN h ON h.conv_id = x.conv_id AND h.held = x.turn JOIN u ON u.id = x.id),
{nested_sql('h', 'conv_id', ['grp'], 29, 'ring', 5)}, c AS (SELECT conv_id AS a, candidate AS b, step = 0 AS truth FROM cand),
z AS (SELECT c.a, c.b, sum(q.y * t.y) AS s FROM c JOIN q ON q.conv_id = c.a JOIN t ON t.conv_id = c.b AND t.g = q.g GROUP BY ALL),
rk AS (SELECT c.a, c.truth, row_number() OVER (PARTITION BY c.a ORDER BY round(coalesce(z.s, 0), 9) DESC, c.b) AS rank FROM c LEFT JOIN z USING (a, b))
SELECT count(*) AS queries, round(avg(CAST(rank = 1 AS INT)), 6) AS top1, round(avg(CAST(rank <= 3 AS INT)), 6) AS top3, round(avg(1.0 / rank), 6) AS mrr, round(median(rank), 6) AS median_rank FROM rk WHERE truth""")
def heldout_turn_retrieval(spark, d):
    """The last turn of a conversation among five, by the summed weights of the turns before it."""
    turns = table(spark, d, "conversations").select((F.col("conv_id").cast("long") * 100000 + F.col("turn")).alias("id"), "conv_id", "turn", "text")
    held = turns.groupBy("conv_id").agg(F.max("turn").alias("held")).withColumn("grp", F.col("conv_id") % 3)
    weights = texts.char_weights(turns, "id", "text")
    x = texts.turns_by_id(turns, "id", "text").select(F.expr("id div 100000").alias("conv_id"), (F.col("id") % 100000).alias("turn"), "t").join(held.select("conv_id", "held"), "conv_id")
    found = nested_candidates(held, "conv_id", ["grp"], s.uniform(29, F.col("conv_id"), "ring"), 5, 29)
    pairs = found.select("conv_id", "candidate", (F.col("step") == 0).alias("truth"))
    ranks = tasks.retrieval_ranks(pairs, "conv_id", x.filter("turn < held"), x.filter("turn = held"), "t", weights)
    return ranks.agg(F.count("*").alias("queries"), r(F.avg((F.col("rank") == 1).cast("int"))).alias("top1"), r(F.avg((F.col("rank") <= 3).cast("int"))).alias("top3"), r(F.avg(1 / F.col("rank"))).alias("mrr"), r(F.median("rank")).alias("median_rank"))


_SET = "list_distinct(regexp_extract_all(lower({}), '[가-힣a-z0-9]+'))"


@query(f"""WITH {nested_sql('documents', 'doc_id', ['source', 'lang'], 31, 'pair', 2)},
c AS (SELECT c.doc_id, step = 0 AS own, {_SET.format("concat_ws(' ', a.lang, a.source, a.text)")} AS s, {_SET.format("coalesce(b.text, '')")} AS t FROM cand c JOIN documents a USING (doc_id) JOIN documents b ON b.doc_id = c.candidate),
j AS (SELECT CAST(own AS INT) AS label, CASE WHEN len(s) + len(t) = 0 THEN 1.0 ELSE len(list_intersect(s, t)) / len(list_distinct(list_concat(s, t))) END AS x FROM c)
SELECT label, count(*) AS n, round(avg(x), 6) AS mean, round(max(x), 6) AS max, round(avg(CAST(x >= 0.1 AS INT)), 6) AS share_over FROM j GROUP BY label""")
def pair_lexical_baseline(spark, d):
    """A document's columns against its own text and against that of a partner of its source and language, or as near as there is."""
    docs = table(spark, d, "documents").withColumn("anchor", F.concat_ws(" ", "lang", "source", "text")).withColumn("text", F.coalesce("text", F.lit("")))
    pairs = tasks.pair_dataset(docs, "doc_id", ["source", "lang"], 31, "pair", "anchor", "text")
    x = pairs.select("label", s.jaccard(s.token_set(F.col("anchor")), s.token_set(F.col("text"))).alias("x"))
    return x.groupBy("label").agg(F.count("*").alias("n"), r(F.avg("x")).alias("mean"), r(F.max("x")).alias("max"), r(F.avg((F.col("x") >= 0.1).cast("int"))).alias("share_over"))


def _vector_pairs(spark, d):
    """Each vector with the one before it of its label (1) and with one of the next label (0)."""
    e = table(spark, d, "embeddings").select("vec_id", "label", "embedding", (F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1).alias("p"))
    asked = e.filter("p > 0").select("vec_id", "label", F.col("embedding").alias("a"), F.explode(F.array(F.struct(F.lit(1).alias("same"), F.col("label").alias("l")), F.struct(F.lit(0).alias("same"), (F.col("label") + 1).alias("l")))).alias("x"), (F.col("p") - 1).alias("p")).select("vec_id", "a", "x.same", "x.l", "p")
    return asked.join(e.select(F.col("label").alias("l"), "p", F.col("embedding").alias("b")), ["l", "p"]).select("vec_id", "same", tasks.pair_features(F.col("a"), F.col("b")).alias("f"))


@query("""WITH e AS (SELECT vec_id, label, embedding :: DOUBLE[] AS v, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS p FROM embeddings)
SELECT a.vec_id, k AS same, CAST(4 * len(a.v) AS INT) AS width, round(list_dot_product(a.v, b.v), 6) AS product, round(list_sum(list_transform(range(1, len(a.v) + 1), lambda i: abs(a.v[i] - b.v[i]))), 6) AS distance
FROM e a, (VALUES (0), (1)) AS o(k), e b WHERE a.p > 0 AND b.p = a.p - 1 AND b.label = a.label + 1 - k""")
def pair_feature_stats(spark, d):
    f, m = F.col("f"), (F.size("f") / 4).cast("int")
    part = lambda k: F.aggregate(F.slice(f, m * k + 1, m), F.lit(0.0), lambda t, v: t + v)
    return _vector_pairs(spark, d).select("vec_id", "same", F.size("f").alias("width"), r(part(2)).alias("product"), r(part(3)).alias("distance"))


@query()
def pair_classifier_instances(spark, d):
    """A linear head on pair features; every held-out pair with its score, for resampling."""
    x = _vector_pairs(spark, d).select((F.col("vec_id") * 2 + F.col("same")).alias("pair_id"), "same", "f", (F.pmod(F.xxhash64("vec_id"), F.lit(5)) == 0).alias("held_out"))
    out = tasks.linear_head(x, "pair_id", "same", "f", "held_out")
    return out.select("pair_id", "same", r("score").alias("score"), "predicted")


@query()
def source_recovery(spark, d):
    """A document's source told from the character grams of its masked text."""
    rows = table(spark, d, "documents").select("doc_id", "source", s.masked(F.col("text"), ["license", "public", "licensed"], "[FIELD]").alias("t"), (F.pmod(F.xxhash64("doc_id"), F.lit(5)) == 0).alias("held_out"))
    out = tasks.anchor_recovery(rows, "doc_id", "t", "source", "held_out")
    hit = lambda c: r(F.avg((F.col(c) == F.col("truth")).cast("int")))
    return out.groupBy("truth").agg(F.count("*").alias("n"), hit("predicted").alias("recall"), hit("majority").alias("majority_recall"))


@query("SELECT doc_id, CAST(ascii(md5(CAST(doc_id AS VARCHAR))) % 5 + 1 AS INT) AS score, CAST(CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END AS INT) AS attempt FROM documents")
def judge_run_retries(spark, d):
    """Scores asked of a stand-in service that answers every third document badly at first; answers are parsed and checked."""
    p = table(spark, d, "documents").select("doc_id", F.concat(F.lit("Score document "), "doc_id").alias("prompt"))
    out = g.complete(p, "doc_id", "prompt", _stand_in, _score_missing, most=2, base=0.5, decay=0.25)
    return out.select("doc_id", s.parsed_score(F.get_json_object(s.json_block(F.col("text")), "$.score")).alias("score"), "attempt")


def _stand_in():
    import hashlib

    def ask(prompt: str, temperature: float) -> str:
        k = prompt.rsplit(" ", 1)[-1]
        score = ord(hashlib.md5(k.encode()).hexdigest()[0]) % 5 + 1
        return "no idea" if int(k) % 3 == 0 and temperature >= 0.5 else f'```json\n{{"score": {score}}}\n```'

    return ask


def _score_missing(text: str) -> str | None:
    return None if '"score"' in text else "no score"


_TRIES = " UNION ALL ".join(f"SELECT doc_id, {a} AS attempt, CAST(floor({u_sql(17, 'doc_id', f'draft{a}')} * 100) AS INT) AS v FROM documents" for a in range(3))


@query(f"""WITH t AS ({_TRIES}), f AS (SELECT *, CASE WHEN v % 10 = 0 THEN 'duplicate' WHEN v >= 70 THEN 'quota' WHEN v % 3 = 1 THEN 'rules' END AS fault FROM t),
k AS (SELECT doc_id, coalesce(min(attempt) FILTER (fault IS NULL), 2) AS attempt FROM f GROUP BY doc_id)
SELECT doc_id, CAST(attempt AS INT) AS attempt, CASE WHEN fault = 'rules' THEN 'item coerced' ELSE 'item ' || v END AS text, CASE WHEN fault IS NULL THEN 'accepted' WHEN fault = 'rules' THEN 'coerced' ELSE 'failed' END AS status,
CASE WHEN fault <> 'rules' THEN fault END AS fault, CAST(attempt + CAST(fault IS NOT NULL AS INT) AS INT) AS told FROM k JOIN f USING (doc_id, attempt)""")
def retry_machine(spark, d):
    """Drafts of a stand-in service, mended, checked in order, retried with feedback, and coerced or given up after three attempts."""
    v = F.regexp_extract("text", "[0-9]+", 0).try_cast("int")
    checks = {"duplicate": lambda x: F.when(v % 10 == 0, F.lit("seen before")), "quota": lambda x: F.when(v >= 70, F.lit("used up")), "rules": lambda x: F.when(v % 3 == 1, F.lit("breaks a rule"))}
    draft = lambda rows, a: rows.withColumn("text", F.concat(F.lit(" item  "), F.floor(s.uniform(17, F.col("doc_id"), f"draft{a}") * 100).cast("string")))
    mend = lambda x: F.trim(F.regexp_replace(x, " +", " "))
    out = g.retry_machine(table(spark, d, "documents").select("doc_id"), "doc_id", draft, mend, checks, {"rules": lambda x: F.lit("item coerced")}, 2, f"{shared_folder(spark)}/retry-{uuid.uuid4().hex}")
    return out.select("doc_id", "attempt", "text", "status", "fault", F.size("feedback").alias("told"))


# Rows of the shape the rules read: changes to a plain row, and the codes that they must give.
_PLAIN = {"age": 45, "career_years": 10, "art_field_primary": "미술", "occupation": "조각가", "province": "서울", "employment_type": "전업", "has_secondary_job": False, "individual_art_income_bracket": "없음", "has_contract_experience": True, "has_copyright": True, "persona": "조각 작업을 이어 온 40대 작가", "professional_persona": "", "living_persona": "", "network_persona": "", "cultural_background": ""}
_NARRATIVES = ["persona", "professional_persona", "living_persona", "network_persona", "cultural_background"]
_RULE_CASES = [
    ({}, []),
    ({"persona": "조각을 하는 20대 작가"}, ["AGE_MISMATCH"]),
    ({"career_years": 40, "age": 50}, ["AGE_CAREER_IMPOSSIBLE", "AGE_MISMATCH"]),
    ({"living_persona": "신진 작가로 산다"}, ["CAREER_MISMATCH_NEW"]),
    ({"career_years": 3, "living_persona": "원로로 산다"}, ["CAREER_MISMATCH_VETERAN"]),
    ({"professional_persona": "10년간 전업"}, ["EMPLOYMENT_DURATION_CONFLATION"]),
    ({"professional_persona": "안무와 콘티"}, ["FIELD_FOREIGN_VOCAB", "FIELD_FOREIGN_VOCAB"]),
    ({"persona": "그림을 그린다"}, ["OCCUPATION_MISMATCH"]),
    ({"living_persona": "부산에서 산다"}, ["REGION_MISMATCH"]),
    ({"living_persona": "해운대를 걷는다"}, ["LANDMARK_REGION_MISMATCH"]),
    ({"living_persona": "알바를 한다"}, ["EMPLOYMENT_MISMATCH"]),
    ({"living_persona": "풍족하다"}, ["INCOME_RICH_BUT_LOW"]),
    ({"individual_art_income_bracket": "6천만원 이상", "living_persona": "생계 위협"}, ["INCOME_POOR_BUT_HIGH"]),
    ({"has_contract_experience": False, "has_copyright": None, "living_persona": "표준계약서와 저작권 수입"}, ["CONTRACT_MISMATCH", "COPYRIGHT_MISMATCH"]),
    ({"age": 60, "career_years": 5, "persona": "조각", "professional_persona": "원로이고 원로", "network_persona": "한평생"}, ["LATE_DEBUT_TONE_MISMATCH"] * 4),
    ({"age": 60, "career_years": 15, "persona": "조각", "cultural_background": "어릴 적부터 미술을 좋아했다."}, ["EARLY_INTEREST_VS_LATE_DEBUT"]),
    ({"age": 60, "career_years": 15, "persona": "조각", "cultural_background": "대학교를 졸업한 후 미술 활동을 했다."}, ["EDUCATION_DEBUT_TIMELINE_MISMATCH"]),
]


@query("WITH c AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{code}')" for i, (_, codes) in enumerate(_RULE_CASES) for code in codes) + f") AS t(i, code)) SELECT code, count(*) AS issues, count(DISTINCT doc_id) AS n_rows FROM documents JOIN c ON i = doc_id % {len(_RULE_CASES)} GROUP BY code")
def consistency_rule_issues(spark, d):
    """All consistency rules over a row for each document, of the shape that the rules read."""
    types = "case long, " + ", ".join(f"{k} {'boolean' if k.startswith('has_') else 'int' if isinstance(v, int) else 'string'}" for k, v in _PLAIN.items())
    shapes = spark.createDataFrame([(i, *(_PLAIN | change).values()) for i, (change, _) in enumerate(_RULE_CASES)], types)
    rows = table(spark, d, "documents").select("doc_id", (F.col("doc_id") % len(_RULE_CASES)).alias("case")).join(F.broadcast(shapes), "case")
    return rows.select("doc_id", F.explode(rules.issues(_NARRATIVES)).alias("x")).groupBy("x.code").agg(F.count("*").alias("issues"), F.count_distinct("doc_id").alias("n_rows"))
