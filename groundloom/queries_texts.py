"""Corpus measures of texts, context rules, least-used choices, provenance and cross-validation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .catalog import query, r, table, written
from .functions import scalar as s
from .operators import texts
from .sources import report_tables


@query("""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '\\s+'), lambda x: x <> '') AS w FROM documents), l AS (SELECT doc_id, len(w) AS len FROM w),
g AS (SELECT doc_id, n, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) AS g FROM w, range(1, 5) AS t(n)),
c AS (SELECT doc_id, n, g, count(*) AS c FROM g GROUP BY ALL),
k AS (SELECT *, row_number() OVER p AS rk, first_value(c) OVER p AS best, lead(c) OVER p AS nxt FROM c WINDOW p AS (PARTITION BY n, g ORDER BY c DESC, doc_id)),
m AS (SELECT doc_id, n, sum(least(c, CASE WHEN rk = 1 THEN coalesce(nxt, 0) ELSE best END)) AS hit FROM k GROUP BY doc_id, n),
d AS (SELECT len, count(*) AS many FROM l GROUP BY len), f AS (SELECT a.len, min_by(b.len, abs(b.len - a.len) * 1000000 + b.len) AS ref FROM d a JOIN d b ON b.len <> a.len OR a.many > 1 GROUP BY a.len),
p AS (SELECT l.doc_id, l.len, f.ref, t.n, coalesce(m.hit, 0) AS hit, greatest(l.len - t.n + 1, 1) AS den FROM l JOIN f USING (len), range(1, 5) AS t(n) LEFT JOIN m ON m.doc_id = l.doc_id AND m.n = t.n)
SELECT doc_id, round(CASE WHEN max(len) = 0 OR max(CASE WHEN n = 1 THEN hit END) = 0 THEN 0 ELSE CASE WHEN max(len) > max(ref) THEN 1 ELSE exp(1 - max(ref) / max(len)) END * exp(sum(0.25 * ln(CASE WHEN hit > 0 THEN hit ELSE 0.1 END / den))) END, 6) AS self_bleu FROM p GROUP BY doc_id""")
def self_bleu(spark, d):
    w = table(spark, d, "documents").select("doc_id", s.words(F.coalesce("text", F.lit(""))).alias("w"))
    return texts.self_bleu(w, "doc_id", "w").select("doc_id", r("score").alias("self_bleu"))


@query("""WITH x AS (SELECT conv_id * 100000 + turn AS id, conv_id, turn, lower(coalesce(text, '')) AS t FROM conversations),
w AS (SELECT id, unnest(list_filter(regexp_split_to_array(t, '\\s+'), lambda v: v <> '')) AS w FROM x), p AS (SELECT id, ' ' || w || ' ' AS p FROM w),
g AS (SELECT id, unnest(list_transform(range(1, length(p) - n + 2), lambda i: substring(p, i, n))) AS g FROM p, range(3, 6) AS t(n) WHERE length(p) >= n),
tf AS (SELECT id, g, count(*) AS tf FROM g GROUP BY ALL), v AS (SELECT g, count(*) AS df, sum(tf) AS cf FROM tf GROUP BY g HAVING count(*) >= 2 ORDER BY cf DESC, g LIMIT 20000),
y AS (SELECT id, g, (1 + ln(tf)) * (ln((1 + (SELECT count(*) FROM x)) / (1 + df)) + 1) AS y FROM tf JOIN v USING (g)), u AS (SELECT id, g, y / sqrt(sum(y * y) OVER (PARTITION BY id)) AS y FROM y),
q AS (SELECT a.id AS a, b.id AS b FROM x a JOIN x b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1), h AS (SELECT q.a, q.b, sum(u.y * z.y) AS c FROM q JOIN u ON u.id = q.a JOIN u z ON z.id = q.b AND z.g = u.g GROUP BY ALL)
SELECT q.a // 100000 AS conv_id, q.a % 100000 AS turn, round(coalesce(c, 0), 6) AS cosine FROM q LEFT JOIN h USING (a, b)""")
def char_tfidf_cosine(spark, d):
    """Similarity of each turn of a conversation to the next one."""
    x = table(spark, d, "conversations").select((F.col("conv_id").cast("long") * 100000 + F.col("turn")).alias("id"), "conv_id", "turn", "text")
    after = x.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("id").alias("b"))
    pairs = x.select(F.col("id").alias("a"), "conv_id", "turn").join(after, ["conv_id", "turn"]).select("a", "b")
    found = texts.row_cosines(pairs, x, "id", "text", texts.char_weights(x, "id", "text"))
    return found.select(F.expr("a div 100000").alias("conv_id"), (F.col("a") % 100000).alias("turn"), r("cosine").alias("cosine"))


@query("""WITH k AS (SELECT array_to_string(list_sort(list_distinct(list_filter(list_transform(string_split(text, ','), lambda x: trim(x)), lambda x: x <> ''))), '|') AS k FROM documents WHERE text IS NOT NULL), n AS (SELECT k, count(*) AS n FROM k GROUP BY k)
SELECT CAST(sum(n) AS BIGINT) AS n_rows, count(*) AS unique_sets, CAST(coalesce(sum(n) FILTER (n > 1), 0) AS BIGINT) AS in_duplicates, round(coalesce(sum(n) FILTER (n > 1), 0) / sum(n), 6) AS rate, max(n) AS largest FROM n""")
def set_duplicates(spark, d):
    """Rows whose comma-separated items form the same set as another row's."""
    items = F.array_sort(F.array_distinct(F.filter(F.transform(F.split("text", ","), lambda x: F.trim(x)), lambda x: x != "")))
    sets = table(spark, d, "documents").filter("text is not null").groupBy(F.sha2(F.array_join(items, "|"), 256).alias("k")).agg(F.count("*").alias("n"))
    copied = F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0))
    return sets.agg(F.sum("n").alias("n_rows"), F.count("*").alias("unique_sets"), copied.alias("in_duplicates"), r(copied / F.sum("n")).alias("rate"), F.max("n").alias("largest"))


@query("""WITH c AS (SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n FROM events GROUP BY ALL), g AS (SELECT day, event_type, coalesce(n, 0) AS n FROM (SELECT DISTINCT day FROM c) CROSS JOIN (SELECT DISTINCT event_type FROM c) LEFT JOIN c USING (day, event_type)),
b AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY event_type ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM g)
SELECT CAST(day AS VARCHAR) AS day, min_by(event_type, {'u': used, 'e': event_type}) AS chosen, CAST(min(used) AS BIGINT) AS used FROM b GROUP BY day""")
def least_used_assignment(spark, d):
    """Each day is a batch: the event type that earlier batches used least, ties by name."""
    c = table(spark, d, "events").groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count("*").alias("n"))
    grid = c.select("day").distinct().crossJoin(F.broadcast(c.select("event_type").distinct())).join(c, ["day", "event_type"], "left")  # days x kinds of events
    before = Window.partitionBy("event_type").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    used = grid.withColumn("used", F.coalesce(F.sum("n").over(before), F.lit(0)))
    return used.groupBy(F.col("day").cast("string").alias("day")).agg(F.min_by("event_type", F.struct("used", "event_type")).alias("chosen"), F.min("used").alias("used"))


_SPAN = "[0-9]{2,}"


@query(f"""WITH m AS (SELECT doc_id, text, regexp_extract_all(text, '{_SPAN}') AS m, string_split_regex(text, '{_SPAN}') AS p FROM documents),
x AS (SELECT doc_id, text, unnest(range(1, len(m) + 1)) AS i, m, p FROM m), s AS (SELECT doc_id, text, m[i] AS match, 1 + list_sum(list_transform(p[1:i], lambda v: length(v))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda v: length(v))), 0) AS pos FROM x),
c AS (SELECT doc_id, pos, match, substring(text, greatest(pos - 24, 1)::BIGINT, (pos - greatest(pos - 24, 1))::BIGINT) AS ctx FROM s)
SELECT doc_id, count(*) AS spans, count(*) FILTER (NOT contains(ctx, '(')) AS flagged, CAST(min(pos) FILTER (NOT contains(ctx, '(')) AS BIGINT) AS first_at FROM c GROUP BY doc_id""")
def rule_spans_windowed(spark, d):
    """Matches of a rule that have no exempting mark within the 24 characters before them."""
    t = F.col("text")
    x = table(spark, d, "documents").select("doc_id", "text", F.explode(texts.spans(t, _SPAN)).alias("s"))
    c = x.select("doc_id", F.col("s.start").alias("at"), (~F.contains(texts.context(t, F.col("s.start"), F.lit(0), 24, 0), F.lit("("))).alias("bad"))
    return c.groupBy("doc_id").agg(F.count("*").alias("spans"), F.count_if("bad").alias("flagged"), F.min(F.when(F.col("bad"), F.col("at"))).cast("long").alias("first_at"))


@query("""WITH c AS (SELECT o_orderpriority AS label, o_orderstatus AS v, count(*) AS n FROM orders GROUP BY ALL), s AS (SELECT *, n / sum(n) OVER (PARTITION BY label) AS share, sum(n) OVER (PARTITION BY label) AS cases FROM c),
b AS (SELECT label, sum(share) AS s, max(cases) AS c, count(*) AS n FROM s GROUP BY label)
SELECT CAST(sum(n) AS BIGINT) AS n_rows, count(*) AS n_labels, max(abs(s - 1)) <= 1e-6 AS sums_ok, abs(sum(c) - 15000) <= 0.05 * 15000 AS total_ok FROM b""")
def provenance_checks(spark, d):
    """Row sums of a table of shares, and its cases against a published total of 15,000."""
    c = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("label"), "o_orderstatus").agg(F.count("*").alias("n"))
    whole = F.sum("n").over(Window.partitionBy("label"))
    return report_tables.provenance(c.withColumn("share", F.col("n") / whole).withColumn("cases", whole), "label", "share", "cases", 15000.0)


@query()
def quality_cv(spark, d):
    """Five folds of a linear classifier of the quality label on simple text measures."""
    t = F.col("text")
    measures = {"chars": F.log1p(F.length(t)), "digits": F.regexp_count(t, F.lit("[0-9]")) / (F.length(t) + 1), "marks": F.regexp_count(t, F.lit(r"[^\w\s]")) / (F.length(t) + 1), "variety": F.size(F.array_distinct(s.words(t))) / (F.size(s.words(t)) + 1)}
    rows = table(spark, d, "documents").join(table(spark, d, "labels").filter("quality is not null"), "doc_id").select("doc_id", "quality", *(c.alias(k) for k, c in measures.items()))
    found = texts.cross_validated(written(rows, "quality"), "doc_id", "quality", list(measures))
    return found.select("fold", "n", *(r(c).alias(c) for c in ("accuracy", "macro_f1", "majority_accuracy")))
