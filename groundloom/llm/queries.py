"""One query for each training-data operator, and the pipeline, for ``__spark_entry__``."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, crfquality, fim, langid, licenses, linededup, mixing, neardup, packing, qualityrules, sharding, warc, yinyang
from .common import table

#: Folder of the public vocabularies; GROUNDLOOM_TOKENIZERS names another.
TOKENIZERS = "GROUNDLOOM_TOKENIZERS"
VOCABULARY = "byte_bpe_50k.json"
#: Shares of tokens by language that the mixture aims at.
TARGETS = {"de": 0.2, "en": 0.5, "es": 0.1, "fr": 0.2}


def vocabulary_path() -> str:
    if folder := os.environ.get(TOKENIZERS):
        return f"{folder}/{VOCABULARY}"
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def op1_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.nearest(spark, vectors, vectors.filter("vec_id % 20 = 0"), 20)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mixing.mix(spark, docs, docs.select("doc_id", F.col("lang").alias("domain")), TARGETS, total="natural")


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shards(spark, table(spark, sf_dir, "documents"), count=8)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qualityrules.judge(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(spark, table(spark, sf_dir, "documents"), vocabulary_path(), 1024, 2)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.drop_recurring_lines(spark, table(spark, sf_dir, "documents"))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(spark, table(spark, sf_dir, "documents"), 85)


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(spark, table(spark, sf_dir, "documents"), 5)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crfquality.score_documents(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), 4, 2)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(spark, table(spark, sf_dir, "pages"))


def op11_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return yinyang.clusters(spark, table(spark, sf_dir, "embeddings"), k=40, rounds=5, seed=2)


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = fim.restored(fim.transform(table(spark, sf_dir, "documents"), seed=1))
    digest = lambda c: F.sha2(F.col(c).cast("binary"), 256)
    return back.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest("output").alias("output_sha256"), digest("restored").alias("restored_sha256"))


def op13_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.labelled(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_nearest, op2_mixing, op3_sharding, op4_quality_rules, op5_packing, op6_line_dedup, op7_near_dedup, op8_language, op9_quality, op10_warc, op11_clusters, op12_fill_middle, op13_licenses, pipeline)}

_SPACE = r"[\x20\x09-\x0D]+"

_NEAR = rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_SPACE}'), lambda x: x <> '') AS w FROM documents),
sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM words),
items AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
linked AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM items a JOIN items b ON a.x = b.x AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
reach AS (SELECT doc_id AS id, doc_id AS other FROM sets UNION SELECT r.id, l.b FROM reach r JOIN linked l ON l.a = r.other)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, r.low AS component_id, s.doc_id = r.low AS kept
FROM sets s JOIN (SELECT id, min(other) AS low FROM reach GROUP BY id) r ON r.id = s.doc_id"""

_WARC = f"""
WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, CASE WHEN payload_bytes >= {warc.LEAST_BYTES} THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM f"""


def _rules_sql() -> str:
    def share(s: str) -> str:
        a, b = s.split(" div ")
        return f"({a}) // {b}"

    rate, rules = qualityrules.ALPHA, qualityrules.RULES
    each = [" + ".join(f"CAST({share(s)} {'<=' if way == 'over' else '>='} {c} AS INT)" for c in cuts) for s, way, cuts in rules.values()]
    both = ", ".join(each)
    return rf"""
WITH t AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(text, '{_SPACE}'), lambda x: x <> '') AS w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM t),
wins AS (SELECT doc_id, unnest(range(1, len(w) - 3)) AS i, w FROM w WHERE len(w) >= 5),
keyed AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS x FROM wins),
twice AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, x) AS n FROM keyed) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, range(5) AS r(k) GROUP BY doc_id),
m AS (SELECT w.doc_id, lang, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words FROM w LEFT JOIN rep ON rep.doc_id = w.doc_id),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m),
held AS (SELECT * FROM b WHERE NOT base_failed AND doc_id IN (SELECT doc_id FROM labels GROUP BY doc_id HAVING min(quality) = 1)),
spare AS (SELECT lang, least({both}) AS spared FROM held),
grid AS (SELECT lang, CAST(r.level AS INT) AS level, count(*) AS good, count(*) FILTER (spared <= r.level) AS lost FROM spare, range({qualityrules.LEVELS}) AS r(level) GROUP BY ALL),
tested AS (SELECT *, CASE WHEN lost > {rate!r} * good THEN false ELSE
  list_sum(list_transform(range(0, lost + 1), lambda i: exp(lgamma(good + 1) - lgamma(i + 1) - lgamma(good - i + 1) + i * ln({rate!r}) + (good - i) * ln(1 - {rate!r}))))
  <= {qualityrules.DELTA!r} / (SELECT count(DISTINCT lang) FROM t) END AS stands FROM grid),
upto AS (SELECT *, bool_and(stands) OVER (PARTITION BY lang ORDER BY level) AS ok FROM tested),
c AS (SELECT lang, max(level) AS level, max(good) AS good, arg_max(lost, level) AS lost FROM upto WHERE ok GROUP BY lang)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(least({both}) > level, true) AS kept, level, good, lost FROM b LEFT JOIN c ON c.lang = b.lang"""


_FIM = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || doc_id) AS h FROM documents),
d AS (SELECT *, CAST(len(u) AS BIGINT) AS n, list_transform([1, 9, 17, 25], lambda i: CAST('0x' || substr(h, i, 8) AS BIGINT)) AS d FROM t),
c AS (SELECT *, least(d[1] % (n + 1), d[2] % (n + 1)) AS lo, greatest(d[1] % (n + 1), d[2] % (n + 1)) AS hi, CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR d[3] % 100 >= 90 THEN 'plain' WHEN d[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM d),
p AS (SELECT doc_id, n, form, text, array_to_string(u[1:lo], '') AS p, array_to_string(u[lo + 1:hi], '') AS m, array_to_string(u[hi + 1:], '') AS s FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(text) AS restored_sha256 FROM p"""


def _clusters_sql(k: int = 40, rounds: int = 5, seed: int = 2) -> str:
    def assigned(i: int) -> str:
        near = "list_sum(list_transform(range(1, 65), lambda j: (x.v[j] - c.c[j]) * (x.v[j] - c.c[j])))"
        return f"a{i} AS MATERIALIZED (SELECT vec_id, any_value(v) AS v, min(struct_pack(d := d, k := k)) AS best FROM (SELECT x.vec_id, x.v, c.k, CAST({near} AS BIGINT) AS d FROM x, c{i} c) GROUP BY vec_id)"

    def moved(i: int) -> str:
        return f"""s{i} AS (SELECT best.k AS k, j, sum(v[j]) AS s, count(*) AS n FROM a{i}, range(1, 65) AS r(j) GROUP BY ALL),
c{i + 1} AS MATERIALIZED (SELECT c.k, coalesce(m.c, c.c) AS c FROM c{i} c LEFT JOIN (SELECT k, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY j) AS c FROM s{i} GROUP BY k) m ON m.k = c.k)"""

    steps = ", ".join(f"{assigned(i)}, {moved(i)}" for i in range(rounds)) + f", {assigned(rounds)}"
    return f"""
WITH x AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda e: CAST(floor(256 * CAST(e AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{seed}:' || vec_id)) - 1 AS k, v AS c FROM x ORDER BY sha256('{seed}:' || vec_id) LIMIT {k}), {steps}
SELECT vec_id, CAST(best.k AS INT) AS cluster, best.d AS distance, CAST(sum(best.d) OVER (PARTITION BY best.k) AS BIGINT) AS cluster_inertia, CAST(sum(best.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.c, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c ON c.k = a.best.k"""


def _licenses_sql() -> str:
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    rows = ", ".join(f"({i}, {quote(label)}, {priority}, {quote(' ' + keyword.replace(' ', '  ') + ' ')}, {quote(licenses.compiled(pattern))}, {base})" for i, (label, priority, keyword, pattern, base) in enumerate(licenses.rules()))
    scores = " ".join(f"WHEN {p} THEN {s}" for p, s in licenses.SCORES.items())
    words = "len({0}) - len(replace({0}, ' ', ''))"
    parts = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    return rf"""
WITH r(rule, label, priority, keyword, pattern, base) AS (VALUES {rows}),
b AS (SELECT rowid AS id, doc_id, trim(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{parts}', '  ', 'g')) AS t FROM (SELECT *, row_number() OVER () AS rowid FROM documents)),
w AS MATERIALIZED (SELECT id, doc_id, CASE WHEN t = '' THEN '' ELSE ' ' || t || ' ' END AS w FROM b),
k AS MATERIALIZED (SELECT w.id, w.w, q.keyword FROM w, (SELECT DISTINCT keyword FROM r) q WHERE contains(w.w, q.keyword)),
m AS (SELECT k.id, r.*, regexp_extract_all(k.w, r.pattern) AS found, string_split(regexp_replace(k.w, r.pattern, ' ' || chr(1) || '\1 ', 'g'), '  ') AS marked FROM k JOIN r USING (keyword) WHERE regexp_matches(k.w, r.pattern)),
z AS (SELECT *, list_filter(range(len(marked)), lambda i: contains(marked[i + 1], chr(1))) AS starts FROM m),
e AS (SELECT id, rule, label, priority, base, unnest(starts) AS s, unnest(found) AS f FROM z),
d AS MATERIALIZED (SELECT id, rule, label, priority, base, s, s + ({words.format('f')}) // 2 AS e FROM e),
kept AS (SELECT * FROM d WHERE NOT EXISTS (SELECT 1 FROM d x WHERE x.id = d.id AND x.priority <= d.priority AND x.s <= d.s AND x.e >= d.e AND (x.s < d.s OR x.e > d.e OR x.priority < d.priority OR x.rule < d.rule))),
base AS (SELECT id, count(*) AS n, min(s) AS lo, max(s) AS hi, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM d WHERE base GROUP BY id),
every AS (SELECT id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT id, label FROM kept UNION ALL SELECT id, label FROM d WHERE base) GROUP BY id),
top AS (SELECT id, min(priority) AS p FROM kept GROUP BY id)
SELECT doc_id, CAST(({words.format('w')}) // 2 AS BIGINT) AS n_words, coalesce(n, 0) AS n_base, lo AS first_word, hi AS last_word, coalesce(base.labels, '') AS base_labels, coalesce(every.labels, '') AS labels, CAST(CASE p {scores} ELSE 0 END AS DOUBLE) AS score
FROM w LEFT JOIN base ON base.id = w.id LEFT JOIN every ON every.id = w.id LEFT JOIN top ON top.id = w.id"""


ORACLES = {"op4_quality_rules": _rules_sql(), "op7_near_dedup": _NEAR, "op10_warc": _WARC, "op11_clusters": _clusters_sql(), "op12_fill_middle": _FIM, "op13_licenses": _licenses_sql()}
