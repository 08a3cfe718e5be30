"""Masking and coverage with terms that come from the data."""

from __future__ import annotations

from pyspark.sql import functions as F

from .catalog import query, r, table
from .operators import terms as tm

#: Stand-ins for numbers with a unit and for cue words.
NUMERIC, CUES = r"[0-9]+(?:\.[0-9]+)? ?(?:years|percent|dollars|km|%)", "licensed|license|public|rights"
_VOC = "SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]{6,}')) AS term FROM benchmark"


def vocabulary(spark, d):
    words = F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{6,}"), F.lit(0))).alias("term")
    return table(spark, d, "benchmark").select(words).distinct()


@query(f"""WITH v AS ({_VOC}), p AS (SELECT string_agg(term, '|' ORDER BY length(term) DESC, term) AS p FROM v)
SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(text, (SELECT p FROM p), '[VALUE]', 'g'), '{NUMERIC}', '[NUMBER]', 'g'), '{CUES}', '[CUE]', 'g')) AS masked FROM documents""")
def data_term_masking(spark, d):
    """Values that other data hold, then numbers with units, then cue words, in this order."""
    told = tm.masked_terms(table(spark, d, "documents"), "doc_id", "text", vocabulary(spark, d), "[VALUE]")
    return told.select("doc_id", F.md5(F.regexp_replace(F.regexp_replace("text", NUMERIC, "[NUMBER]"), CUES, "[CUE]")).alias("masked"))


@query(r"""WITH h AS (SELECT page_id, html, regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1) AS host, url FROM pages)
SELECT page_id, md5(replace(CASE WHEN host = '' THEN replace(html, url, '[OWN]') ELSE replace(replace(html, url, '[OWN]'), host, '[OWN]') END, '[OWN]', '[OWN]')) AS masked FROM h""")
def own_value_masking(spark, d):
    """A page without its own address and host."""
    host = F.regexp_extract("url", "^[a-z]+://([^/?#:]+)", 1)
    return table(spark, d, "pages").select("page_id", F.md5(tm.own_masked(F.col("html"), [F.col("url"), host], "[OWN]")).alias("masked"))


@query(f"""WITH v AS ({_VOC}), n AS (SELECT source, count(*) AS n_rows FROM documents GROUP BY 1),
u AS (SELECT DISTINCT d.source, v.term FROM documents d, v WHERE contains(d.text, v.term)),
k AS (SELECT n.source, v.term, row_number() OVER (PARTITION BY n.source ORDER BY v.term) AS rk FROM n CROSS JOIN v LEFT JOIN u ON u.source IS NOT DISTINCT FROM n.source AND u.term = v.term WHERE u.term IS NULL)
SELECT n.source, n_rows, (SELECT count(*) FROM v) AS n_terms, (SELECT count(*) FROM u WHERE u.source IS NOT DISTINCT FROM n.source) AS used, round((SELECT count(*) FROM u WHERE u.source IS NOT DISTINCT FROM n.source) / greatest((SELECT count(*) FROM v), 1), 6) AS coverage,
coalesce((SELECT string_agg(term, ',' ORDER BY term) FROM k WHERE k.source IS NOT DISTINCT FROM n.source AND rk <= 5), '') AS unused FROM n""")
def vocabulary_gaps(spark, d):
    """How much of a vocabulary each source's texts hold, and the first terms that none does."""
    told = tm.coverage(table(spark, d, "documents"), ["source"], "text", vocabulary(spark, d))
    return told.select("source", "n_rows", "n_terms", "used", r("coverage").alias("coverage"), F.array_join("unused", ",").alias("unused"))
