"""The report of a run over documents and labels, with its gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from .catalog import PLACES, query, r, table
from .operators import report as rp
from .operators.checks import fingerprint

CONFIG = {"seed": 7, "columns": ["text", "lang"], "name": "día"}

_PARTS = {
    "schema_pass_rate": ("documents", "avg(CAST(doc_id IS NOT NULL AND text IS NOT NULL AND n_chars >= 0 AS INT))"),
    "validation_error_rate": ("documents", "avg(CAST(lang IS NULL AS INT))"),
    "validation_warning_rate": ("documents", "avg(CAST(n_chars < 40 AS INT))"),
    "null_only_exposed_columns": ("documents", "CAST(count(text) = 0 AS INT) + CAST(count(lang) = 0 AS INT) + CAST(count(source) = 0 AS INT)"),
    "district_placeholder_rate": ("documents", "avg(CAST(text LIKE '%[unknown]%' AS INT))"),
    "exact_duplicate_narrative_rows": ("texts", "sum(n - 1)"),
    "hobby_set_duplicate_rate": ("texts", "sum(CASE WHEN n > 1 THEN n ELSE 0 END) / sum(n)"),
    "hobby_atom_top1_share": ("sources", "max(n) / sum(n)"),
    "fact_checks_failed": ("labels", "CAST(abs(avg(quality) - 0.7) > 0.1 AS INT) + CAST(avg(toxic) > 0.05 AS INT)"),
}
_GATES = [g for g in rp.PREVIEW if g.switch not in ("field_marginal", "joint") and g.needed]


def _sql() -> str:
    metrics = " UNION ALL ".join(f"SELECT '{k}' AS name, CAST({e} AS DOUBLE) AS value FROM {t}" for k, (t, e) in _PARTS.items())
    gates = " UNION ALL ".join(f"SELECT '{g.name}' AS name, '{g.comparator}' AS comparator, CAST({g.limit} AS DOUBLE) AS threshold, value {g.comparator.replace('==', '=')} {g.limit} AS passed FROM m WHERE name = '{g.name}'" for g in _GATES)
    return f"""WITH texts AS (SELECT text, count(*) AS n FROM documents GROUP BY 1), sources AS (SELECT source, count(*) AS n FROM documents GROUP BY 1), m AS ({metrics}), g AS ({gates}),
every AS (SELECT 'metric' AS kind, name, value, NULL :: VARCHAR AS comparator, NULL :: DOUBLE AS threshold, NULL :: BOOLEAN AS passed FROM m
UNION ALL SELECT 'gate', name, value, comparator, threshold, passed FROM g JOIN m USING (name) UNION ALL SELECT 'verdict', 'failed gates', count(*) FILTER (NOT passed), NULL, NULL, bool_and(passed) FROM g)
SELECT kind, name, round(value, {PLACES}) AS value, comparator, threshold, passed, '{fingerprint(CONFIG)}' AS config FROM every"""


@query(_sql())
def preview_report(spark, d):
    """Metrics of four grains in a pass each, nine gates over them, the verdict, and the configuration's fingerprint."""
    docs, n = table(spark, d, "documents"), F.col("n")
    share = lambda c: F.avg(c.cast("int"))
    empty = lambda c: (F.count(c) == 0).cast("int")
    grains = [
        (docs, {
            "schema_pass_rate": share(F.col("doc_id").isNotNull() & F.col("text").isNotNull() & (F.col("n_chars") >= 0)),
            "validation_error_rate": share(F.col("lang").isNull()),
            "validation_warning_rate": share(F.col("n_chars") < 40),
            "null_only_exposed_columns": empty("text") + empty("lang") + empty("source"),
            "district_placeholder_rate": share(F.contains("text", F.lit("[unknown]"))),
        }),
        (docs.groupBy(F.sha2("text", 256).alias("k")).agg(F.count("*").alias("n")), {"exact_duplicate_narrative_rows": F.sum(n - 1), "hobby_set_duplicate_rate": F.sum(F.when(n > 1, n).otherwise(0)) / F.sum(n)}),
        (docs.groupBy("source").agg(F.count("*").alias("n")), {"hobby_atom_top1_share": F.max(n) / F.sum(n)}),
        (table(spark, d, "labels"), {"fact_checks_failed": (F.abs(F.avg("quality") - 0.7) > 0.1).cast("int") + (F.avg("toxic") > 0.05).cast("int")}),
    ]
    told = rp.report(rp.measured(grains), rp.PREVIEW, CONFIG, ("field_marginal", "joint"))
    return told.withColumn("value", r("value"))
