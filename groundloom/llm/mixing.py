"""Soft-membership mixing of sources to target weights.

A naive Bayes classifier over hashed words, learned from a labelled table, gives each document a posterior over
the target domains; its log odds are those of at most ``EVIDENCE`` words, so that membership stays soft in long texts.
Document rates then solve a least-squares problem, by projected gradient: rates are at least ``least_rate``
(0 or more), and the expected token total of each domain, rate x tokens x posterior summed over the documents,
shall equal its target.

Each step needs only one total a domain. A document's rate is a function of its posterior and of the last steps, so
a step writes no table and a lost task is simply run again; after ``STEPS`` steps the rates are written and the
history starts anew. The fit ends when every domain is within ``CLOSE`` of the budget, or when targets that no rates
can meet leave the residual as it is (it gains less than a hundredth of CLOSE in ``STEPS`` steps); the residual is returned. If neither
comes to pass in ``MOST_STEPS`` steps, an error is raised.

Learning uses at most ``MOST_LABELLED`` labelled documents (least id hashes); prediction and fit use all documents
and whole texts. ``total`` is the budget of tokens: a number, "natural" (as many as the documents have, so that domains above their target are
thinned), or None (the least for which no domain must shrink).

Cases: rows of one doc_id are one document (a null id too). Null, empty and blank texts: no tokens, the prior as
posterior, and a rate that moves nothing. A domain without labelled documents gets posterior 0 and its target is left out of the
rest. No document: no row. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch

BUCKETS, MOST_LABELLED, EVIDENCE, STEPS, MOST_STEPS, CLOSE = 8192, 4000, 20, 25, 400, 1e-3
_GAP = r"[\x20\x09-\x0D]+"


def _words(docs: DataFrame, *keep: str) -> DataFrame:
    """A row for each word, and one without a word for rows that have none."""
    found = docs.select("doc_id", *keep, F.explode_outer(F.split("text", _GAP)).alias("w"))
    return found.select("doc_id", *keep, F.when(F.col("w") != "", F.expr(f"pmod(xxhash64(w), {BUCKETS})")).alias("bucket"))


def classifier(docs: DataFrame, labelled: DataFrame, domains: list[str]) -> tuple[DataFrame, dict[str, float]]:
    """(bucket, a weight for each domain) and the log priors of the domains that were seen."""
    import math

    chosen = labelled.filter(F.col("domain").isin(domains) & F.col("doc_id").isNotNull()).orderBy(F.xxhash64("doc_id", F.lit(13)), "doc_id", "domain").limit(MOST_LABELLED)
    known = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    counts = _words(known, "domain").filter("bucket is not null").groupBy("bucket", "domain").agg(F.count("*").alias("n")).groupBy("bucket").agg(*(F.sum(F.when(F.col("domain") == d, F.col("n")).otherwise(0)).alias(f"n{i}") for i, d in enumerate(domains))).collect()  # BUCKETS rows at most
    prior = {r["domain"]: r["n"] for r in known.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    totals = [sum(r[f"n{i}"] for r in counts) for i in range(len(domains))]
    by_bucket = {r["bucket"]: r for r in counts}
    rows = [(b, *(math.log(((by_bucket[b][f"n{i}"] if b in by_bucket else 0) + 0.5) / (totals[i] + 0.5 * BUCKETS)) for i in range(len(domains)))) for b in range(BUCKETS)]
    table = docs.sparkSession.createDataFrame(rows, "bucket long, " + ", ".join(f"w{i} double" for i in range(len(domains))))
    every = sum(prior.values())
    return table, {d: math.log(prior[d] / every) for d in domains if prior.get(d)}


def posteriors(docs: DataFrame, labelled: DataFrame, domains: list[str]) -> DataFrame:
    """doc_id, n_tokens, p0, p1, ... in the order of the domains."""
    table, prior = classifier(docs, labelled, domains)
    k = range(len(domains))
    scored = _words(docs.select("doc_id", "text")).join(F.broadcast(table), "bucket", "left")  # BUCKETS rows
    sums = scored.groupBy("doc_id").agg(F.count("bucket").alias("n_tokens"), *(F.coalesce(F.sum(f"w{i}"), F.lit(0.0)).alias(f"s{i}") for i in k))
    temper = F.least(F.lit(1.0), F.lit(float(EVIDENCE)) / F.greatest(F.col("n_tokens"), F.lit(1)))
    seen = [i for i in k if domains[i] in prior]
    if not seen:
        return sums.select("doc_id", "n_tokens", *(F.lit(1.0 / len(domains)).alias(f"p{i}") for i in k))
    logit = sums.select("doc_id", "n_tokens", *((F.col(f"s{i}") * temper + prior[domains[i]]).alias(f"l{i}") for i in seen))
    top = F.greatest(*(F.col(f"l{i}") for i in seen)) if len(seen) > 1 else F.col(f"l{seen[0]}")
    logit = logit.withColumn("top", top)
    power = logit.select("doc_id", "n_tokens", *(F.exp(F.col(f"l{i}") - F.col("top")).alias(f"e{i}") for i in seen))
    whole = sum((F.col(f"e{i}") for i in seen[1:]), F.col(f"e{seen[0]}"))
    return power.select("doc_id", "n_tokens", *((F.col(f"e{i}") / whole if i in seen else F.lit(0.0)).alias(f"p{i}") for i in k))


def rate_of(history: list[list[float]], least: float) -> Column:
    """The rate after some steps from ``rate_0``: each adds a combination of the posteriors and is cut at the bound."""
    rate: Column = F.col("rate_0")
    for step in history:
        rate = F.greatest(F.lit(least), rate + sum(F.col(f"p{i}") * F.lit(u) for i, u in enumerate(step)))
    return rate


def mix(spark: SparkSession, docs: DataFrame, labelled: DataFrame, targets: dict[str, float], total: float | str | None = None, least_rate: float = 0.0) -> DataFrame:
    """doc_id, n_tokens, p_<domain>..., rate, copies (the rate rounded up or down by a hash of the id, right on average), residual (the largest miss, as a share of the budget)."""
    scratch = Scratch(spark, "mixing")
    domains = sorted(targets)
    k = range(len(domains))
    soft = scratch.save(posteriors(docs, labelled, domains).withColumn("rate_0", F.lit(max(1.0, least_rate))), "rates-0")
    held = lambda rate: [x or 0.0 for x in soft.agg(*(F.sum(rate * F.col("n_tokens") * F.col(f"p{i}")) for i in k)).first()]
    natural = held(F.lit(1.0))
    live = [i for i in k if natural[i] > 0]
    weight = sum(targets[domains[i]] for i in live) or 1.0
    share = [targets[domains[i]] / weight if i in live else 0.0 for i in k]
    budget = sum(natural) if total == "natural" else total if total is not None else max((natural[i] / share[i] for i in live if share[i] > 0), default=0.0)
    want = [budget * s for s in share]
    miss = lambda now: max((abs(now[i] - want[i]) for i in live), default=0.0) / max(budget, 1.0)
    history: list[list[float]] = []
    now, taken, written = held(F.col("rate_0")), 0, 0
    misses = [miss(now)]
    while misses[-1] > CLOSE and (taken < STEPS or misses[-STEPS - 1] - misses[-1] > CLOSE / 100):
        if taken == MOST_STEPS:
            raise RuntimeError(f"rates still move after {taken} steps; largest miss {misses[-1]:.4f} of the budget")
        if len(history) == STEPS:
            written += 1
            soft = scratch.save(soft.withColumn("rate_0", rate_of(history, least_rate)), f"rates-{written}")
            history = []
        history.append([(want[i] - now[i]) / natural[i] if i in live else 0.0 for i in k])
        now, taken = held(rate_of(history, least_rate)), taken + 1
        misses.append(miss(now))
    rated = soft.withColumn("rate", rate_of(history, least_rate))
    part = F.expr("pmod(xxhash64(doc_id, 17), 1048576) / 1048576D")
    return rated.select("doc_id", "n_tokens", *(F.col(f"p{i}").alias(f"p_{d}") for i, d in enumerate(domains)), "rate", F.floor(F.col("rate") + part).cast("long").alias("copies"), F.lit(misses[-1]).alias("residual"))
