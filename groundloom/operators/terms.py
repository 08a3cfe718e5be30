"""Many terms at once: masking, matches and coverage of terms that come from the data.

Up to ``TERMS`` terms are sent to all tasks as one automaton, which reads a text once however many terms there are. More are
joined: windows of the texts meet the terms by their first characters, and a candidate is compared in full. Both forms
find the same. A match is the longest term at the leftmost place, then the search goes on behind it, as with an
alternation of the terms, longest first.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranking import attached, same, sized

#: Terms of one automaton, and characters of a window.
TERMS, WINDOW = 200_000, 512
_MATCHES = "array<struct<start:int,length:int,term:string>>"


def value_terms(rows: DataFrame, columns: list[str], least: int = 1) -> DataFrame:
    """term: the different values of the columns as texts; nulls, shorter ones and the word None are none."""
    values = F.explode(F.array_distinct(F.array(*(F.col(c).cast("string") for c in columns)))).alias("term")
    return rows.select(values).filter(F.col("term").isNotNull() & (F.length("term") >= least) & (F.col("term") != "None")).distinct()


def chosen(matches: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Leftmost, longest, not overlapping, of (start, length, term)."""
    out, end = [], 0
    for start, length, term in sorted(matches, key=lambda m: (m[0], -m[1])):
        if start >= end:
            out.append((start, length, term))
            end = start + length
    return out


def _automaton(terms: list[str]):
    import ahocorasick

    made = ahocorasick.Automaton()
    for t in terms:
        made.add_word(t, t)
    made.make_automaton()
    return made


def _found(automaton, text: str | None) -> list[tuple[int, int, str]]:
    if not text or not len(automaton):
        return []
    return [(end + 1 - len(t), len(t), t) for end, t in automaton.iter(text)]


def _few(terms: DataFrame, most: int) -> list[str] | None:
    """The terms, if they are at most ``most``."""
    rows = terms.select("term").filter("term <> ''").distinct().limit(most + 1).collect()
    return [r["term"] for r in rows] if len(rows) <= most else None


def _joined(rows: DataFrame, keys: list[str], text: str, terms: DataFrame) -> DataFrame:
    """keys, start, length, term: every place of every term, by a join on the terms' first characters."""
    known = terms.select("term").filter("term <> ''").distinct().withColumn("length", F.length("term"))
    sizes = known.agg(F.coalesce(F.min("length"), F.lit(1)).alias("head"), F.coalesce(F.max("length"), F.lit(1)).alias("longest")).first()
    head, longest = sizes["head"], sizes["longest"]
    known = known.withColumn("gram", F.substring("term", 1, head))
    long = rows.select(*keys, F.col(text).alias("__t"), F.length(text).alias("__n")).filter(F.col("__n") >= head)
    cut = long.withColumn("__from", F.explode(F.expr(f"sequence(0, __n - {head}, {WINDOW})"))).select(*keys, "__from", F.col("__t").substr(F.col("__from") + 1, F.lit(WINDOW + longest - 1)).alias("__w"))
    at = cut.withColumn("__i", F.explode(F.expr(f"sequence(0, least({WINDOW - 1}, length(__w) - {head}))")))
    grams = at.withColumn("gram", F.col("__w").substr(F.col("__i") + 1, F.lit(head)))
    hits = grams.join(sized(known), "gram").filter(F.col("__w").substr(F.col("__i") + 1, F.col("length")) == F.col("term"))
    return hits.select(*keys, (F.col("__from") + F.col("__i")).alias("start"), "length", "term")


def masked_terms(rows: DataFrame, key: str, text: str, terms: DataFrame, mask: str, most: int = TERMS) -> DataFrame:
    """key and the text with each match (of ``terms``: term) replaced; keys must differ if there are more than ``most`` terms. A null text stays null."""

    def replaced(t: str | None, matches: list[tuple[int, int, str]]) -> str | None:
        if t is None:
            return None
        parts, end = [], 0
        for start, length, _ in matches:
            parts += [t[end:start], mask]
            end = start + length
        return "".join([*parts, t[end:]])

    names = _few(terms, most)
    if names is not None:

        def mark(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            automaton = _automaton(names)
            for part in batches:
                yield pd.DataFrame({key: part[key], text: [replaced(t, chosen(_found(automaton, t))) for t in part[text].astype(object).where(part[text].notna(), None)]})

        narrow = rows.select(key, text)
        return narrow.mapInPandas(mark, narrow.schema)
    found = _joined(rows, [key], text, terms).groupBy(key).agg(F.collect_list(F.struct("start", "length", "term")).alias("__m"))

    def rebuild(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            out = [replaced(t, chosen([(m["start"], m["length"], m["term"]) for m in ms] if ms is not None else [])) for t, ms in zip(part[text].astype(object).where(part[text].notna(), None), part["__m"])]
            yield pd.DataFrame({key: part[key], text: out})

    narrow = rows.select(key, text)
    return narrow.join(found, key, "left").mapInPandas(rebuild, narrow.schema)


def own_masked(text: Column, own: list[Column], mask: str) -> Column:
    """The text without its row's own values, the longest first; nulls and empty values are none."""
    values = F.filter(F.array(*(o.cast("string") for o in own)), lambda v: v.isNotNull() & (v != ""))
    ordered = F.transform(F.array_sort(F.transform(values, lambda v: F.struct((-F.length(v)).alias("n"), v.alias("v")))), lambda x: x["v"])
    return F.aggregate(ordered, text, lambda t, v: F.replace(t, v, F.lit(mask)))


def used_terms(rows: DataFrame, group: list[str], text: str, terms: DataFrame, most: int = TERMS) -> DataFrame:
    """group, term: each term that occurs anywhere in a text of the group, once."""
    names = _few(terms, most)
    if names is None:
        return _joined(rows, group, text, terms).select(*group, "term").distinct()
    narrow = rows.select(*group, F.col(text).alias("__t"))
    schema = rows.select(*group, F.lit("").alias("term")).schema

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        automaton = _automaton(names)
        for part in batches:
            found = part["__t"].map(lambda t: sorted({m[2] for m in _found(automaton, t)}))
            yield part[group].assign(term=found).explode("term").dropna(subset=["term"]).drop_duplicates()

    return narrow.mapInPandas(look, schema).distinct()


def coverage(rows: DataFrame, group: list[str], text: str, terms: DataFrame, show: int = 5, most: int = TERMS) -> DataFrame:
    """group, n_rows, n_terms, used, coverage, unused (the first ``show`` terms in order that no text of the group holds)."""
    known = terms.select("term").filter("term <> ''").distinct()
    groups = rows.groupBy(*group).agg(F.count("*").alias("n_rows"))
    seen = used_terms(rows, group, text, known, most)
    counted = attached(groups, known.agg(F.count("*").alias("n_terms")), [])
    tally = seen.groupBy(*group).agg(F.count("*").alias("used")).withColumnsRenamed({c: f"__{c}" for c in group})
    met = counted.join(tally, same(counted, tally, group), "left").drop(*(f"__{c}" for c in group)).withColumn("used", F.coalesce("used", F.lit(0)))
    grid = groups.select(*group).crossJoin(sized(known))  # groups x vocabulary
    there = seen.withColumnsRenamed({c: f"__{c}" for c in [*group, "term"]})
    lacking = grid.join(there, same(grid, there, [*group, "term"]), "left_anti")
    first = lacking.withColumn("__r", F.row_number().over(Window.partitionBy(*group).orderBy("term"))).filter(F.col("__r") <= show)
    listed = first.groupBy(*group).agg(F.array_sort(F.collect_list("term")).alias("unused")).withColumnsRenamed({c: f"__{c}" for c in group})
    told = met.join(listed, same(met, listed, group), "left").drop(*(f"__{c}" for c in group))
    return told.select(*group, "n_rows", "n_terms", "used", (F.col("used") / F.greatest("n_terms", F.lit(1))).alias("coverage"), F.coalesce("unused", F.array().cast("array<string>")).alias("unused"))
