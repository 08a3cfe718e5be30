"""Terms by automaton and by join against regular expressions; own values; coverage."""

import random
import re

import pytest
from pyspark.sql import functions as F

from groundloom.operators import terms as tm
from groundloom.operators import texts


@pytest.fixture(scope="module")
def data(spark):
    rng = random.Random(3)
    terms = sorted({"".join(rng.choices("abé日", k=rng.randrange(2, 6))) for _ in range(60)} | {"None"})
    rows = [(i, "".join(rng.choices("abé日 x", k=rng.randrange(0, 1500))), "g" if i % 3 else None) for i in range(40)] + [(90, None, "g"), (91, "", "h"), (92, "xx xx", "h")]
    return terms, rows, spark.createDataFrame([(t,) for t in terms] + [("",), (None,)], "term string"), spark.createDataFrame(rows, "id long, t string, g string")


@pytest.mark.parametrize("most", [10_000, 5])
def test_masking_equals_an_alternation_longest_first(data, most):
    terms, rows, known, frame = data
    pattern = re.compile("|".join(re.escape(t) for t in sorted(terms, key=len, reverse=True)))
    got = {r.id: r.t for r in tm.masked_terms(frame, "id", "t", known, "[\\1]", most).collect()}
    assert got == {i: None if t is None else pattern.sub(lambda m: "[\\1]", t) for i, t, _ in rows}


@pytest.mark.parametrize("most", [10_000, 5])
def test_coverage_counts_substrings(data, most):
    terms, rows, known, frame = data
    for r in tm.coverage(frame, ["g"], "t", known, 5, most).collect():
        mine = [t or "" for _, t, g in rows if g == r.g]
        used = {x for x in terms if any(x in t for t in mine)}
        assert (r.n_rows, r.n_terms, r.used) == (len(mine), len(terms), len(used)) and abs(r.coverage - len(used) / len(terms)) < 1e-12
        assert r.unused == sorted(set(terms) - used)[:5]


def test_no_terms_and_no_rows(spark, data):
    _, rows, known, frame = data
    assert {r.id: r.t for r in tm.masked_terms(frame, "id", "t", known.limit(0), "_").collect()} == {i: t for i, t, _ in rows}
    assert tm.masked_terms(frame.limit(0), "id", "t", known, "_").count() == 0 and tm.coverage(frame.limit(0), ["g"], "t", known).count() == 0


def test_values_and_own_values(spark):
    rows = spark.createDataFrame([(1, "ab", "b", "ab b abb"), (2, None, "", "x"), (3, "None", "b", None)], "id long, p string, q string, t string")
    assert {r.term for r in tm.value_terms(rows, ["p", "q"]).collect()} == {"ab", "b"}
    got = {r.id: r.m for r in rows.select("id", tm.own_masked(F.col("t"), [F.col("q"), F.col("p")], "_").alias("m")).collect()}
    assert got == {1: "_ _ __", 2: "x", 3: None}


def test_spans_of_many_matches(spark):
    text = "é1 22 日333, " * 300
    want = [(m.start() + 1, m[0]) for m in re.finditer("[0-9]+", text)]
    rows = spark.createDataFrame([(text,), ("",), ("none",), (None,), ("7",)], "t string").select(texts.spans(F.col("t"), "[0-9]+").alias("s")).collect()
    assert [(x.start, x.match) for x in rows[0].s] == want and not rows[1].s and not rows[2].s and not rows[3].s
    assert [(x.start, x.match) for x in rows[4].s] == [(1, "7")]
