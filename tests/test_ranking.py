"""Gapless numbers, nested candidates and random pairs against plain versions; nulls, single rows, empty tables."""

import hashlib
import math
from collections import Counter
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from groundloom.functions.scalar import uniform
from groundloom.operators import ranking as rk


def u(seed, row, stage):
    return int(hashlib.md5(f"{seed}|{row}|{stage}".encode()).hexdigest()[:8], 16) / 2**32


@pytest.fixture(scope="module")
def rows(spark):
    data = [(i, None if i % 11 == 0 else "abc"[(i * i) % 3], i % 7 if i % 5 else None) for i in range(300)] + [(1000, "lonely", 1)]
    return data, spark.createDataFrame(data, "id long, field string, age long").repartition(5)


@pytest.mark.parametrize("per", [7, 100_000])
@pytest.mark.parametrize("group", [[], ["field"], ["field", "age"]])
def test_numbers_have_no_gaps(rows, group, per):
    data, frame = rows
    got = rk.numbered(frame, group, uniform(3, F.col("id"), "x"), "id", range_rows=per).collect()
    at = {"field": 1, "age": 2}
    groups = {}
    for r in data:
        groups.setdefault(tuple(r[at[g]] for g in group), []).append((u(3, r[0], "x"), r[0]))
    want = {i: (k + 1, len(v)) for v in groups.values() for k, (_, i) in enumerate(sorted(v))}
    assert {r.id: (r.place, r.size) for r in got} == want and len(got) == len(data)


def test_no_rows(spark):
    empty = spark.createDataFrame([], "id long, field string")
    assert rk.numbered(empty, ["field"], uniform(3, F.col("id"), "x"), "id").count() == 0
    assert rk.numbered(empty, [], uniform(3, F.col("id"), "x"), "id").count() == 0
    assert rk.nested_candidates(empty, "id", ["field"], uniform(3, F.col("id"), "x"), 4, 1).count() == 0
    assert rk.random_pairs(empty, "id", [], 10, 1).count() == 0
    report = rk.similarity_report(rk.random_pairs(empty, "id", [], 10, 1).withColumn("x", F.lit(1.0)), [], "x", 0.85).collect()
    assert [tuple(r) for r in report] == [(0, 0.0, 0.0, 0.0)]


def test_folds_splits_and_balance(rows, spark):
    data, frame = rows
    folds = rk.folds(frame, ["field"], "id", 5, 1).collect()
    for field in {r[1] for r in data}:
        sizes = Counter(r.fold for r in folds if r.field == field)
        assert max(sizes.values()) - min(sizes[k] for k in range(5)) <= 1
    train = rk.split_rows(frame, ["field"], "id", 0.8, 1).collect()
    for field in {r[1] for r in data}:
        mine = [r.train for r in train if r.field == field]
        assert sum(mine) == math.ceil(0.8 * len(mine))
    some = frame.filter("field <> 'lonely' or field is null")
    even = Counter(r.field for r in rk.balanced_rows(some, "field", "id", 1, least=5).collect())
    assert len(set(even.values())) == 1 and set(even) == {r[1] for r in data} - {"lonely"}
    assert set(Counter(r.field for r in rk.balanced_rows(some, "field", "id", 1, cap=7, least=5).collect()).values()) == {7}
    with pytest.raises(Exception, match="rows per value of field"):
        rk.balanced_rows(frame, "field", "id", 1).collect()


@pytest.mark.parametrize("count", [2, 10, 290])
def test_candidates_come_from_the_finest_group_that_has_them(rows, count):
    data, frame = rows
    got = {}
    for r in rk.nested_candidates(frame, "id", ["field", "age"], uniform(3, F.col("id"), "x"), count, 5).collect():
        got.setdefault(r.id, []).append(r)
    field, age = {r[0]: r[1] for r in data}, {r[0]: r[2] for r in data}
    assert set(got) == set(field)
    for i, found in got.items():
        names = [r.candidate for r in found]
        assert len(names) == len(set(names)) == min(count, len(data)) and [r.candidate for r in found if r.step == 0] == [i]
        near = sum(field[j] == field[i] and age[j] == age[i] for j in field) - 1
        same = sum(field[j] == field[i] for j in field) - 1
        levels = Counter(r.level for r in found)
        assert levels[1] == min(count - 1, near) and levels[2] == min(count - 1, same) - levels[1] and levels[3] == count - 1 - levels[1] - levels[2]
        for r in found:
            assert r.level == 0 or (1 if (field[r.candidate], age[r.candidate]) == (field[i], age[i]) else 2 if field[r.candidate] == field[i] else 3) == r.level


def test_a_table_smaller_than_the_list(spark):
    frame = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b")], "id long, field string")
    got = rk.nested_candidates(frame, "id", ["field"], uniform(3, F.col("id"), "x"), 10, 5).collect()
    assert sorted((r.id, r.candidate) for r in got) == [(i, j) for i in (1, 2, 3) for j in (1, 2, 3)]


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 8, 13, 30])
def test_all_pairs_appear_once(spark, n):
    frame = spark.range(n).withColumnRenamed("id", "k")
    for most in (3, 10_000):
        got = [(r.first, r.second) for r in rk.random_pairs(frame, "k", [], most, 7).collect()]
        every = {frozenset(p) for p in combinations(range(n), 2)}
        assert len(got) == min(most, len(every)) == len({frozenset(p) for p in got})
        assert {frozenset(p) for p in got} <= every


def test_pairs_are_spread_evenly_and_inside_groups(rows):
    data, frame = rows
    got = rk.random_pairs(frame, "id", ["field"], 60, 11).collect()
    field = {r[0]: r[1] for r in data}
    assert all(field[r.first] == field[r.second] == r.field for r in got)
    assert Counter(r.field for r in got) == {f: min(60, n * (n - 1) // 2) for f, n in Counter(field.values()).items() if n > 1}
    seen = Counter(x for r in rk.random_pairs(frame, "id", [], 3000, 12).collect() for x in (r.first, r.second))
    expected = 6000 / len(data)
    assert sum((seen[i] - expected) ** 2 / expected for i in field) < 1.5 * len(data)
