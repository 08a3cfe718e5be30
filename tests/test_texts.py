"""Corpus measures of texts: what they deal between tasks, and parts of them against plain Python."""

import random
from collections import Counter

import numpy as np
import pytest

from pyspark.sql import functions as F

from groundloom.operators import chargrams, leads, tasks, texts


def dealt(spark):
    """Bytes that all stages so far wrote for other stages."""
    sc, jvm = spark.sparkContext, spark.sparkContext._jvm
    empty = jvm.java.util.ArrayList()
    stages = sc._jsc.sc().statusStore().stageList(empty, False, False, sc._gateway.new_array(jvm.double, 0), empty)
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_self_bleu_deals_few_bytes_a_gram(spark):
    """As rows of strings a gram took over 50 bytes, dealt three times."""
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefghij", k=7)) for _ in range(20000)]
    rows = [(i, rng.choices(words, k=400)) for i in range(300)]
    frame = spark.createDataFrame(rows, "id long, w array<string>")
    before = dealt(spark)
    assert len(texts.self_bleu(frame, "id", "w").collect()) == 300
    grams = sum(len({tuple(w[j : j + n]) for j in range(401 - n)}) for _, w in rows for n in (1, 2, 3, 4))
    assert dealt(spark) - before < 16 * grams


@pytest.mark.parametrize("n", [1, 2, 3])
def test_leads_of_blocks(n):
    """Blocks counted apart and merged equal counts of all rows."""
    rng = random.Random(n)
    rows = {k * 1000: rng.choices(range(6), k=rng.randrange(0, 30)) for k in range(40)} | {77: [5]}
    counts = {k: Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) for k, w in rows.items()}
    want = {k: sum(max(0, c - max((o[g] for j, o in counts.items() if j != k), default=0)) for g, c in mine.items()) for k, mine in counts.items()}
    names, blocks = list(rows), []
    for i in range(0, len(names), 7):
        part = names[i : i + 7]
        tokens = np.array([t + 1 for k in part for t in rows[k]], np.uint64)
        grams, best, second, keys = leads._counted(tokens, np.array(part, np.int64), np.array([len(rows[k]) for k in part]), n)
        if len(grams):
            steps, *rest = leads._unpacked(leads._packed([np.diff(grams, prepend=np.uint64(0)), best, second, keys]), 4)
            blocks.append((np.cumsum(steps.view(np.uint64), dtype=np.uint64), *rest))
    columns = [np.concatenate(c) for c in zip(*blocks)]
    order = np.argsort(columns[0], kind="stable")
    _, best, second, keys = leads._merged(*(c[order] for c in columns))
    got = Counter()
    for k, lost in zip(keys.tolist(), (best - second).tolist()):
        got[k] += lost
    assert {k: got[k] for k in rows} == want


def talk(spark, n=400):
    rng = random.Random(9)
    words = ["".join(rng.choices("abcdefgh", k=rng.randrange(3, 12))) for _ in range(3000)]
    rows = [(i, None if i == 7 else " ".join(rng.choices(words, k=80))) for i in range(n)]
    return spark.createDataFrame(rows, "id long, text string"), sum(len(t or "") for _, t in rows)


def test_cosines_deal_texts_not_grams(spark):
    """As rows of grams each text took about 500 rows, dealt again and again."""
    rows, size = talk(spark)
    pairs = rows.select(F.col("id").alias("a"), ((F.col("id") + 1) % 400).alias("b"))
    before = dealt(spark)
    assert len(texts.row_cosines(pairs, rows, "id", "text", texts.char_weights(rows, "id", "text")).collect()) == 400
    assert dealt(spark) - before < 8 * size


def test_retrieval_deals_texts_not_grams(spark):
    """So did retrieval: four context texts and a target for each key, three candidates."""
    rows, size = talk(spark)
    x = rows.select((F.col("id") % 80).alias("k"), (F.col("id") / 80).cast("int").alias("turn"), F.lower(F.coalesce("text", F.lit(""))).alias("t"))
    pairs = rows.filter("id < 80").select(F.col("id").alias("k"), F.explode(F.array(*(F.struct(((F.col("id") + j) % 80).alias("candidate"), F.lit(j == 0).alias("truth")) for j in range(3)))).alias("c")).select("k", "c.*")
    before = dealt(spark)
    ranks = tasks.retrieval_ranks(pairs, "k", x.filter("turn < 4"), x.filter("turn = 4"), "t", texts.char_weights(rows, "id", "text")).collect()
    assert len(ranks) == 80 and {r["rank"] for r in ranks} <= {1, 2, 3}
    assert dealt(spark) - before < 8 * size


def test_character_grams_of_odd_texts(spark):
    """Counts and vocabulary against plain Python, with unknown words, repeats and texts of none."""
    lines = ["aaaa aaaa b", "", "  ", "é日本 aaaa\tb", "zzz"]
    plain = [Counter(p[i : i + n] for w in t.split() for p in [f" {w} "] for n in (3, 4, 5) for i in range(len(p) - n + 1)) for t in lines]
    told = chargrams.Counter(3, 5)
    text, gram, times = told.count(lines)
    names = list(told.grams)
    assert {(t, names[g]): n for t, g, n in zip(text.tolist(), gram.tolist(), times.tolist())} == {(t, g): n for t, c in enumerate(plain) for g, n in c.items()}
    known = chargrams.Counter(3, 5, {" b ": 0, "aaa": 1})
    assert [x.tolist() for x in known.count(["zz", "aaaa b aaaa", "b"])] == [[1, 1, 2], [0, 1, 0], [1, 4, 1]]
    assert [x.tolist() for x in known.count(["", "zz"])] == [[], [], []]
    cf, df = sum(plain, Counter()), Counter(g for c in plain for g in c)
    want = sorted((g for g in cf if df[g] >= 2), key=lambda g: (-cf[g], g))[:4]
    found = chargrams.vocabulary(spark.createDataFrame([(t,) for t in lines], "t string"), "t", features=4)
    assert found == [(g, df[g]) for g in want]


def test_recovery_reads_texts_twice(spark):
    """Each stage of the model made the grams of all texts anew."""
    read = spark.sparkContext.accumulator(0)

    def seen(t):
        read.add(1)
        return t

    rng = random.Random(2)
    rows = [(i, "ab"[i % 2], " ".join(rng.choices(["red", "rose", "rust"] if i % 2 else ["blue", "blot", "bloom"], k=6)), i % 5 == 0) for i in range(100)] + [(900, None, "red", False)]
    frame = spark.createDataFrame(rows, "id long, kind string, text string, held boolean").repartition(2).withColumn("text", F.udf(seen)("text"))
    got = tasks.anchor_recovery(frame, "id", "text", "kind", "held").collect()
    assert len(got) == 20 and all(r.truth == r.predicted for r in got)
    assert read.value <= 2 * len(rows)
