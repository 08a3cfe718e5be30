"""The pipeline's stages against plain Python, and the whole run."""

import collections
import re

import numpy as np
import pytest

pytest.importorskip("groundloom.llm")
import corpus_pipeline as cp  # noqa: E402
from groundloom.llm import crfquality, linededup, mixing  # noqa: E402

SHAPE = "doc_id long, text string, lang string, source string, n_chars long, kept string, copies string, score string"


def prose(rng, n):
    return " ".join("".join(chr(97 + int(c)) for c in str(k)) for k in rng.integers(1000, 9999, n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = np.random.default_rng(6)
    rows = [(i, prose(rng, 30) + ("\nplease read our terms before you leave" if i % 3 == 0 else ""), "en" if i % 2 else "de", "s") for i in range(60)]
    rows += [(100 + i, rows[7][1] + " end" * (i % 2), "en", "s") for i in range(4)]  # copies and near copies
    rows += [(200 + i, "#$% " * 40, "en", "s") for i in range(20)]  # junk
    rows += [(300, None, "en", "s"), (301, "", None, None), (302, " \n ", "de", "s"), (None, prose(rng, 30), "en", "s"), (3, prose(rng, 30), "en", "s")]
    path = tmp_path_factory.mktemp("pipeline")
    spark.createDataFrame([(*r, 0 if r[1] is None else len(r[1]), "k", "c", "s") for r in rows], SHAPE).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(r[0], int(not (r[1] or "#").startswith("#")), 0) for r in rows if r[0] is not None], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def bag(df):
    return collections.Counter(tuple(r) for r in df.select(*cp.COLUMNS).collect())


def sets(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    good = cp.quality(spark, docs, folder)
    assert good.columns == list(cp.COLUMNS)
    fine = {r.doc_id for r in crfquality.score_documents(spark, docs, labels).filter("predicted = 1").collect()}
    kept = bag(good)
    assert {k[0] for k in kept} == fine and sum(kept.values()) >= 64 and not any(k[0] is not None and 200 <= k[0] < 220 for k in kept)

    clean = cp.lines(spark, good, folder)
    assert clean.columns == list(cp.COLUMNS)
    for r in clean.collect():
        assert "terms before" not in (r.text or "") and r.n_chars == (None if r.text is None else len(r.text))
    assert clean.count() == sum(kept.values())

    unique = bag(cp.near_duplicates(spark, clean, folder))
    every = bag(clean)
    named = sorted({k[0] for k in every if k[0] is not None})
    texts = {i: [sets(k[1]) for k in every if k[0] == i] for i in named}
    low = {i: i for i in named}
    for _ in named:
        for a in named:
            for b in named:
                if any(x and y and 100 * len(x & y) >= cp.SIMILAR * len(x | y) for x in texts[a] for y in texts[b]):
                    low[a] = low[b] = min(low[a], low[b])
    assert {k[0] for k in unique if k[0] is not None} == {i for i in named if low[i] == i}
    assert {7} == {i for i in (7, 100, 101, 102, 103) if i in {k[0] for k in unique}}

    before = cp.near_duplicates(spark, clean, folder)
    mixed = bag(cp.mixture(spark, before, folder))
    rates = {r.doc_id: r.copies for r in mixing.mix(spark, before, before.selectExpr("doc_id", "lang as domain"), cp.TARGETS).collect()}
    assert mixed == collections.Counter({k: n * (1 if k[0] is None else rates[k[0]]) for k, n in unique.items() if k[0] is None or rates[k[0]]})


def test_run(spark, folder):
    out = cp.run(spark, folder).toPandas()
    assert {"doc_id", "piece", "start", "length", "sequence_id", "offset"} <= set(out.columns) and len(out)
    for _, s in out.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert s["offset"].tolist() == [0, *s["length"].cumsum()[:-1]] and s["length"].sum() <= 1024


def test_empty_tables(spark, folder, tmp_path):
    for name in ("documents", "labels"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert cp.run(spark, str(tmp_path)).count() == 0


def test_line_dedup_by_plain_rules(spark):
    """Templates, holders and dropped lines of documents without copies, against the rules applied line by line."""
    rng = np.random.default_rng(12)
    kinds = ["Posted by {} in the news section of our site", "{} of 90", "Read more about {} and all of its friends here", "Subscribe now", "Last change by {} on the main page of it"]
    docs = {}
    for i in range(40):
        some = [k.format(prose(rng, 1)) for j, k in enumerate(kinds) if (i + j) % 3 == 0 or (j == 1 and i < 2)]
        docs[i] = "\n".join([prose(rng, 30), *some, prose(rng, 25)])
    got = {r.doc_id: r.text for r in linededup.drop_recurring_lines(spark, spark.createDataFrame(list(docs.items()), "doc_id long, text string")).collect()}
    lines = [(i, x, ["<*>" if re.search("[0-9]", t) else t for t in x.split()]) for i, text in docs.items() for x in dict.fromkeys(text.split("\n"))]

    def runs(t):
        rest = t[2:]
        return [rest[len(rest) * k // 3 : len(rest) * (k + 1) // 3] for k in range(3)]

    holders = collections.defaultdict(set)
    of = collections.defaultdict(set)

    def add(template, i, x):
        holders[template].add(i)
        of[i, x].add(template)

    groups = collections.defaultdict(list)
    for i, x, t in lines:
        add(("exact", *t), i, x)
        if len(t) >= 5:
            for k in range(3):
                groups[len(t), *t[:2], k, *runs(t)[k]].append((i, x, t))
                add(("but", k, len(t), *t[:2], *(tuple(r) for j, r in enumerate(runs(t)) if j != k)), i, x)
    for key, members in groups.items():
        if len(members) >= 3:
            model = [collections.Counter(m[2][p] for m in members).most_common(1)[0][0] for p in range(key[0])]
            for i, x, t in members:
                if 100 * sum(a == b for a, b in zip(t, model)) >= linededup.SIMILAR * len(t):
                    add(("voted", key), i, x)
    want = {i: "\n".join(x for x in text.split("\n") if not any(len(holders[h]) >= 3 for h in of[i, x])) for i, text in docs.items()}
    assert got == want and sum(a != b for a, b in zip(docs.values(), want.values())) > 30
