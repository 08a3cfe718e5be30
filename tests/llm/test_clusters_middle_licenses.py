"""Yinyang clusters, ropes and license rules against plain versions, with their edge cases."""

import hashlib
import random
import re

import numpy as np
import pytest

pytest.importorskip("groundloom.llm")
from groundloom.llm import fim, licenses, yinyang  # noqa: E402
from test_operators import SHAPE, messy  # noqa: E402


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(messy(), SHAPE)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SHAPE)


# ---- centroid clustering ------------------------------------------------------------------------


def plain_clusters(rows, k, rounds, seed, scale=256):
    kept = [(i, [int(np.floor(scale * float(x))) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]
    first = sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:k]
    c = [v for _, v in first]
    if not c:
        return []
    x = np.array([v for _, v in kept], dtype=object)

    def near():
        d = np.array([((x - np.array(m, dtype=object)) ** 2).sum(1) for m in c])
        return d.argmin(0), d.min(0)

    for _ in range(rounds):
        of, _ = near()
        c = [[int(s) // int((of == j).sum()) for s in x[of == j].sum(0)] if (of == j).any() else m for j, m in enumerate(c)]
    of, d = near()
    name = [hashlib.sha256(",".join(map(str, m)).encode()).hexdigest() for m in c]
    return sorted(((i, int(j), int(z), int(d[of == j].sum()), int(d.sum()), name[j]) for (i, _), j, z in zip(kept, of, d)), key=lambda r: (r[0] is None, r))


def vectors(n, seed, ties=False):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, 64))
    x = centres[rng.integers(0, 12, n)] + rng.normal(size=(n, 64)) * 0.3
    if ties:
        x = np.round(rng.integers(-1, 2, (n, 64)) * np.r_[np.ones(3), np.zeros(61)], 0)
    return [(int(i), [float(np.float32(t)) for t in v]) for i, v in enumerate(x)]


@pytest.mark.parametrize("ties", [False, True])
def test_clusters_equal_plain_ones(spark, ties):
    rows = vectors(500, 3, ties)
    rows += [(1000, None), (1001, []), (1002, [1.0] * 63), (1003, [1.0] * 63 + [None]), (1004, [1.0] * 63 + [float("nan")]), (1005, [1.0] * 63 + [float("inf")]), (None, [0.5] * 64), (7, [0.25] * 64), (7, rows[7][1])]
    frame = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<float>, cluster string, label int")
    got = sorted((tuple(r) for r in yinyang.clusters(spark, frame).collect()), key=lambda r: (r[0] is None, r))
    assert got == plain_clusters(rows, 40, 5, 2)


def test_few_or_no_vectors(spark):
    shape = "vec_id long, embedding array<float>"
    assert yinyang.clusters(spark, spark.createDataFrame([], shape)).count() == 0
    assert yinyang.clusters(spark, spark.createDataFrame([(1, None), (2, [1.0])], shape)).count() == 0
    rows = vectors(5, 1)
    got = sorted(tuple(r) for r in yinyang.clusters(spark, spark.createDataFrame(rows, shape)).collect())
    assert got == plain_clusters(rows, 40, 5, 2)
    with pytest.raises(Exception, match="larger than"):
        yinyang.clusters(spark, spark.createDataFrame([(1, [1e30] * 64)], shape))


def test_bounds_save_distances_and_change_nothing():
    rng = np.random.default_rng(5)
    x = np.floor(256 * (rng.normal(size=(30, 64))[rng.integers(0, 30, 2000)] + rng.normal(size=(2000, 64)) * 0.1)).astype(np.int64)
    c = x[:40].copy()
    group = yinyang.grouped(c)
    of, upper, lower = yinyang.scan_all(x, c, group)
    assert group.max() == 3
    for _ in range(6):
        new = np.array([x[of == j].sum(0) // max(1, (of == j).sum()) if (of == j).any() else c[j] for j in range(40)])
        moved = yinyang._up(yinyang.own_squared(new, c, np.arange(40)))
        c = new
        of, upper, lower, compared = yinyang.reassign(x, of, upper, lower, c, group, moved)
        assert (of == yinyang.squared(x, c).argmin(1)).all()
        d = np.sqrt(yinyang.squared(x, c))
        assert (upper >= d[np.arange(2000), of] - 1e-6).all()
        d[np.arange(2000), of] = np.inf
        assert all((lower[:, g] <= d[:, group == g].min(1) + 1e-6).all() for g in range(4))
    assert compared < x.shape[0] * 40 / 2


def test_large_components_are_exact():
    x = np.array([[1 << 25] * 64, [-(1 << 25)] * 64, [3] * 64], np.int64)
    want = [[sum((int(a) - int(b)) ** 2 for a, b in zip(p, q)) for q in x] for p in x]
    assert (yinyang.squared(x, x) == np.array(want)).all()


# ---- fill in the middle -------------------------------------------------------------------------


def plain_middle(i, text):
    text = text or ""
    u = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    h = hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    n = len(u)
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    lo, hi = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(u[:lo]), "".join(u[lo:hi]), "".join(u[hi:])
    if h4 % 100 < 20:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_middle_equals_plain_one(spark, docs, none):
    assert fim.restored(fim.transform(none)).count() == 0
    rng = random.Random(4)
    signs = ["a", "Z", "é", "日", "𝒳", "\n", " ", "1", "<", "P", "S", "M", ">", "<P>", "word", "\x00"]
    rows = messy() + [(1000 + i, "".join(rng.choices(signs, weights=[9] * 13 + [0.02, 9, 1], k=rng.randrange(0, 900))), "", "", 1, "", "", "", "", "", "") for i in range(120)]
    rows += [(5000, "é" * 300_000 + "<P" + "z" * 300_000, "", "", 1, "", "", "", "", "", "")]
    got = fim.restored(fim.transform(spark.createDataFrame(rows, SHAPE))).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1], str(r[5]))
    want = sorted(((r[0], *plain_middle(r[0], r[1])) for r in rows), key=key)
    assert sorted((tuple(r)[:6] for r in got), key=key) == want
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    texts = sorted((r[0] is None, r[0] or 0, r[1] or "") for r in rows)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.restored) for r in got) == texts


def test_ropes_split_at_every_rank():
    text = "ab, cd é日x" * 60
    raw = text.encode()
    ((same, at, chars),) = fim.unit_starts([raw])
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    rope = fim.rope_of(same, at, chars)
    assert (rope.units, rope.chars, fim.text_of(rope)) == (len(units), len(text), raw)
    for k in range(-1, len(units) + 2):
        a, b = fim.split(rope, k)
        k = min(max(k, 0), len(units))
        assert fim.text_of(a).decode() == "".join(units[:k]) and fim.text_of(b).decode() == "".join(units[k:])
        assert (a.units, b.units, a.chars, b.chars) == (k, len(units) - k, len("".join(units[:k])), len("".join(units[k:])))

    def depth(r):
        return 1 if isinstance(r, fim.Leaf) else 1 + max(depth(r.left), depth(r.right))

    assert depth(rope) <= 2 + np.log2(len(units) / fim.LEAF + 1)


# ---- license rules ------------------------------------------------------------------------------


def sample(pattern, rng):
    """A text that the pattern of a rule matches."""
    parser = re._parser
    literal = lambda node: "".join(one(x) for x in node)

    def one(x):
        op, a = x
        name = str(op)
        if name == "LITERAL":
            return chr(a)
        if name == "IN":
            op2, b = rng.choice(a)
            return chr(b) if str(op2) == "LITERAL" else chr(rng.randint(*b))
        if name == "ANY":
            return "w"
        if name == "BRANCH":
            return literal(rng.choice(a[1]))
        if name == "SUBPATTERN":
            return literal(a[3])
        assert name in ("MAX_REPEAT", "MIN_REPEAT"), name
        return "".join(literal(a[2]) for _ in range(rng.randint(a[0], a[1])))

    return literal(parser.parse(pattern))


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_licenses(text):
    w = words(text)
    at = "".join(f" {x} " for x in w)
    spans = []
    for rule, (label, priority, _, pattern, base) in enumerate(licenses.rules()):
        for m in re.finditer(licenses.compiled(pattern), at):
            s = at[: m.start()].count(" ") // 2
            spans.append((s, s + m[0].count(" ") // 2, priority, rule, label, base))
    over = lambda x, y: x != y and x[0] <= y[0] and x[1] >= y[1] and x[2] <= y[2] and (x[:2] != y[:2] or x[2:4] < y[2:4])
    kept = [x for x in spans if not any(over(y, x) for y in spans)]
    base = [x for x in spans if x[5]]
    score = {None: 0.0, **licenses.SCORES}[min((x[2] for x in kept), default=None)]
    joined = lambda xs: ",".join(sorted({x[4] for x in xs}))
    return len(w), len(base), min((x[0] for x in base), default=None), max((x[0] for x in base), default=None), joined(base), joined(base + kept), score


def test_every_rule_contains_its_keyword_and_matches_its_samples():
    rng = random.Random(1)
    rules = licenses.rules()
    assert 300 < len(rules) and len({(r[0], r[3]) for r in rules}) == len(rules)
    for label, priority, keyword, pattern, _ in rules:
        compiled = licenses.compiled(pattern)
        for _ in range(12):
            text = sample(compiled, rng)
            assert re.fullmatch(compiled, text), (label, text)
            assert f" {keyword.replace(' ', '  ')} " in text, (label, keyword, text)
            assert priority in licenses.SCORES and licenses.anchor(keyword) in keyword.split()


def spelled(pattern):
    """Every text that a pattern spells; classes of characters by the first of each range, repeats by their least number or one."""

    def texts(nodes):
        out = [""]
        for x in nodes:
            out = [a + b for a in out for b in one(x)]
        return out

    def one(x):
        op, a = str(x[0]), x[1]
        if op == "LITERAL":
            return [chr(a)]
        if op == "IN":
            return [chr(b if str(o) == "LITERAL" else b[0]) for o, b in a]
        if op == "ANY":
            return ["w"]
        if op == "BRANCH":
            return [t for n in a[1] for t in texts(n)]
        if op == "SUBPATTERN":
            return texts(a[3])
        return [""] * (a[0] == 0) + [t * max(a[0], 1) for t in texts(a[2])]

    return texts(re._parser.parse(pattern))


def test_every_spelling_of_a_rule_contains_its_keyword():
    for label, _, keyword, pattern, _ in licenses.rules():
        for text in spelled(licenses.compiled(pattern)):
            assert f" {keyword.replace(' ', '  ')} " in text, (label, keyword, text)


def test_spellings_beside_the_usual_one_are_found(spark):
    cases = {"the MIT X11 license": "mit", "MIT/Expat License": "mit", "zlib/libpng license": "zlib", "No part of this book may be copied": "proprietary", "no part of this site may be stored": "proprietary"}
    frame = spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")
    for row, want in zip(sorted(licenses.labelled(frame).collect()), cases.values(), strict=True):
        assert want in row.labels.split(","), row


def test_licenses_equal_plain_ones(spark, docs, none):
    assert licenses.labelled(none).count() == 0
    rng = random.Random(2)
    patterns = [licenses.compiled(r[3]) for r in licenses.rules()]
    texts = [sample(rng.choice(patterns), rng).strip() for _ in range(250)]
    texts = [t.upper() if i % 5 == 0 else "some text (" + t.replace("  ", ", ") + ") and " + texts[i - 1] if i % 3 == 0 else t for i, t in enumerate(texts)]
    texts += ["CC BY cc by, CC-BY 4.0!", "cc cc by by", "All rights\nreserved. All Rights  Reserved", "accby general public licenses", "GNU Lesser General Public License, version 2.1 or later", "ＣＣ by", "cc\x00by", "© 2020", "©2020 x"]
    texts.append(" ".join(rng.choices(["cc by 4.0", "gnu general public license version 3", "mit license", "filler words", "licensed under the", "all rights reserved"], k=900)))
    rows = messy() + [(1000 + i, t, "", "", 1, "", "", "", "", "", "") for i, t in enumerate(texts)]
    got = licenses.labelled(spark.createDataFrame(rows, SHAPE)).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    for g, want in zip(sorted(map(tuple, got), key=key), sorted(((r[0], *plain_licenses(r[1])) for r in rows), key=key), strict=True):
        assert g == want


def test_known_notices(spark):
    cases = {
        "Licensed under CC BY-NC 4.0.": {"cc-by", "cc-by-nc-4.0"},
        "GPLv2+ or the GPL-3.0-only": {"gpl-2.0", "gpl-3.0"},
        "SPDX-License-Identifier: Apache-2.0": {"apache-2.0"},
        "Permission is hereby granted, free of charge, to any person obtaining a copy": {"mit"},
        "under version 2 of the GNU General Public License": {"gpl-2.0", "gpl"},
        "http://creativecommons.org/licenses/by-sa/3.0/": {"cc-by-sa-3.0"},
        "The cat sat with a license to mew; as is common, it was provided for any purpose": set(),
    }
    frame = spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")
    for row, want in zip(sorted(licenses.labelled(frame).collect()), cases.values()):
        assert {x for x in row.labels.split(",") if x and x != "licensed"} == want
