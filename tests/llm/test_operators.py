"""Nulls, empty and very long texts, repeated rows, empty tables and clashing columns; results against brute force."""

import random
import re
import zlib

import numpy as np
import pytest

pytest.importorskip("groundloom.llm")
from groundloom.llm import ann, crfquality, langid, linededup, mixing, neardup, packing, qualityrules, sharding, warc  # noqa: E402
from groundloom.llm.common import Scratch  # noqa: E402

SHAPE = "doc_id long, text string, lang string, source string, n_chars long, kept string, score string, rank string, size string, n string, bucket string"
EN = "the cat sat on the mat and looked at the old dog that was near the door of the house."
DE = "der Hund lief über die Straße und bellte laut als er die kleine Katze vor dem Haus sah."


def messy():
    texts = [EN, DE, None, "", " \n\t ", "a", "1 2 3", EN, EN.replace("old", "big") + " " + EN * 3, "word " * 40_000, "x" * 100_000, DE + "\n" + EN, "日本語のテキスト", "\x1c   ", "don't we'll\r\n3²"]
    rows = [(i, t, "en" if i % 2 else "de", f"s{i % 3}", None) for i, t in enumerate(texts)]
    rows += [(3, "", None, None, 0), (0, EN, "de", "s0", 5), (None, EN, None, None, None), (90, DE, None, "s1", 1)]
    rows += [(100 + i, " ".join(w + c for c in "abcdefghijklmnopq") + f"\nshared footer line {i} with five words\n{w}", "en", "s", 1) for i, w in enumerate("red green blue white black grey pink brown".split())]
    return [(*r, "k", "s", "r", "z", "n", "b") for r in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(messy(), SHAPE)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SHAPE)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, int(i >= 100 or i < 2), 0) for i in [0, 1, 4, 5, 6, 9, 10, *range(100, 108)]] + [(None, 1, 0), (7, None, None)], "doc_id long, quality int, toxic int")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def test_near_duplicates(spark, docs, none):
    assert neardup.near_duplicates(spark, none).count() == 0
    got = {r.doc_id: r for r in neardup.near_duplicates(spark, docs).collect()}
    sets = {}
    for i, text, *_ in messy():
        w = words(text)
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    ids = [i for i in sets if i is not None]
    low = {i: i for i in ids}
    for _ in ids:
        for a in ids:
            for b in ids:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                    low[a] = low[b] = min(low[a], low[b])
    for i in ids:
        assert (got[i].n_shingles, got[i].component_id, got[i].kept) == (len(sets[i]), low[i], low[i] == i)
    assert got[None].component_id == 0 and not got[None].kept


def test_crowds_find_what_pairs_find():
    rng = np.random.default_rng(2)
    sets = [[np.unique(rng.integers(0, 60, 30)) for _ in range(n)] for n in (7, 9)]
    common = neardup.overlap([np.concatenate(s) for s in sets], [np.array([len(x) for x in s]) for s in sets], width=16)
    assert (common == [[len(np.intersect1d(a, b)) for b in sets[1]] for a in sets[0]]).all()


def test_large_group_of_near_copies(spark):
    rng = np.random.default_rng(4)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for i in range(120):
        w = list(base)
        for k in rng.choice(120, rng.integers(0, 9), replace=False):
            w[k] = f"v{rng.integers(1000)}"
        rows.append((i, " ".join(w)))
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = [{tuple(t.split()[k : k + 5]) for k in range(116)} for _, t in rows]
    low = list(range(120))
    for _ in range(6):
        for a in range(120):
            for b in range(120):
                if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                    low[a] = low[b] = min(low[a], low[b])
    assert [got[i] for i in range(120)] == low


def joined_rows(spark, work):
    """Rows that the joins of the plans run by ``work`` make."""
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    work()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    total = 0
    for k in range(before, store.executionsCount()):
        run = store.executionsList(k, 1).apply(0).executionId()
        values, nodes = store.executionMetrics(run), store.planGraph(run).allNodes()
        for n in (nodes.apply(i) for i in range(nodes.size())):
            for m in (n.metrics().apply(i) for i in range(n.metrics().size())):
                if "Join" in n.name() and m.name() == "number of output rows" and values.contains(m.accumulatorId()):
                    total += int(values.apply(m.accumulatorId()).replace(",", ""))
    return total


def test_links_are_joined_once_not_in_every_round(spark):
    # 150 ids linked with each of 30 ids; those are linked with one another only through them
    edges = spark.createDataFrame([(1000 + i, k) for i in range(150) for k in range(30)], "a long, b long")
    got = []
    rows = joined_rows(spark, lambda: got.extend(neardup.by_stars(spark, edges, Scratch(spark, "stars"), "x").collect()))
    assert sorted(map(tuple, got)) == [(i, 0) for i in [*range(30), *range(1000, 1150)]]
    # once towards the least above, once towards the least below; each round of labels joins them in both directions
    assert 0 < rows <= 2 * 150 * 30


def test_stars_find_what_a_plain_search_finds(spark):
    rng = np.random.default_rng(6)
    ids = rng.permutation(60)
    cases = [[], [(5, 5), (7, 7), (7, 3)], list(zip(ids, ids[1:])), [(99, k) for k in range(40)], [(-5, 3), (3, -9), (2, 2)], rng.integers(0, 90, (70, 2))]
    for k, case in enumerate(cases):
        case = [(int(a), int(b)) for a, b in case]
        low = {x: x for e in case for x in e}
        for _ in low:
            for a, b in case:
                low[a] = low[b] = min(low[a], low[b])
        got = neardup.by_stars(spark, spark.createDataFrame(case, "a long, b long"), Scratch(spark, "stars"), f"x{k}").collect()
        assert sorted(map(tuple, got)) == sorted(low.items())


def test_packing(spark, docs, none):
    from groundloom.llm.queries import vocabulary_path
    from tokenizers import Tokenizer

    path = vocabulary_path()
    assert packing.pack(spark, none, path).count() == 0
    got = packing.pack(spark, docs, path, with_ids=True).collect()
    model = Tokenizer.from_file(path)
    model.encode_special_tokens = True
    want = sorted((i is None, i or 0, np.array(model.encode(t or "", add_special_tokens=False).ids + [2], "<u4").tobytes()) for i, t, *_ in messy())
    bins, whole = {}, {}
    for r in sorted(got, key=lambda r: (r.piece, r.start)):
        raw = np.array(r.ids, "<u4").tobytes()
        assert zlib.crc32(raw) == r.ids_crc32 and len(r.ids) == r.length <= 1024 and (r.piece == 0 or r.length == 1024)
        whole.setdefault(r.doc_id, []).append((r.start, raw))
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for content in bins.values():
        at = 0
        for offset, length in sorted(content):
            assert offset == at
            at += length
        assert at <= 1024
    once = {i: w for _, i, w in want if [x[1] for x in want].count(i) == 1}
    for i, w in once.items():
        if i:
            assert b"".join(raw for _, raw in sorted(whole[i])) == w
    assert sum(len(r.ids) for r in got) == sum(len(w) // 4 for *_, w in want)


def test_added_tokens_are_encoded_as_the_file_says():
    from groundloom.llm.queries import vocabulary_path
    from tokenizers import Tokenizer

    model, encode = Tokenizer.from_file(vocabulary_path()), packing.BpeEncoder(vocabulary_path())
    for text in ["a<|endoftext|>b", "<|endoftext|>", "no added token"]:
        assert np.frombuffer(encode(text), "<u4").tolist() == model.encode(text, add_special_tokens=False).ids
    assert encode.fast and 50256 in np.frombuffer(encode("a<|endoftext|>b"), "<u4")


def test_best_fit_is_the_sequential_rule():
    rng = np.random.default_rng(3)
    for _ in range(60):
        size = int(rng.integers(5, 60))
        counts = {n: int(c) for n, c in zip(range(1, size + 1), rng.integers(0, 6, size))}
        used, seen = {}, {}
        for length, lo, hi, first, each, at in packing.best_fit(counts, size):
            assert lo == seen.get(length, 0)
            seen[length] = hi
            for k in range(hi - lo):
                used.setdefault(first + k // each, []).append((at + k % each * length, length))
        assert seen == {n: c for n, c in counts.items() if c}
        rooms = []
        for n in sorted((n for n, c in counts.items() for _ in range(c)), reverse=True):
            fit = [x for x in rooms if x >= n]
            rooms.append((min(fit) if fit else size) - n)
            if fit:
                rooms.remove(min(fit))
        assert len(used) == len(rooms)


def test_sharding(spark, docs, none):
    assert sharding.shards(spark, none, 8).count() == 0
    got = sharding.shards(spark, docs, 4).collect()
    assert len(got) == len(messy()) and {r.shard for r in got} <= set(range(4))
    for k in range(4):
        assert sorted(r.slot for r in got if r.shard == k) == list(range(sum(r.shard == k for r in got)))
    text = {i: (t or "").encode() for i, t, *_ in messy()}
    assert all((r.size, r.text_crc32) == (len(text[r.doc_id]) + 1, zlib.crc32(text[r.doc_id])) for r in got)


def test_sharding_balances_and_keeps_copies_together(spark):
    rows = [(i, "copy" if i % 3 == 0 else f"text {i} " * (i % 7 + 1), "l", "s") for i in range(3000)]
    got = sharding.shards(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), 8).toPandas()
    sizes = got.groupby("shard")["size"].sum()
    assert len(sizes) == 8 and sizes.max() <= 1.03 * sizes.mean()
    assert got[got["doc_id"] % 3 == 0]["shard"].nunique() == 1


def tree(items, leaves, first=0, span=None, close=None):
    """The k-d tree by sorting: {item key: leaf}; items are (key, bytes, coordinates)."""
    if leaves == 1 or not items:
        return {x[0]: first for x in items}
    dims = range(len(items[0][2]))
    ends = [(min(x[2][d] for x in items), max(x[2][d] for x in items)) for d in dims]
    d = max(dims, key=lambda d: ((ends[d][1] - ends[d][0]) / span[d], -d))
    want, left, right, rest = sum(x[1] for x in items) * (leaves // 2) / leaves, [], [], sorted(items, key=lambda x: x[2][d])
    while rest:
        below, at = 0, 0
        for at, x in enumerate(rest):
            if below + x[1] >= want or at == len(rest) - 1:
                break
            below += x[1]
        to_left = below + rest[at][1] - want <= want - below
        heavy = below < want < below + rest[at][1] and min(want - below, below + rest[at][1] - want) > close
        if not heavy:
            cut = at + to_left
            left, right, rest = left + rest[:cut], right + rest[cut:], []
        else:
            x = rest.pop(at)
            (left if to_left else right).append(x)
            want -= x[1] if to_left else 0
    return tree(left, leaves // 2, first, span, close) | tree(right, leaves - leaves // 2, first + leaves // 2, span, close)


def test_sharding_is_a_kd_tree(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(240):
        text = "copied " * 9 if i % 9 == 0 else prose(rng, int(rng.integers(1, 40)))
        rows.append((i, text, ["de", "en", None, "fr"][i % 4], f"common-prefix-{rng.integers(0, 30)}"))
    got = sharding.shards(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), 5).toPandas()
    langs, sources = (sorted({r[c] or "" for r in rows}) for c in (2, 3))
    facts = {}
    for i, text, lang, source in rows:
        f = facts.setdefault(text, [0, 99, 99, len(text) + 1, i])
        f[0] += len(text) + 1
        f[1], f[2] = min(f[1], langs.index(lang or "")), min(f[2], sources.index(source))
    tie = {r.t: r.x & (2**20 - 1) for r in spark.createDataFrame([(t,) for t in facts], "t string").selectExpr("t", "xxhash64(xxhash64(t), cast(null as long)) as x").collect()}
    low = [min(f[k] for f in facts.values()) for k in range(1, 5)]
    items = [(t, f[0], [((f[k] - low[k - 1]) << 20) + tie[t] for k in range(1, 5)]) for t, f in facts.items()]
    span = [max(x[2][d] for x in items) - min(x[2][d] for x in items) for d in range(4)]
    total = sum(x[1] for x in items)
    want = tree(items, 5, span=span, close=sharding.CLOSE * total / 5)
    assert [want[rows[r.doc_id][1]] for r in got.itertuples()] == list(got["shard"])


def test_groups_below_a_leaf_stay_whole(spark):
    rows = [(i, "abc"[i % 3] * 50, "l", "s") for i in range(18)]
    got = sharding.shards(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), 2).collect()
    shards = {k: {r.shard for r in got if r.doc_id % 3 == k} for k in range(3)}
    assert all(len(s) == 1 for s in shards.values()) and set.union(*shards.values()) == {0, 1}
    # a group above a leaf is dealt, so that no shard is left without
    big = [(i, "x" * 50, "l", "s") for i in range(900)] + [(1000 + i, f"text {i}", "l", "s") for i in range(40)]
    sizes = sharding.shards(spark, spark.createDataFrame(big, "doc_id long, text string, lang string, source string"), 4).toPandas().groupby("shard")["size"].sum()
    assert len(sizes) == 4 and sizes.max() < 1.1 * sizes.mean()


def test_quality_rules(spark, docs, none, labels):
    assert qualityrules.judge(spark, none, labels).count() == 0
    got = {r.doc_id: r for r in qualityrules.judge(spark, docs, labels).collect()}
    for i, text, *_ in messy():
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        lines = [x for x in (text or "").split("\n") if words(x)]
        at = {}
        for k in range(len(w) - 4):
            at.setdefault(tuple(w[k : k + 5]), []).append(k)
        covered = {k + j for v in at.values() if len(v) > 1 for k in v for j in range(5)}
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered))
        assert r.base_failed == (len(w) < 10 or 100 * len(covered) > 20 * len(w)) and not (r.kept and r.base_failed)


def test_quality_rules_certify_a_path_of_cutoffs(spark):
    """Two strata, one with holdouts enough: the level is that of a plain computation, and it rejects."""
    import math

    rng = np.random.default_rng(3)
    rows, marks = [], []
    for i in range(400):
        stratum, odd = ("big", i % 4 == 3) if i < 320 else ("small", i % 4 == 3)
        text = prose(rng, 40) + (" " + "#" * 30 if odd else " #" if i % 40 == 0 else "")
        rows.append((i, text, stratum))
        marks.append((i, int(not odd), 0))
    got = qualityrules.judge(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")).collect()

    def share(r, rule):
        a, b = {"long_words": (r.word_chars, r.n_words), "short_words": (r.word_chars, r.n_words), "symbols": (r.n_symbols, r.word_chars), "dup_lines": (r.n_dup_lines, r.n_words), "repeats": (r.n_repeat_words, r.n_words)}[rule]
        return 1000 * a // b

    def rejected(r, level):
        return any(share(r, rule) > cuts[level] if way == "over" else share(r, rule) < cuts[level] for rule, (_, way, cuts) in qualityrules.RULES.items())

    want = {}
    for stratum in ("big", "small"):
        good = [r for r in got if rows[r.doc_id][2] == stratum and marks[r.doc_id][1] and not r.base_failed]
        for level in range(qualityrules.LEVELS):
            lost = sum(rejected(r, level) for r in good)
            p = qualityrules.ALPHA
            if lost > p * len(good) or sum(math.comb(len(good), i) * p**i * (1 - p) ** (len(good) - i) for i in range(lost + 1)) > qualityrules.DELTA / 2:
                break
            want[stratum] = level, len(good), lost
    assert "big" in want and "small" not in want
    for r in got:
        level = want.get(rows[r.doc_id][2])
        assert (r.level, r.good, r.lost) == (level or (None, None, None))
        assert r.kept == (not r.base_failed and not (level and rejected(r, level[0])))
    assert sum(not r.kept for r in got if not r.base_failed) == 80


def test_binomial_bound(spark):
    import math

    for n, k, p in [(50, 0, 0.05), (200, 7, 0.02), (5000, 30, 0.01)]:
        want = math.log(sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)))
        got = spark.sql(f"SELECT {qualityrules.log_binomial_cdf(f'{n}L', f'{k}L', p)} AS x").first().x
        assert abs(got - want) < 1e-9


def test_line_dedup(spark, docs, none):
    assert linededup.drop_recurring_lines(spark, none).count() == 0
    got = {r.doc_id: r for r in linededup.drop_recurring_lines(spark, docs, keep=("lang",)).collect()}
    assert got[2].text is None and got[3].text == "" and got[0].text == EN
    for i in range(100, 108):
        assert "shared footer" not in got[i].text and got[i].n_dropped >= 1


def prose(rng, n):
    return " ".join("".join(chr(97 + int(c)) for c in str(k)) for k in rng.integers(1000, 9999, n))


def test_line_dedup_counts_a_group_of_copies_once_and_cuts_short_pages(spark):
    rng = np.random.default_rng(8)
    footer = "please read our terms before you go on from here"
    pages = [(i, footer + "\n" + prose(rng, 4 if i == 2 else 40)) for i in range(3)]  # the third is mostly boilerplate
    lines = [prose(rng, 12) for _ in range(20)]
    copies = []
    for i in range(10, 16):
        some = list(lines)
        some[i - 10] = prose(rng, 12)
        copies.append((i, "\n".join(some)))
    got = {r.doc_id: r for r in linededup.drop_recurring_lines(spark, spark.createDataFrame(pages + copies, "doc_id long, text string")).collect()}
    assert all(footer not in got[i].text and got[i].n_dropped == 1 for i in range(3))
    assert all(got[i].text == t for i, t in copies)
    # two independent documents more, and a line of the copies recurs: it goes from the copies too
    more = [(20 + i, lines[15] + "\n" + prose(rng, 40)) for i in range(2)]
    got = {r.doc_id: r for r in linededup.drop_recurring_lines(spark, spark.createDataFrame(copies + more, "doc_id long, text string")).collect()}
    assert all(got[i].n_dropped == 1 and lines[15] not in got[i].text for i, _ in copies + more)


def test_line_dedup_keeps_several_templates_in_a_leaf(spark):
    rng = np.random.default_rng(9)
    kinds = ["Posted by {} in the news section of our site"] * 40 + ["Posted by {} for all friends of old steam trains"] * 30
    kinds += [f"Posted by {{}} {a} {b} {a} {b} {a} {b} {a}" for a, b in ("xy", "yz", "zx") for _ in range(10)]  # these blend
    rows = [(i, k.format(prose(rng, 1)) + "\n" + prose(rng, 30)) for i, k in enumerate(kinds)]
    got = linededup.drop_recurring_lines(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 100 and all(r.n_dropped == 1 and "Posted" not in r.text for r in got)


def test_line_dedup_of_short_lines(spark):
    rng = np.random.default_rng(10)
    rows = [(i, f"Home\nPage {i} of 90\n{2000 + i}\n17\nAll rights reserved.\n\n{prose(rng, 4)}\n{prose(rng, 30)}") for i in range(4)]
    got = linededup.drop_recurring_lines(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()
    text = dict(rows)
    assert all(r.text == "\n".join([str(2000 + r.doc_id)] + text[r.doc_id].split("\n")[5:]) and r.n_dropped == 4 for r in got)
    two = linededup.drop_recurring_lines(spark, spark.createDataFrame(rows[:2], "doc_id long, text string")).collect()
    assert all(r.text == text[r.doc_id] and r.n_dropped == 0 for r in two)


def test_mixing(spark, docs, none):
    labelled = docs.selectExpr("doc_id", "lang as domain")
    targets = {"en": 0.5, "de": 0.5}
    assert mixing.mix(spark, none, labelled, targets).count() == 0
    got = mixing.mix(spark, docs, labelled, targets, least_rate=0.0).collect()
    assert len(got) == len({r[0] for r in messy()})
    totals = {d: sum(r.rate * r.n_tokens * r[f"p_{d}"] for r in got) for d in targets}
    assert all(abs(r.p_en + r.p_de - 1) < 1e-9 and r.rate >= 0 for r in got)
    assert abs(totals["en"] - totals["de"]) < 0.02 * sum(totals.values())


def test_mixing_by_plain_projected_gradient(spark, docs):
    """The rates are those of numpy's steps, domains above their target are thinned, and targets out of reach end with their residual."""
    labelled = docs.selectExpr("doc_id", "lang as domain")
    for targets, total in (({"en": 0.9, "de": 0.1}, "natural"), ({"en": 0.5, "de": 0.5}, None), ({"en": 1.0, "de": 0.0}, 500.0)):
        got = mixing.mix(spark, docs, labelled, targets, total=total).toPandas()
        tokens, p = got["n_tokens"].to_numpy(float), got[["p_de", "p_en"]].to_numpy()
        natural = (tokens[:, None] * p).sum(0)
        share = np.array([targets["de"], targets["en"]])
        budget = natural.sum() if total == "natural" else total or (natural[share > 0] / share[share > 0]).max()
        rate, misses = np.ones(len(got)), []
        while True:
            now = (rate[:, None] * tokens[:, None] * p).sum(0)
            misses.append(np.abs(now - budget * share).max() / budget)
            if misses[-1] <= mixing.CLOSE or len(misses) > mixing.STEPS and misses[-mixing.STEPS - 1] - misses[-1] <= mixing.CLOSE / 100:
                break
            rate = np.maximum(0, rate + p @ ((budget * share - now) / natural))
        assert np.allclose(rate, got["rate"], rtol=1e-6, atol=1e-9) and np.allclose(misses[-1], got["residual"])
        assert total != "natural" or (got["rate"] < 1).any()
    assert mixing.mix(spark, docs, labelled, {"en": 0.5, "xx": 0.5}).filter("p_xx <> 0").count() == 0


def test_language(spark, docs, none):
    assert langid.identify(spark, none).count() == 0
    got = {r.doc_id: r for r in langid.identify(spark, docs).collect()}
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (2, 3, 4, 6))
    assert all(0 <= r.score <= 1 for r in got.values()) and got[12].lang_pred in ("en", "de")


def test_language_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    held = langid.identify(spark, docs).filter("held_out").join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert sum(r.lang == r.lang_pred for r in held) >= 0.95 * len(held)


def test_quality(spark, docs, none, labels):
    assert crfquality.score_documents(spark, none, labels).count() == 0
    got = crfquality.score_documents(spark, docs, labels).collect()
    assert len(got) == len(messy()) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    assert all(r.score == 0 for r in got if r.doc_id in (2, 3, 4))
    unlabelled = crfquality.score_documents(spark, docs, labels.limit(0)).filter("doc_id = 1").first()
    assert unlabelled.score == 0.5


def test_chain_marginals_by_enumeration():
    import itertools

    rng = np.random.default_rng(0)
    u, pair = rng.normal(size=(1, 4)), rng.normal(size=(2, 2))
    paths = list(itertools.product((0, 1), repeat=4))
    weight = np.exp([sum(u[0][k] * p[k] for k in range(4)) + sum(pair[p[k], p[k + 1]] for k in range(3)) for p in paths])
    want = [sum(w for w, p in zip(weight, paths) if p[k]) / weight.sum() for k in range(4)]
    good, _, log_z = crfquality.marginals(u, np.ones((1, 4), bool), pair)
    assert np.allclose(good[0], want) and np.allclose(log_z, np.log(weight.sum()))


def test_nearest(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 8))
    rows = [(i, v.tolist(), "r") for i, v in enumerate(x)] + [(900, None, "r"), (901, [0.0] * 8, "r"), (902, [float("nan")] * 8, "r"), (903, [], "r"), (904, [1.0, None] + [0.0] * 6, "r"), (905, x[0].tolist(), "r"), (0, x[0].tolist(), "r")]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank string")
    got = ann.nearest(spark, v, v.filter("vec_id % 20 = 0"), 20).collect()
    x = np.vstack([x, x[:1]]).astype(np.float32).astype(float)
    ids = np.array([*range(300), 905])
    hits = total = 0
    for q in range(0, 300, 20):
        score = x @ x[q]
        order = [int(ids[k]) for k in np.lexsort((ids, -score)) if ids[k] != q][:20]
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)
        assert [r.rank for r in mine] == list(range(1, len(mine) + 1))
        assert all(abs(score[list(ids).index(r.vec_id)] - r.score) < 1e-9 for r in mine)
        hits, total = hits + len({r.vec_id for r in mine} & set(order)), total + 20
    assert hits >= 0.9 * total
    assert ann.nearest(spark, v.limit(0), v.limit(0)).count() == 0
    few = v.filter("vec_id < 3")
    assert {r.query_id for r in ann.nearest(spark, few, few).collect()} == {0, 1, 2}


@pytest.mark.parametrize("norms", ["spread", "one long row"])
def test_nearest_of_unequal_norms(spark, norms):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(2500, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x *= (rng.lognormal(0, 0.7, 2500) if norms == "spread" else np.where(np.arange(2500) == 7, 20.0, 1.0))[:, None]
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in ann.nearest(spark, v, v.filter("vec_id % 50 = 0"), 20).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = 0
    for q in range(0, 2500, 50):
        score = x @ x[q]
        score[q] = -np.inf
        hits += len(got[q] & set(np.argsort(-score)[:20].tolist()))
    assert hits >= 0.9 * 20 * 50


def test_archives(spark):
    rows = [(1, "http://a.b/x", "h" * 200), (0, "http://c.d/y?z#q", "h" * 200), (2, None, None), (3, "http://u@E.F:8080", "short"), (4, "http://e.f", "short"), (5, "http://a.b/x", "ü\r\n\r\n" * 90), (5, "http://a.b/x", "ü\r\n\r\n" * 90), (None, "http://n", "h" * 200)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, offset string")
    got = warc.round_trip(spark, pages).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r for r in got}
    assert by[1].record_type == "revisit" and by[1].refers_to == 0 and by[1].payload_bytes == 200
    assert by[0].record_type == by[3].record_type == by[4].record_type == by[5].record_type == by[None].record_type == "response"
    assert by[2].payload_bytes == 0 and by[5].payload_bytes == len(("ü\r\n\r\n" * 90).encode())
    assert warc.url_key("https://Blog.example.com:80/a?b#c") == "com,example,blog:80)/a?b"
    assert warc.round_trip(spark, pages.limit(0)).count() == 0


def test_near_copies_of_clashing_and_missing_ids(spark):
    base = " ".join(f"w{k}" for k in range(120))
    near = base + " tail"
    other = " ".join(f"v{k}" for k in range(90))
    shape = "doc_id long, text string"
    got = {r.doc_id: r for r in neardup.near_duplicates(spark, spark.createDataFrame([(0, other), (0, base), (1, near)], shape)).collect()}
    assert (got[1].component_id, got[1].kept) == (0, False)
    rows = neardup.near_duplicates(spark, spark.createDataFrame([(None, near), (7, base), (9, other)], shape)).collect()
    assert {(r.doc_id, r.component_id, r.kept) for r in rows} == {(None, 7, False), (7, 7, True), (9, 9, True)}
    # a missing id joins two texts that are not alike themselves; without any id all stay
    chain = [base, "a b c d e f " + base, "a b c d e f " + base + " g h i j k l"]
    rows = neardup.near_duplicates(spark, spark.createDataFrame([(5, chain[0]), (None, chain[1]), (3, chain[2])], shape), 92).collect()
    assert {r.component_id for r in rows} == {3}
    rows = neardup.near_duplicates(spark, spark.createDataFrame([(None, base), (None, base), (None, near)], shape)).collect()
    assert {(r.component_id, r.kept) for r in rows} == {(None, True)}
    crowd = [(None if k % 3 else k, base.replace(f"w{k + 5} ", f"x{k} ")) for k in range(60)]
    rows = neardup.near_duplicates(spark, spark.createDataFrame(crowd, shape)).collect()
    assert {r.component_id for r in rows} == {0}


def test_copies_that_match_neither_end_of_a_bucket_are_one_holder(spark):
    rng = np.random.default_rng(8)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 6))
    passage = " ".join(word() for _ in range(14))
    groups = []
    for g in range(12):
        base = [word() for _ in range(90)]
        # near copies of one text, each with a word of its own
        groups.append([" ".join(base[:i] + [word()] + base[i + 1 :]) for i in range(4)])
    rows = [(g * 10 + i, f"{t}\n{passage if g == 5 else 'other ' + word()}") for g, group in enumerate(groups) for i, t in enumerate(group)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert all(r.n_dropped == 0 for r in linededup.drop_recurring_lines(spark, frame).collect())
    more = spark.createDataFrame(rows + [(900 + i, " ".join(word() for _ in range(50)) + "\n" + passage) for i in range(2)], "doc_id long, text string")
    lost = {r.doc_id for r in linededup.drop_recurring_lines(spark, more).collect() if r.n_dropped}
    assert lost == {50, 51, 52, 53, 900, 901}


def test_copies_with_one_shared_line_of_many_are_one_holder(spark):
    rng = np.random.default_rng(9)
    line = lambda: " ".join("".join(rng.choice(list("klmnopqrst"), 5)) for _ in range(9))
    shared = line()
    body = [line() for _ in range(30)]
    rows = [(0, "\n".join([*body, shared])), (1, "\n".join([*body[:-1], line(), shared])), (2, "\n".join([line(), line(), shared]))]
    got = linededup.drop_recurring_lines(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(r.n_dropped == 0 for r in got)
    rows.append((3, "\n".join([line(), shared, line()])))
    got = {r.doc_id: r.n_dropped for r in linededup.drop_recurring_lines(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {0: 1, 1: 1, 2: 1, 3: 1}


def test_many_lost_lines_of_a_document(spark):
    lines = [f"{w} stands in line number words of {w}" for w in ("".join(p) for p in __import__("itertools").product("abcdefgh", repeat=4))][:3000]
    rows = [(i, "\n".join([*lines, f"own {'xyzuv'[i]} words of this one page", *lines[:5]])) for i in range(5)]
    other = [(10 + i, "\n".join([" ".join(f"{'mnopq'[i]}{k}{j}z".translate(str.maketrans("0123456789", "abcdefghij")) for j in range(9)) for k in range(2500)] + lines)) for i in range(4)]
    got = {r.doc_id: r for r in linededup.drop_recurring_lines(spark, spark.createDataFrame(rows + other, "doc_id long, text string")).collect()}
    assert all(got[i].n_dropped >= 3005 for i in range(5)) and all(got[i].n_dropped >= 3000 for i in range(10, 14))


def test_nearest_of_several_lengths_and_clashing_ids(spark):
    rng = np.random.default_rng(6)
    rows = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(60)] + [(100 + i, [float(x) for x in rng.normal(size=3)]) for i in range(5)] + [(200, [1.0, 2.0])]
    clash = [(3, [9.0] * 8), (3, [-9.0] * 8)]
    v = spark.createDataFrame(rows + clash, "vec_id long, embedding array<double>")
    got = {}
    for r in ann.nearest(spark, v, v.filter("vec_id in (3, 20, 100, 102, 200)"), 4).collect():
        got.setdefault(r.query_id, []).append((r.vec_id, round(r.score, 9)))
    plain = {i: x for i, x in rows} | {3: [-9.0] * 8}
    for q in (3, 20, 100, 102):
        best = sorted((-round(float(np.dot(plain[q], x)), 9), i) for i, x in plain.items() if i != q and len(x) == len(plain[q]))[:4]
        assert got[q] == [(i, -s) for s, i in best]
    assert 200 not in got


def test_alike_sketches_of_a_bucket_end_in_one_group(spark):
    rng, bins = random.Random(5), linededup.BINS
    fresh = lambda b: (b << 58 | rng.getrandbits(58)) - (1 << 64 if b >= bins // 2 else 0)
    changed = lambda s, k: [fresh(b) if b in k else v for b, v in enumerate(s)]
    common, sketches = [fresh(b) for b in range(bins)], []
    for _ in range(6):  # chains: only neighbours are alike, so most match neither end of the bucket
        step = [fresh(b) for b in range(bins)]
        for k in range(12):
            sketches.append(step)
            step = changed(step, {(13 * k + i) % bins for i in range(13)})
    sketches += [changed(common, set(rng.sample(range(bins), 32))) for _ in range(60)]  # alone, with half of a passage
    ids = rng.sample(range(1000), len(sketches))
    close = lambda a, b: 100 * sum(x == y for x, y in zip(a, b)) >= linededup.ALIKE * bins
    top = {i: i for i in ids}
    for _ in ids:
        for i, a in zip(ids, sketches):
            top[i] = min(top[j] for j, b in zip(ids, sketches) if close(a, b))
    assert len({top[i] for i in ids[:72]}) == 6 and all(top[i] == i for i in ids[72:])
    kept = spark.createDataFrame([(i, s, -1) for i, s in zip(ids, sketches)], "rep long, sketch array<long>, full long")
    sides = spark.createDataFrame([(i, 7) for i in ids], "rep long, bucket long")
    found = linededup.alike(spark, Scratch(spark, "test"), kept, sides, spark.createDataFrame([], "a long, b long")).collect()
    assert {i: top[i] for i in ids} == {i: i for i in ids} | {r.id: r.comp for r in found}
