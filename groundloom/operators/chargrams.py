"""Counts of the character grams inside blank-padded words, made text by text in tasks: what is dealt are texts and vocabularies, never grams by row."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..catalog import DROPPED, settings, written

#: Python gets few texts at a time, since they may be long.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20)}
#: Characters of texts that are counted in one pass; words and grams that a task keeps numbers of.
CHARS, WORDS, GRAMS = 1 << 20, 300_000, 1_000_000
_BLANK = re.compile("[ \t\n\x0b\f\r]+")


class Counter:
    """Numbers words and the grams in them; with a vocabulary, only its grams count."""

    def __init__(self, low: int, high: int, known: dict[str, int] | None = None):
        self.sizes, self.known = range(low, high + 1), known
        self.grams: dict[str, int] = {} if known is None else known
        self.forget()

    def forget(self) -> None:
        self.words: dict[str, int] = {}
        self.flat, self.ends = np.zeros(1024, np.int64), [0]
        if self.known is None:
            self.grams = {}

    def _learn(self, word: str) -> int:
        p = f" {word} "
        found = [p[i : i + n] for n in self.sizes for i in range(len(p) - n + 1)]
        ids = [self.grams.setdefault(g, len(self.grams)) for g in found] if self.known is None else [self.grams[g] for g in found if g in self.grams]
        begin, end = self.ends[-1], self.ends[-1] + len(ids)
        if end > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(max(len(self.flat), len(ids)), np.int64)])
        self.flat[begin:end] = ids
        self.ends.append(end)
        self.words[word] = len(self.words)
        return self.words[word]

    def count(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """text, gram, count of all grams, by text and gram."""
        ids, lengths = [], []
        for t in texts:
            mine = [w for w in _BLANK.split(t) if w]
            ids += [self._learn(w) if (i := self.words.get(w)) is None else i for w in mine]
            lengths.append(len(mine))
        # a text's different words first, then their grams
        pairs, times = np.unique(np.repeat(np.arange(len(texts)), lengths) * len(self.words) + np.array(ids, np.int64), return_counts=True)
        text, word = np.divmod(pairs, max(len(self.words), 1))
        ends = np.array(self.ends, np.int64)
        sizes = ends[word + 1] - ends[word]
        at = np.arange(sizes.sum()) + np.repeat(ends[word] - np.r_[0, np.cumsum(sizes)[:-1]][: len(sizes)], sizes)
        keys = np.repeat(text, sizes) * len(self.grams) + self.flat[at]
        order = np.argsort(keys, kind="stable")
        keys, times = keys[order], np.repeat(times, sizes)[order]
        if not len(keys):
            return (np.zeros(0, np.int64),) * 3
        new = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        return *np.divmod(keys[new], len(self.grams)), np.add.reduceat(times, new)


def _runs(texts: list[str]) -> Iterator[tuple[int, int]]:
    begin = held = 0
    for i, t in enumerate(texts):
        held += len(t)
        if held >= CHARS:
            yield begin, i + 1
            begin, held = i + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


def lowered(text: Column | str) -> Column:
    return F.lower(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")))


def vocabulary(rows: DataFrame, text: str, low: int = 3, high: int = 5, min_df: int = 2, features: int = 20000) -> list[tuple[str, int]]:
    """(gram, number of rows with it) of the commonest ``features`` grams of at least ``min_df`` rows, commonest first, ties by gram. A row is a text in lower case."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told = Counter(low, high)
        df = cf = np.zeros(0, np.int64)

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(told.grams), pa.string()), pa.array(df), pa.array(cf)], names=["gram", "df", "cf"])

        for batch in batches:
            texts = batch.column(0).to_pylist()
            for a, b in _runs(texts):
                _, gram, times = told.count(texts[a:b])
                more = np.zeros(len(told.grams) - len(df), np.int64)
                df = np.concatenate([df, more]) + np.bincount(gram, minlength=len(told.grams))
                cf = np.concatenate([cf, more]) + np.bincount(gram, times, len(told.grams)).astype(np.int64)
                if len(told.words) > WORDS or len(told.grams) > GRAMS:
                    yield out()
                    told.forget()
                    df = cf = np.zeros(0, np.int64)
        yield out()

    with settings(rows.sparkSession, BATCHES | DROPPED):
        grams = rows.select(text).mapInArrow(counted, "gram string, df long, cf long").groupBy("gram").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))
        return [(r.gram, r.df) for r in grams.filter(F.col("df") >= min_df).orderBy(F.desc("cf"), "gram").limit(features).collect()]


def count_vectors(rows: DataFrame, text: str, known: list[tuple[str, int]], out: str = "tf", low: int = 3, high: int = 5) -> DataFrame:
    """The rows, as a table, with the counts of known grams of a text in lower case as a sparse vector instead of the text."""
    from pyspark.ml.linalg import VectorUDT

    rest = [c for c in rows.columns if c != text]
    size = len(known)

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counter(low, high, {g: i for i, (g, _) in enumerate(known)})
        for batch in batches:
            texts = batch.column(text).to_pylist()
            for a, b in _runs(texts):
                if len(counts.words) > WORDS:
                    counts.forget()
                at, gram, times = counts.count(texts[a:b])
                ends = pa.array(np.searchsorted(at, np.arange(b - a + 1)), pa.int32())
                parts = [pa.array(np.zeros(b - a, np.int8)), pa.array(np.full(b - a, size, np.int32)), pa.ListArray.from_arrays(ends, pa.array(gram.astype(np.int32))), pa.ListArray.from_arrays(ends, pa.array(times.astype(float)))]
                vectors = pa.StructArray.from_arrays(parts, names=["type", "size", "indices", "values"])
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(a, b - a) for c in rest), vectors], names=[*rest, out])

    kept = rows.select(*rest, text)
    schema = StructType([kept.schema[c] for c in rest])
    made = kept.mapInArrow(told, StructType([*schema, StructField(out, VectorUDT.sqlType())]))
    with settings(rows.sparkSession, BATCHES):
        return written(made, "counts", StructType([*schema, StructField(out, VectorUDT())]))


class Weights:
    """Unit-length vectors of texts: log-scaled counts times smoothed inverse row frequency."""

    def __init__(self, known: list[tuple[str, int]], n_rows: int, low: int = 3, high: int = 5):
        self.known, self.low, self.high = known, low, high
        self.idf = np.log((1 + n_rows) / (1 + np.array([df for _, df in known], float))) + 1

    def maker(self) -> Callable[[list[str]], Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]]:
        """For use in one task: (begin, end, text, gram, weight) of runs of the texts; texts count from 0."""
        told = Counter(self.low, self.high, {g: i for i, (g, _) in enumerate(self.known)})

        def vectors(texts: list[str]):
            for a, b in _runs(texts):
                if len(told.words) > WORDS:
                    told.forget()
                text, gram, times = told.count(texts[a:b])
                y = (1 + np.log(times)) * self.idf[gram]
                norm = np.sqrt(np.bincount(text, y * y, b - a))
                yield a, b, text + a, gram, y / norm[text]

        return vectors


def pair_cosines(pairs: DataFrame, rows: DataFrame, key: str, text: str, weights: Weights) -> DataFrame:
    """a, b, cosine of the texts of the listed pairs of keys (columns a and b, with what else they hold); texts without known grams have cosine 0.

    ``rows`` hold one text in lower case for each key. Texts are dealt twice, once for each side."""

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, width = weights.maker(), max(len(weights.known), 1)
        for batch in batches:
            n, sides = batch.num_rows, []
            for side in ("ta", "tb"):
                found = [(t * width + g, y) for _, _, t, g, y in vectors(batch.column(side).to_pylist())]
                sides.append([np.concatenate(x) for x in zip(*found)])
            _, i, j = np.intersect1d(sides[0][0], sides[1][0], assume_unique=True, return_indices=True)
            cosine = np.bincount(sides[0][0][i] // width, sides[0][1][i] * sides[1][1][j], n)
            yield pa.RecordBatch.from_arrays([batch.column("pair"), pa.array(cosine)], names=["pair", "cosine"])

    a = rows.select(F.col(key).alias("__a"), F.col(text).alias("ta"))
    b = rows.select(F.col(key).alias("__b"), F.col(text).alias("tb"))
    met = pairs.select(F.struct(*pairs.columns).alias("pair")).join(a, F.col("pair.a") == F.col("__a")).join(b, F.col("pair.b") == F.col("__b")).select("pair", "ta", "tb")
    kind = dict(met.dtypes)["pair"]
    with settings(rows.sparkSession, BATCHES):
        return written(met.mapInArrow(told, f"pair {kind}, cosine double"), "cosines").select("pair.*", "cosine")


def summed_scores(pairs: DataFrame, key: str, context: DataFrame, target: DataFrame, text: str, weights: Weights) -> DataFrame:
    """The pairs (key, candidate and what else they hold) with ``s``: the candidate's target against the sum of the key's context texts.

    ``context`` may hold many texts of a key; ``target`` one each; both in lower case. A key's texts come one after the other to one task, which adds them up."""

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, now, total = weights.maker(), None, np.zeros(len(weights.known))
        for batch in batches:
            keys, pair = batch.column("__key").to_pylist(), batch.column("pair")
            asked, rows, s = pair.is_valid().to_pylist(), [], []
            for a, b, at, gram, y in vectors(batch.column("t").to_pylist()):
                cuts = np.searchsorted(at, np.arange(a, b + 1))
                for i in range(a, b):
                    g, w = gram[cuts[i - a] : cuts[i - a + 1]], y[cuts[i - a] : cuts[i - a + 1]]
                    if keys[i] != now:
                        now = keys[i]
                        total[:] = 0
                    if asked[i]:
                        rows.append(i)
                        s.append(float(total[g] @ w))
                    else:
                        total[g] += w
            if rows:
                yield pa.RecordBatch.from_arrays([pair.take(pa.array(rows)), pa.array(s)], names=["pair", "s"])

    listed = pairs.select(F.col(key).alias("__key"), F.struct(*pairs.columns).alias("pair"), F.col("candidate").alias("__c"))
    kind = dict(listed.dtypes)["pair"]
    wanted = listed.join(target.select(F.col(key).alias("__t"), F.col(text).alias("t")), F.col("__c") == F.col("__t"), "left").select("__key", "pair", F.coalesce("t", F.lit("")).alias("t"))
    given = context.select(F.col(key).alias("__key"), F.lit(None).cast(kind).alias("pair"), F.col(text).alias("t"))
    dealt = given.unionByName(wanted).repartition("__key").sortWithinPartitions("__key", F.col("pair").isNotNull())
    with settings(pairs.sparkSession, BATCHES):
        return written(dealt.mapInArrow(told, f"pair {kind}, s double"), "scores").select("pair.*", "s")
