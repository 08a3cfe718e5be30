"""Document quality by a linear-chain conditional random field over lines.

Every line of a document is labelled good or bad. A line's features are shares of byte classes, word counts
and lengths, repeats inside the line and of earlier lines, and the same figures of the lines before and after.
Forward-backward gives each line's probability of being good; weighted by line length these make the
document's score. The field is trained in numpy (Adam, L2) on a bounded sample of ``MOST_TEXTS`` labelled
documents, in which each line carries its document's label; a logistic curve, fitted on the same sample,
then spreads the scores so that 0.5 is even odds between the classes, each weighted alike.

Cases: null, empty or blank text: score 0 (there is nothing to keep), predicted 0. No labelled row: score 0.5.
With one label only, its value is the score. Repeated rows and null ids are scored row by row; labels that disagree about a
document both count. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import _SPACE, chunks, fold, sampled_texts, small_batches, word_hashes

MOST_TEXTS, STEPS, THRESHOLD = 3000, 120, 0.7

_CLASSES = np.zeros((256, 5), np.uint8)  # letters, upper case, digits, marks of prose, other signs
for _b in range(33, 127):
    _c = chr(_b)
    _CLASSES[_b] = [_c.isalpha(), _c.isupper(), _c.isdigit(), _c in ".,;:!?'\"()-", not _c.isalnum() and _c not in ".,;:!?'\"()-"]
_CLASSES[128:, 0] = 1
_OWN = 14
N_FEATURES = 3 * _OWN + 2


def line_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, lengths in bytes, first line of each text with one more entry) of all lines that hold a word."""
    feats, lengths, counts = [], [], []
    for lo, hi in chunks(texts):
        block = [t + b"\n" for t in texts[lo:hi]]
        data = np.frombuffer(b"".join(block), np.uint8)
        doc_end = np.cumsum([len(t) for t in block])
        line_end = np.flatnonzero(data == 10)
        line_start = np.concatenate(([0], line_end[:-1] + 1))
        words, _ = word_hashes([data[:-1].tobytes()], lower=False)
        space = _SPACE[data]
        w_start = np.flatnonzero(~space & np.concatenate(([True], space[:-1])))
        w_line = np.searchsorted(line_end, w_start)
        has = np.bincount(w_line, minlength=len(line_end))
        keep = np.flatnonzero(has)
        owner = np.searchsorted(doc_end, line_end[keep], side="right")
        counts.append(np.bincount(owner, minlength=hi - lo))
        if not len(keep):
            continue
        n_words = has[keep].astype(float)
        size = (line_end[keep] - line_start[keep]).astype(float)
        shares = np.stack([np.add.reduceat(_CLASSES[data, k].astype(np.int64), line_start)[keep] for k in range(5)], 1) / size[:, None]
        again = np.concatenate(([False], (words[1:] == words[:-1]) & (w_line[1:] == w_line[:-1])))
        twice = np.zeros(len(words), bool)
        order = np.lexsort((words, w_line))
        same = (words[order][1:] == words[order][:-1]) & (w_line[order][1:] == w_line[order][:-1])
        twice[order[1:]] = same
        run = np.bincount(w_line, again, len(line_end))[keep] / n_words
        repeat = np.bincount(w_line, twice, len(line_end))[keep] / n_words
        place = np.arange(len(words)) - np.repeat(np.concatenate(([0], np.cumsum(n_words)[:-1])), n_words.astype(int)).astype(int)
        with np.errstate(over="ignore"):
            key = np.add.reduceat(words * (place.astype(np.uint64) * np.uint64(2) + np.uint64(0x9E3779B97F4A7C15)), np.concatenate(([0], np.cumsum(has[keep])[:-1])))
        seen = np.zeros(len(keep))
        o = np.lexsort((np.arange(len(keep)), key, owner))
        seen[o[1:]] = (key[o][1:] == key[o][:-1]) & (owner[o][1:] == owner[o][:-1])
        prose = np.isin(data[line_end[keep] - 1], np.frombuffer(b'.!?:"', np.uint8)).astype(float)
        first_upper = _CLASSES[data[np.minimum(line_start[keep], len(data) - 1)], 1].astype(float)
        letters = shares[:, 0] * size
        own = np.column_stack([shares, np.minimum(n_words, 60) / 60, np.log1p(n_words) / 5, np.minimum(letters / n_words, 20) / 10, np.abs(np.minimum(letters / n_words, 20) - 5.5) / 10, run, repeat, seen, prose, first_upper])
        before, after = np.zeros_like(own), np.zeros_like(own)
        inner = owner[1:] == owner[:-1]
        before[1:][inner] = own[:-1][inner]
        after[:-1][inner] = own[1:][inner]
        edge = np.ones(len(own))
        edge[1:][inner] = 0
        feats.append(np.column_stack([own, before, after, edge, np.ones(len(own))]))
        lengths.append(size)
    first = np.concatenate(([0], np.cumsum(np.concatenate(counts)))).astype(int) if counts else np.zeros(1, int)
    return (np.concatenate(feats), np.concatenate(lengths), first) if feats else (np.zeros((0, N_FEATURES)), np.zeros(0), first)


def padded(first: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Line numbers of the documents, padded to the longest, and which are real."""
    n = first[docs + 1] - first[docs]
    at = first[docs][:, None] + np.arange(n.max())[None, :]
    real = np.arange(n.max())[None, :] < n[:, None]
    return np.where(real, at, 0), real


def marginals(unary: np.ndarray, real: np.ndarray, pair: np.ndarray):
    """(P(good) of lines, expected transitions (2, 2), log partition) for two labels; unary: log odds of good, (documents, lines)."""
    b, t = unary.shape
    node = np.stack([np.zeros_like(unary), unary], 2)
    fwd, bwd = np.zeros((b, t, 2)), np.zeros((b, t, 2))
    fwd[:, 0] = node[:, 0]
    for k in range(1, t):
        step = np.logaddexp(fwd[:, k - 1, 0, None] + pair[0], fwd[:, k - 1, 1, None] + pair[1]) + node[:, k]
        fwd[:, k] = np.where(real[:, k, None], step, fwd[:, k - 1])
    for k in range(t - 2, -1, -1):
        ahead = node[:, k + 1] + bwd[:, k + 1]
        step = np.logaddexp(pair[:, 0] + ahead[:, 0, None], pair[:, 1] + ahead[:, 1, None])
        bwd[:, k] = np.where(real[:, k + 1, None], step, 0)
    log_z = np.logaddexp(fwd[:, -1, 0], fwd[:, -1, 1])
    good = np.exp(np.minimum(0, fwd[:, :, 1] + bwd[:, :, 1] - log_z[:, None])) * real
    moves = fwd[:, :-1, :, None] + pair[None, None] + (node + bwd)[:, 1:, None, :] - log_z[:, None, None, None]
    moves = (np.exp(np.minimum(moves, 0)) * real[:, 1:, None, None]).sum((0, 1))
    return good, moves, log_z


@dataclass
class LineField:
    weights: np.ndarray
    pair: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    curve: tuple[float, float] = (1.0, 0.0)

    def raw(self, texts: list[bytes]) -> np.ndarray:
        """Length-weighted mean of the lines' marginals; NaN for texts without a word."""
        x, size, first = line_features(texts)
        odds = ((x - self.mean) / self.scale) @ self.weights
        out = np.full(len(texts), np.nan)
        n = np.diff(first)
        order = np.argsort(n, kind="stable")
        order = order[n[order] > 0]
        for group in np.array_split(order, max(1, len(order) // 64)):
            if len(group):
                at, real = padded(first, group)
                good, _, _ = marginals(np.where(real, odds[at], 0), real, self.pair)
                weight = size[at] * real
                out[group] = (good * weight).sum(1) / weight.sum(1)
        return out

    def score(self, texts: list[bytes]) -> np.ndarray:
        raw = self.raw(texts)
        p = np.clip(raw, 1e-6, 1 - 1e-6)
        a, b = self.curve
        return np.where(np.isnan(raw), 0.0, 1 / (1 + np.exp(-(a * np.log(p / (1 - p)) + b))))


def train(samples: list[tuple[str, int]]) -> LineField | float:
    """A field, or the constant score where the sample holds fewer than two labels."""
    samples = [(t, int(y)) for t, y in samples if t.strip(" \t\n\v\f\r")]
    labels = {y for _, y in samples}
    if len(labels) < 2:
        return float(labels.pop()) if labels else 0.5
    texts, y = [t.encode("utf-8", "replace") for t, _ in samples], np.array([v for _, v in samples], float)
    x, _, first = line_features(texts)
    mean, scale = x.mean(0), x.std(0) + 1e-6
    mean[-1], scale[-1] = 0, 1
    x = (x - mean) / scale
    doc_weight = np.where(y == 1, 0.5 / (y == 1).sum(), 0.5 / (y == 0).sum())
    order = np.argsort(np.diff(first), kind="stable")
    groups = [padded(first, g) + (g,) for g in np.array_split(order, max(1, len(order) // 64)) if len(g)]
    w, pair = np.zeros(x.shape[1]), np.zeros((2, 2))
    m, v = [np.zeros_like(w), np.zeros_like(pair)], [np.zeros_like(w), np.zeros_like(pair)]
    for step in range(1, STEPS + 1):
        g_w, g_pair = 1e-4 * w, 1e-2 * pair
        odds = x @ w
        for at, real, docs in groups:
            share = (doc_weight[docs] / np.maximum(1, real.sum(1)))[:, None] * real
            good, moves, _ = marginals(np.where(real, odds[at], 0), real, pair)
            g_w = g_w + ((good - y[docs][:, None]) * share)[real] @ x[at[real]]
            n_moves = max(1, real[:, 1:].sum())
            own = np.zeros((2, 2))
            for c in (0, 1):
                own[c, c] = (real[:, 1:].sum(1) * (y[docs] == c)).sum()
            g_pair = g_pair + (moves - own) / n_moves * doc_weight[docs].sum()
        for p, g, a, b in zip((w, pair), (g_w, g_pair), m, v):
            a *= 0.9
            a += 0.1 * g
            b *= 0.99
            b += 0.01 * g * g
            p -= 0.1 * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-9)
    field = LineField(w, pair, mean, scale)
    p = np.clip(field.raw(texts), 1e-6, 1 - 1e-6)
    z = np.log(p / (1 - p))
    a, b = 1.0, 0.0
    for _ in range(300):  # logistic curve by gradient descent with a prior that keeps the slope moderate
        q = 1 / (1 + np.exp(-(a * z + b)))
        r = (q - y) * doc_weight
        a, b = a - 0.3 * ((r * z).sum() + 1e-3 * (a - 1)), b - 0.3 * (r.sum() + 1e-3 * b)
    field.curve = (max(a, 0.05), b)
    return field


def score_documents(spark: SparkSession, docs: DataFrame, labels: DataFrame, folds: int = 4, held: int = 2) -> DataFrame:
    """doc_id, held_out, score, predicted; learned from ``labels`` (doc_id, quality) of documents that aren't held out."""
    small_batches(spark)
    model = train(sampled_texts(docs, labels.filter(fold("doc_id", folds) != held), "quality", MOST_TEXTS))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            texts = ["" if t is None else t for t in part["text"].astype(object).where(part["text"].notna(), None)]
            data = [t.encode("utf-8", "replace") for t in texts]
            score = np.array([model if t.strip(b" \t\n\v\f\r") else 0.0 for t in data]) if isinstance(model, float) else model.score(data)
            yield pd.DataFrame({"doc_id": part["doc_id"], "held_out": part["held_out"], "score": score.astype(float), "predicted": (score >= THRESHOLD).astype(int)})

    rows = docs.select("doc_id", "text", (fold("doc_id", folds) == held).alias("held_out"))
    return rows.mapInPandas(run, "doc_id long, held_out boolean, score double, predicted int")


def accepted(spark: SparkSession, docs: DataFrame, labels: DataFrame, folds: int = 4, held: int = 2) -> DataFrame:
    """The rows of ``docs``, all columns, that score at least THRESHOLD; a row is scored where it is read, so nothing is joined back."""
    small_batches(spark)
    model = train(sampled_texts(docs, labels.filter(fold("doc_id", folds) != held), "quality", MOST_TEXTS))

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        data = ["".encode() if t is None else t.encode("utf-8", "replace") for t in texts.astype(object).where(texts.notna(), None)]
        if isinstance(model, float):
            return pd.Series([model if t.strip(b" \t\n\v\f\r") else 0.0 for t in data])
        return pd.Series(model.score(data))

    return docs.filter(score("text") >= THRESHOLD)
