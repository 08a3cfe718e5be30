"""Language identification by a convolutional network over raw bytes.

Filters of several widths slide over fixed-length windows of UTF-8 bytes; each filter's maximum over the
window feeds a softmax. The network is trained in numpy (Adam, cross-entropy) on windows of a bounded sample
of labelled texts: ``MOST_TEXTS`` texts, at most ``WINDOWS_A_TEXT`` windows each. Prediction covers whole
texts: every window, in batches; a text's posterior is the mean over its windows, by window length.

Byte inputs are one-hot, so a filter of width w is w tables of 256 rows; for prediction two neighbouring
tables are merged into one of 65,536 rows, which halves the look-ups.

Cases: null texts and texts without a letter: ``und``, score 0. With no labelled row at all every text is
``und``. Ties between languages go to the alphabetically first. Repeated rows and null ids are answered row by
row. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold, sampled_texts, small_batches

WINDOW, WIDTHS, FILTERS = 256, (2, 3, 4), 8
#: Consecutive windows share so many bytes that no filter misses a place.
STRIDE = WINDOW - max(WIDTHS) + 1
MOST_TEXTS, WINDOWS_A_TEXT, EPOCHS, BATCH = 4000, 3, 6, 64
UNKNOWN = "und"


@dataclass
class ByteConv:
    languages: list[str]
    tables: dict[int, np.ndarray]  # width -> (width, 256, FILTERS)
    bias: np.ndarray
    dense: np.ndarray
    offset: np.ndarray

    def prepare(self) -> None:
        """Merged tables, built where they are used."""
        self.steps = []
        for width in WIDTHS:
            t = self.tables[width]
            merged = [((t[k][:, None, :] + t[k + 1][None, :, :]).reshape(65536, FILTERS), k) for k in range(0, width - 1, 2)]
            self.steps.append((width, merged, t[width - 1] if width % 2 else None))

    def posteriors(self, windows: np.ndarray) -> np.ndarray:
        pair = windows[:, :-1].astype(np.int32) * 256 + windows[:, 1:]
        peaks = []
        for width, merged, last in self.steps:
            places = windows.shape[1] - width + 1
            total = None
            for table, k in merged:
                part = table.take(pair[:, k : k + places], axis=0)
                total = part if total is None else np.add(total, part, out=total)
            if last is not None:
                total += last.take(windows[:, width - 1 : width - 1 + places], axis=0)
            peaks.append(total.max(axis=1))
        hidden = np.maximum(np.concatenate(peaks, axis=1) + self.bias, 0)
        return softmax(hidden @ self.dense + self.offset)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def windows_of(data: bytes) -> np.ndarray:
    """All windows of a text, the last one padded with zero bytes."""
    n = max(1, -(-(len(data) - (WINDOW - STRIDE)) // STRIDE))
    padded = np.zeros((n - 1) * STRIDE + WINDOW, np.uint8)
    padded[: len(data)] = np.frombuffer(data, np.uint8)
    return np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[::STRIDE]


def train(samples: list[tuple[str, str]], seed: int = 7) -> ByteConv | None:
    languages = sorted({y for _, y in samples})
    if not languages:
        return None
    rng = np.random.default_rng(seed)
    xs, ys = [], []
    for text, y in samples:
        w = windows_of(text.encode("utf-8", "replace"))
        for k in rng.permutation(len(w))[:WINDOWS_A_TEXT]:
            xs.append(w[k])
            ys.append(languages.index(y))
    x, y = np.array(xs), np.array(ys)
    model = ByteConv(languages, {w: rng.normal(0, 0.1, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS}, np.zeros(FILTERS * len(WIDTHS), np.float32), rng.normal(0, 0.2, (FILTERS * len(WIDTHS), len(languages))).astype(np.float32), np.zeros(len(languages), np.float32))
    params = [*model.tables.values(), model.bias, model.dense, model.offset]
    m, v, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(x))
        for lo in range(0, len(order), BATCH):
            at = order[lo : lo + BATCH]
            bx = x[at]
            raw, peak = [], []
            for width in WIDTHS:
                places = WINDOW - width + 1
                total = sum(model.tables[width][k].take(bx[:, k : k + places], axis=0) for k in range(width))
                p = total.argmax(axis=1)
                peak.append(p)
                raw.append(np.take_along_axis(total, p[:, None, :], 1)[:, 0])
            pre = np.concatenate(raw, axis=1) + model.bias
            hidden = np.maximum(pre, 0)
            out = softmax(hidden @ model.dense + model.offset)
            out[np.arange(len(at)), y[at]] -= 1
            out /= len(at)
            back = (out @ model.dense.T) * (pre > 0)
            grads = []
            for i, width in enumerate(WIDTHS):
                g = np.zeros_like(model.tables[width])
                part = back[:, i * FILTERS : (i + 1) * FILTERS]
                for k in range(width):
                    byte = np.take_along_axis(bx, peak[i] + k, 1)
                    np.add.at(g[k], (byte, np.arange(FILTERS)[None, :]), part)
                grads.append(g)
            grads += [back.sum(0), hidden.T @ out, out.sum(0)]
            t += 1
            for p, g, a, b in zip(params, grads, m, v):
                a *= 0.9
                a += 0.1 * g
                b *= 0.999
                b += 0.001 * g * g
                p -= 0.01 * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.999**t)) + 1e-8)
    return model


def has_letter(text: str) -> bool:
    return any(c.isalpha() for c in text)


def predict(model: ByteConv, texts: list[str | None]) -> list[tuple[str, float]]:
    out: list[tuple[str, float]] = [(UNKNOWN, 0.0)] * len(texts)
    held, size = [], 0

    def flush() -> None:
        nonlocal held, size
        if not held:
            return
        every = np.concatenate([w for _, _, w in held])
        p = np.concatenate([model.posteriors(every[k : k + 64]) for k in range(0, len(every), 64)])
        at = 0
        for i, n, w in held:
            weight = np.full(len(w), float(STRIDE))
            weight[-1] = max(1, n - STRIDE * (len(w) - 1))
            mean = weight @ p[at : at + len(w)].astype(np.float64) / weight.sum()
            best = int(mean.argmax())
            out[i] = (model.languages[best], float(min(1.0, mean[best])))
            at += len(w)
        held, size = [], 0

    for i, text in enumerate(texts):
        if text and has_letter(text):
            data = text.encode("utf-8", "replace")
            held.append((i, len(data), windows_of(data)))
            size += len(data)
            if size > 1 << 20:
                flush()
    flush()
    return out


def identify(spark: SparkSession, docs: DataFrame, folds: int = 5) -> DataFrame:
    """doc_id, held_out, lang_pred, score; learned from rows with a language that aren't held out."""
    small_batches(spark)
    learn = docs.filter("lang is not null").filter(fold("doc_id", folds) != 0)
    model = train(sampled_texts(docs, learn, "lang", MOST_TEXTS))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if model:
            model.prepare()
        for part in batches:
            texts = part["text"].astype(object).where(part["text"].notna(), None).tolist()
            found = predict(model, texts) if model else [(UNKNOWN, 0.0)] * len(texts)
            yield pd.DataFrame({"doc_id": part["doc_id"], "held_out": part["held_out"], "lang_pred": [a for a, _ in found], "score": [b for _, b in found]})

    rows = docs.select("doc_id", "text", (fold("doc_id", folds) == 0).alias("held_out"))
    return rows.mapInPandas(run, "doc_id long, held_out boolean, lang_pred string, score double")
