"""The byte convolution network against a plain loop over windows, places and filters."""

import numpy as np
import pytest

pytest.importorskip("groundloom.llm")
from groundloom.llm import langid  # noqa: E402

SAMPLES = [("the cat sat on the mat by the door", "en"), ("der Hund lief über die Straße", "de"), ("le chat est sur la chaise", "fr")] * 8


def plain_posterior(model, window):
    peaks = []
    for width in langid.WIDTHS:
        for f in range(langid.FILTERS):
            peaks.append(max(sum(float(model.tables[width][k][window[at + k]][f]) for k in range(width)) for at in range(len(window) - width + 1)))
    hidden = [max(p + float(b), 0.0) for p, b in zip(peaks, model.bias)]
    raw = [sum(h * float(model.dense[i][c]) for i, h in enumerate(hidden)) + float(model.offset[c]) for c in range(len(model.languages))]
    e = np.exp(np.array(raw) - max(raw))
    return e / e.sum()


def test_predictions_equal_a_plain_convolution():
    model = langid.train(SAMPLES)
    model.prepare()
    texts = ["the dog and the cat", "die Katze und der Hund vor der Straße " * 9, "le chat " * 40, "ab", "x" * langid.WINDOW, "é" * 130, "12 34", "", None]
    for text, (language, score) in zip(texts, langid.predict(model, texts)):
        if not text or not langid.has_letter(text):
            assert (language, score) == (langid.UNKNOWN, 0.0)
            continue
        data = text.encode()
        n = 1
        while langid.STRIDE * (n - 1) + langid.WINDOW < len(data):
            n += 1
        total, weights = np.zeros(len(model.languages)), 0
        for k in range(n):
            piece = data[k * langid.STRIDE : k * langid.STRIDE + langid.WINDOW]
            weight = langid.STRIDE if k < n - 1 else max(1, len(data) - langid.STRIDE * (n - 1))
            total += weight * plain_posterior(model, piece + bytes(langid.WINDOW - len(piece)))
            weights += weight
        mean = total / weights
        assert language == model.languages[int(mean.argmax())]
        assert score == pytest.approx(float(mean.max()), abs=1e-4)
