"""Language identification by averaged hashed subword embeddings and a linear softmax.

A text is lower-cased; letters stay and everything else counts as a gap. Each run of two or three code points inside a
word with its edges is hashed to one of ``buckets`` vectors, and the softmax sees their mean. The model is trained by stochastic gradient descent in
numpy on a bounded sample; its temperature and the score below which a document is rejected are calibrated on the part
of the sample that training has not seen.
"""

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelake.llm.samples import fitted, labelled_sample

UNKNOWN = "und"
BUCKETS = 1 << 16
SIZES = (2, 3)
_CHUNK = 1 << 19

RESULT = T.StructType(
    [T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("accepted", T.BooleanType())]
)


def letter_table() -> np.ndarray:
    """For every code point, itself if it is a letter and else 0."""
    return np.array([i if chr(i).isalpha() else 0 for i in range(0x110000)], dtype=np.uint32)


def subwords(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all subwords of code points in which 0 is a gap, and the place where each begins.

    A subword holds a letter, and a gap only at its ends.
    """
    found, places = [], []
    for size in SIZES:
        n = len(codes) - size + 1
        if n < 1:
            continue
        inner = np.ones(n, dtype=bool)
        for i in range(1, size - 1):
            inner &= codes[i : n + i] != 0
        if size == 2:
            inner &= (codes[:n] | codes[1 : n + 1]) != 0
        at = np.flatnonzero(inner)
        hashed = np.full(len(at), size * 0x9E3779B1 & 0xFFFFFFFF, dtype=np.uint32)
        for i in range(size):
            hashed ^= codes[at + i]
            hashed *= np.uint32(0x85EBCA6B)
            hashed ^= hashed >> np.uint32(15)
        found.append((hashed >> np.uint32(16)).astype(np.int32))
        places.append(at)
    if not found:
        return np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.int64)
    return np.concatenate(found), np.concatenate(places)


@dataclass
class LanguageModel:
    """Vectors of the buckets, the softmax, and what calibration found."""

    langs: list[str]
    vectors: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    reject_below: float = 0.0
    letters: np.ndarray | None = field(default=None, repr=False, compare=False)

    def _codes(self, text: str) -> np.ndarray:
        if self.letters is None:
            self.letters = letter_table()
        raw = np.frombuffer(text.lower().encode("utf-32-le", "replace"), dtype="<u4")
        return self.letters[raw]

    def mean(self, text: str) -> np.ndarray | None:
        """The mean vector over the whole text, or None where it has no letter. Long texts are read in chunks."""
        total, count = np.zeros(self.vectors.shape[1]), 0
        codes = np.concatenate([[np.uint32(0)], self._codes(text), [np.uint32(0)]])
        if not codes.any():
            return None
        overlap = max(SIZES) - 1
        for start in range(0, len(codes), _CHUNK):
            buckets, places = subwords(codes[start : start + _CHUNK + overlap])
            own = buckets[places < _CHUNK]
            counts = np.bincount(own, minlength=len(self.vectors)) if len(own) > len(self.vectors) else None
            total += counts @ self.vectors if counts is not None else self.vectors[own].sum(axis=0, dtype=np.float64)
            count += len(own)
        return total / max(count, 1)

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float], list[bool]]:
        """Language, calibrated score and whether it is accepted."""
        means = [self.mean(text) if isinstance(text, str) else None for text in texts]
        langs, scores, accepted = [], [], []
        for mean in means:
            if mean is None or not self.langs:
                langs.append(UNKNOWN), scores.append(0.0), accepted.append(False)
                continue
            logits = (mean @ self.weights + self.bias) / self.temperature
            share = np.exp(logits - logits.max())
            share /= share.sum()
            best = int(share.argmax())
            langs.append(self.langs[best]), scores.append(float(share[best]))
            accepted.append(bool(share[best] >= self.reject_below))
        return langs, scores, accepted


def _snippets(sample: list[tuple[str, str]], random: np.random.Generator) -> list[tuple[str, str]]:
    """Every text, and pieces of it from a few words to a paragraph."""
    found = []
    for lang, text in sample:
        found.append((lang, text))
        for length in (30, 150):
            if len(text) > length:
                start = int(random.integers(0, len(text) - length))
                found.append((lang, text[start : start + length]))
    return found


def train(
    sample: list[tuple[str, str]], dims: int = 8, epochs: int = 12, rate: float = 4.0, keep: float = 0.998, seed: int = 7
) -> LanguageModel:
    """Fit the model on (lang, text) pairs.

    Every fifth text is kept out of training. The temperature is the one that makes these likeliest, and documents are
    rejected below the score that the share ``keep`` of them reaches (never above 0.5).
    """
    langs = sorted({lang for lang, _ in sample})
    random = np.random.Generator(np.random.PCG64(seed))
    vectors = random.normal(0, 1 / dims, (BUCKETS, dims)).astype(np.float32)
    model = LanguageModel(langs, vectors, np.zeros((dims, len(langs))), np.zeros(len(langs)))
    if not langs:
        return model
    number = {lang: i for i, lang in enumerate(langs)}
    shown = _snippets([x for i, x in enumerate(sample) if i % 5 or len(sample) < 25], random)
    held = _snippets(sample[::5], random)

    def features(pairs: list[tuple[str, str]]) -> list[tuple[int, np.ndarray, np.ndarray]]:
        found = []
        for lang, text in pairs:
            codes = np.concatenate([[np.uint32(0)], model._codes(text), [np.uint32(0)]])
            buckets, counts = np.unique(subwords(codes)[0], return_counts=True)
            if len(buckets):
                found.append((number[lang], buckets, (counts / counts.sum()).astype(np.float32)))
        return found

    data = features(shown)
    model.weights = random.normal(0, 0.1, model.weights.shape)
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for i in random.permutation(len(data)):
            label, buckets, share = data[i]
            mean = share @ vectors[buckets]
            logits = mean @ model.weights + model.bias
            error = np.exp(logits - logits.max())
            error /= error.sum()
            error[label] -= 1
            back = (model.weights @ error).astype(np.float32)
            model.weights -= 0.1 * step * np.outer(mean, error)
            model.bias -= 0.02 * step * error
            vectors[buckets] -= step * share[:, None] * back
    checked = features(held)
    if checked:
        logits = np.array([share @ vectors[buckets] @ model.weights + model.bias for _, buckets, share in checked])
        labels = np.array([label for label, _, _ in checked])

        def shares(temperature: float) -> np.ndarray:
            scaled = logits / temperature
            found = np.exp(scaled - scaled.max(axis=1, keepdims=True))
            return found / found.sum(axis=1, keepdims=True)

        rows = np.arange(len(labels))
        grid = np.geomspace(0.25, 4, 33)
        model.temperature = float(min(grid, key=lambda t: -np.log(shares(t)[rows, labels] + 1e-12).sum()))
        best = np.sort(shares(model.temperature).max(axis=1))
        model.reject_below = float(min(0.5, best[int((1 - keep) * len(best))]))
    return model


def fit_language_model(
    labelled: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    per_lang: int = 400,
    most_langs: int = 200,
    chars: int = 2000,
) -> LanguageModel:
    """Fit on at most ``per_lang`` rows of each of the ``most_langs`` most frequent languages, ``chars`` characters of each."""
    sample = labelled_sample(labelled, labelled, key, F.col(lang), text, per_lang, most_langs, chars)
    return fitted(sample, train, LanguageModel)


def language(model: LanguageModel, text: Column) -> Column:
    """lang, score (0 to 1) and accepted of a text, as a struct.

    The whole text counts. A null text and one without a letter are ``und`` with score 0 and not accepted; so is any
    text if the model knows no language.
    """

    @F.pandas_udf(RESULT)
    def predict(texts: pd.Series) -> pd.DataFrame:
        langs, scores, accepted = model.predict(texts.tolist())
        return pd.DataFrame({"lang": langs, "score": scores, "accepted": accepted})

    model.letters = None  # made anew by each task
    return predict(text)
