"""Toxicity by multiple-instance learning.

Only documents are labelled. A sentence's probability is a logistic function of
its words; a document's is the noisy-or of its sentences, 1 - prod(1 - p), and
the words' weights are trained through it from the documents' labels. Scored
sentences then tell where a document offends. A document's score takes p^2 / (p +
``LEAK``) of each sentence for p: much the same where a sentence offends, next to
nothing where it is as innocent as most, so that length alone makes no text toxic.

A word is a run of letters, digits and underscores, lower-cased; a sentence ends
at ., !, ? or a line break. A sentence's log-odds are a bias and the sum of its
words' weights, and a word weighs what its parts weigh: the whole word and its beginnings of
``PREFIXES`` letters, so that inflected forms share what they have in common. The
sample is bounded: at most ``per_class`` rows of each label, ``max_bytes`` a text and
``learning.TOTAL_BYTES`` a label; parts in fewer than ``MIN_TEXTS`` of its texts have no weight. Every text
is scored whole.

Defined cases: a null or empty text has no sentence and the score of one without
words; without a row of each label every text gets the share of toxic labels,
(toxic + 1) / (all + 2); empty tables give empty results; repeated rows each give
a row; columns other than id, text and label are never read.
"""

from __future__ import annotations

import math
import re
from array import array
from collections import Counter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import per_text
from .learning import sigmoid, training_rows

PER_CLASS = 2000
MAX_BYTES = 32 << 10
MIN_TEXTS = 3
PREFIXES = (3, 4, 5)
STEPS = 150
RIDGE = 0.1
#: Of the size of a doubtful sentence's probability; a plain one's is some 1e-4.
LEAK = 0.01
STOPS = ".!?\n"
#: Words and the stops between sentences.
TOKEN = re.compile(r"\w+|[.!?\n]")
#: Words whose weight a worker keeps.
KEPT = 300_000


def parts(word: str) -> list[str]:
    """The whole word, marked by a space behind it, and its beginnings."""
    return [word + " ", *(word[:n] for n in PREFIXES if len(word) >= n)]


class Model(NamedTuple):
    weights: dict[str, float]
    bias: float
    #: Score of every text where there was too little to learn from, else None.
    constant: float | None = None


class Weigher(dict):
    """Word -> weight, filled as words are met."""

    def __init__(self, model: Model):
        self.model = model
        self.update(dict.fromkeys(STOPS, math.nan))

    def __missing__(self, word: str) -> float:
        if len(self) >= KEPT:
            self.clear()
            self.update(dict.fromkeys(STOPS, math.nan))
        self[word] = weight = sum([self.model.weights.get(p, 0.0) for p in parts(word)])
        return weight


def fit_texts(texts: list[str], y: np.ndarray, weight: np.ndarray) -> Model:
    """Parts' weights by full-batch Adam on the noisy-or likelihood of the labels, with a ridge."""
    words: dict[str, int] = {}
    of_text, of_sentence, word_at = array("i"), array("i"), array("i")
    seen: Counter[str] = Counter()
    for d, text in enumerate(texts):
        tokens = TOKEN.findall(text.lower())
        of_text.append(d)
        for token in tokens:
            if token in STOPS:
                of_text.append(d)
            else:
                of_sentence.append(len(of_text) - 1)
                word_at.append(words.setdefault(token, len(words)))
        seen.update({p for w in set(tokens) for p in parts(w) if w not in STOPS})
    ids = {p: i for i, p in enumerate(sorted(p for p, n in seen.items() if n >= MIN_TEXTS))}
    pairs = np.array([(i, ids[p]) for w, i in words.items() for p in parts(w) if p in ids], np.int64).reshape(-1, 2)
    of_text, of_sentence, word_at = (np.frombuffer(a, np.int32) for a in (of_text, of_sentence, word_at))
    w, b = np.zeros(len(ids)), -6.0
    m, v = np.zeros(len(ids) + 1), np.zeros(len(ids) + 1)
    for step in range(1, STEPS + 1):
        by_word = np.bincount(pairs[:, 0], w[pairs[:, 1]], len(words))
        z = np.bincount(of_sentence, by_word[word_at], len(of_text)) + b
        odds = np.bincount(of_text, np.logaddexp(0, z), len(texts))  # -log of no sentence being toxic
        pull = weight * np.where(y == 1, -1 / np.expm1(np.clip(odds, 1e-9, 500.0)), 1.0)
        dz = sigmoid(z) * pull[of_text]
        by_word = np.bincount(word_at, dz[of_sentence], len(words))
        grad = np.append(np.bincount(pairs[:, 1], by_word[pairs[:, 0]], len(ids)) + RIDGE * w, dz.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        move = 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        w -= move[:-1]
        b -= move[-1]
    return Model({p: float(w[i]) for p, i in ids.items() if abs(w[i]) >= 1e-3}, float(b))


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", per_class: int = PER_CLASS, max_bytes: int = MAX_BYTES, id_col: str = "doc_id", text_col: str = "text") -> Model:
    clean, toxic, counts = training_rows(docs, labels, label_col, per_class, max_bytes, id_col, text_col)
    if not clean or not toxic:
        return Model({}, 0.0, (counts[1] + 1) / (sum(counts) + 2))
    y = np.array([0] * len(clean) + [1] * len(toxic))
    weight = np.where(y == 1, counts[1] / sum(counts) / (y == 1).mean(), counts[0] / sum(counts) / (y == 0).mean())
    return fit_texts(clean + toxic, y, weight)


def log_odds(tokens: list[str], weigher: Weigher) -> np.ndarray:
    """Of each sentence, those without words too: one more than there are stops."""
    weights = np.array([math.nan, *map(weigher.__getitem__, tokens)])
    starts = np.isnan(weights)
    weights[starts] = 0.0
    return np.add.reduceat(weights, np.flatnonzero(starts)) + weigher.model.bias


def score_text(text: str, weigher: Weigher) -> float:
    """The document's probability."""
    if weigher.model.constant is not None:
        return weigher.model.constant
    p = sigmoid(log_odds(TOKEN.findall(text.lower()), weigher))
    return float(-np.expm1(np.log1p(-np.minimum(p * p / (p + LEAK), 1 - 1e-12)).sum()))


def offending(text: str, weigher: Weigher, threshold: float) -> list[dict]:
    """Start, end (in characters) and score of each sentence from ``threshold`` on."""
    if weigher.model.constant is not None:
        return []
    found, at = [], 0
    for sentence in re.split(r"[.!?\n]", text):
        p = float(sigmoid(log_odds(TOKEN.findall(sentence.lower()), weigher)[0]))
        if p >= threshold:
            found.append({"start": at, "end": at + len(sentence), "score": p})
        at += len(sentence) + 1
    return found


#: The weigher of the last model a worker met, by the model's identity within the task.
_last: list[Weigher] = []


def _weigher(model: Model) -> Weigher:
    if not _last or _last[0].model is not model:
        _last[:] = [Weigher(model)]
    return _last[0]


def score(df: DataFrame, model: Model, threshold: float = 0.3, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` (all columns but the text), score and predicted (1 from the threshold on)."""
    keep = [c for c in df.columns if c != text_col] if keep is None else keep

    def run(texts: list[str]) -> dict[str, pa.Array]:
        s = np.array([score_text(t, _weigher(model)) for t in texts])
        return {"score": pa.array(s, pa.float64()), "predicted": pa.array((s >= threshold).astype(np.int32))}

    return per_text(df, run, "score double, predicted int", text_col, keep)


def locate(df: DataFrame, model: Model, threshold: float = 0.3, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` (all columns but the text) and spans: start, end (in characters) and score of each offending sentence."""
    keep = [c for c in df.columns if c != text_col] if keep is None else keep
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def run(texts: list[str]) -> dict[str, pa.Array]:
        spans = [offending(t, _weigher(model), threshold) for t in texts]
        return {"spans": pa.array(spans, kind)}

    return per_text(df, run, "spans array<struct<start:int,end:int,score:double>>", text_col, keep)
