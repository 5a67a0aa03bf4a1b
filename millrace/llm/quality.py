"""Operator 1, quality classifier: positive-unlabelled learning by the non-negative risk.

Trusted positives are rows labelled 1, the unlabelled rows those without a label; labelled zeros are
not used. The class prior of the unlabelled rows is estimated by the best bin: over the thresholds
of a first classifier of positives against unlabelled, the smallest ratio (with its confidence
bound) of the unlabelled share above to the positive share above. Then the non-negative unbiased
risk  prior * E_p[l(g)] + max(0, E_u[l(-g)] - prior * E_p[l(-g)])  with logistic loss l is
minimised by Adam; where the second term turns negative, its own gradient is ascended instead.
g is additive over quantile bins of surface features of the whole text, so 1 / (1 + exp(-g))
estimates P(label 1 | text).

Training rows are a sample by a hash of the key, bounded by `positives` and `unlabelled`.

Defined cases: null text counts as empty, which gets the score of its features (all zero). Repeated
label rows of a document: the largest label holds. No positive or no unlabelled row: score 0.5.
Rows that repeat or tie get equal scores.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import appended, share_of, text_batches

FEATURES = (
    "log_words", "word_mean", "word_sd", "upper", "digit", "symbol", "mark", "bar", "bang", "space", "breaks",
    "distinct", "top_word", "top_pair", "same_next", "repeated_lines", "line_words", "no_letter", "one_letter",
    "shouted", "capital", "entropy", "sentence_words", "mixed",
)

#: Character classes by code point below 128: upper case, digit, symbol, mark, bar, bang, space, break.
CLASSES = ("upper", "digit", "symbol", "mark", "bar", "bang", "space", "breaks")
_of = np.full(128, 255, dtype=np.uint8)
for _k, _chars in enumerate(("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "#$%&*+<=>@[]^_`{}~\\/", ".,;:'\"()-?", "|", "!", " \t", "\n\r\x0b\x0c")):
    _of[[ord(c) for c in _chars]] = _k


def features_of(text: str | None) -> list[float]:
    """The FEATURES of one whole text."""
    if not text:
        return [0.0] * len(FEATURES)
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    n = len(raw)
    counts = np.bincount(raw, minlength=256)
    kinds = np.bincount(_of[raw[raw < 128]], minlength=256)[: len(CLASSES)]
    p = counts[counts > 0] / n
    words = text.split()
    m = max(1, len(words))
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) if words else np.zeros(1)
    seen = Counter(words)
    pairs = Counter(pairwise(words))
    lines = [x for x in text.split("\n") if x.strip()]
    stops = sum(1 for w in words if w[-1] in ".!?")
    bare = [w.strip("#$%&*!.,|") for w in words]
    return [
        float(np.log1p(len(words))), float(lengths.mean()), float(lengths.std()), kinds[0] / n, kinds[1] / n, kinds[2] / n, kinds[3] / n, kinds[4] / n,
        kinds[5] / n, kinds[6] / n, kinds[7] / n, len(seen) / m, max(seen.values(), default=0) / m, max(pairs.values(), default=0) / m,
        sum(a == b for a, b in pairwise(words)) / m, 1 - len(set(lines)) / max(1, len(lines)), m / max(1, len(lines)), sum(not w for w in bare) / m,
        sum(len(w) == 1 for w in bare) / m, sum(len(w) > 1 and w.isupper() for w in bare) / m, sum(w[:1].isupper() for w in bare) / m, float(-(p * np.log2(p)).sum()),
        m / max(1, stops), sum(len(w) != len(b) for w, b in zip(words, bare, strict=True)) / m,
    ]


class Model:
    """Quantile bins of each feature and a weight for each bin; prior: the estimated class prior."""

    def __init__(self, edges: list[np.ndarray], weights: np.ndarray, prior: float):
        self.edges, self.weights, self.prior = edges, weights, prior

    def score(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(one_hot(x, self.edges) @ self.weights)


def one_hot(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """The bins as 0/1 columns, then a constant."""
    out = np.zeros((len(x), sum(len(e) + 1 for e in edges) + 1), dtype=np.float32)
    out[:, -1] = 1
    at = 0
    for k, e in enumerate(edges):
        out[np.arange(len(x)), at + np.searchsorted(e, x[:, k], side="right")] = 1
        at += len(e) + 1
    return out


def adam(gradient, size: int, steps: int, rate: float = 0.05, decay: float = 1e-3) -> np.ndarray:
    w, m, v = np.zeros(size), np.zeros(size), np.zeros(size)
    for t in range(1, steps + 1):
        g = gradient(w) + decay * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def times(a: np.ndarray, v: np.ndarray) -> np.ndarray:
    """a @ v in the precision of a, so that a large a isn't converted in each step."""
    return a @ v.astype(a.dtype)


def best_bin(p: np.ndarray, u: np.ndarray, sure: float = 0.1) -> float:
    """The class prior of the unlabelled rows, from the scores of positives and unlabelled rows."""
    at = np.sort(np.concatenate([p, u]))
    share_p = 1 - np.searchsorted(np.sort(p), at, side="left") / len(p)
    share_u = 1 - np.searchsorted(np.sort(u), at, side="left") / len(u)
    bound = np.sqrt(np.log(4 / sure) / 2 / len(u)) + np.sqrt(np.log(4 / sure) / 2 / len(p))
    ok = share_p > 0.05
    best = int(np.argmin(np.where(ok, (share_u + bound) / np.maximum(share_p, 1e-9), np.inf)))
    return float(np.clip(share_u[best] / share_p[best], 0.01, 0.99))


def nn_gradient(p: np.ndarray, u: np.ndarray, prior: float):
    """The gradient of the non-negative risk with logistic loss."""

    def gradient(w: np.ndarray) -> np.ndarray:
        zp, zu = times(p, w), times(u, w)
        sp, su = sigmoid(zp), sigmoid(zu)
        positive = times(p.T, (sp - 1) / len(p)) * prior
        rest = np.logaddexp(0, np.clip(zu, -30, 30)).mean() - prior * np.logaddexp(0, np.clip(zp, -30, 30)).mean()
        negative = times(u.T, su / len(u)) - prior * times(p.T, sp / len(p))
        return positive + negative if rest >= 0 else -negative

    return gradient


def fit_arrays(p: np.ndarray, u: np.ndarray, bins: int = 16, steps: int = 3000, decay: float = 1e-4) -> Model:
    """p, u: feature rows of positives and of unlabelled rows."""
    if not len(p) or not len(u):
        return Model([np.zeros(0)] * len(FEATURES), np.zeros(len(FEATURES) + 1), 0.5)
    both = np.concatenate([p, u])
    edges = [np.unique(np.quantile(both[:, k], np.linspace(0, 1, bins + 1)[1:-1])) for k in range(both.shape[1])]
    hp, hu = one_hot(p, edges), one_hot(u, edges)

    def apart(a: np.ndarray, b: np.ndarray):
        return lambda w: 0.5 * (times(a.T, (sigmoid(times(a, w)) - 1) / len(a)) + times(b.T, sigmoid(times(b, w)) / len(b)))

    # the prior from rows that the first classifier hasn't seen: each half is scored by the other's
    own_p, own_u = np.zeros(len(hp)), np.zeros(len(hu))
    for k in (0, 1):
        if len(hp) > 1 and len(hu) > 1:
            first = adam(apart(hp[k::2], hu[k::2]), hp.shape[1], steps // 2, decay=decay)
            own_p[1 - k :: 2], own_u[1 - k :: 2] = hp[1 - k :: 2] @ first, hu[1 - k :: 2] @ first
    prior = best_bin(own_p, own_u)
    return Model(edges, adam(nn_gradient(hp, hu, prior), hp.shape[1], steps, decay=decay), prior)


def sample(docs: DataFrame, chosen: Column, most: int, text: str, key: str) -> np.ndarray:
    """Feature rows of about `most` of the chosen rows, by a hash of the key."""
    text_batches(docs.sparkSession)
    docs = docs.filter(chosen)
    n = docs.count()

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"key": b["key"], "x": [features_of(t if isinstance(t, str) else None) for t in b["text"]]})

    rows = docs.filter(share_of(F.col(key), most / max(1, n), 1)).select(F.xxhash64(F.col(key), F.col(text)).alias("key"), F.col(text).alias("text"))
    got = rows.mapInPandas(features, "key long, x array<double>").toPandas().sort_values("key", kind="stable")
    return np.array(got["x"].tolist(), dtype=float).reshape(len(got), len(FEATURES))


def fit(docs: DataFrame, labels: DataFrame, allowed: Column, text: str = "text", key: str = "doc_id", label: str = "quality", positives: int = 12_000, unlabelled: int = 24_000) -> Model:
    """A model from the allowed rows of docs. Two bounded samples reach the driver, as features."""
    marks = labels.groupBy(F.col(key).alias("_key")).agg(F.max(F.col(label)).alias("_label"))
    docs = docs.filter(allowed).select(key, text)
    joined = docs.join(marks, F.col(key) == F.col("_key"), "left")
    p = sample(joined, F.coalesce(F.col("_label") == 1, F.lit(False)), positives, text, key)
    u = sample(joined, F.col("_key").isNull(), unlabelled, text, key)
    return fit_arrays(p, u)


def predict(docs: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """docs with P(label 1); no shuffle. An existing column of this name is replaced."""

    def make():
        return lambda texts: [model.score(np.array([features_of(t) for t in texts], dtype=float).reshape(len(texts), len(FEATURES))).tolist()]

    return appended(docs, [text], T.StructType([T.StructField(name, T.DoubleType())]), make)
