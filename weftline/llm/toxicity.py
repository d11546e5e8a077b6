"""Operator 4, toxicity by a classifier chain.

Categories are predicted one after another by linear (logistic) models over the same word features; each later model
also sees the earlier categories' probabilities. In training those probabilities are out-of-fold: each labelled
document's comes from models that did not see its fold. Categories before the last are labelled by a short list of
words within toxic documents, the last, toxic, by the label itself.

Features are words, and beginnings of words, that the labelled documents tie to the label most strongly, at most
FEATURES. The fit uses a bounded sample of the labelled documents (TRAIN_ROWS, distinct texts, in order of a hash);
every document is scored, whole, wherever it is.

Null and empty texts have no features and get the models' base probability; null labels are not used; without both
classes among the labels every probability is the share of the class; repeated rows get the same answer; an empty
table gives an empty result. Columns of docs pass through, whatever their names, but columns that the result names are
replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, unused

#: At most so many labelled documents are fitted, and so many word features kept.
TRAIN_ROWS = 4000
FEATURES = 256
#: A feature's log odds must lie so many standard errors from none, in at least MIN_DOCS documents.
MIN_Z = 3.5
MIN_DOCS = 3
#: Lengths of words' beginnings that are features too: inflected words share them.
PREFIXES = (5, 7)
#: Bounds of the threshold that out-of-fold predictions choose.
THRESHOLDS = (0.2, 0.9)
FOLDS = 5
RIDGE = 1.0

# Words that mark a category within toxic documents.
CATEGORIES = (
    ("insult", ("idiot", "moron", "stupid", "loser", "clown", "fool", "dumb", "imbecile")),
    ("contempt", ("trash", "scum", "worthless", "pathetic", "disgusting", "garbage", "vermin", "filth")),
)
LAST = "toxic"

_word = re.compile(r"[^\W_]+")


def features_of(text: str | None) -> set[str]:
    """The distinct words of a whole text in lower case, their beginnings (with a star), and the categories they mark."""
    words = set(_word.findall((text or "").lower()))
    found = set(words)
    for n in PREFIXES:
        found.update(w[:n] + "*" for w in words if len(w) > n)
    found.update(f"*{name}" for name, marks in CATEGORIES if not words.isdisjoint(marks))
    return found


@dataclass(frozen=True)
class Chain:
    """The fitted chain: features, and for each category its bias, feature weights and weights of earlier categories."""

    features: tuple[str, ...]
    names: tuple[str, ...]
    weights: tuple[tuple[float, ...], ...]
    threshold: float

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(x), len(self.names)))
        for k, w in enumerate(self.weights):
            out[:, k] = _sigmoid(np.column_stack([np.ones(len(x)), x, out[:, :k]]) @ np.array(w))
        return out


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


def _logistic(x: np.ndarray, y: np.ndarray, steps: int = 12) -> np.ndarray:
    """Ridge logistic regression by Newton steps; the first column is the bias and is not shrunk."""
    w = np.zeros(x.shape[1])
    if not 0 < y.sum() < len(y):
        share = (y.sum() + 0.5) / (len(y) + 1)
        w[0] = np.log(share / (1 - share))
        return w
    shrink = np.full(x.shape[1], RIDGE)
    shrink[0] = 1e-6
    for _ in range(steps):
        p = _sigmoid(x @ w)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(shrink), x.T @ (y - p) - shrink * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit_chain(words: list[set[str]], toxic: np.ndarray) -> Chain:
    """Fit on labelled documents' words. Rows are taken in the order given, which fixes the folds."""
    toxic = np.asarray(toxic, dtype=float)
    n, positive = len(words), float(toxic.sum())
    seen: dict[str, list[float]] = {}
    for own, y in zip(words, toxic):
        for w in own:
            c = seen.setdefault(w, [0.0, 0.0])
            c[int(y)] += 1
    strength = []
    for w, (clean, bad) in seen.items():
        if clean + bad >= MIN_DOCS:
            odds = np.log((bad + 0.5) / (positive - bad + 0.5)) - np.log((clean + 0.5) / (n - positive - clean + 0.5))
            z = odds / np.sqrt(1 / (bad + 0.5) + 1 / (clean + 0.5))
            if abs(z) >= MIN_Z or w.startswith("*"):
                strength.append((-abs(z), w))
    features = tuple(w for _, w in sorted(strength)[:FEATURES])
    number = {w: i for i, w in enumerate(features)}
    x = np.zeros((n, len(features)))
    for row, own in enumerate(words):
        x[row, [number[w] for w in own if w in number]] = 1.0
    labels = [toxic * np.array([f"*{name}" in own for own in words], dtype=float) for name, _ in CATEGORIES] + [toxic]
    fold = np.arange(n) % FOLDS
    ones, early, weights = np.ones((n, 1)), np.zeros((n, 0)), []
    out_of_fold = np.zeros(n)
    for y in labels:
        full = np.column_stack([ones, x, early])
        weights.append(tuple(_logistic(full, y)) if n else (0.0,) * full.shape[1])
        out_of_fold = np.zeros(n)
        for f in range(FOLDS):
            if (fold == f).any():
                out_of_fold[fold == f] = _sigmoid(full[fold == f] @ _logistic(full[fold != f], y[fold != f]))
        early = np.column_stack([early, out_of_fold])
    return Chain(features, (*[c for c, _ in CATEGORIES], LAST), tuple(weights), _threshold(out_of_fold, toxic))


def _threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The threshold of the best F1 on out-of-fold probabilities: the middle of the gap below the last one accepted."""
    if not 0 < y.sum() < len(y):
        return 0.5
    order = np.argsort(-p, kind="stable")
    hits, cuts = np.cumsum(y[order]), np.arange(1, len(y) + 1)
    f1 = 2 * hits / (cuts + y.sum())
    ends = np.append(np.diff(p[order]) != 0, True)  # ties are accepted together
    best = int(np.argmax(np.where(ends, f1, -1)))
    below = p[order][best + 1] if best + 1 < len(y) else 0.0
    return float(np.clip((p[order][best] + below) / 2, *THRESHOLDS))


def train(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "toxic", rows: int = TRAIN_ROWS) -> Chain:
    """Fit on at most rows labelled documents; only their distinct words reach the driver."""
    marked = labels.select(F.col(f"`{doc_id}`").alias("_id"), F.col(f"`{label}`").cast("int").alias("_toxic")).dropna().distinct()
    chosen = marked.orderBy(F.xxhash64("_id"), "_id", "_toxic").limit(rows)
    joined = docs.select(F.col(f"`{doc_id}`").alias("_id"), F.col(f"`{text}`").alias("_text")).join(F.broadcast(chosen), "_id")

    def listed(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            yield pd.Series([sorted(features_of(t)) for t in texts], dtype=object)

    udf = F.pandas_udf(listed, "array<string>")
    found = joined.groupBy(F.xxhash64("_text").alias("_same")).agg(F.min("_id").alias("_id"), F.max("_toxic").alias("_toxic"), F.max("_text").alias("_text"))
    # an id may stand at several texts
    found = found.orderBy(F.xxhash64("_id"), "_id", "_same").limit(rows)
    sample = found.select("_id", "_same", "_toxic", udf("_text").alias("_words")).collect()
    sample.sort(key=lambda r: (r["_id"], r["_same"]))
    return fit_chain([set(r["_words"]) for r in sample], np.array([r["_toxic"] > 0 for r in sample], dtype=float))


def score(docs: DataFrame, chain: Chain, text: str = "text") -> DataFrame:
    """docs with a probability for each category and the verdict is_toxic."""
    schema = ", ".join(f"p_{n} double" for n in chain.names) + ", is_toxic boolean"

    def scored(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        number = {w: i for i, w in enumerate(chain.features)}
        for texts in parts:
            x = np.zeros((len(texts), len(number)))
            for row, t in enumerate(texts):
                for w in features_of(t).intersection(number):
                    x[row, number[w]] = 1.0
            p = chain.probabilities(x)
            out = pd.DataFrame(p, columns=[f"p_{n}" for n in chain.names])
            out["is_toxic"] = p[:, -1] >= chain.threshold
            yield out

    own = {f"p_{n}" for n in chain.names} | {"is_toxic"}
    rest = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in own]
    small_batches(docs.sparkSession)
    (made,) = unused(docs, "tox")
    return docs.select(*rest, F.pandas_udf(scored, schema)(F.col(f"`{text}`")).alias(made)).select(*rest, f"{made}.*")
