"""Quality by naive Bayes support vectors.

A text is the set of its n-grams: words, and one to three neighbouring word
shapes (letters and digits by case and kind, runs collapsed, symbols as they
are; a mark tells a word that the text had before). Each n-gram's indicator is
scaled by the log ratio of its smoothed shares in the two classes, and a linear
hinge-loss model is fitted to the scaled indicators by dual coordinate descent.
A logistic curve fitted on the margins of left-out folds turns margins into
scores.

The model is fitted on at most ``per_class`` labelled documents of either class,
taken in the order of a hash of their ids outside the held-out fold. Spark tasks
compute their features; sparse ids of a bounded number of documents reach the
driver. Every document is scored over its whole text where it is read.

Defined results: null text counts as empty and scores by the bias alone; rows
that repeat an id are scored alike; with labels of one class only, or none, all
scores are the share of positive labels (0 without labels); further columns are
kept.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Recent, labelled_ids, refuse_clash, small_batches, text_of

FOLDS, HELD_OUT_FOLD, THRESHOLD = 4, 2, 0.7
PER_CLASS = 2000
#: A feature counts if so many documents of the sample have it.
MIN_DOCS = 4
SMOOTHING, COST, EPOCHS, PARTS = 1.0, 0.1, 8, 2
SHAPES = str.maketrans({c: "a" for c in "bcdefghijklmnopqrstuvwxyz"} | {c: "A" for c in "BCDEFGHIJKLMNOPQRSTUVWXYZ"} | {c: "0" for c in "123456789"})
RUN = re.compile(r"(.)\1+")
#: Words, and n-grams of shapes, that a task remembers.
CACHE = 100_000


def _hash(name: str) -> int:
    return zlib.crc32(name.encode("utf-8", "surrogatepass"))


def shape(word: str) -> str:
    word = word if word.isascii() else "".join("a" if c.islower() else "A" if c.isupper() else "0" if c.isdigit() else c for c in word)
    return RUN.sub(r"\1", word.translate(SHAPES))


class Features:
    """Feature ids of texts; remembers words, and the n-grams of shapes, which are few."""

    def __init__(self) -> None:
        self.words = Recent(lambda word: (_hash("w" + word.lower()), shape(word)), CACHE)
        self.grams = Recent(lambda g: _hash("s" + " ".join(g)), CACHE)

    def __call__(self, text: str) -> np.ndarray:
        seen: set[str] = set()
        known, grams, shapes = self.words.__getitem__, set(), []
        for w in text.split():
            shapes.append(known(w)[1] + ("=" if w in seen and len(w) > 6 else ""))
            seen.add(w)
        grams.update(zip(shapes), zip(shapes, shapes[1:]), zip(shapes, shapes[1:], shapes[2:]))
        ids = {known(w)[0] for w in seen}
        ids.update(map(self.grams.__getitem__, grams))
        return np.fromiter(ids, np.uint32, len(ids))


@dataclass(frozen=True)
class Model:
    ids: np.ndarray  # sorted
    weights: np.ndarray  # of the indicators: log-count ratio times coefficient
    bias: float
    slope: float
    shift: float

    def margins(self, docs: list[np.ndarray]) -> np.ndarray:
        out = np.full(len(docs), self.bias)
        if len(self.ids):
            for k, ids in enumerate(docs):
                at = np.minimum(np.searchsorted(self.ids, ids), len(self.ids) - 1)
                out[k] += self.weights[at[self.ids[at] == ids]].sum()
        return out

    def scores(self, docs: list[np.ndarray]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margins(docs) + self.shift, -35, 35)))


def descend(rows: list[np.ndarray], ratio: np.ndarray, y: np.ndarray, cost: np.ndarray) -> tuple[np.ndarray, float]:
    """L1-loss linear support vectors by dual coordinate descent over rows of scaled indicators."""
    w, bias, alpha, rng = np.zeros(len(ratio)), 0.0, np.zeros(len(y)), np.random.default_rng(0)
    scaled = [ratio[r] for r in rows]
    norm = np.asarray([float(x @ x) + 1.0 for x in scaled])
    for _ in range(EPOCHS):
        for i in rng.permutation(len(y)):
            r, x = rows[i], scaled[i]
            gradient = y[i] * (float(w[r] @ x) + bias) - 1
            new = min(max(alpha[i] - gradient / norm[i], 0.0), cost[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[r] += step * x  # ids within a row are distinct
                bias += step
                alpha[i] = new
    return w, bias


def _fit(rows: list[np.ndarray], size: int, y: np.ndarray) -> tuple[np.ndarray, float]:
    flat, per = np.concatenate(rows), np.repeat(y, [len(r) for r in rows])
    p, q = (SMOOTHING + np.bincount(flat[per == k], minlength=size) for k in (1, -1))
    ratio = np.log(p / p.sum()) - np.log(q / q.sum())
    weight = np.where(y == 1, len(y) / (2 * (y == 1).sum()), len(y) / (2 * (y == -1).sum()))
    w, bias = descend(rows, ratio, y, COST * weight)
    return w * ratio, bias


def _calibrate(margins: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve of likeliest labels, by Newton steps."""
    x, t = np.column_stack([margins, np.ones(len(y))]), (y + 1) / 2
    t = np.where(t == 1, (t.sum() + 1) / (t.sum() + 2), 1 / (len(t) - t.sum() + 2))
    c = np.asarray([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ c, -35, 35)))
        c = c - np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2), x.T @ (p - t))
        c = np.clip(c, -50, 50)
    return float(max(c[0], 1e-3)), float(c[1])


def learn(docs: list[np.ndarray], y: np.ndarray) -> Model:
    """``y``: 1 or 0 for each document."""
    share = float(y.mean()) if len(y) else 0.0
    if share in (0.0, 1.0):
        return Model(np.empty(0, np.uint32), np.empty(0), 0.0, 0.0, 35.0 if share else -35.0)
    ids, counts = np.unique(np.concatenate(docs), return_counts=True)
    ids = ids[counts >= min(MIN_DOCS, len(docs))]
    rows = [np.searchsorted(ids, np.intersect1d(d, ids)) for d in docs]
    sign = np.where(y == 1, 1, -1)
    part, margins = np.arange(len(y)) % PARTS, np.zeros(len(y))
    for k in range(PARTS):
        some, rest = np.flatnonzero(part != k), np.flatnonzero(part == k)
        if len(set(sign[some])) == 2:
            w, bias = _fit([rows[i] for i in some], len(ids), sign[some])
            margins[rest] = [w[rows[i]].sum() + bias for i in rest]
    w, bias = _fit(rows, len(ids), sign)
    used = np.abs(w) > 1e-9
    return Model(ids[used], w[used], bias, *_calibrate(margins, sign))


def _features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    of = Features()
    for pdf in batches:
        yield pd.DataFrame({"doc_id": pdf["doc_id"], "label": pdf["label"], "ids": [np.sort(of(t)).view(np.int32) for t in pdf["text"]]})


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    """Learns from ``labels.quality`` of rows outside the held-out fold."""
    small_batches(docs.sparkSession)
    chosen = labelled_ids(labels, "quality", FOLDS, HELD_OUT_FOLD, per_class)
    rows = (
        docs.select("doc_id", text_of().alias("text"))
        .join(F.broadcast(chosen), "doc_id")  # at most 2 * per_class ids
        .select("doc_id", "label", "text")
        .mapInPandas(_features, "doc_id long, label int, ids array<int>")
        .dropDuplicates(["doc_id"])
        .toPandas()
        .sort_values("doc_id")
    )
    return learn([np.asarray(x, np.int32).view(np.uint32) for x in rows["ids"]], rows["label"].to_numpy(int))


def score(docs: DataFrame, model: Model, text_col: str = "text", out_col: str = "_quality") -> DataFrame:
    """Adds ``out_col double``, a name that no column may have: how likely label 1 is."""
    refuse_clash(docs, out_col)
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample

    @F.pandas_udf("double")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        features = Features()
        for texts in batches:
            yield pd.Series(np.concatenate([shared.value.scores([features(t)]) for t in texts]) if len(texts) else [], dtype=float)

    return docs.withColumn(out_col, of(text_of(text_col)))
