"""Toxicity by multiple-instance learning.

A document is a bag of sentences. Each sentence scores ``sigmoid(w.x + b)`` on
its words and word prefixes, and the document's score is their noisy-or,
``1 - prod(1 - p)``: one toxic sentence is enough, and none is needed in a
clean one. ``w`` and ``b`` are learnt from document labels alone, by gradient
steps on the likelihood of the noisy-or; the sentence scores then locate the
offending sentences.

The model is fitted on at most ``per_class`` labelled documents of either
class, taken in the order of a hash of their ids outside the held-out fold.
Their features are computed and counted by Spark tasks; sparse ids of a bounded
number of documents reach the driver. Every document is scored over its whole text.

Defined results: null text counts as empty and scores as one empty sentence;
a document without labels is only scored; rows that repeat an id are scored
alike; ids may be null; without any positive or any negative label all scores are the share of
positive labels (0 without labels); further columns are ignored.
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

from .common import Recent, labelled_ids, refuse_clash, small_batches, stage, text_of

FOLDS, HELD_OUT_FOLD, THRESHOLD = 3, 1, 0.7
PER_CLASS = 2500
#: A feature counts if so many documents of the sample have it.
MIN_DOCS = 5
#: It must be so many times as frequent in toxic documents.
LIFT = 3
EPOCHS, RATE, SPARSE = 300, 0.1, 0.3
SENTENCE = re.compile(r"[^.!?\n]+")
WORD = re.compile(r"[^\W\d_]+")
SCORES = "score double, worst_start int, worst_end int, worst_score double, n_offending int, offending array<struct<start:int,end:int,score:double>>"
#: Words a task remembers.
CACHE = 50_000


def word_features(word: str) -> list[int]:
    """Hashed ids of the word and of its prefixes of three to six letters."""
    names = [f"w{word}", *(f"p{word[:k]}" for k in range(3, 7) if len(word) >= k)]
    return [zlib.crc32(x.encode("utf-8", "surrogatepass")) for x in names]


def sentence_words(text: str) -> Iterator[tuple[int, int, set[str]]]:
    """Spans of the sentences that have a word, and the words."""
    for m in SENTENCE.finditer(text):
        words = set(WORD.findall(m.group().lower()))
        if words:
            yield m.start(), m.end(), words


@dataclass(frozen=True)
class Model:
    weights: dict[int, float]
    bias: float

    def word_weight(self, word: str) -> float:
        return sum(self.weights.get(f, 0.0) for f in word_features(word))


def _features(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in rows:
        out = []
        for doc_id, label, text in zip(pdf["doc_id"], pdf["label"], pdf["text"]):
            bags = [sorted({f for w in words for f in word_features(w)}) for _, _, words in sentence_words(text)] or [[]]
            out.append((doc_id, label, np.asarray([x for b in bags for x in b], np.uint32).view(np.int32), np.asarray([len(b) for b in bags], np.int32)))
        yield pd.DataFrame(out, columns=["doc_id", "label", "ids", "sizes"])


def _only(ids: np.ndarray, sizes: np.ndarray, kept: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bags without the features that aren't in ``kept`` (sorted)."""
    known = np.isin(ids, kept)
    return ids[known], np.bincount(np.repeat(np.arange(len(sizes)), sizes)[known], minlength=len(sizes)).astype(np.int32)


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    """Learns from ``labels.toxic`` of rows outside the held-out fold.

    Features that don't set toxic documents apart are dropped by a grouped
    count before anything reaches the driver.
    """
    small_batches(docs.sparkSession)
    chosen = labelled_ids(labels, "toxic", FOLDS, HELD_OUT_FOLD, per_class)
    bags = stage(
        docs.select("doc_id", text_of().alias("text"))
        .join(F.broadcast(chosen), "doc_id")  # at most 2 * per_class ids
        .select("doc_id", "label", "text")
        .mapInPandas(_features, "doc_id long, label int, ids array<int>, sizes array<int>")
        .dropDuplicates(["doc_id"]),
        "toxicity-bags",
    )
    size = {r["label"]: r["n"] for r in bags.groupBy("label").agg(F.count("*").alias("n")).collect()}
    positive, negative = size.get(1, 0), size.get(0, 0)
    seen = bags.select("label", F.explode(F.array_distinct("ids")).alias("id")).groupBy("id").agg(F.sum("label").alias("p"), F.count("*").alias("n"))
    telling = (F.col("p") >= MIN_DOCS) & (F.col("p") * (negative + 1) >= LIFT * (F.col("n") - F.col("p") + 1) * (positive + 1))
    kept = np.sort(seen.where(telling).select("id").toPandas()["id"].to_numpy(np.int32))

    def only(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = [_only(np.asarray(i, np.int32), np.asarray(s, np.int32), kept) for i, s in zip(pdf["ids"], pdf["sizes"])]
            yield pdf.assign(ids=[x[0] for x in got], sizes=[x[1] for x in got])

    rows = bags.mapInPandas(only, bags.schema).toPandas().sort_values("doc_id")
    return learn(list(rows["ids"]), list(rows["sizes"]), rows["label"].to_numpy(float), kept)


def learn(ids: list, sizes: list, y: np.ndarray, kept: np.ndarray) -> Model:
    """Gradient steps on the likelihood of the noisy-or over the features ``kept``
    (sorted). A word can only make a sentence likelier to be toxic, and a sparse
    penalty sets the weights of chance features to zero."""
    share = float(y.mean()) if len(y) else 0.0
    if share in (0.0, 1.0) or not len(kept):
        return Model({}, 30.0 if share == 1 else -30.0)
    flat = np.concatenate([np.asarray(x, np.int32) for x in ids])
    per_sentence = np.concatenate([np.asarray(x, np.int64) for x in sizes])
    sentence = np.repeat(np.arange(len(per_sentence), dtype=np.int32), per_sentence)
    doc = np.repeat(np.arange(len(y), dtype=np.int32), [len(x) for x in sizes])
    flat = np.searchsorted(kept, flat).astype(np.int32)
    w, b = np.zeros(len(kept)), -4.0
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for step in range(1, EPOCHS + 1):
        z = np.clip(np.bincount(sentence, w[flat], len(per_sentence)) + b, -30, 30)
        p = 1 / (1 + np.exp(-z))
        clean = np.exp(-np.bincount(doc, np.logaddexp(0, z), len(y)))  # probability of no toxic sentence
        slope = np.where(y == 1, -clean / np.maximum(1 - clean, 1e-9), 1.0)[doc] * p / len(y)
        g = np.bincount(flat, slope[sentence], len(w)) + SPARSE / len(y)
        gb = slope.sum()
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        c1, c2 = 1 - 0.9**step, 1 - 0.999**step
        w = np.maximum(w - RATE * (m / c1) / (np.sqrt(v / c2) + 1e-6), 0)
        b -= RATE * (mb / c1) / (np.sqrt(vb / c2) + 1e-6)
    return Model({int(f): float(x) for f, x in zip(kept.view(np.uint32), w) if x > 1e-3}, float(b))


def score(docs: DataFrame, model: Model, out_col: str = "_toxic") -> DataFrame:
    """Adds ``out_col`` to ``docs``, which may have no column of that name: score, the
    worst sentence's span (code points, end exclusive) and score, how many sentences
    reach THRESHOLD, and which these are (start, end, score)."""
    refuse_clash(docs, out_col)
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample

    @F.pandas_udf(SCORES)
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known = shared.value
        weight = Recent(known.word_weight, CACHE).__getitem__
        for texts in batches:
            out = []
            for text in texts:
                spans = [(s, e, known.bias + sum(map(weight, words))) for s, e, words in sentence_words(text)] or [(0, 0, known.bias)]
                z = np.clip(np.asarray([x[2] for x in spans]), -30, 30)
                p = 1 / (1 + np.exp(-z))
                k = int(z.argmax())
                found = [{"start": spans[i][0], "end": spans[i][1], "score": float(p[i])} for i in np.flatnonzero(p >= THRESHOLD)]
                out.append((float(-np.expm1(-np.logaddexp(0, z).sum())), spans[k][0], spans[k][1], float(p[k]), len(found), found))
            yield pd.DataFrame(out, columns=["score", "worst_start", "worst_end", "worst_score", "n_offending", "offending"])

    return docs.withColumn(out_col, of(text_of()))


def offending(scored: DataFrame, out_col: str = "_toxic") -> DataFrame:
    """The offending sentences of each document that ``score`` finds toxic: all that reach
    THRESHOLD, or the worst one where several milder ones make it toxic together."""
    t = F.col(out_col)
    worst = F.array(F.struct(t["worst_start"].alias("start"), t["worst_end"].alias("end"), t["worst_score"].alias("score")))
    rows = scored.where(t["score"] >= THRESHOLD).select("doc_id", text_of().alias("_text"), t["score"].alias("score"), F.explode(F.when(t["n_offending"] > 0, t["offending"]).otherwise(worst)).alias("s"))
    return rows.select("doc_id", "score", F.col("s.start").alias("start"), F.col("s.end").alias("end"), F.col("s.score").alias("sentence_score"), F.expr("substring(_text, s.start + 1, s.end - s.start)").alias("sentence"))
