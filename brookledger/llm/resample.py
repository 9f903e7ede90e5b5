"""Importance resampling of documents towards a target collection, over partition-local word tries.

1. A task folds its texts into a trie: a node is a run of words, and holds how often
   it was met and the CRC-32 of its bytes so far, which a further word carries on.
   A trie that outgrows its bound adds its counts to the task's bucket totals, one
   number a bucket, and starts anew: nothing is left out and memory stays bounded.
2. The bucket totals of the tasks are added up in a grouped sum. The totals of both
   collections are as many numbers as there are buckets; from them come the gains.
3. A second pass walks each text down a trie whose nodes carry their bucket's gain; the
   weight of a document is what its runs gain together.
4. Documents of enough words get Gumbel noise from a hash of their id, are range-sorted
   by score, and those of the first places are drawn.

Defined results: words are runs of digits, letters and everything beyond ASCII, with
A-Z in lower case; a null text has no words; a null id counts as the empty string in the hash and
is last among equal scores; rows that repeat an id are documents of their own; texts of
any length are walked in pieces that end between words; an empty collection has no
counts; further columns are ignored by ``weigh`` and ``decide`` and kept by ``draw``.
"""

from __future__ import annotations

import math
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, numbered, small_batches, stage

RUN, BUCKETS, SEED = 1, 10_000, 2024
#: Documents of fewer words aren't drawn; of the others so many of a hundred are.
LEAST_WORDS, PERCENT = 20, 10
#: Nodes and bytes of words of a trie, and bytes of a text that are walked at once.
NODES, NODE_BYTES, PIECE = 200_000, 32 << 20, 1 << 20
#: Each byte in lower case, or a space where it's no part of a word. Bytes beyond ASCII are.
FOLD = bytes(b if chr(b).isalnum() or b > 127 else 32 for b in range(256)).lower()


class Words(dict):
    """The first level of a trie: word -> node."""

    def __init__(self, trie: Trie):
        self.trie = trie

    def __missing__(self, word: bytes) -> int:
        node = self[word] = self.trie.node(zlib.crc32(word))
        if self.trie.most > 1:
            self.trie.spelt[node] = word
        self.trie.size += len(word)
        return node


class Trie:
    """Runs of up to ``most`` words. Nodes are numbers; ``crc`` is the state of each."""

    def __init__(self, most: int):
        self.most = most
        self.clear()

    def clear(self) -> None:
        self.words, self.deeper = Words(self), {}  # deeper: node << 32 | node of the next word -> node
        self.spelt: dict[int, bytes] = {}
        self.crc, self.size = array("I"), 0

    def node(self, crc: int) -> int:
        self.crc.append(crc)
        return len(self.crc) - 1

    def full(self) -> bool:
        return len(self.crc) > NODES or self.size > NODE_BYTES

    def walk(self, words: list[bytes], carried: int) -> Iterator[np.ndarray]:
        """The nodes of all runs, by length, but for those that lie within the first ``carried`` words."""
        ids = at = np.fromiter(map(self.words.__getitem__, words), np.int64, len(words))
        yield ids[carried:]
        for k in range(1, self.most):
            if len(at) < 2:
                return
            keys, back = np.unique(at[:-1] << 32 | ids[k:], return_inverse=True)
            at = np.fromiter(map(self._step, keys.tolist()), np.int64, len(keys))[back]
            yield at[max(0, carried - k) :]

    def _step(self, key: int) -> int:
        node = self.deeper.get(key)
        if node is None:
            node = self.deeper[key] = self.node(zlib.crc32(self.spelt[key & 0xFFFFFFFF], zlib.crc32(b" ", self.crc[key >> 32])))
        return node


def pieces(raw: bytes | None) -> Iterator[list[bytes]]:
    """The words of a text, in runs of about ``PIECE`` bytes."""
    text, start = (raw or b"").translate(FOLD), 0
    while start < len(text):
        end = text.find(b" ", start + PIECE)
        end = len(text) if end < 0 else end
        yield text[start:end].split()
        start = end


def walked(trie: Trie, raw: bytes | None) -> Iterator[tuple[int, np.ndarray]]:
    """How many words each piece of a text has, and the nodes of the runs that end in it."""
    tail: list[bytes] = []
    for words in pieces(raw):
        yield len(words), np.concatenate([np.empty(0, np.int64), *trie.walk(tail + words, len(tail))])
        tail = (tail + words)[-(trie.most - 1) :] if trie.most > 1 else []


def totals(docs: DataFrame, run: int = RUN, buckets: int = BUCKETS, text_col: str = "text") -> DataFrame:
    """_bucket and _n, the runs of words that fall on it in all texts."""
    small_batches(docs.sparkSession)

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trie, sums = Trie(run), np.zeros(buckets, np.int64)
        held: list[np.ndarray] = []

        def settle() -> None:
            """Counts of the nodes met since the last time, to the totals of their buckets."""
            if held:
                counts = np.bincount(np.concatenate(held), minlength=len(trie.crc))
                np.add.at(sums, np.asarray(trie.crc, np.int64) % buckets, counts)
                held.clear()

        for pdf in batches:
            met = 0
            for raw in pdf["_text"]:
                for _, nodes in walked(trie, raw):
                    held.append(nodes)
                    met += len(nodes)
                    if met > NODES or trie.full():
                        settle()
                        met = 0
                    if trie.full():
                        trie.clear()
            settle()
        at = np.flatnonzero(sums)
        yield pd.DataFrame({"_bucket": at.astype(np.int32), "_n": sums[at]})

    rows = docs.select(F.col(text_col).cast("string").cast("binary").alias("_text")).mapInPandas(of, "_bucket int, _n long")
    return rows.groupBy("_bucket").agg(F.sum("_n").alias("_n"))


def gains(docs: DataFrame, target: DataFrame, run: int = RUN, buckets: int = BUCKETS, text_col: str = "text", target_text_col: str = "text") -> np.ndarray:
    """What a run of each bucket adds to a weight: 1000 times the logarithm of how much likelier it is in ``target``, rounded down."""
    s, t = np.zeros(buckets), np.zeros(buckets)
    for sums, rows in ((s, totals(docs, run, buckets, text_col)), (t, totals(target, run, buckets, target_text_col))):
        got = rows.toPandas()  # no more rows than buckets
        sums[got["_bucket"]] = got["_n"]
    both = zip((t + 1) * (s.sum() + buckets), (s + 1) * (t.sum() + buckets))
    return np.asarray([math.floor(1000 * math.log(a / b)) for a, b in both], np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, run: int = RUN, text_col: str = "text", out_col: str = "_weight") -> DataFrame:
    """Adds ``out_col``: n_words, n_features and weight."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(gain)  # a number a bucket

    @F.pandas_udf("n_words long, n_features long, weight long")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        gain, trie, on, known = shared.value, Trie(run), np.empty(1024, np.int64), 0  # on: gains of the nodes, as far as they are known
        for batch in batches:
            out = np.zeros((len(batch), 3), np.int64)
            for k, raw in enumerate(batch):
                for words, nodes in walked(trie, raw):
                    if len(on) < len(trie.crc):
                        on = np.resize(on, 2 * len(trie.crc))
                    on[known : len(trie.crc)] = gain[np.asarray(trie.crc[known:], np.int64) % len(gain)]
                    known = len(trie.crc)
                    out[k] += words, len(nodes), on[nodes].sum()
                    if trie.full():
                        trie.clear()
                        known = 0
            yield pd.DataFrame(out, columns=["n_words", "n_features", "weight"])

    return docs.withColumn(out_col, of(F.col(text_col).cast("string").cast("binary")))


def noise(id_col: str, seed: int = SEED) -> Column:
    """1000 times Gumbel noise from the id, rounded down."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def decide(
    docs: DataFrame, target: DataFrame, run: int = RUN, buckets: int = BUCKETS, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text"
) -> DataFrame:
    """One row per row of ``docs``: id, n_features, weight, score and rank, which is null where the document isn't drawn."""
    rows = weigh(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")), gains(docs, target, run, buckets, text_col, target_text_col), run, "_text")
    rows = stage(rows.select("_id", "_weight.*").withColumn("score", F.col("weight") + noise("_id", seed)), "resample-weights")
    enough = F.col("n_words") >= least_words
    drawn = rows.where(enough).count() * percent // 100
    order = [F.desc("score"), F.asc_nulls_last("_id"), F.col("n_words")]
    ranked = numbered(rows.where(enough), order, "resample-ranks", "_place").withColumn("rank", F.when(F.col("_place") < drawn, F.col("_place") + 1)).drop("_place")
    out = ranked.unionByName(rows.where(~enough).withColumn("rank", F.lit(None).cast("long")))
    return out.select(F.col("_id").alias(id_col), "n_features", "weight", "score", "rank")


def draw(
    docs: DataFrame, target: DataFrame, run: int = RUN, buckets: int = BUCKETS, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text"
) -> DataFrame:
    """The rows of ``docs`` that are drawn, with all their columns. Texts don't shuffle: rows are held against the last place that is drawn.

    Of rows that can't be told apart at that place, by id and score, any may be taken."""
    out, score = fresh(docs, "_weight"), fresh(docs, "_score")
    chosen = decide(docs, target, run, buckets, percent, least_words, seed, id_col, text_col, target_text_col).where("rank IS NOT NULL")
    last = chosen.orderBy(F.desc("rank")).limit(1).collect()
    if not last:
        return docs.limit(0)
    at, with_it = last[0], F.lit(last[0][id_col]).cast(docs.schema[id_col].dataType)
    rows = weigh(docs, gains(docs, target, run, buckets, text_col, target_text_col), run, text_col, out).where(F.col(out)["n_words"] >= least_words)
    rows = rows.withColumn(score, F.col(out)["weight"] + noise(id_col, seed))
    before = F.coalesce(F.col(id_col) < with_it, F.col(id_col).isNotNull() & F.lit(at[id_col] is None))
    same = (F.col(score) == at["score"]) & F.col(id_col).eqNullSafe(with_it)
    left = chosen.where((F.col("score") == at["score"]) & F.col(id_col).eqNullSafe(with_it)).count()
    return rows.where((F.col(score) > at["score"]) | (F.col(score) == at["score"]) & before).unionByName(rows.where(same).limit(left)).drop(out, score)
