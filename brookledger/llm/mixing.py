"""Mixing sources to target weights, block by block.

1. The words of a source, its documents in the order of their ids, are one stream that is cut
   into blocks of ``BLOCK`` words; the last may be shorter. A document has its place in
   the stream from a range sort and running sums by range, so one source with
   a third of all words is dealt over as many tasks as others together.
2. Targets share the words of all sources by weight and stop at ``MOST`` times a source's size; what
   they leave is shared again until no target is above. A target gives a quota of slots.
3. The output is cut into shards of ``SLOTS`` slots. Each shard draws its counts of all sources: a multinomial draw on the
   condition that the shards together meet the quotas. For that the shards are halved again
   and again, and at each half the counts are drawn from what the two have together
   (multivariate hypergeometric) with a seed of that half's own. A task draws the shards it
   is given, in any order and any number of times, with the same outcome.
4. The k-th slot that a source has, over all shards, is mapped to a block by a pseudorandom permutation of
   the source's blocks (a Feistel network with cycle walking), another one for each pass through the source: none is
   taken twice before all are taken once. The very last slot of a source is cut so that its
   words are the rounded target.
5. Slots and the pieces of documents meet in a join by source and block index.

Defined results: words are runs of anything but ASCII white space; a null text has none; sources are in the
order of code points, null last as a source of its own; rows that repeat an id are documents of their own; null
ids are last; a source without words has a target of 0; an empty table gives an empty
result; further columns are ignored. The same table gives the same mix, however it is partitioned.
What the driver holds and broadcasts is a few numbers a source, for ``MOST_SOURCES`` at most; more are refused.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, dealt, stage, text_of

WEIGHTS, MOST, SEED = (5, 2, 1), 3, 2024
#: Words of a block and slots of a shard.
BLOCK, SLOTS = 256, 1024
#: Sources whose numbers the driver brings together.
MOST_SOURCES = 500_000
#: Above so many slots numpy draws no more: they are halved in proportion, from which a draw would differ by one in ten thousand.
DRAWN = 500_000_000
ROUNDS = 4


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _once(x: np.ndarray, half: np.ndarray, key: np.ndarray, back: bool) -> np.ndarray:
    """One pass through the network over numbers of twice ``half`` bits."""
    low = (np.uint64(1) << half) - np.uint64(1)
    left, right = x >> half, x & low
    for r in reversed(range(ROUNDS)) if back else range(ROUNDS):
        salt = key + np.uint64((r + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        if back:
            left, right = right ^ (_mix(left ^ salt) & low), left
        else:
            left, right = right, left ^ (_mix(right ^ salt) & low)
    return left << half | right


def permuted(i: np.ndarray, n: np.ndarray, key: np.ndarray, back: bool = False) -> np.ndarray:
    """Where numbers ``i`` below ``n`` go in the permutation of ``key``; ``back``: where they came from."""
    x, n, key = i.astype(np.uint64), n.astype(np.uint64), key.astype(np.uint64)
    bits = np.ceil(np.log2(np.maximum(n.astype(np.float64), 2))).astype(np.uint64)
    half = (bits + np.uint64(2)) // np.uint64(2)
    out, todo = x.copy(), np.arange(len(x))
    while len(todo):
        out[todo] = _once(out[todo], half[todo], key[todo], back)
        todo = todo[out[todo] >= n[todo]]
    return out.astype(np.int64)


def keys(source: np.ndarray, epoch: np.ndarray, seed: int) -> np.ndarray:
    return _mix(_mix(_mix(np.uint64(seed) + source.astype(np.uint64)) + epoch.astype(np.uint64)))


def targets(sizes: np.ndarray, weights: np.ndarray, most: float = MOST) -> np.ndarray:
    """Shares of all sizes by weight, none above ``most`` times its size; the excess goes to the others by weight."""
    out, free, cap = np.zeros(len(sizes)), np.ones(len(sizes), bool), most * sizes.astype(np.float64)
    while free.any():
        out[free] = (float(sizes.sum()) - cap[~free].sum()) * weights[free] / weights[free].sum()
        above = free & (out > cap)
        if not above.any():
            break
        out[above] = cap[above]
        free &= ~above
    return out


@dataclass
class Quotas:
    """By source: words, blocks, slots, and the words that the last slot takes (0: its block's)."""

    size: np.ndarray
    blocks: np.ndarray
    slots: np.ndarray
    cut: np.ndarray
    block: int

    def length(self, source: np.ndarray, block: np.ndarray) -> np.ndarray:
        return np.minimum(self.block, self.size[source] - block * self.block)


def quotas(sizes: np.ndarray, target: np.ndarray, block: int, seed: int) -> Quotas:
    """Slots whose blocks have the rounded target's words, the last one cut."""
    words, n = np.floor(target + 0.5).astype(np.int64), -(-sizes // block)
    epochs, rest = np.divmod(words, np.maximum(sizes, 1))
    short = block * n - sizes  # what the last block lacks
    at = permuted(np.maximum(n - 1, 0), np.maximum(n, 1), keys(np.arange(len(n)), epochs, seed), back=True)  # its place in the pass that isn't whole
    more = -(-rest // block)
    more = np.where(at < more, -(-(rest + short) // block), more)
    cut = np.where(rest > 0, rest - ((more - 1) * block - np.where(at < more - 1, short, 0)), 0)
    return Quotas(sizes, n, epochs * n + more, cut, block)


class Shards:
    """The counts of all sources that each shard draws, and how many slots of each source the shards before it have."""

    def __init__(self, counts: np.ndarray, slots: int, seed: int):
        self.all, self.slots, self.seed, self.total = counts.astype(np.int64), slots, seed, int(counts.sum())
        self.n = -(-self.total // slots)
        self.node = lru_cache(maxsize=256)(self._node)

    def _node(self, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
        """Counts of the shards from ``low`` to before ``high``, a node of the halving, and of those before."""
        if (low, high) == (0, self.n):
            return self.all, np.zeros_like(self.all)
        up_low, up_high = self._parent(low, high)
        counts, before = self.node(up_low, up_high)
        middle = (up_low + up_high) // 2
        left = self._left(counts, (min(middle * self.slots, self.total) - up_low * self.slots), up_low, up_high)
        return (left, before) if high == middle else (counts - left, before + left)

    def _parent(self, low: int, high: int) -> tuple[int, int]:
        a, b = 0, self.n
        while True:
            middle = (a + b) // 2
            half = (a, middle) if high <= middle else (middle, b)
            if half == (low, high):
                return a, b
            a, b = half

    def _left(self, counts: np.ndarray, room: int, low: int, high: int) -> np.ndarray:
        total = int(counts.sum())
        if total <= DRAWN:
            return np.random.default_rng([self.seed, low, high]).multivariate_hypergeometric(counts, room, method="marginals")
        share = counts * (room / total)
        left = np.minimum(np.floor(share).astype(np.int64), counts)
        rest = room - int(left.sum())
        order = np.argsort(left - share, kind="stable")
        while rest > 0:  # less than one a source, but for rounding
            some = order[left[order] < counts[order]][:rest]
            left[some] += 1
            rest -= len(some)
        return left

    def shard(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        a, b = 0, self.n
        while b - a > 1:
            middle = (a + b) // 2
            a, b = (a, middle) if k < middle else (middle, b)
        return self.node(a, b)


def words_of(text: Column) -> Column:
    return F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")).cast("long")


@dataclass
class Mix:
    """What a mix is made of. ``docs``: _row, _id, _src, size, start (in its source's stream); ``sources``: a row each."""

    docs: DataFrame
    sources: DataFrame
    quotas: Quotas


def prepare(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST, block: int = BLOCK, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> Mix:
    spark = docs.sparkSession
    text = text_of(text_col)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(source_col).alias("_source"), words_of(text).alias("size"), F.xxhash64(text).alias("_hash"))
    rows = dealt(stage(rows, "mix-sizes"), [F.asc_nulls_last("_source"), F.asc_nulls_last("_id"), F.col("_hash"), F.col("size")], "mix-documents")
    sums = stage(rows.groupBy("_source").agg(F.sum("size").alias("source_size"), F.sum(F.octet_length(F.col("_source").cast("string"))).alias("_bytes")), "mix-sources")
    if (n := sums.count()) > MOST_SOURCES:
        raise ValueError(f"{n} sources are more than {MOST_SOURCES}: merge some")
    got = sums.orderBy(F.asc_nulls_last("_source")).select("source_size").toPandas()  # at most MOST_SOURCES numbers
    sizes = got["source_size"].to_numpy(np.int64)
    weight = np.resize(np.asarray(weights, np.float64), n)
    target = targets(sizes, weight, most)
    # The same order again, beside the names, which the driver needn't see.
    place = (F.row_number().over(W.orderBy(F.asc_nulls_last("_source"))) - 1).alias("_src")
    numbers = spark.createDataFrame(pd.DataFrame({"_src": np.arange(n), "target": target}), "_src long, target double")
    sources = stage(sums.select("_source", "source_size", place).join(numbers, "_src"), "mix-targets")
    # Where a document starts: what its range has of its source before it, and what the ranges before have of it.
    inside = F.coalesce(F.sum("size").over(W.partitionBy("_part", "_source").orderBy("_row").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = rows.groupBy("_part", "_source").agg(F.sum("size").alias("_n"))  # as many as ranges and sources together
    before = F.coalesce(F.sum("_n").over(W.partitionBy("_source").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    names = parts.select(F.col("_part").alias("_p"), F.col("_source").alias("_s"), before.alias("_before")).join(sources.select(F.col("_source").alias("_t"), "_src"), F.col("_s").eqNullSafe(F.col("_t"))).drop("_t")
    names = _small(stage(names, "mix-parts"))
    placed = rows.withColumn("_inside", inside).join(names, (F.col("_part") == F.col("_p")) & F.col("_source").eqNullSafe(F.col("_s")))
    row = F.shiftleft(F.col("_part").cast("long"), 33) + F.col("_row")
    return Mix(stage(placed.select(row.alias("_row"), "_id", "_src", "size", (F.col("_inside") + F.col("_before")).alias("start")), "mix-placed"), sources, quotas(sizes, target, block, seed))


def _small(df: DataFrame) -> DataFrame:
    """Broadcast if its size, checked, is within the bound."""
    size = df.agg(F.sum(F.lit(32) + F.coalesce(F.octet_length(F.col("_s").cast("string")), F.lit(0)))).first()[0] or 0
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def slots(spark: SparkSession, q: Quotas, per_shard: int = SLOTS, seed: int = SEED) -> DataFrame:
    """shard, position (from 0), _src, epoch, _block and took, the words taken from the block's start."""
    n = -(-int(q.slots.sum()) // per_shard)
    shared = spark.sparkContext.broadcast(q)  # four numbers a source

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        q = shared.value
        shards = Shards(q.slots, per_shard, seed)
        for pdf in batches:
            for k in pdf["id"].tolist():
                counts, before = shards.shard(k)
                src = np.repeat(np.arange(len(counts)), counts)
                nth = np.arange(len(src)) - np.repeat(np.cumsum(counts) - counts, counts) + before[src]
                epoch, i = np.divmod(nth, q.blocks[src])
                block = permuted(i, q.blocks[src], keys(src, epoch, seed))
                took = q.length(src, block)
                took = np.where((nth == q.slots[src] - 1) & (q.cut[src] > 0), q.cut[src], took)
                at = np.random.default_rng([seed, 1, k]).permutation(len(src))
                yield pd.DataFrame({"shard": k, "position": at.astype(np.int32), "_src": src, "epoch": epoch.astype(np.int32), "_block": block, "took": took})

    tasks = max(1, min(n, 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    return spark.range(0, n, 1, tasks).mapInPandas(of, "shard long, position int, _src long, epoch int, _block long, took long")


def spans(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST, block: int = BLOCK, per_shard: int = SLOTS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix: shard, position, place (in the slot), the id, first_word (of the document, from 0), words and epoch."""
    mix = prepare(docs, weights, most, block, seed, id_col, text_col, source_col)
    return _met(mix, per_shard, seed).select("shard", "position", "place", F.col("_id").alias(id_col), "first_word", "words", "epoch")


def _met(mix: Mix, per_shard: int, seed: int) -> DataFrame:
    """Slots joined to the pieces of documents by source and block index; keys are blocks, so no source is hot."""
    size = mix.quotas.block
    whole = mix.docs.where("size > 0")
    first, last = F.floor(F.col("start") / size), F.floor((F.col("start") + F.col("size") - 1) / size)
    pieces = whole.withColumn("_block", F.explode(F.sequence(first, last)))
    begins = F.greatest(F.col("start"), F.col("_block") * size)
    ends = F.least(F.col("start") + F.col("size"), (F.col("_block") + 1) * size)
    pieces = pieces.select("_row", "_id", "_src", "_block", (begins - F.col("_block") * size).alias("place"), (begins - F.col("start")).alias("first_word"), (ends - begins).alias("_n"))
    # Shards look small to Spark, but each makes as many rows as it has slots: never a broadcast.
    both = slots(mix.docs.sparkSession, mix.quotas, per_shard, seed).hint("merge").join(pieces, ["_src", "_block"]).where("place < took")
    return both.withColumn("words", F.least("_n", F.col("took") - F.col("place")))


def decide(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST, block: int = BLOCK, per_shard: int = SLOTS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per row of ``docs``: id, size, source_size, target and taken, the words of it that the mix takes."""
    mix = prepare(docs, weights, most, block, seed, id_col, text_col, source_col)
    taken = _met(mix, per_shard, seed).groupBy("_row").agg(F.sum("words").alias("taken"))
    sources = F.broadcast(mix.sources.select("_src", "source_size", "target"))  # three numbers for each of MOST_SOURCES at most
    out = mix.docs.join(taken, "_row", "left").join(sources, "_src")
    return out.select(F.col("_id").alias(id_col), "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"))
