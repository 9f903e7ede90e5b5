"""Exact dedup by two-pass Bloom filtering (DataFrame functions only).

Texts are read once for their hashes; from then on rows are slim. Pass one gives
each text a place, two bits in one 32,768-bit block of a blocked Bloom filter, and
counts the places: equal ones are added up in the task that reads them, so a task
ships one row for each text it meets, and a text that a third of all rows share is
one of them. Bits of places met more than once are kept. (Whole blocks aren't
shipped: at ``BITS_PER_ROW`` bits a row every task would send nearly the whole filter.)
Pass two probes the filter: a text both of whose bits are kept is *possibly*
repeated. Only such rows shuffle by their SHA-256; all others are known to be unique
and pass straight through. The filter never misses a repeated text, and the exact
grouping that follows removes its false positives.

A filter up to ``BROADCAST_BYTES`` is broadcast. A larger one stays sharded by block:
slim rows (hashes, never texts) are joined to it, and ``keep`` then sends every row
through the one join by hash.

Defined results: null text counts as empty; a null id sorts below all others;
of rows that repeat both id and text one is kept; an empty table gives an
empty result; further columns, whatever their names, ride along untouched.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, stage

BLOCK_BITS = 32768
BITS_PER_ROW = 16
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalised(text: Column) -> Column:
    """Lower-cases A-Z only. ``lower`` does just that where all characters are ASCII."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def _hashes(norm: Column) -> list[Column]:
    return [F.sha2(norm, 256).alias("_sha"), F.xxhash64(norm).alias("_hash")]


def _places(blocks: int) -> list[Column]:
    """The block and the two bits of ``_hash``."""
    h = F.col("_hash")
    return [
        F.pmod(h, F.lit(blocks)).alias("_block"),
        F.pmod(F.shiftrightunsigned(h, 17), F.lit(BLOCK_BITS)).alias("_bit1"),
        F.pmod(F.xxhash64(h, F.lit(1)), F.lit(BLOCK_BITS)).alias("_bit2"),
    ]


def repeated_bits(slim: DataFrame, blocks: int) -> DataFrame:
    """Pass one: (_block, _bits) with both bits of each place that at least two rows have."""
    return (
        slim.select(*_places(blocks))
        .groupBy("_block", (F.col("_bit1") * BLOCK_BITS + F.col("_bit2")).alias("_place"))
        .agg(F.count("*").alias("_n"))
        .where("_n > 1")
        .select("_block", F.explode(F.array((F.col("_place") / BLOCK_BITS).cast("long"), F.col("_place") % BLOCK_BITS)).alias("_bit"))
        .groupBy("_block")
        .agg(F.bitmap_construct_agg("_bit").alias("_bits"))
    )


def _is_set(bit: str) -> Column:
    byte = F.conv(F.hex(F.substring(F.col("_bits"), (F.col(bit) / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.call_function("shiftright", byte, (F.col(bit) % 8).cast("int")).bitwiseAND(F.lit(1)) == 1


class Filter:
    """What pass one found in rows with ``_hash``."""

    def __init__(self, slim: DataFrame, name: str):
        self.blocks = max(1, math.ceil(slim.count() * BITS_PER_ROW / BLOCK_BITS))
        self.bits = stage(repeated_bits(slim, self.blocks), name)
        self.small = self.bits.count() * BLOCK_BITS // 8 <= BROADCAST_BYTES

    def probe(self, rows: DataFrame) -> DataFrame:
        """Pass two: adds ``_maybe``, whether the row's text is possibly repeated."""
        bits = F.broadcast(self.bits) if self.small else self.bits
        rows = rows.withColumns({name: c for name, c in zip(("_block", "_bit1", "_bit2"), _places(self.blocks))}).join(bits, "_block", "left")
        return rows.withColumn("_maybe", F.coalesce(_is_set("_bit1") & _is_set("_bit2"), F.lit(False))).drop("_bits", "_block", "_bit1", "_bit2")


def decide(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, text_sha256.

    The row with the largest id stays of each group of equal texts.
    """
    slim = stage(docs.select(F.col(id_col).alias("_id"), *_hashes(normalised(F.col(text_col))), F.monotonically_increasing_id().alias("_row")), "dedup-hashes")
    probed = stage(Filter(slim, "dedup-filter").probe(slim), "dedup-probed")
    out = lambda keep, n, kept: [F.col("_id").alias(id_col), keep.alias("keep_id"), n.cast("long").alias("group_size"), kept.alias("kept"), F.col("_sha").alias("text_sha256")]
    maybe = probed.where("_maybe")
    groups = stage(  # as a table, so that the join below deals both sides anew and can split a hot text
        maybe.groupBy("_sha").agg(F.count("*").alias("_n"), F.max(F.struct(F.col("_id").isNotNull(), "_id", "_row")).alias("_best")),
        "dedup-groups",
    )
    return (
        probed.where("not _maybe")
        .select(*out(F.col("_id"), F.lit(1), F.lit(True)))
        .unionByName(
            maybe.join(groups, "_sha").select(*out(F.col("_best._id"), F.col("_n"), F.col("_row") == F.col("_best._row")))
        )
    )


def keep(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Winners are chosen among slim rows. Texts that the filter proves unique never
    shuffle; the others meet the winners by hash and id together, so the copies of
    a hot text are dealt over all tasks.
    """
    slim = stage(docs.select(F.col(id_col).alias("_id"), *_hashes(normalised(F.col(text_col)))), "dedup-hashes")
    found = Filter(slim, "dedup-filter")
    best = stage(
        (found.probe(slim).where("_maybe") if found.small else slim)
        .groupBy("_sha", "_id")
        .agg(F.count("*").alias("_same"))
        .groupBy("_sha")
        .agg(F.max(F.struct(F.col("_id").isNotNull(), "_id", "_same")).alias("_best"))
        .select(F.col("_sha").alias("_of"), F.col("_best._id").alias("_winner"), F.col("_best._same").alias("_same")),
        "dedup-winners",
    )
    rows = docs.select(F.struct(*docs.columns).alias("_doc"), F.col(id_col).alias("_id"), *_hashes(normalised(F.col(text_col))))
    rows = found.probe(rows) if found.small else rows.withColumn("_maybe", F.lit(True))
    among = lambda winners: rows.where("_maybe").join(winners, (F.col("_sha") == F.col("_of")) & F.col("_id").eqNullSafe(F.col("_winner")), "left_semi")
    kept = among(best.where("_same = 1")).select("_doc")
    if found.small:
        kept = rows.where("not _maybe").select("_doc").unionByName(kept)
    repeated = best.where("_same > 1")
    if not repeated.isEmpty():
        kept = kept.unionByName(among(repeated).dropDuplicates(["_sha"]).select("_doc"))
    return kept.select("_doc.*")
