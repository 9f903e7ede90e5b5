"""Best-fit packing of token pieces into sequences, bulk-synchronously.

1. Every text is tokenised where it is read; only texts longer than the capacity
   are cut. From here on rows are slim (ids, never tokens).
2. Pieces are range-sorted by (length, id, piece). A piece's rank among those of
   its length is its place in that sort, so a length that a third of all pieces
   share is still spread over many tasks.
3. Supersteps match the sorted pieces with the sorted gaps. Pieces of one length
   are interchangeable and so are gaps of one size, so both sorted lists are kept
   run-length encoded: at most ``capacity`` classes each, however many rows there
   are. One superstep sweeps one length, longest first: its pieces look up their
   successor, the smallest gap that holds them; conflicts are resolved by rank,
   the pieces of lowest rank taking the gaps in order; the gaps are updated, and
   the sweep repeats until no piece is left or no gap fits. What is left opens
   new sequences. The outcome is that of best-fit decreasing. The sweep over the
   classes runs on the driver; README says why it isn't a Spark job a superstep.
4. Each task places its pieces by a binary search of (length, rank) in the list of
   placements, which depends on the lengths that occur and not on the rows. It is
   broadcast in parts of whole lengths, each of a bounded size.

Defined results: a null or empty text is the closing id alone; ids may be of any
plain type, and a null id sorts first; rows that repeat an id are separate pieces; an empty table gives an empty
result; further columns are ignored.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, small_batches, stage, text_of

CAPACITY, END_ID = 4096, 1
#: Runs a task remembers; beyond, those that it hasn't met lately go.
CACHE = 150_000
#: A full stop or comma between a letter and white space: a word of its own to the tokenizer.
ENDED = re.compile(r"(?<=[a-z\u00df-\u00f6\u00f8-\u00ff])([.,])(?=[ \n])")
PIECES = "doc_id string, piece int, start long, length long, ids_crc32 long"


class Words:
    """Ids of the runs between white space, remembered as little-endian 32-bit integers."""

    def __init__(self, source: str):
        self.tokenizer = _tokenizer(source)
        self.known, self.before = {"": b""}, {}

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text.

        The tokenizer's words never cross a space or line feed, so each run between
        them is encoded once. It folds case and splits a letter from a mark, so both
        are done first where that can't change the ids: fewer runs differ.
        """
        split = [_plain(t).replace("\n", " ").split(" ") for t in texts]
        if len(self.known) > CACHE:
            self.known, self.before = {"": b""}, self.known
        new = []
        for run in set().union(*split):
            if run in self.known:
                continue
            if (old := self.before.get(run)) is None:
                new.append(run)
            else:
                self.known[run] = old
        for k in range(0, len(new), 5000):
            part = new[k : k + 5000]
            got = self.tokenizer.encode_batch_fast(part, add_special_tokens=False)
            self.known.update(zip(part, (array("I", e.ids).tobytes() for e in got)))
        of = self.known.__getitem__
        return [b"".join(map(of, runs)) for runs in split]


def _plain(text: str) -> str:
    """Lower case, and a space before a mark that ends a word, for texts in Latin-1 without special tokens."""
    if "<|" in text:
        return text
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return text
    return ENDED.sub(r" \1", text.lower())


@lru_cache(maxsize=2)
def _tokenizer(source: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallelism
    from tokenizers import Tokenizer

    return Tokenizer.from_str(source)


def _tokenised(docs: DataFrame, tokenizer_path: str, capacity: int, end_id: int, finish, returns: str, id_col: str, text_col: str) -> DataFrame:
    small_batches(docs.sparkSession)
    with open(tokenizer_path, encoding="utf-8") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())  # a fixed size
    end, step = np.asarray([end_id], "<u4").tobytes(), 4 * capacity

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = Words(shared.value)
        for pdf in batches:
            for k in range(0, len(pdf), 1000):
                out, part = [], pdf.iloc[k : k + 1000]
                for doc_id, raw in zip(part["_id"].tolist(), words.encode(part["_text"].tolist())):
                    raw += end
                    out += [finish(doc_id, i, i * capacity, raw[p : p + step]) for i, p in enumerate(range(0, len(raw), step))]
                yield pd.DataFrame(out, columns=[x.split()[0] for x in returns.split(", ")])

    # Ids travel as text: beside a null, pandas would read large ones as floating point.
    rows = docs.select(F.col(id_col).cast("string").alias("_id"), text_of(text_col).alias("_text")).mapInPandas(of, returns)
    return rows.withColumn("doc_id", F.col("doc_id").cast(docs.schema[id_col].dataType))


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Slim rows: doc_id, piece, start, length, ids_crc32."""

    def finish(doc_id: str | None, piece: int, start: int, raw: bytes) -> tuple:
        return doc_id, piece, start, len(raw) // 4, zlib.crc32(raw)

    return _tokenised(docs, tokenizer_path, capacity, end_id, finish, PIECES, id_col, text_col)


def piece_ids(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece and the ids themselves, to be joined to placements and written out."""

    def finish(doc_id: str | None, piece: int, start: int, raw: bytes) -> tuple:
        return doc_id, piece, np.frombuffer(raw, "<u4").astype(np.int32)

    return _tokenised(docs, tokenizer_path, capacity, end_id, finish, "doc_id string, piece int, ids array<int>", id_col, text_col)


def supersteps(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Placements (length, first rank, pieces, first sequence, pieces a sequence, offset).

    Pieces ``first rank + i`` go to sequence ``first sequence + i // a`` where ``a``
    is the number of pieces a sequence, at ``offset + (i % a) * length``.
    """
    out, opened = [], 0
    sizes: list[int] = []  # of the gaps there are, ascending
    gaps: dict[int, list[tuple[int, int]]] = {}  # size -> runs (first sequence, sequences)

    def add(size: int, first: int, n: int) -> None:
        if size and n:
            if size not in gaps:
                insort(sizes, size)
                gaps[size] = []
            gaps[size].append((first, n))

    def fill(length: int, size: int, rank: int, left: int, first: int, n: int) -> int:
        """Puts up to ``left`` pieces into ``n`` gaps of one size; how many went."""
        each = size // length
        whole = min(n, left // each)
        if whole:
            out.append((length, rank, whole * each, first, each, capacity - size))
            add(size - each * length, first, whole)
        rest = min(each, left - whole * each) if whole < n else 0
        if rest:
            out.append((length, rank + whole * each, rest, first + whole, rest, capacity - size))
            add(size - rest * length, first + whole, 1)
        used = whole + bool(rest)
        add(size, first + used, n - used)
        return whole * each + rest

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            k = bisect_left(sizes, length)  # the successor among the gaps
            if k == len(sizes):
                n = -(-left // (capacity // length))
                done = fill(length, capacity, rank, left, opened, n)
                opened += n
                rank, left = rank + done, left - done
                continue
            size = sizes.pop(k)
            for first, n in sorted(gaps.pop(size)):
                done = fill(length, size, rank, left, first, n) if left else 0
                if not done:
                    add(size, first, n)
                rank, left = rank + done, left - done
    return out


def place(rows: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to pieces with doc_id, piece and length (1 to ``capacity``)."""
    spark = rows.sparkSession
    names = rows.columns
    rows = stage(rows, "pieces")
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    row = F.monotonically_increasing_id()
    ranked = stage(
        rows.repartitionByRange(parts, "length", "doc_id", "piece")
        .sortWithinPartitions("length", "doc_id", "piece")
        .withColumn("_part", F.shiftright(row, 33).cast("int"))
        .withColumn("_row", row.bitwiseAND(F.lit((1 << 33) - 1))),
        "pieces-ranked",
    )
    runs = ranked.groupBy("_part", "length").agg(F.count("*").alias("n"), F.min("_row").alias("first")).toPandas()  # at most capacity + partitions rows
    runs = runs.sort_values(["length", "_part"], kind="stable")
    before = runs.groupby("length")["n"].cumsum() - runs["n"]
    shift = dict(zip(zip(runs["_part"].tolist(), runs["length"].tolist()), (before - runs["first"]).tolist()))
    plan = np.asarray(supersteps({int(k): int(v) for k, v in runs.groupby("length")["n"].sum().items()}, capacity), np.int64).reshape(-1, 6)
    plan = plan[np.lexsort((plan[:, 1], plan[:, 0]))]
    kind = ranked.schema["doc_id"].dataType
    schema = ", ".join(f"{n} {'string' if n == 'doc_id' else ranked.schema[n].dataType.simpleString()}" for n in names)

    def placed(plan: np.ndarray) -> DataFrame:
        shared = spark.sparkContext.broadcast((shift, plan))

        def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            shift, plan = shared.value
            key = plan[:, 0] << 44 | plan[:, 1]
            for pdf in batches:
                length = pdf["length"].to_numpy(np.int64)
                rank = pdf["_row"].to_numpy(np.int64) + np.fromiter((shift[k] for k in zip(pdf["_part"].tolist(), length.tolist())), np.int64, len(pdf))
                _, first_rank, _, first, each, offset = plan[np.searchsorted(key, length << 44 | rank, "right") - 1].T
                i = rank - first_rank
                pdf = pdf.assign(sequence_id=first + i // each, offset=offset + i % each * length)
                yield pdf.drop(columns=["_part", "_row"])

        some = ranked if not len(plan) else ranked.where(F.col("length").between(int(plan[0, 0]), int(plan[-1, 0])))
        out = some.withColumn("doc_id", F.col("doc_id").cast("string")).mapInPandas(of, f"{schema}, sequence_id long, offset long")
        return out.withColumn("doc_id", F.col("doc_id").cast(kind))

    return reduce(DataFrame.unionByName, map(placed, _parts(plan, BROADCAST_BYTES)))


def _parts(plan: np.ndarray, most: int) -> list[np.ndarray]:
    """The plan, sorted by length, in runs of whole lengths of about ``most`` bytes: each is broadcast to the rows of its lengths."""
    cuts, start = [], 0
    for k in np.flatnonzero(np.diff(plan[:, 0])) + 1:
        if plan[start:k].nbytes >= most:
            cuts.append(k)
            start = k
    return np.split(plan, cuts)


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Where each piece of each document goes."""
    return place(pieces(docs, tokenizer_path, capacity, end_id, id_col, text_col), capacity)


def sequences(placed: DataFrame, ids: DataFrame) -> DataFrame:
    """sequence_id and its ids in order (at most the capacity of them)."""
    return (
        placed.join(ids, ["doc_id", "piece"])
        .groupBy("sequence_id")
        .agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("_parts"))
        .select("sequence_id", F.flatten("_parts.ids").alias("ids"))
    )
