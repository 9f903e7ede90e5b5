"""Document fingerprints: invertible Bloom lookup sketches of paragraphs.

A text's paragraphs (sentences of a line, at most ``LONGEST`` code points each;
a repeated one counts by its occurrence) have 64-bit digests. A sketch adds each
digest to three cells, one in each third of the sketch; a cell holds a count, the
exclusive or of its digests and that of their check values. The sketches of two
versions subtract cell by cell, and peeling recovers the digests in which they
differ: a cell that holds one digest gives it up, which empties others. If cells
remain, the versions are sketched again ``GROW`` times larger. Likeness is the
share of paragraphs in common: shared / (shared + differing).

A document meets the next one in a task: rows are dealt by ranges of their id
and sorted there, and the first row of each range also goes, as a guest, to the
range before it (the very first one to the last range). So texts shuffle once,
and no window runs over the whole table.

Defined results: null and empty texts have no paragraphs, and two such texts are
alike (1); null ids sort first; rows with equal ids are ordered by their texts;
a single row is its own next; an empty table gives an empty result; further
columns are ignored by ``compare_next`` and kept by ``fingerprint``.
"""

from __future__ import annotations

import base64
import hashlib
import json
import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import refuse_clash, small_batches, text_of

#: Cells of a fingerprint, and how much larger each retry is.
CELLS, GROW = 24, 4
LONGEST = 200
PARAGRAPH = re.compile(rf"[^.!?\n]{{1,{LONGEST}}}[.!?\n]*|[.!?\n]+")
#: Documents sketched and peeled together.
TOGETHER = 400
RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def digests(text: str) -> np.ndarray:
    """Distinct 64-bit digests of the paragraphs, repeated ones by their occurrence."""
    times: dict[str, int] = {}
    out = set()
    for p in PARAGRAPH.findall(text):
        k = times[p] = times.get(p, -1) + 1
        out.add(xxhash.xxh3_64_intdigest(p, seed=k))
    return np.fromiter(out, np.uint64, len(out))


def _mix(x: np.ndarray, salt: int) -> np.ndarray:
    x = (x ^ np.uint64(salt)) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class Sketches:
    """The sketches of several texts side by side; ``cells`` each."""

    def __init__(self, doc: np.ndarray, keys: np.ndarray, docs: int, cells: int):
        self.docs, self.cells = docs, cells
        self.count = np.zeros(docs * cells, np.int64)
        self.keys = np.zeros(docs * cells, np.uint64)
        self.checks = np.zeros(docs * cells, np.uint64)
        self.put(doc, keys, np.ones(len(keys), np.int64))

    def put(self, doc: np.ndarray, keys: np.ndarray, sign: np.ndarray) -> None:
        third, check = self.cells // 3, _mix(keys, 9)
        for j in range(3):
            at = doc * self.cells + j * third + (_mix(keys, j + 1) % np.uint64(third)).astype(np.int64)
            np.add.at(self.count, at, sign)
            np.bitwise_xor.at(self.keys, at, keys)
            np.bitwise_xor.at(self.checks, at, check)

    def minus(self, other: Sketches) -> Sketches:
        out = object.__new__(Sketches)
        out.docs, out.cells = self.docs, self.cells
        out.count, out.keys, out.checks = self.count - other.count, self.keys ^ other.keys, self.checks ^ other.checks
        return out

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Recovered (doc, digest, sign), and which texts came out whole. Empties the cells."""
        third, got = self.cells // 3, []
        cells = np.flatnonzero(self.count)
        while len(cells):
            pure = cells[(np.abs(self.count[cells]) == 1) & (self.checks[cells] == _mix(self.keys[cells], 9))]
            keys, doc, j = self.keys[pure], pure // self.cells, pure % self.cells // third
            own = np.zeros(len(pure), bool)
            for k in range(3):
                own |= (j == k) & ((_mix(keys, k + 1) % np.uint64(third)).astype(np.int64) == pure % third)
            doc, keys, sign = doc[own], keys[own], self.count[pure[own]]
            order = np.lexsort((keys, doc))
            doc, keys, sign = doc[order], keys[order], sign[order]
            if not len(doc):
                break
            first = np.r_[True, (doc[1:] != doc[:-1]) | (keys[1:] != keys[:-1])]
            doc, keys, sign = doc[first], keys[first], sign[first]
            self.put(doc, keys, -sign)
            got.append((doc, keys, sign))
            cells = np.flatnonzero(self.count)
        left = (self.count != 0) | (self.keys != 0) | (self.checks != 0)
        whole = ~left.reshape(self.docs, self.cells).any(axis=1)
        if not got:
            return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64), whole
        return *(np.concatenate(x) for x in zip(*got)), whole

    def strings(self) -> list[str]:
        raw = np.zeros(self.docs * self.cells, [("count", "<i4"), ("keys", "<u8"), ("checks", "<u4")])
        raw["count"], raw["keys"], raw["checks"] = self.count, self.keys, self.checks & np.uint64(0xFFFFFFFF)
        size, data = self.cells * raw.itemsize, raw.tobytes()
        return [base64.b64encode(data[k : k + size]).decode() for k in range(0, len(data), size)]


def _flat(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    doc = np.repeat(np.arange(len(sets)), np.fromiter(map(len, sets), np.int64, len(sets)))
    return doc, np.concatenate(sets) if sets else np.empty(0, np.uint64)


def sketch(sets: list[np.ndarray], cells: int = CELLS) -> Sketches:
    return Sketches(*_flat(sets), len(sets), cells)


def differing(a: list[np.ndarray], b: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each pair of digest sets, the digests only in the first and only in the second."""
    out: list = [None] * len(a)
    todo, cells = list(range(len(a))), CELLS
    while todo:
        doc, keys, sign, whole = sketch([a[i] for i in todo], cells).minus(sketch([b[i] for i in todo], cells)).peel()
        order = np.argsort(doc, kind="stable")
        ends = np.searchsorted(doc[order], np.arange(1, len(todo)))
        keys, sign = np.split(keys[order], ends), np.split(sign[order], ends)
        rest = []
        for i, k, s, ok in zip(todo, keys, sign, whole):
            if ok:
                out[i] = k[s > 0], k[s < 0]
            else:
                rest.append(i)
        todo, cells = rest, cells * GROW
    return out


def likeness(a: list[np.ndarray], b: list[np.ndarray]) -> list[float]:
    out = []
    for x, y, (only_x, only_y) in zip(a, b, differing(a, b)):
        apart, total = len(only_x) + len(only_y), len(x) + len(y)
        out.append((total - apart) / (total + apart) if total else 1.0)
    return out


def fingerprint(docs: DataFrame, text_col: str = "text", out_col: str = "_fingerprint") -> DataFrame:
    """Adds ``out_col string``, a name that no column may have: the sketch of CELLS cells."""
    refuse_clash(docs, out_col)
    small_batches(docs.sparkSession)

    @F.pandas_udf("string")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(sketch([digests(t) for t in texts]).strings(), dtype=object)

    return docs.withColumn(out_col, of(text_of(text_col)))


def edited(text: str, after: str) -> str:
    """The last half of the code points gives way to the first as many of the next text."""
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


def _compare(ids: list, texts: list[str], last: str) -> pd.DataFrame:
    after = [*texts[1:], last]
    changed = [edited(t, a) for t, a in zip(texts, after)]
    own = [digests(t) for t in [*texts, last]]
    new = [digests(t) for t in changed]
    return pd.DataFrame({
        "doc_id": ids,
        "n_chars": np.fromiter(map(len, texts), np.int64, len(texts)),
        "edited_sha256": [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in changed],
        "fingerprint": sketch(own[:-1]).strings(),
        "edited_fingerprint": sketch(new).strings(),
        "near_edited": likeness(own[:-1], new),
        "near_next": likeness(own[:-1], own[1:]),
    })


def _in_order(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by id, the guest last; each but the last of a run waits for the next one's text."""
    ids: list = []
    texts: list[str] = []
    for pdf in batches:
        for doc_id, text in zip(pdf["_id"].tolist(), pdf["_text"].tolist()):
            if len(ids) == TOGETHER:
                yield _compare(ids, texts, text)
                ids, texts = [], []
            ids.append(doc_id)
            texts.append(text)
    if len(ids) > 1:
        yield _compare(ids[:-1], texts[:-1], texts[-1])


def _range_of(value: Column, bounds: list[int]) -> Column:
    """How many of the sorted ``bounds`` are at most ``value``, found in two steps of about their root; 0 for null.
    The bounds are one literal, however many there are."""
    if not bounds:
        return F.lit(0)
    wide = math.isqrt(len(bounds)) + 1
    groups = F.from_json(F.lit(json.dumps([bounds[k : k + wide] for k in range(0, len(bounds), wide)])), "array<array<bigint>>")
    group = F.size(F.filter(groups, lambda g: g[0] <= value))
    inner = F.size(F.filter(F.get(groups, group - 1), lambda b: b <= value))
    return F.when(value >= bounds[0], (group - 1) * wide + inner).otherwise(0).cast("int")


def compare_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document with its edited text and the next document; columns as in RESULT."""
    spark = docs.sparkSession
    small_batches(spark)
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), text_of(text_col).alias("_text"))
    bounds = rows.approxQuantile("_id", [k / parts for k in range(1, parts)], 0.2 / parts) if parts > 1 else []
    bounds = sorted({int(b) for b in bounds})
    rows = rows.withColumn("_part", _range_of(F.col("_id"), bounds))
    # Ids of the first rows only: one a range, so as many as there are partitions.
    firsts = sorted((r["_part"], r["_nulls"], r["first"]) for r in rows.groupBy("_part").agg(F.min("_id").alias("first"), F.count_if(F.col("_id").isNull()).alias("_nulls")).collect())
    if not firsts:
        return spark.createDataFrame([], RESULT)
    heads = spark.createDataFrame([(None if nulls else first, firsts[k - 1][0]) for k, (_, nulls, first) in enumerate(firsts)], "_first long, _to int")
    guests = rows.join(F.broadcast(heads), F.col("_id").eqNullSafe(F.col("_first"))).groupBy("_id", "_to").agg(F.min("_text").alias("_text"))
    return (
        rows.withColumn("_guest", F.lit(0))
        .unionByName(guests.select("_id", "_text", F.col("_to").alias("_part"), F.lit(1).alias("_guest")))
        .repartitionById(parts, F.col("_part"))
        .sortWithinPartitions("_guest", F.col("_id").asc_nulls_first(), "_text")
        # Ids travel as text: beside a null, pandas would read large ones as floating point.
        .select(F.col("_id").cast("string").alias("_id"), "_text")
        .mapInPandas(_in_order, RESULT.replace("doc_id long", "doc_id string"))
        .withColumn("doc_id", F.col("doc_id").cast("long"))
    )
