"""Byte-level BPE encoding and decoding by DuckDB recursive queries inside each task.

A text is split by the tokenizer's pattern. The words that a worker meets for
the first time become token-position rows, one a byte; a recursive query joins
neighbouring rows to the merge table and contracts each word's leftmost pair of
least rank until no word has a pair left. Known words come from a bounded cache,
so frequent words are contracted once. Decoding joins token-position rows to the
vocabulary and aggregates their bytes in order of position.

A call holds a bounded number of rows, by bytes. Long words are contracted at many places at once, and a word that is
longer than a call takes goes through in segments that overlap: a million random letters take some 20 seconds, a million
times the same letter some 80.

No shuffle: texts are encoded where they are read. The rank file (a fixed size,
under 1 MB) is read by the driver and broadcast.

Defined results: null and empty texts have no ids and decode to no bytes; very
long texts are encoded whole; repeated rows repeat their result; an empty table
gives an empty result; ``encode`` keeps all other columns and refuses to
overwrite one; an id outside the vocabulary fails ``decode``.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of

#: Words a worker remembers; beyond, those that it hasn't met lately go.
CACHE = 300_000
#: Code points encoded, ids decoded and new words contracted at once (a longer text goes alone).
LONG, CHUNK_CHARS, CHUNK_IDS, CHUNK_WORDS = 64, 2_000_000, 400_000, 20_000
#: Rows of all steps of a call for short words, and bytes of a call for long ones; a longer word is cut.
CHUNK_ROWS, SEGMENT = 2_000_000, 1 << 17

CONTRACT = """
WITH RECURSIVE s AS (
    SELECT 0 AS step, word, pos, id FROM token_rows
    UNION ALL
    (WITH pairs AS (
        SELECT step, word, pos, id,
               CASE WHEN lead(word) OVER w = word THEN lead(id) OVER w END AS next_id,
               CASE WHEN lag(word) OVER w = word THEN lag(pos) OVER w END AS before
        FROM s WINDOW w AS (ORDER BY pos)),
    ranked AS (SELECT pairs.*, merged FROM pairs LEFT JOIN merges ON id = left_id AND next_id = right_id),
    best AS (
        SELECT word, min((merged::BIGINT << 32) | pos) AS key
        FROM ranked WHERE merged IS NOT NULL GROUP BY word)
    SELECT step + 1, word, pos, CASE WHEN pos = (key & 4294967295) THEN (key >> 32)::INT ELSE id END
    FROM ranked JOIN best USING (word) WHERE before IS DISTINCT FROM (key & 4294967295))
)
SELECT word, id
FROM s JOIN (SELECT word, max(step) AS step FROM s GROUP BY word) USING (word, step)
ORDER BY pos"""

#: The same for long words. Only the last state of each position is kept (an id of -1: gone into the token before it), and a step
#: contracts each pair whose rank is the least of the pairs that begin near it. Cells are as long as the longest
#: token that the words' bytes can make, and a token only changes through a pair beside it; so what lies beyond the next cells could reach such a pair
#: only by a token longer than any before its turn comes. Of pairs of one rank that overlap, every second one is taken, from the
#: first of them on, once that one is settled. A pair that gives rise to one of lower rank waits, and those of its rank near it
#: with it, until it is the leftmost least among more cells, as what that one makes may reach as far again. ``edges``: the cells whose neighbours are all known.
CONTRACT_LONG = """
WITH RECURSIVE s USING KEY (pos) AS (
    SELECT pos, word, id FROM token_rows
    UNION
    (WITH live AS (SELECT pos, word, id FROM recurring.s WHERE id >= 0 AND word IN (SELECT word FROM s)),
    pairs AS (
        SELECT pos, word, id, lead(id) OVER w AS next_id, lead(pos) OVER w AS next_pos,
               lag(id) OVER w AS left_of, lag(pos) OVER w AS left_pos, lead(id, 2) OVER w AS right_of
        FROM live WINDOW w AS (PARTITION BY word ORDER BY pos)),
    ranked AS (
        SELECT pairs.*, merged, pos // {cell} AS cell, (merged::BIGINT << 40) | pos AS key, lag(next_pos) OVER w = pos AND lag(merged) OVER w = merged AS chained
        FROM pairs JOIN merges ON id = left_id AND next_id = right_id WINDOW w AS (PARTITION BY word ORDER BY pos)),
    cells AS (SELECT word, cell, min(merged) AS lowest, min(key) AS key FROM ranked GROUP BY word, cell),
    least AS (
        SELECT word, cell, min(lowest) OVER (PARTITION BY word ORDER BY cell RANGE BETWEEN 1 PRECEDING AND 2 FOLLOWING) AS near,
               min(key) OVER (PARTITION BY word ORDER BY cell RANGE BETWEEN 3 PRECEDING AND 4 FOLLOWING) AS far
        FROM cells),
    turn AS (
        SELECT ranked.*, key = far AND cell - 3 >= lo AND cell + 4 <= hi AS alone
        FROM ranked JOIN least USING (word, cell) JOIN edges USING (word) WHERE merged = near AND cell - 1 >= lo AND cell + 2 <= hi),
    runs AS (
        SELECT *, count(*) FILTER (NOT coalesce(chained AND before = pos, false)) OVER (PARTITION BY word ORDER BY pos) AS run
        FROM (SELECT *, lag(next_pos) OVER (PARTITION BY word ORDER BY pos) AS before FROM turn)),
    apart AS (
        SELECT *, lag(next_pos) OVER (PARTITION BY word ORDER BY pos) AS last_gone
        FROM (SELECT *, row_number() OVER r AS k, coalesce(first_value(chained) OVER r, false) AS headless FROM runs WINDOW r AS (PARTITION BY word, run ORDER BY pos))
        WHERE k % 2 = 1 AND NOT headless),
    checked AS (
        SELECT apart.*, coalesce(a.merged < apart.merged, false) OR coalesce(b.merged < apart.merged, false) AS lower
        FROM apart
        LEFT JOIN merges a ON a.left_id = CASE WHEN last_gone = left_pos THEN apart.merged ELSE left_of END AND a.right_id = apart.merged
        LEFT JOIN merges b ON b.left_id = apart.merged AND b.right_id = right_of),
    done AS (
        SELECT pos, next_pos, word, merged
        FROM (SELECT *, min(CASE WHEN lower THEN merged END) OVER (PARTITION BY word ORDER BY cell RANGE BETWEEN 1 PRECEDING AND 2 FOLLOWING) AS held FROM checked)
        WHERE alone OR NOT lower AND held IS DISTINCT FROM merged)
    SELECT pos, word, merged FROM done
    UNION ALL
    SELECT next_pos, word, -1 FROM done)
)
SELECT pos, word, id FROM s WHERE id >= 0 ORDER BY pos"""

DECODE = """
SELECT doc, string_agg(hex, '' ORDER BY pos) AS hex, count(*) AS n
FROM id_rows JOIN vocabulary USING (id) GROUP BY doc"""


def read_ranks(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


class Codec:
    """The vocabulary of one rank file in a DuckDB connection of this worker."""

    def __init__(self, rank_file: bytes, pattern: str):
        import duckdb
        import regex

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, rank_file.splitlines())}
        rows = [(ranks[t[:k]], ranks[t[k:]], r) for t, r in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks]
        merges = pd.DataFrame(np.asarray(rows, np.int32).reshape(-1, 3), columns=["left_id", "right_id", "merged"])  # noqa: F841
        vocabulary = pd.DataFrame({"id": np.asarray(list(ranks.values()), np.int32), "hex": [t.hex() for t in ranks]})  # noqa: F841
        # No folder to spill in: it would be a local one.
        self.con = duckdb.connect(config={"threads": 1, "memory_limit": "256MB", "temp_directory": ""})
        self.merge_keys = np.asarray(merges["left_id"], np.int64) << 32 | merges["right_id"]
        self.spelt, self.lengths = np.frombuffer(b"".join(ranks), np.uint8), np.asarray([len(t) for t in ranks])
        self.begins = np.cumsum(self.lengths) - self.lengths
        self.con.execute("CREATE TABLE merges AS FROM merges")
        self.con.execute("CREATE TABLE vocabulary AS FROM vocabulary")
        self.byte_ids = np.asarray([ranks.get(bytes([b]), -1) for b in range(256)], np.int32)
        self.ranks, self.split = ranks, regex.compile(pattern).findall
        self.names = list(map(str, range(1 + max(ranks.values()))))
        self.known: dict[str, bytes] = {}  # each word's ids as 32-bit integers
        self.before: dict[str, bytes] = {}

    def contract(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word that isn't a token by itself, by the recursive queries."""
        out: list[bytes] = [b""] * len(words)
        steps = [len(w) * (len(w) + 1) // 2 if len(w) <= LONG else 0 for w in words]  # the query for short words keeps its steps
        for at in _runs([k for k, n in enumerate(steps) if n], steps, CHUNK_ROWS):
            for k, ids in zip(at, self._short([words[k] for k in at])):
                out[k] = ids
        sizes = [len(w) for w in words]
        for at in _runs([k for k, n in enumerate(sizes) if LONG < n <= SEGMENT], sizes, SEGMENT):
            some, starts = [words[k] for k in at], np.cumsum([0, *(sizes[k] for k in at)])
            word = np.repeat(np.arange(len(at)), [sizes[k] for k in at])
            pos, ids = self._contracted(word, np.arange(starts[-1]), self._bytes(b"".join(some)), [(-9, 1 << 40)] * len(at), self._reach(some))
            for k, part in zip(at, np.split(ids, np.searchsorted(pos, starts[1:-1]))):
                out[k] = part.tobytes()
        for k, n in enumerate(sizes):
            if n > SEGMENT:
                out[k] = self._very_long(words[k])
        return out

    def _bytes(self, raw: bytes) -> np.ndarray:
        return self.byte_ids[np.frombuffer(raw, np.uint8)]

    def _short(self, words: list[bytes]) -> list[bytes]:
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        token_rows = pd.DataFrame({  # noqa: F841
            "word": np.repeat(np.arange(len(words), dtype=np.int32), sizes),
            "pos": np.arange(sizes.sum(), dtype=np.int64),  # ascending over all words
            "id": self._bytes(b"".join(words)),
        })
        got = self.con.execute(CONTRACT).fetchnumpy()
        raw = np.ascontiguousarray(got["id"], np.int32).tobytes()
        ends = (4 * np.cumsum(np.bincount(got["word"], minlength=len(words)))).tolist()
        return [raw[start:end] for start, end in zip([0, *ends], ends)]

    def _reach(self, words: list[bytes]) -> int:
        """The length of the longest token that the words' bytes can make."""
        has = np.zeros(256, bool)
        for w in words:
            has[np.frombuffer(w, np.uint8)] = True
        return int(self.lengths[np.logical_and.reduceat(has[self.spelt], self.begins)].max(initial=2))

    def _contracted(self, word: np.ndarray, pos: np.ndarray, ids: np.ndarray, known: list[tuple[int, int]], cell: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions and ids of the tokens that are left. ``known``: of each word, the first and last cell that all is known of."""
        token_rows = pd.DataFrame({"word": word.astype(np.int32), "pos": pos.astype(np.int64), "id": ids})  # noqa: F841
        edges = pd.DataFrame({"word": np.arange(len(known), dtype=np.int32), "lo": [a for a, _ in known], "hi": [b for _, b in known]})  # noqa: F841
        got = self.con.execute(CONTRACT_LONG.format(cell=cell)).fetchnumpy()
        return np.ascontiguousarray(got["pos"], np.int64), np.ascontiguousarray(got["id"], np.int32)

    def _very_long(self, word: bytes) -> bytes:
        """A word in segments, from left to right. What can't be settled without what lies behind a segment waits for the next one, which
        begins so far before it that nothing further left can still change; a segment that settles nothing grows."""
        cell, out, size = self._reach([word]), [], SEGMENT
        pos, ids, end = np.empty(0, np.int64), np.empty(0, np.int32), 0  # tokens that wait, and where the bytes behind them begin
        while True:
            more = min(len(word), max(end, (int(pos[0]) if len(pos) else end) + size))
            pos, ids, end = np.r_[pos, np.arange(end, more)], np.r_[ids, self._bytes(word[end:more])], more
            known = -(-int(pos[0]) // cell) if out else -9, end // cell - 1 if end < len(word) else 1 << 40
            pos, ids = self._contracted(np.zeros(len(pos)), pos, ids, [known], cell)
            if end == len(word):
                return b"".join([*out, ids.tobytes()])
            first = np.flatnonzero(np.isin(ids[:-1].astype(np.int64) << 32 | ids[1:], self.merge_keys))[:1]  # the first pair that still merges
            settled = int(np.searchsorted(pos, min([end, *pos[first]]) - 16 * cell))
            size = SEGMENT if settled > 0 else 2 * size
            if settled > 0:
                out.append(ids[:settled].tobytes())
                pos, ids = pos[settled:], ids[settled:]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        split = [self.split(t) for t in texts]
        if len(self.known) > CACHE:
            self.known, self.before = {}, self.known
        todo = []
        for word in set(chain.from_iterable(split)):
            if word in self.known:
                continue
            if (old := self.before.get(word)) is not None:
                self.known[word] = old
                continue
            whole = self.ranks.get(raw := word.encode("utf-8"))
            if whole is None:
                todo.append((word, raw))
            else:
                self.known[word] = np.asarray([whole], np.int32).tobytes()
        for k in range(0, len(todo), CHUNK_WORDS):
            part = todo[k : k + CHUNK_WORDS]
            self.known.update(zip((w for w, _ in part), self.contract([raw for _, raw in part])))
        of = self.known.__getitem__
        return [np.frombuffer(b"".join(map(of, words)), np.int32) for words in split]

    def decode(self, ids: list[np.ndarray]) -> list[bytes]:
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        if not sizes.sum():
            return [b""] * len(ids)
        id_rows = pd.DataFrame({  # noqa: F841
            "doc": np.repeat(np.arange(len(ids), dtype=np.int32), sizes),
            "pos": np.arange(sizes.sum(), dtype=np.int64),
            "id": np.concatenate(ids).astype(np.int32),
        })
        got = self.con.execute(DECODE).fetchnumpy()
        if got["n"].sum() != sizes.sum():
            raise ValueError("an id outside the vocabulary")
        out = [b""] * len(ids)
        for doc, text in zip(got["doc"], got["hex"]):
            out[doc] = bytes.fromhex(text)
        return out


@lru_cache(maxsize=2)
def _codec(rank_file: bytes, pattern: str) -> Codec:
    return Codec(rank_file, pattern)


def _pieces(values: list, most: int) -> Iterator[list]:
    """Runs of ``values`` whose sizes add up to about ``most``."""
    run, size = [], 0
    for v in values:
        if run and size + len(v) > most:
            yield run
            run, size = [], 0
        run.append(v)
        size += len(v)
    if run:
        yield run


def _runs(at: list[int], sizes: list[int], most: int) -> Iterator[list[int]]:
    """``at`` in runs whose sizes add up to ``most`` at most, where no single one is larger."""
    run, size = [], 0
    for k in at:
        if run and size + sizes[k] > most:
            yield run
            run, size = [], 0
        run.append(k)
        size += sizes[k]
    if run:
        yield run


def _udf(docs: DataFrame, rank_path: str, pattern: str, returns: str, finish):
    shared = docs.sparkSession.sparkContext.broadcast(read_ranks(rank_path))

    @F.pandas_udf(returns)
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        codec = _codec(shared.value, pattern)
        for batch in batches:
            yield finish(codec, list(batch))

    return of


def encode(docs: DataFrame, rank_path: str, pattern: str, text_col: str = "text", out_col: str = "ids") -> DataFrame:
    """Adds ``out_col array<int>``."""
    if out_col in docs.columns:
        raise ValueError(f"{out_col} is a column already")

    def finish(codec: Codec, texts: list[str]) -> pd.Series:
        return pd.Series([ids for run in _pieces(texts, CHUNK_CHARS) for ids in codec.encode(run)], dtype=object)

    return docs.withColumn(out_col, _udf(docs, rank_path, pattern, "array<int>", finish)(text_of(text_col)))


def decode(rows: DataFrame, rank_path: str, pattern: str, ids_col: str = "ids", out_col: str = "bytes") -> DataFrame:
    """Adds ``out_col binary``; null ids count as none."""
    if out_col in rows.columns:
        raise ValueError(f"{out_col} is a column already")

    def finish(codec: Codec, ids: list) -> pd.Series:
        return pd.Series([raw for run in _pieces(ids, CHUNK_IDS) for raw in codec.decode(run)], dtype=object)

    ids = F.coalesce(F.col(ids_col), F.array().cast("array<int>"))
    return rows.withColumn(out_col, _udf(rows, rank_path, pattern, "binary", finish)(ids))


def digests(docs: DataFrame, rank_path: str, pattern: str, text_col: str = "text", out_col: str = "_bpe") -> DataFrame:
    """Adds ``out_col``: n_tokens, ids_sha256 and decoded_sha256 of the decoded ids,
    made where the ids are, so that they needn't leave the task."""

    def finish(codec: Codec, texts: list[str]) -> pd.DataFrame:
        out = []
        for run in _pieces(texts, CHUNK_CHARS):
            encoded = codec.encode(run)
            decoded = [raw for some in _pieces(encoded, CHUNK_IDS) for raw in codec.decode(some)]
            for ids, raw in zip(encoded, decoded):
                out.append((len(ids), hashlib.sha256(",".join(map(codec.names.__getitem__, ids.tolist())).encode()).hexdigest(), hashlib.sha256(raw).hexdigest()))
        return pd.DataFrame(out, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    returns = "n_tokens long, ids_sha256 string, decoded_sha256 string"
    shared = docs.sparkSession.sparkContext.broadcast(read_ranks(rank_path))

    @F.pandas_udf(returns)
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        codec = _codec(shared.value, pattern)
        for batch in batches:
            yield finish(codec, list(batch))

    return docs.withColumn(out_col, of(text_of(text_col)))
