"""Near-duplicate classes by order MinHash and banded alignment.

1. A text is its sequence of five-word shingles, each labelled with its
   occurrence. Texts with equal words are one group (a grouped minimum of slim
   rows) and have one number, in the order of their smallest ids; the rest works on these
   numbers, so texts that share an id are told apart.
2. Order MinHash: for each of ``TABLES`` hash functions the ``TOGETHER`` smallest
   labelled shingles, kept in text order, make a bucket. Texts in which 0.8 of the
   shingles agree in order share at least one of the buckets with a probability
   over 0.9999.
3. Each bucket's members are paired with its smallest id: a star, which joins most
   copies at a price linear in the members of a bucket.
4. Buckets that still hold several classes are dealt into tiles, and every two tiles
   of a bucket meet in a task of their own: their common shingles are counted
   as products of matrices, and pairs of different classes with enough of them are
   verified. So all pairs of a bucket are tested, but for those in one class already.
5. Pairs are verified by alignment of their whole shingle sequences inside a band:
   matched / (all - matched) >= 0.8. No more shingles than the band is wide can be
   unmatched in an accepted pair, so the band loses none.
6. Links are contracted to classes by alternating large-star and small-star
   steps over tables; a class is named by its smallest id. (Of unlike texts that share an id, each may name a class of its own by it.)

Texts move only from the documents in some candidate pair; hot centres are
joined as skewed joins, which adaptive execution splits.

Defined results: case and what stands between words don't count; texts of fewer
than five words are one shingle; texts without words are equal only if identical;
null text counts as empty; a null id is in no class and its row stays; rows that
repeat an id belong to the classes of their texts, and go or stay by their texts; rows that repeat both stay or go
together; ids must be whole numbers; an empty table gives an empty result; ``keep`` returns all columns.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, Recent, dealt, fresh, small_batches, stage, text_of

WORDS, SIMILARITY = 5, 0.8
TABLES, TOGETHER = 16, 3
#: A tile has about so many members at most, or so many shingles if they are long; a product takes so many shingles at once.
TILE, TILE_SHINGLES, COLUMNS = 384, 1 << 18, 4096
#: Words a task remembers.
CACHE = 60_000
WORD = re.compile(r"\w+")
SALTS = np.random.default_rng(7).integers(1, 2**63, TABLES, dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(29))


class Shingler:
    def __init__(self) -> None:
        self.known = Recent(xxhash.xxh3_64_intdigest, CACHE)

    def words(self, text: str) -> np.ndarray:
        out = WORD.findall(text.lower())
        return np.fromiter(map(self.known.__getitem__, out), np.uint64, len(out))

    def key(self, text: str, words: np.ndarray | None = None) -> bytes:
        """A key that equal word sequences share, and texts without words only if they are identical."""
        words = self.words(text) if words is None else words
        return xxhash.xxh3_128_digest(b"w" + words.tobytes() if len(words) else b"t" + text.encode("utf-8", "surrogatepass"))

    def __call__(self, text: str) -> tuple[bytes, np.ndarray]:
        """The key, and the labelled shingles in text order."""
        words = self.words(text)
        key = self.key(text, words)
        if not len(words):
            return key, np.empty(0, np.uint64)
        width = min(WORDS, len(words))
        n = len(words) - width + 1
        h = np.zeros(n, np.uint64)
        for k in range(width):
            h = _mix(h * np.uint64(0x9E3779B97F4A7C15) + words[k : k + n])
        return key, labelled(h)


def labelled(h: np.ndarray) -> np.ndarray:
    """Hashes made distinct by their occurrence: first, second, ..."""
    order = np.argsort(h, kind="stable")
    ranked = h[order]
    new = np.r_[True, ranked[1:] != ranked[:-1]]
    if new.all():
        return h
    start = np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))
    times = np.empty(len(h), np.uint64)
    times[order] = (np.arange(len(h)) - start).astype(np.uint64)
    return np.where(times > 0, _mix(h + times * np.uint64(0xD6E8FEB86659FD93)), h)


def buckets(h: np.ndarray) -> np.ndarray:
    """One bucket for each table; none without shingles."""
    if not len(h):
        return np.empty(0, np.int64)
    width = min(TOGETHER, len(h))
    least = np.empty((TABLES, width), np.uint64)
    for t, salt in enumerate(SALTS):
        g = _mix(h ^ salt)
        least[t] = g[np.sort(np.argpartition(g, width - 1)[:width])]
    out = SALTS
    for k in range(width):
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + least[:, k])
    return out.view(np.int64)


def needed(total: int | np.ndarray, least: float = SIMILARITY) -> np.ndarray:
    """The fewest matches that make two sequences of ``total`` shingles together alike."""
    return np.ceil(least * total / (1 + least) - 1e-9).astype(np.int64)


def alike(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> bool:
    """Whether an alignment of the labelled sequences matches enough of both."""
    total = len(a) + len(b)
    need = int(needed(total, least))
    if not len(a) or not len(b) or min(len(a), len(b)) < need:
        return False
    band = total - 2 * need  # more unmatched elements than that are too many
    _, at_a, at_b = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    near = np.abs(at_a - at_b) <= band
    if near.sum() < need:
        return False
    order = np.argsort(at_a[near])
    tails: list[int] = []  # elements are distinct: the best alignment is the longest increasing run
    for j in at_b[near][order].tolist():
        k = bisect_left(tails, j)
        if k == len(tails):
            tails.append(j)
        else:
            tails[k] = j
    return len(tails) >= need


def features(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Slim rows: _id, _key, _n (shingles), _buckets."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingles = Shingler()
        for pdf in batches:
            got = [shingles(t) for t in pdf["_text"]]
            yield pd.DataFrame({"_id": pdf["_id"], "_key": [k for k, _ in got], "_n": np.fromiter((len(h) for _, h in got), np.int64, len(got)), "_buckets": [buckets(h) for _, h in got]})

    return docs.select(F.col(id_col).cast("long").alias("_id"), text_of(text_col).alias("_text")).where("_id IS NOT NULL").mapInPandas(of, "_id long, _key binary, _n long, _buckets array<long>")


def sequences(docs: DataFrame, texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """_id, the number of a text, and its shingles; ``texts``: _node, the number, with _id and _key of a row that has it."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingles = Shingler()
        for pdf in batches:
            got = [shingles(t) for t in pdf["_text"]]
            yield pd.DataFrame({"_id": pdf["_id"], "_key": [k for k, _ in got], "_shingles": [h.view(np.int64) for _, h in got]})

    rows = docs.select(F.col(id_col).cast("long").alias("_id"), text_of(text_col).alias("_text"))
    texts = stage(texts, "near-ids")
    if texts.count() * 48 <= BROADCAST_BYTES:
        texts = F.broadcast(texts)
    rows = rows.join(texts.select("_id"), "_id", "left_semi").mapInPandas(of, "_id long, _key binary, _shingles array<long>")
    return rows.join(texts, ["_id", "_key"]).select(F.col("_node").alias("_id"), "_shingles")


def keys(docs: DataFrame, text_col: str, out_col: str) -> DataFrame:
    """Adds the key that texts of equal words share."""

    @F.pandas_udf("binary")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        shingles = Shingler()
        for batch in batches:
            yield pd.Series([shingles.key(t) for t in batch], dtype=object)

    return docs.withColumn(out_col, of(text_of(text_col)))


def verified(pairs: DataFrame, shingles: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sequences align."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ok = [alike(np.asarray(x), np.asarray(y)) for x, y in zip(pdf["_x"], pdf["_y"])]
            yield pdf.loc[ok, ["a", "b"]]

    first = shingles.select(F.col("_id").alias("a"), F.col("_shingles").alias("_x"))
    second = shingles.select(F.col("_id").alias("b"), F.col("_shingles").alias("_y"))
    return pairs.join(second, "b").join(first, "a").mapInPandas(of, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for the nodes of ``edges`` (a, b): the smallest node that can be reached."""
    edges, size = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")), None
    while True:
        edges = stage(edges, "links", size)
        size = 2 * edges.count()  # none of the tables below has more rows
        # Done when every node hangs on one root: no node has two parents, or is both a child and a parent.
        ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("up")))
        knots = ends.groupBy("node").agg(F.sum("up").alias("ups"), F.count("*").alias("n")).where("ups > 1 OR (ups = 1 AND n > 1)")
        if knots.isEmpty():
            return edges.select(F.col("u").alias("node"), F.col("v").alias("label"))
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stage(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "links-least", size)
        large = stage(both.where("v > u").join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")), "links-large", size)
        least = stage(large.groupBy("u").agg(F.min("v").alias("m")), "links-least", size)
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        edges = small.distinct()


def common(seqs: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many shingles each sequence at ``a`` shares with each at ``b``."""
    sizes = [len(x) for x in seqs]
    _, column, times = np.unique(np.concatenate(seqs), return_inverse=True, return_counts=True)
    often = times > 1  # the others are in one sequence only
    column = np.where(often, np.cumsum(often) - 1, -1)[column]
    of = np.split(column, np.cumsum(sizes)[:-1])

    def cells(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows and columns that are set, by column."""
        row, col = np.repeat(np.arange(len(at)), [sizes[k] for k in at]), np.concatenate([of[k] for k in at])
        order = np.argsort(col, kind="stable")[np.count_nonzero(col < 0) :]
        return row[order], col[order]

    (row_a, col_a), (row_b, col_b) = cells(a), cells(b)
    out = np.zeros((len(a), len(b)), np.float32)
    for start in range(0, int(often.sum()), COLUMNS):
        x, y = np.zeros((len(a), COLUMNS), np.float32), np.zeros((len(b), COLUMNS), np.float32)
        for m, row, col in ((x, row_a, col_a), (y, row_b, col_b)):
            lo, hi = np.searchsorted(col, [start, start + COLUMNS])
            m[row[lo:hi], col[lo:hi] - start] = 1
        out += x @ y.T
    return out.astype(np.int64)


def links_of_tiles(pdf: pd.DataFrame) -> pd.DataFrame:
    """Classes (a, b) to be joined by pairs of two tiles (or one) of a bucket; pairs that earlier links join are not tested."""
    names, of = np.unique(pdf["_class"].to_numpy(), return_inverse=True)
    tile, at = pdf["_tile"].to_numpy(), np.arange(len(pdf))
    first, second = at[tile == pdf["_i"].iloc[0]], at[tile == pdf["_j"].iloc[0]]
    links: list[tuple[int, int]] = []
    if len(names) > 1 and len(first) and len(second):
        seqs = [np.asarray(x) for x in pdf["_shingles"]]
        n, one = np.fromiter(map(len, seqs), np.int64, len(seqs)), pdf["_i"].iloc[0] == pdf["_j"].iloc[0]
        most = np.bincount(of).argmax()  # pairs within the largest class needn't be counted
        root = list(range(len(names)))

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = x = root[root[x]]
            return x

        for a, b in ((first[of[first] != most], second), (first[of[first] == most], second[of[second] != most])):
            if not len(a) or not len(b):
                continue
            close = (common(seqs, a, b) >= needed(n[a][:, None] + n[b][None])) & (of[a][:, None] != of[b][None])
            if one and len(b) == len(second):
                close &= (a[:, None] < b[None]) | (of[b][None] == most)
            elif one:
                continue  # in one tile, the first turn has met these
            for x, y in np.argwhere(close).tolist():
                p, q = find(of[a[x]]), find(of[b[y]])
                if p != q and alike(seqs[a[x]], seqs[b[y]]):
                    root[max(p, q)] = min(p, q)
                    links.append((names[of[a[x]]], names[of[b[y]]]))
    return pd.DataFrame(links, columns=["a", "b"], dtype=np.int64)


def remaining_links(spread: DataFrame, labels: DataFrame | None, shingles: DataFrame) -> DataFrame:
    """Links (a, b) between classes that share a bucket, from all pairs of its members."""
    now = spread.withColumn("_class", F.col("_id")) if labels is None else spread.join(labels, F.col("_id") == F.col("node"), "left").withColumn("_class", F.coalesce("label", "_id")).drop("node", "label")
    now = stage(now, "near-mixed")
    # Two members have met as centre and member.
    mixed = now.groupBy("_bucket").agg(F.count("*").alias("_size"), F.sum("_n").alias("_sum"), F.min("_class").alias("_least"), F.max("_class").alias("_most")).where("_size > 2 AND _least <> _most")
    mixed = mixed.select("_bucket", F.greatest(F.ceil(F.col("_size") / TILE), F.ceil(F.col("_sum") / TILE_SHINGLES)).cast("int").alias("_tiles"))
    tiled = stage(now.join(mixed, "_bucket").select("_bucket", "_id", "_class", "_tiles", F.pmod(F.xxhash64("_id", "_bucket"), F.col("_tiles").cast("long")).cast("int").alias("_tile")), "near-tiles")
    met = tiled.join(shingles, "_id").withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_tiles") - 1)))
    met = met.select("_bucket", F.least("_tile", "_other").alias("_i"), F.greatest("_tile", "_other").alias("_j"), "_tile", "_id", "_class", "_shingles")
    return met.groupBy("_bucket", "_i", "_j").applyInPandas(links_of_tiles, "a long, b long").distinct()


def _decided(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """_id, _key, class_id and kept of each row with an id."""
    small_batches(docs.sparkSession)
    rows = stage(features(docs, id_col, text_col), "near-features")
    groups = rows.groupBy("_key").agg(F.min(F.struct("_id", "_n", "_buckets")).alias("r")).select("_key", "r.*")
    groups = dealt(groups, [F.col("_id"), F.col("_key")], "near-groups").withColumn("_node", F.shiftleft(F.col("_part").cast("long"), 33) + F.col("_row"))
    # From here on ``_id`` is the number of a text.
    spread = groups.where("_n > 0").select(F.col("_node").alias("_id"), "_n", F.explode("_buckets").alias("_bucket"))
    # Buckets of one text lead nowhere; their rows go before anything is joined.
    shared = stage(spread.groupBy("_bucket").agg(F.count("*").alias("_size")).where("_size > 1").select("_bucket"), "near-buckets")
    spread = stage(spread.join(shared, "_bucket"), "near-members")
    members = groups.select("_node", "_id", "_key").join(spread.select(F.col("_id").alias("_node")).distinct(), "_node")
    shingles = stage(sequences(docs, members, id_col, text_col).dropDuplicates(["_id"]), "near-shingles")
    centre = stage(spread.groupBy("_bucket").agg(F.min(F.struct("_id", "_n")).alias("c")), "near-centres")
    pairs = spread.join(centre, "_bucket").where((F.col("_id") != F.col("c._id")) & (F.least("_n", "c._n") >= SIMILARITY * F.greatest("_n", "c._n")))
    pairs = stage(pairs.select(F.col("c._id").alias("a"), F.col("_id").alias("b")).distinct(), "near-pairs")
    links, labels = stage(verified(pairs, shingles), "near-links"), None
    if not links.isEmpty():
        labels = components(links)
    links = stage(remaining_links(spread, labels, shingles), "near-links")
    if not links.isEmpty():
        labels = components(links if labels is None else links.unionByName(labels.toDF("a", "b")))
    groups = groups.select("_key", "_node", F.col("_id").alias("_own"))
    if labels is None:
        groups = groups.withColumn("class_id", F.col("_own")).withColumn("_first", F.lit(True))
    else:
        named = labels.where("node <> label").join(groups.select(F.col("_node").alias("label"), F.col("_own").alias("_name")), "label")
        groups = groups.join(named, F.col("_node") == F.col("node"), "left").withColumn("class_id", F.coalesce("_name", "_own")).withColumn("_first", F.col("label").isNull())
    groups = stage(groups.select("_key", "_own", "class_id", "_first"), "near-classes")
    return rows.select("_id", "_key").join(groups, "_key").select("_id", "_key", "class_id", (F.col("_first") & (F.col("_id") == F.col("_own"))).alias("kept"))


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row with an id: the id, class_id and whether it is the one that stays."""
    return _decided(docs, id_col, text_col).select(F.col("_id").alias(id_col), "class_id", "kept")


def keep(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay: of each class those with the id and words that name it, and rows without an id.

    Rows go by their id; where an id has unlike texts, by the key of the text too."""
    decided = stage(_decided(docs, id_col, text_col), "near-decided")
    gone = stage(decided.where("not kept").select(F.col("_id").alias("_gone"), "_key").distinct(), "near-gone")
    several = decided.join(gone.select(F.col("_gone").alias("_id")), "_id", "left_semi").groupBy("_id").agg((F.min("_key") != F.max("_key")).alias("_unlike")).where("_unlike")
    several = stage(several.select(F.col("_id").alias("_several")), "near-several")
    own = docs[id_col].cast("long")
    if several.isEmpty():
        ids = gone.select("_gone").distinct()
        return docs.join(ids, own == ids["_gone"], "left_anti")
    plain = gone.join(several, F.col("_gone") == F.col("_several"), "left_anti").select("_gone").distinct()
    key = fresh(docs, "_near")
    rest = docs.join(plain, own == plain["_gone"], "left_anti")
    unlike = keys(rest.join(several, own == several["_several"], "left_semi"), text_col, key)
    unlike = unlike.join(gone, (unlike[id_col].cast("long") == gone["_gone"]) & (unlike[key] == gone["_key"]), "left_anti").drop(key)
    return rest.join(several, own == several["_several"], "left_anti").unionByName(unlike)
