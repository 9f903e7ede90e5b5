"""Importance resampling against brute force."""

import hashlib
import math
import random
import re
import zlib

import pytest

from brookledger.llm import resample

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ODD = [None, "", " \n", "a", "A B", "é ß É", "don't_stop-me", "日本語 テキスト!", "😀 emoji x2", "tab\tand\x0bfeed\x1cmark", "x" * 3000, "\x85next\xa0line"]


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def features(text, run):
    w = words(text)
    return [" ".join(w[i : i + k]) for k in range(1, run + 1) for i in range(len(w) - k + 1)]


def brute(docs, target, run=1, buckets=10_000, percent=10, least=20, seed=2024):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = [0] * buckets, [0] * buckets
    for counts, texts in ((s, [x for _, x in docs]), (t, target)):
        for x in texts:
            for f in features(x, run):
                counts[bucket(f)] += 1
    gain = lambda b: math.floor(1000 * math.log(float(t[b] + 1) * (sum(s) + buckets) / (float(s[b] + 1) * (sum(t) + buckets))))
    out = []
    for doc_id, x in docs:
        f = features(x, run)
        weight = sum(gain(bucket(a)) for a in f)
        h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append([doc_id, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words(x))])
    among = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[5]))
    for k, r in enumerate(among[: percent * len(among) // 100]):
        r[4] = k + 1
    return [tuple(r[:5]) for r in out]


def key(r):
    return tuple((v is None, v or 0) for v in r)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    vocabulary = ["ta", "Re", "mon", "sil7", "ka", "élan", "da", "zwölf", "ox"]
    out = list(ODD)
    for n in [3, 19, 20, 21, 60, 200] * 12:
        out.append(rng.choice([" ", "\n", ", "]).join(rng.choice(vocabulary) for _ in range(n)))
    return [*out, out[-1], out[-2].upper()]


TARGET = ["ta mon ta mon KA", None, "", "élan élan zwölf"]


@pytest.mark.parametrize("run", [1, 3])
def test_decide(spark, texts, run, monkeypatch):
    docs = [*enumerate(texts), (None, texts[-1]), (None, texts[-1]), (17, texts[30]), (17, texts[30])]
    df = spark.createDataFrame([(*r, 1, 2) for r in docs], "doc_id long, text string, _weight int, score int").repartition(5)
    target = spark.createDataFrame([(x,) for x in TARGET], "text string")
    got = resample.decide(df, target, run=run)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, got.collect()), key=key) == sorted(brute(docs, TARGET, run), key=key)
    drawn = resample.draw(df, target, run=run)
    assert drawn.columns == df.columns
    assert sorted((r["doc_id"] for r in drawn.collect()), key=lambda i: (i is None, i or 0)) == sorted((r[0] for r in brute(docs, TARGET, run) if r[4]), key=lambda i: (i is None, i or 0))


@pytest.mark.parametrize("run", [1, 3])
def test_small_tries_and_pieces_change_nothing(texts, run, monkeypatch):
    """Tries that start anew all the time, and texts that are walked in pieces of a few bytes, as a task sees them."""
    monkeypatch.setattr(resample, "PIECE", 7)
    for text in texts:
        trie, got = resample.Trie(run), []
        for _, nodes in resample.walked(trie, None if text is None else text.encode()):
            got += [trie.crc[k] for k in nodes]
            trie.clear()
        assert sorted(got) == sorted(zlib.crc32(f.encode()) for f in features(text, run))


def test_no_rows(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a " * 30)] * 10, "doc_id long, text string")
    assert resample.decide(none, none).count() == 0 and resample.draw(none, some).count() == 0
    rows = resample.decide(some, none).collect()
    assert sorted(r["rank"] or 0 for r in rows) == [0] * 9 + [1] and resample.draw(some, none).count() == 1
