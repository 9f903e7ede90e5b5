"""Mixing against brute force: targets, draws, permutations and the spans of words."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from brookledger.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 2000), min_size=1, max_size=9))
def test_targets(sizes):
    weights = np.resize(np.asarray(mixing.WEIGHTS, float), len(sizes))
    got = mixing.targets(np.asarray(sizes), weights)
    assert abs(got.sum() - sum(sizes)) < 1e-6 * (1 + sum(sizes)) and all(t <= 3 * s + 1e-9 for t, s in zip(got, sizes))
    free = [t / w for t, s, w in zip(got, sizes, weights) if t < 3 * s - 1e-6]  # these have one level, and the others no more than it
    assert not free or max(free) - min(free) < 1e-6 * (1 + max(free)) and all(t / w <= max(free) + 1e-6 for t, w in zip(got, weights))


@settings(max_examples=100, deadline=None)
@given(st.integers(1, 3000), st.integers(0, 2**63))
def test_permutation(n, key):
    i = np.arange(n)
    out = mixing.permuted(i, np.full(n, n), np.full(n, key, np.uint64))
    assert sorted(out.tolist()) == list(range(n))
    assert mixing.permuted(out, np.full(n, n), np.full(n, key, np.uint64), back=True).tolist() == i.tolist()


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 500), min_size=1, max_size=6).filter(sum), st.integers(1, 40), st.booleans())
def test_shards_meet_the_quotas(counts, slots, in_proportion):
    drawn, mixing.DRAWN = mixing.DRAWN, 50 if in_proportion else mixing.DRAWN
    try:
        shards = mixing.Shards(np.asarray(counts), slots, 1)
        got = [shards.shard(k) for k in range(shards.n)]
        again = mixing.Shards(np.asarray(counts), slots, 1).shard(shards.n - 1)
    finally:
        mixing.DRAWN = drawn
    assert [a.tolist() for a in again] == [a.tolist() for a in got[-1]]
    sums = np.zeros(len(counts), int)
    for k, (some, before) in enumerate(got):
        assert before.tolist() == sums.tolist() and (some >= 0).all()
        assert some.sum() == (slots if k < shards.n - 1 else sum(counts) - slots * k)
        sums += some
    assert sums.tolist() == counts


def test_draws_are_spread_as_a_multinomial():
    counts = np.asarray([6000, 3000, 1000])
    shards = mixing.Shards(counts, 100, 3)
    got = np.asarray([shards.shard(k)[0] for k in range(shards.n)])
    assert np.allclose(got.mean(0), counts / 100) and 0.6 < got[:, 0].var() / (100 * 0.6 * 0.4) < 1.5


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    out = [(None, "id less", "a"), (None, "id less", "a"), (5, "same id", "b"), (5, "same id and more", "b"), (6, None, "b"), (7, " \n\t ", "empty"), (8, "", None)]
    for i in range(10, 150):
        source = rng.choice(["a"] * 12 + ["b", "ä", "Z", None])
        out.append((i, " ".join("w" * rng.randint(1, 3) for _ in range(rng.choice([1, 5, 40, 300]))), source))
    return [*out, (200, "w x y z\x1cq \x0b\x0cend " * 3000, "long")]


def brute(rows):
    sizes = Counter()
    for _, text, source in rows:
        sizes[source] += len(WORD.findall(text or ""))
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    goal = mixing.targets(np.asarray([sizes[s] for s in order]), np.resize(np.asarray(mixing.WEIGHTS, float), len(order)))
    return sizes, dict(zip(order, goal))


@pytest.mark.parametrize("block,per_shard", [(256, 1024), (7, 16), (1, 50)])
def test_mix(spark, rows, block, per_shard):
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, source string, size int, _src int")
    got = mixing.decide(df.repartition(6), block=block, per_shard=per_shard)
    assert got.columns == ["doc_id", "size", "source_size", "target", "taken"]
    got = sorted(map(tuple, got.collect()), key=str)
    sizes, goal = brute(rows)
    source = defaultdict(list)
    for i, text, s in rows:
        source[i, len(WORD.findall(text or ""))].append(s)
    assert len(got) == len(rows)
    by = Counter()
    for i, size, all_size, target, taken in got:
        s = source[i, size][0]
        assert all_size == sizes[s] and abs(target - goal[s]) < 1e-6 and 0 <= taken <= 3 * size
        by[s] += taken
    assert all(abs(by[s] - goal[s]) <= 0.5 for s in sizes)
    assert got == sorted(map(tuple, mixing.decide(df.repartition(2), block=block, per_shard=per_shard).collect()), key=str)


def test_spans(spark, rows):
    """Slots are filled without gaps, whole blocks but the last of a source, and no word comes again before all its source came."""
    rows = [r for r in rows if r[0] is not None and r[0] != 5]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    got = mixing.spans(df, block=7, per_shard=16).collect()
    size = {i: len(WORD.findall(t or "")) for i, t, _ in rows}
    source = {i: s for i, _, s in rows}
    slots, times = defaultdict(list), Counter()
    for r in got:
        slots[r["shard"], r["position"]].append((r["place"], r["words"], source[r["doc_id"]], r["epoch"]))
        assert 0 <= r["first_word"] and r["first_word"] + r["words"] <= size[r["doc_id"]]
        times.update((r["doc_id"], w) for w in range(r["first_word"], r["first_word"] + r["words"]))
    short = Counter()
    for parts in slots.values():
        at = 0
        for place, words, *_ in sorted(parts):
            assert place == at
            at += words
        assert at <= 7 and len({p[2:] for p in parts}) == 1
        short[parts[0][2]] += at < 7
    assert sorted(slots) == [(k // 16, k % 16) for k in range(len(slots))]
    sizes, goal = brute(rows)
    for s in sizes:
        n = [times[i, w] for i in size if source[i] == s for w in range(size[i])]
        assert not n or max(n) - min(n) <= 1 and sum(n) == int(goal[s] + 0.5)
        assert short[s] <= 1 + -(-goal[s] // max(1, sizes[s]))


def test_no_rows(spark):
    none = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.decide(none).count() == 0 and mixing.spans(none).count() == 0
    assert [tuple(r) for r in mixing.decide(spark.createDataFrame([(1, None, None)], none.schema)).collect()] == [(1, 0, 0, 0.0, 0)]


def test_too_many_sources(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MOST_SOURCES", 1)
    with pytest.raises(ValueError):
        mixing.decide(spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "doc_id long, text string, source string"))
