"""Components and serial choice against plain loops, on chains and hubs."""

import random

import pytest
from pyspark.sql import functions as F

from brookledger.operators import graph, matching

EDGES = "l long, r long, l_order struct<d:int,i:long>, cost struct<c:double,i:long>"


def plain_components(edges):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    for a, b in edges:
        p, q = sorted((find(a), find(b)))
        root[q] = p
    return {x: find(x) for x in root}


@pytest.mark.parametrize("edges", [
    [(k, k + 1) for k in range(700)],
    [(0, k) for k in range(1, 500)] + [(k, k + 1) for k in range(600, 640)],
    [(random.Random(k).randrange(400), random.Random(-k).randrange(400)) for k in range(1, 260)],
])
def test_components(spark, edges):
    got = graph.components(spark.createDataFrame(edges, "a long, b long"))
    want = {k: v for k, v in plain_components([e for e in edges if e[0] != e[1]]).items()}
    assert {r["node"]: r["component"] for r in got.collect()} == want


def loop(edges):
    used, out = set(), {}
    for l, r, order, cost in sorted(edges, key=lambda e: (e[2], e[3])):
        if l not in out and r not in used:
            out[l] = r
            used.add(r)
    return out


def chosen(spark, edges, **how):
    got = matching.assignment(spark.createDataFrame(edges, EDGES), **how)
    return {r["l"]: r["r"] for r in got.pairs.collect()}, got


def test_a_chain_of_ten_thousand(spark):
    """Each left wishes for what the one before it may take: round by round that is ten thousand rounds."""
    edges = [(k, r, (0, k), (float(c), r)) for k in range(10_000) for c, r in ((0, k - 1), (1, k)) if r >= 0]
    got, how = chosen(spark, edges)
    assert got == loop(edges) and len(got) == 10_000 and how.rounds == matching.ROUNDS and how.grouped > 19_000


@pytest.mark.parametrize("seed", range(3))
def test_large_components_go_on_in_rounds(spark, seed):
    rng = random.Random(seed)
    edges = {(rng.randrange(60), rng.randrange(60)) for _ in range(150)}
    edges = [(l + 100 * g, r + 100 * g, (l % 7, l), (rng.choice([0.0, 1.0, 2.0]), r + 100 * g)) for g in range(2) for l, r in edges]
    got, how = chosen(spark, edges, rounds=1, small=20)
    assert got == loop(edges) and how.rounds >= 1
    assert chosen(spark, edges, small=0)[0] == got


def test_no_edges(spark):
    got, how = chosen(spark, [])
    assert got == {} and how == (how.pairs, 0, 0)


def test_folds_see_rows_in_order(spark):
    rows = spark.createDataFrame([(k % 3, 100 - k) for k in range(90)], "g int, v int").repartition(5)

    def fold():
        seen = []
        return lambda row: seen.append(row[0]) or [(row[0], len(seen), max(seen))]

    for r in graph.folded(rows, "g", [F.col("v")], fold, "v int, n int, most int").collect():
        assert r["most"] == r["v"] and 1 <= r["n"] <= 30
