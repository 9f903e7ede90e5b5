"""Conversation repair against brute force."""

import hashlib
import heapq
import random
import re
import zlib
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from brookledger.llm import conversations

SCHEMA = "conv_id long, turn long, role string, text string"
LEGAL = re.compile("(s?(ua)+)?")


def cheapest(signature):
    """(cost, audit) by search over all edit sequences in the order of cost and letters; at most two insertions in a row."""
    best, heap = {}, [(0, "", 0, "")]
    while heap:
        cost, audit, k, made = heapq.heappop(heap)
        if k == len(signature) and LEGAL.fullmatch(made):
            return cost, audit
        state = (k, made[-1:], made == "s", audit[-2:] if audit.endswith("I") else "")
        if best.setdefault(state, (cost, audit)) < (cost, audit):
            continue
        if not audit.endswith("II"):
            for c in "ua":
                heapq.heappush(heap, (cost + 5, audit + "I", k, made + c))
        if k < len(signature):
            x = signature[k]
            heapq.heappush(heap, (cost + 2, audit + "D", k + 1, made))
            if x != "x":
                more = 5 * x.isupper()
                for c in "ua":
                    heapq.heappush(heap, (cost + more + 1, audit + "R", k + 1, made + c))
                heapq.heappush(heap, (cost + more, audit + "K", k + 1, made + x.lower()))
        heap = [h for h in heap if re.fullmatch("s?(ua)*u?", h[3])]
        heapq.heapify(heap)


@settings(max_examples=150, deadline=None)
@given(st.text("suaoSUAOx", max_size=7))
def test_solve(signature):
    assert conversations.solve(signature) == cheapest(signature)


def test_long_signature():
    cost, audit = conversations.solve("ua" * 100_000 + "x" + "u")
    assert cost == 4 and audit == "K" * 200_000 + "DD"


def replayed(rows, audit):
    out, rows = [], iter(rows)
    for e in audit:
        due = "assistant" if out and out[-1][0][0] == "u" else "user"
        role, text = (due, "") if e == "I" else next(rows)
        if e != "D":
            out.append((due if e == "R" else role, text))
    return out


def damage(rows):
    out = []
    for c, t, role, text in rows:
        spaced = lambda x: " " if x is None else x
        role, text = spaced(role), spaced(text)
        k = zlib.crc32(f"{spaced(c)}:{spaced(t)}".encode()) % 20
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        out += [(c, t, "user" if k == 4 else role, text)] * (0 if k == 0 else 2 if k == 3 else 1)
    return out


def report(rows, damaged):
    groups = defaultdict(list)
    for c, t, role, text in damaged:
        groups[c].append((t, role, text))
    out = []
    for c in {r[0] for r in rows}:
        g = sorted(groups[c], key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest()))
        seen, signature, n = set(), "", dict.fromkeys(("blank", "duplicate", "truncated"), 0)
        for _, role, text in g:
            bare = text.rstrip(" \t\n\x0b\x0c\r")
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
            seen.add((role, text))
            letter = role[:1] if role[:1] and role[:1] in "sua" else "o"
            signature += "x" if fault in ("blank", "duplicate") else letter.upper() if fault else letter
            if fault:
                n[fault] += 1
        turns = [t for t, _, _ in g if t is not None]
        two = [a[1][:1] + b[1][:1] for a, b in zip(g, g[1:])]
        cost, audit = conversations.solve(signature)
        whole = "\n".join(f"{r}:{t}" for r, t in replayed([(r, t) for _, r, t in g], audit))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out.append((c, gaps, *n.values(), sum(x not in ("su", "ua", "au") for x in two), cost, audit, hashlib.sha256(whole.encode()).hexdigest()))
    return out


def key(r):
    return tuple((v is None, "" if v is None else str(v)) for v in r)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    out = []
    for c in [*range(60), None]:
        for t in range(rng.choice([1, 2, 3, 8, 40])):
            turn = rng.choice([None, 2**53 + t]) if c == 7 else None if c == 8 else t * rng.choice([1, 1, 1, 2])
            role = rng.choice(["user", "assistant"] * 8 + ["system", "tool", "", None, "User"]) if t else rng.choice(["system", "user"])
            text = rng.choice(["Hi.", "Yes!", "Where? ", "cut off", "", " \t\r\n\x0c", None, "a ", "日本。", f"No {t}.", f"So {t}.", f"Well {t}!"])
            out.append((c, turn, role, text))
    return [*out, (99, 0, "user", "Copy."), (99, 0, "user", "Copy."), (99, 0, "assistant", "Copy."), (2**60 + 1, 1, "user", "Large.")]


def test_report(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = conversations.report(conversations.damaged(df), df.select("conv_id"))
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert sorted(map(tuple, got.collect()), key=key) == sorted(report(rows, damage(rows)), key=key)


def test_repair(spark, rows):
    df = spark.createDataFrame([(c, t, r, x, 1, 2) for c, t, r, x in rows], SCHEMA + ", _fault int, audit int")
    parts = defaultdict(list)
    for r in conversations.repair(df).collect():
        parts[r["conv_id"]].append((r["place"], r["role"], r["text"]))
    spaced = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    want = {r[0]: r[-1] for r in report(spaced, spaced)}
    for c, sha in want.items():
        made = [f"{r}:{x}" for _, r, x in sorted(parts[c])]
        assert hashlib.sha256("\n".join(made).encode()).hexdigest() == sha
        assert LEGAL.fullmatch("".join(m[0] for m in made))


def test_no_rows(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert conversations.report(conversations.damaged(none), none.select("conv_id")).count() == 0 and conversations.repair(none).count() == 0
    dropped = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    df = spark.createDataFrame([(dropped, 0, "user", "Gone.")], SCHEMA)
    assert [tuple(r) for r in conversations.report(conversations.damaged(df), df.select("conv_id")).collect()] == [(dropped, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
