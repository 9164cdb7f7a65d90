"""Trie, cells and pairs of similar texts against nested loops."""

import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from nameforge.functions.similarity import lcs
from nameforge.operators import cells, near, trie

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi pi rho sigma tau phi chi psi omega".split()


def texts(rng, n):
    seeds = [" ".join(rng.choice(WORDS) for _ in range(rng.randrange(5, 30))) for _ in range(12)]
    out = []
    for _ in range(n):
        t = list(rng.choice(seeds))
        for _ in range(rng.choice([0, 0, 1, 3, 8])):
            at = rng.randrange(len(t))
            t[at : at + rng.randrange(2)] = rng.choice("abcé𝒳")
        out.append("".join(t))
    return [*out, "", "", "a" * 40_000, "a" * 39_000]


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60), st.text(max_size=60))
def test_codes_keep_the_budget(a, b):
    h = trie.histograms([a, b]).astype(int)
    assert np.abs(h[0] - h[1]).sum() <= len(a) + len(b) - 2 * lcs(a, b)


@pytest.mark.parametrize(("leaf", "most"), [(1, 40), (4, 1 << 18), (16, 300)])
def test_trie_is_the_nested_loop(leaf, most):
    rng = random.Random(leaf)
    t = texts(rng, 150)
    h = trie.histograms(t)
    root = np.array([rng.randrange(3) for _ in t])
    length = np.array([len(x) for x in t])
    loc = np.array([rng.choice([0, 5, 10, 11, 13, 20]) for _ in t])
    tree = trie.Trie(h, root, [(length, length), (loc, loc)], leaf)
    got = Counter()
    for u, v in ((0, 0), (1, 2)):
        for i, j in tree.pairs(np.array([u]), np.array([v]), (1, 10), [(3, 10)], most):
            got.update((min(x, y), max(x, y)) for x, y in zip(i.tolist(), j.tolist(), strict=True))
    want = Counter()
    for j in range(len(t)):
        for i in range(j):
            if {root[i], root[j]} in ({0}, {1, 2}) and 10 * abs(loc[i] - loc[j]) <= 3 * max(loc[i], loc[j]):
                if 10 * np.abs(h[i].astype(int) - h[j]).sum() <= len(t[i]) + len(t[j]):
                    want[i, j] += 1
    assert got == want and max(want.values()) == 1


def test_trie_of_nothing():
    none = np.zeros(0, np.int64)
    t = trie.Trie(trie.histograms([]), none, [(none, none)])
    assert list(t.pairs(none, none, (1, 10), [])) == []


@pytest.mark.parametrize("cap", [4000, 9])
def test_every_pair_meets_once(spark, cap):
    rng = random.Random(3)
    rows = [(i, rng.choice("xxxy"), rng.choice([0, 1, 4, 5, 6, 7, 10, 14, 20, 30, 90])) for i in range(140)]
    df = spark.createDataFrame(rows, "id long, block string, size int")
    got = cells.self_cells(df, df, "block", "id", cap, "size", (3, 10)).collect()
    by = {}
    for r in got:
        by.setdefault((r["block"], *(r[c] for c in cells.CELL)), []).append(r)
    met = Counter()
    for members in by.values():
        for x in members:
            for y in members:
                if x["id"] < y["id"] and (x["side"] == y["side"] == 0 or {x["side"], y["side"]} == {1, 2}):
                    met[x["id"], y["id"]] += 1
        assert cap > 100 or len(members) < 6 * cap
    want = {(i, j) for i, b, s in rows for j, c, t in rows if i < j and b == c and 10 * abs(s - t) <= 3 * max(s, t)}
    assert want <= set(met) and max(met.values()) == 1


@pytest.mark.parametrize("cap", [4000, 15])
def test_pairs(spark, cap):
    rng = random.Random(8)
    rows = [(i, rng.choice("pppq"), rng.choice([10, 12, 20]), t) for i, t in enumerate(texts(rng, 120))]
    df = spark.createDataFrame(rows, "id long, block string, loc long, text string").repartition(3)
    got = near.pairs(df, df, (21, 200), ["loc"], [(3, 10)], cap).collect()
    want = {}
    for i, b, s, x in rows:
        for j, c, t, y in rows:
            d = len(x) + len(y) - 2 * lcs(x, y) if i < j and b == c else None
            if d is not None and 10 * abs(s - t) <= 3 * max(s, t) and 200 * d <= 21 * (len(x) + len(y)):
                want[i, j] = d
    assert {(r["a"], r["b"]): r["d"] for r in got} == want and len(got) == len(want)
    assert near.pairs(df.where("false"), df.where("false"), (1, 10), ["loc"], [(3, 10)], cap).count() == 0
    assert near.pairs(df.withColumn("text", F.lit("")), df, (1, 10), [], [], cap).count() == sum(b == c for i, b, *_ in rows for j, c, *_ in rows if i < j)
