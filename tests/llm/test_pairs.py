"""The n-gram join against all pairs."""

from __future__ import annotations

import random
import re

import pytest

from meridia.llm import ngram_join


def word_sets(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute(rows, k, num, den):
    sets = [word_sets(t, k) for _, t in rows]
    up = {d: d for d, _ in rows if d is not None}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, (a, _) in enumerate(rows):
        for j in range(i):
            b, s, t = rows[j][0], sets[i], sets[j]
            if None not in (a, b) and s and t and den * len(s & t) >= num * len(s | t):
                x, y = top(a), top(b)
                up[max(x, y)] = min(x, y)
    return sorted(((d, len(s), None if d is None else top(d)) for (d, _), s in zip(rows, sets)), key=str)


def made(seed, n=160):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    base = [[rng.choice(vocabulary) for _ in range(rng.choice((3, 8, 30, 90, 300)))] for _ in range(12)]
    rows = []
    for i in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.choice((0, 0, 1, 1, 2, 4, 8))):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        rows.append((i, " ".join(w)))
    rows += [(1000, None), (1001, ""), (1002, " \t "), (1003, "One"), (1004, "one"), (None, "one"), (None, None)]
    rows += [(5, rows[5][1]), (5, rows[40][1]), (1005, "x " * 9000)]
    return rows


@pytest.mark.parametrize(("seed", "k", "num", "how"), [(1, 4, 85, {}), (2, 5, 80, {"often": 0}), (3, 4, 85, {"often": 0}), (4, 2, 60, {"often": 0}), (5, 2, 60, {"often": 0, "first": 1}), (6, 2, 70, {"first": 1, "heads": 3, "most": 200})])
def test_same_components_as_all_pairs(spark, seed, k, num, how):
    rows = made(seed)
    got = ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as entry"), k=k, num=num, **how)
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows, k, num, 100)


@pytest.mark.parametrize("limit", [0, 3, 60])
@pytest.mark.parametrize("num", [55, 80, 85, 95])
def test_linked_sets_share_an_entry(limit, num):
    import numpy as np

    rng = np.random.default_rng(num + limit)
    bounds = ngram_join.levels(num, 100)
    for _ in range(300):
        n = int(rng.integers(1, 150))
        pool = rng.integers(0, 2**63, 400).astype(np.uint64)
        x = np.unique(rng.choice(pool, n, replace=False))
        change = int(rng.integers(0, 1 + n * (100 - num) // 100))
        y = np.unique(np.concatenate([x[rng.permutation(len(x))[change:]], rng.choice(pool, int(rng.integers(0, change + 1)))]))
        if not len(y) or 100 * len(np.intersect1d(x, y)) < num * len(np.union1d(x, y)):
            continue
        rare = lambda s: (s % np.uint64(7)).astype(np.uint8)
        e, f = (ngram_join.prefix_entries(s, rare(s), limit, num, 100, bounds) for s in (x, y))
        assert len(np.intersect1d(e, f))


def test_empty_table(spark):
    assert ngram_join.jaccard_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_first_of_each_group_stays(spark):
    rows = [(3, "a b c d e f g"), (1, "a b c d e f g"), (2, "other words"), (4, None)]
    assert sorted(r[0] for r in ngram_join.keep_first(spark.createDataFrame(rows, "doc_id long, text string")).collect()) == [1, 2, 4]
