"""Leaks by every alignment, with no seeds: the masks must miss none."""

from __future__ import annotations

import itertools
import random
import re

from meridia.llm import decontaminate


def words(text):
    return [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]


def test_every_allowed_pattern_leaves_a_seed():
    for w in range(8, 16):
        for bad in itertools.combinations(range(w), w - -(-w * 80 // 100)):
            assert any(all(m == "0" or at + k not in bad for k, m in enumerate(mask)) for mask in decontaminate.MASKS for at in range(w - len(mask) + 1)), (w, bad)


def brute(docs, items, window=15, percent=80, least=8):
    out = {}
    for d, text in docs:
        x = words(text)
        for item, passage in items:
            v = words(passage)
            m = min(window, len(v))
            for shift in range(-len(v) + 1, len(x)) if len(v) >= least else ():
                same = [0 <= shift + k < len(x) and x[shift + k] == v[k] for k in range(len(v))]
                best = max(sum(same[s : s + m]) for s in range(len(v) - m + 1))
                if best * 100 >= m * percent:
                    out[d, item] = max(out.get((d, item), (0, 0)), (best, m))
    return sorted((*k, *v) for k, v in out.items())


def test_same_pairs_as_every_alignment(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(500)]
    items = [(n, " ".join(rng.choice(vocabulary) for _ in range(n))) for n in (*range(8, 26), 40)]
    docs, bad = [], list(itertools.combinations(range(15), 3))
    for d in range(300):
        passage = words(rng.choice(items)[1])
        m = min(15, len(passage))
        at = rng.randrange(len(passage) - m + 1)
        gone = [at + k for k in bad[rng.randrange(len(bad))]] if m == 15 else rng.sample(range(m), m // 5)
        gone += [k for k in range(len(passage)) if not at <= k < at + m and rng.random() < 0.4]
        for k in gone:
            passage[k] = f"x{rng.randrange(10**6)}"
        around = [rng.choice(vocabulary) for _ in range(rng.choice((0, 3, 30)))]
        docs.append((d, " ".join([*around, *passage, *around])))
    passage = words(dict(items)[15])
    docs.append((900, " ".join("other" if k in (0, 5, 8) else x for k, x in enumerate(passage))))
    docs.append((901, " ".join("other" if k in (5, 8) else x for k, x in enumerate(passage))))
    docs.append((902, " ".join(passage[1:13])))
    want = brute(docs, items)
    assert {r[0] for r in want} == {d for d, _ in docs}
    left, right = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for most in (1_000_000, 0):
        assert sorted(map(tuple, decontaminate.find_leaks(left, right, most_broadcast=most).collect())) == want
