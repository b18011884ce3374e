"""Spaced seeds against a direct search."""

from __future__ import annotations

import random
import re

from meridia.llm import decontaminate


def words(text):
    return [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]


def brute(docs, items, window=15, percent=80, least=8):
    out = {}
    for d, text in docs:
        w = words(text)
        for item, passage in items:
            v = words(passage)
            m = min(window, len(v))
            if len(v) < least or text is None:
                continue
            for mask in decontaminate.MASKS:
                ones = [i for i, x in enumerate(mask) if x == "1"]
                for i in range(len(w) - len(mask) + 1):
                    for j in range(len(v) - len(mask) + 1):
                        if all(w[i + k] == v[j + k] for k in ones):
                            same = [0 <= i - j + k < len(w) and w[i - j + k] == v[k] for k in range(len(v))]
                            best = max(sum(same[s : s + m]) for s in range(max(0, j - m + 1), min(j, len(v) - m) + 1))
                            if best * 100 >= m * percent:
                                out[d, item] = max(out.get((d, item), (0, 0)), (best, m))
    return sorted(((*k, *v) for k, v in out.items()), key=str)


def test_same_pairs_as_direct_search(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(n))) for i, n in enumerate((3, 7, 8, 9, 12, 15, 16, 40, 60, 8))]
    items += [(90, None), (91, ""), (92, items[5][1]), (5, items[5][1]), (93, "the " * 20)]
    docs = []
    for d in range(80):
        w = [rng.choice(vocabulary) for _ in range(rng.choice((0, 5, 40, 120)))]
        passage = words(rng.choice(items)[1])
        for _ in range(rng.choice((0, 0, 1, 2, 3, 8))):
            if passage:
                passage[rng.randrange(len(passage))] = rng.choice(vocabulary)
        at = rng.randrange(len(w) + 1)
        docs.append((d, "  ".join([*w[:at], *[x.upper() + "," for x in passage[rng.choice((0, 0, 4)) :]], *w[at:]])))
    docs += [(None, items[7][1]), (200, None), (201, ""), (3, docs[3][1]), (202, "The " * 3000)]
    left, right = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as item_id", "2 as seed"), spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items)
    assert len(want) > 30
    for most in (1_000_000, 0):
        got = decontaminate.find_leaks(left, right, most_broadcast=most)
        assert sorted(map(tuple, got.collect()), key=str) == want
    kept = decontaminate.drop_leaks(left, right)
    bad = {r[0] for r in want}
    assert sorted(str(r[0]) for r in kept.collect()) == sorted(str(d) for d, _ in docs if d not in bad) and kept.columns == left.columns


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b c d e f g h i")], "item_id long, text string")
    assert decontaminate.find_leaks(none, items).count() == 0
    assert decontaminate.drop_leaks(items.withColumnRenamed("item_id", "doc_id"), items.limit(0)).count() == 1
