"""Importance resampling against plain Python, with n-grams and odd rows."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from meridia.llm import resampling
from meridia.llm._common import Scratch

FOLD = str.maketrans(resampling.UPPER, resampling.LOWER)


def features(text, sizes):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(FOLD))
    return len(w), [" ".join(w[i : i + n]) for n in range(sizes[0], sizes[1] + 1) for i in range(len(w) - n + 1)]


def brute(docs, target, share=0.1, least=20, sizes=(1, 1), buckets=10_000, seed=2024):
    docs = [(i, *features(x, sizes)) for i, x in docs if i is not None]
    hashed = lambda g: zlib.crc32(g.encode()) % buckets
    s, t = Counter(hashed(g) for _, _, f in docs for g in f), Counter(hashed(g) for x in target for g in features(x, sizes)[1])
    ss, tt = float(sum(s.values()) + buckets), float(sum(t.values()) + buckets)
    gain = [math.floor(1000 * math.log((t[b] + 1.0) * ss / ((s[b] + 1.0) * tt))) for b in range(buckets)]
    rows = []
    for i, n, f in docs:
        weight = sum(gain[hashed(g)] for g in f)
        h = int(hashlib.sha256(f"{seed}:{i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    able = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], r[0]))
    for k, r in enumerate(able[: math.floor(len(able) * share + 1e-9)]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in rows), key=str)


def run(spark, docs, target, **how):
    docs = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as n_words", "2 as buckets", "3 as rank", "4 as at", "5 as times", "6 as id").repartition(3)
    target = spark.createDataFrame([(x,) for x in target], "text string")
    out = resampling.resample(docs, target, **how)
    assert out.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    return sorted(map(tuple, out.collect()), key=str)


@pytest.mark.parametrize(("sizes", "buckets"), [((1, 1), 10_000), ((1, 2), 10_000), ((2, 3), 97)])
def test_against_plain_python(spark, sizes, buckets):
    rng = random.Random(buckets + sizes[1])
    words = ["Alpha", "beta", "Élan", "naïve", "x9", "日本", "gamma", "delta"]
    docs = [(i, ", ".join(rng.choices(words, k=rng.randint(1, 60)))) for i in range(120)]
    target = [" ".join(rng.choices(words[:3], k=30)) for _ in range(5)]
    assert run(spark, docs, target, ngrams=sizes, buckets=buckets, chars=500) == brute(docs, target, sizes=sizes, buckets=buckets)


def test_odd_rows(spark):
    long = "word other " * 100_000
    docs = [(1, None), (2, ""), (3, "!!! ... \x00 \x0b"), (4, "same text " * 20), (5, "same text " * 20), (5, "same text " * 20), (None, "nobody " * 30), (6, long), (-7, "ÀÉ ß " * 12), (8, "x" * 300_000)]
    target = ["same text", None, "", "word " * 40]
    for share in (0.1, 0.5, 1.0, 0.0):
        assert run(spark, docs, target, share=share) == brute(docs, target, share=share)
    assert run(spark, [], target) == []
    assert run(spark, docs, []) == brute(docs, [])


def test_ranks_of_a_sorted_table_are_in_a_row(spark):
    df = spark.range(5000).selectExpr("id", "id % 7 as v").repartition(9)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # ranges are small here
    try:
        out = resampling.rank_rows(df, Scratch(spark, "ranks"), [df["v"].desc(), df["id"].asc()])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    rows = sorted(map(tuple, out.select("rank", "v", "id").collect()))
    assert [r[0] for r in rows] == list(range(1, 5001)) and [r[1:] for r in rows] == sorted((r[1:] for r in rows), key=lambda r: (-r[0], r[1]))


def test_documents_like_the_target_come_first(spark):
    docs = [(i, ("stars planets orbit " if i % 10 == 0 else "cake butter oven ") * 20) for i in range(100)]
    out = resampling.resample(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([("planets in orbit of stars",)], "text string"))
    assert {r["doc_id"] for r in out.where("rank is not null").collect()} == set(range(0, 100, 10))
