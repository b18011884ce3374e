"""op2's index entries, its search for few lines among many, and the shuffle files of its counts."""

from __future__ import annotations

import time

import numpy as np

from meridia.llm import line_dedup
from meridia.llm._common import Scratch, Sketch, merge_sketches, mix, rarity
from meridia.llm.ngram_join import levels, prefix_entries


def made(rng):
    """(words of lines, their numbers, levels of words): most words are frequent, some others are counted once."""
    lines = [np.sort(rng.choice(1000, n, replace=False)) for n in (*rng.integers(1, 40, 60), *rng.integers(40, 400, 40))]
    words = mix(np.arange(1000, dtype=np.uint64)) >> np.uint64(64 - line_dedup.BITS)
    rows = np.zeros((2, 1 << 16), np.uint8)
    for w, level in zip(words, np.where(np.arange(1000) < 900, 30, rng.integers(1, 20, 1000))):
        for row, at in zip(rows, Sketch.places(mix(np.array([w])), 1 << 16)):
            row[at] = np.maximum(row[at], level)
    return np.concatenate([words[x] for x in lines]), np.array([len(x) for x in lines]), rows


def test_entries_of_all_lines_as_of_each():
    token, size, rows = made(np.random.default_rng(3))
    x, limit, bounds = line_dedup._Ordered(token, size, rows), 21, levels(80, 100)
    key, line, at, word, other = x.entries(80, 100, limit, bounds)
    assert (at < 0).sum() > 100 and (x.token[word][at >= 0] == x.token[other][at >= 0]).all()
    got = {(int(i), int(k)) for i, k in zip(line, key)}
    assert len(got) == len(key)
    want, first = set(), x.prefix(80, 100)
    for i in range(len(size)):
        mine = x.line == i
        t, rare = x.token[mine], x.level[mine]
        if (rare[: first[mine][0]] > limit).any():
            e = prefix_entries(t, rare, limit, 80, 100, bounds)
            e = e[~np.isin(e, t[rare == 1])]
        else:
            e = t[: first[mine][0]][rare[: first[mine][0]] > 1]
        want |= {(i, int(k)) for k in mix(e) >> np.uint64(16)}
    assert got == want


def test_likely_loses_none_and_keeps_few(spark):
    rows = spark.range(40_000).selectExpr("id - 20000 as doc_id", "cast(id % 7 as int) as line_no", "id as other")
    wanted = Scratch(spark, "test-likely").save(rows.where("other % 400 = 3").select("doc_id", "line_no"), "wanted")
    got = {r["other"] for r in line_dedup.likely(rows, wanted).collect()}
    assert {i for i in range(40_000) if i % 400 == 3} <= got and len(got) < 500
    assert line_dedup.likely(rows, wanted.where("false")).count() == 0


def test_counts_leave_no_shuffle_files(spark):
    files = lambda: {str(x) for x in spark.sparkContext._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()) if "shuffle_" in str(x)}
    blocks = spark.createDataFrame([(b, bytearray(np.full(Sketch.BLOCK, b + 1, np.uint32).tobytes())) for b in (0, 1, 0, 2)], "block int, counts binary")
    want = merge_sketches(blocks, 2 * Sketch.BLOCK)
    before = files()
    got = merge_sketches(blocks, 2 * Sketch.BLOCK, Scratch(spark, "test-counts"))
    assert (got == want).all() and (rarity(got, np.array([0], np.uint64)) == 2).all()
    for _ in range(100):
        if not files() - before:
            break
        time.sleep(0.1)
    assert not files() - before
