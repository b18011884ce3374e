"""Line deduplication against all pairs of lines."""

from __future__ import annotations

import random

from meridia.llm import line_dedup


def brute(rows, num=80, den=100, least=3):
    lines = sorted((d, i, frozenset(x.split())) for d, t in rows if d is not None and t is not None for i, x in enumerate(t.encode().split(b"\n")))
    lines = [x for x in lines if len(x[2]) >= least]
    gone = set()
    for i, (d, no, s) in enumerate(lines):
        if any(den * len(s & t) >= num * len(s | t) and (e, o) < (d, no) for e, o, t in lines[:i]):
            gone.add((d, no))
    return gone


def made():
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(200)]
    base = [[rng.choice(vocabulary) for _ in range(rng.choice((2, 3, 4, 8, 15, 40)))] for _ in range(40)]
    rows = []
    for d in range(60):
        text = []
        for _ in range(rng.randrange(1, 12)):
            w = list(rng.choice(base))
            for _ in range(rng.choice((0, 0, 1, 2, 3))):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            text.append(" ".join(w))
        rows.append((d, "\n".join(text)))
    return rows + [(100, None), (101, ""), (102, "\n\n \n"), (None, "w1 w2 w3 w4"), (103, "a b c " * 5000), (104, "c b a a a"), (3, rows[3][1]), (105, "é " * 3 + "\x0b x y z\r")]


def test_same_lines_as_all_pairs(spark):
    rows = made()
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as n", "2 as first")
    for how in ({}, {"first": 1}, {"frequent": 8}, {"first": 1, "frequent": 8, "most": 60, "heads": 3}):
        assert {tuple(r) for r in line_dedup.later_lines(docs, **how).collect()} == brute(rows)
    gone = brute(rows)
    out = line_dedup.dedup_lines(docs)
    assert out.columns == ["doc_id", "text", "n", "first", "n_lines", "n_removed"]
    want = sorted((d, None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if (d, i) not in gone)) for d, t in rows if d is not None)
    assert sorted(((r["doc_id"], r["text"]) for r in out.where("doc_id is not null").collect()), key=lambda r: (r[0], r[1] or "")) == sorted(want, key=lambda r: (r[0], r[1] or ""))
    assert out.count() == len(rows)


def test_empty_table(spark):
    assert line_dedup.dedup_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0
