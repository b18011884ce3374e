"""Lines of one and two words against all pairs of lines, in op2 and in the pipeline's stage."""

from __future__ import annotations

import random

import corpus_pipeline
from meridia.llm import line_dedup, queries


def made():
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(30)]
    rows = []
    for d in range(40):
        lines = []
        for _ in range(rng.randrange(1, 9)):
            w = [rng.choice(vocabulary) for _ in range(rng.choice((1, 1, 2, 2, 3, 4, 5, 9)))]
            lines.append(" ".join(w * rng.choice((1, 1, 3))))
        rows.append((d, "\n".join(lines)))
    return rows + [(50, "w1\n w1 w1\t\nw1 w2\nw2 w1 w2"), (51, ""), (52, "\n \n"), (53, None), (54, "x " * 9000 + "\nx"), (54, "solo")]


def brute(rows, num=80, den=100):
    lines = sorted((d, i, frozenset(x.split())) for d, t in rows if t is not None for i, x in enumerate(t.encode().split(b"\n")))
    lines = [x for x in lines if x[2]]
    return {(d, no) for i, (d, no, s) in enumerate(lines) if any(den * len(s & t) >= num * len(s | t) and (e, o) < (d, no) for e, o, t in lines[:i])}


def less(rows, gone):
    return sorted((d, None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if (d, i) not in gone)) for d, t in rows)


def test_short_lines_as_all_pairs(spark):
    rows = made()
    docs, gone = spark.createDataFrame(rows, "doc_id long, text string"), brute(rows)
    for how in ({}, {"first": 1, "frequent": 8, "most": 50, "heads": 2}):
        assert {tuple(r) for r in line_dedup.later_lines(docs, min_words=1, **how).collect()} == gone
    short = {(d, i) for d, t in rows if t for i, x in enumerate(t.split("\n")) if 0 < len(set(x.split())) < 3}
    assert len(gone & short) > 20


def test_op2_and_the_stage_take_them(spark, tmp_path):
    rows = made()
    docs, want = spark.createDataFrame(rows, "doc_id long, text string"), less(rows, brute(rows))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    key = lambda r: (r[0], r[1] or "")
    got = queries.op2_line_dedup(spark, str(tmp_path)).select("doc_id", "text").collect()
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    stage = corpus_pipeline.dedup_lines(spark, docs.selectExpr("*", "length(text) as n_chars"), str(tmp_path)).collect()
    assert {(r["doc_id"], r["text"]) for r in stage if r["text"] and r["text"].split()} == {(d, t) for d, t in want if t and t.split()}
