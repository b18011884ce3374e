"""Chunks and spans of substring deduplication against plain Python."""

import hashlib
import random

from meridia.llm import chunk_dedup


def _texts():
    r = random.Random(3)
    words = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 9))) for _ in range(900)]
    some = lambda n: " ".join(r.choice(words) for _ in range(n))
    shared = [some(60) for _ in range(12)]
    rows = [(i, f"{some(r.randint(0, 90))} {r.choice(shared)} {some(r.randint(0, 90))}") for i in range(60)]
    rows += [(60, rows[0][1]), (61, shared[0] + " " + shared[0]), (62, ""), (63, None), (64, "x"), (65, "z" * 3000), (None, shared[1])]
    return shared, rows


def _expected(rows, least):
    chunks = []
    for doc, text in rows:
        if doc is not None and text is not None:
            raw, a = text.encode(), 0
            for b in chunk_dedup.cuts(raw):
                chunks.append((doc, a, b, hashlib.sha1(raw[a:b]).digest()))
                a = b
    first, spans = {}, []
    for doc, a, b, key in sorted(chunks):
        source = first.setdefault(key, (doc, a))
        if source == (doc, a):
            continue
        if spans and spans[-1][0] == doc and spans[-1][2] == a:
            spans[-1] = (doc, spans[-1][1], b, spans[-1][3] | {source[0]})
        else:
            spans.append((doc, a, b, {source[0]}))
    return sorted((d, a, b - a, sorted(s)) for d, a, b, s in spans if b - a >= least)


def test_chunks_cover_the_text():
    for text in (b"", b"x", b"a" * 5000, " ".join(map(str, range(4000))).encode()):
        ends = chunk_dedup.cuts(text)
        assert [b - a for a, b in zip([0, *ends], ends)] == [n for n in (b - a for a, b in zip([0, *ends], ends)) if 0 < n <= chunk_dedup.MOST]
        assert (ends[-1] if ends else 0) == len(text)


def test_chunks_resist_insertions():
    text = " ".join(map(str, range(4000))).encode()
    pieces = lambda t: {t[a:b] for a, b in zip([0, *chunk_dedup.cuts(t)], chunk_dedup.cuts(t))}
    before, after = pieces(text), pieces(text[:5000] + b" inserted " + text[5000:])
    assert len(before & after) > 0.95 * len(before)


def test_spans_against_plain_python(spark):
    _, rows = _texts()
    docs = spark.createDataFrame([(d, t, "extra") for d, t in rows], "doc_id long, text string, start string").repartition(5)
    got = sorted((r["doc_id"], r["start"], r["length"], list(r["source_ids"])) for r in chunk_dedup.repeated_spans(docs).collect())
    assert got == _expected(rows, 80)
    assert any(d == 60 and n == len(rows[0][1].encode()) for d, _, n, _ in got)


def test_no_rows(spark):
    assert chunk_dedup.repeated_spans(spark.createDataFrame([], "doc_id long, text string")).count() == 0
