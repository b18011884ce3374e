"""Packing: plans against exact optima, ids against the tokenizer, and whole round trips."""

from __future__ import annotations

import random
import zlib
from functools import cache

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from meridia.llm import packing, queries

PATH = public_tokenizers.path("word_bpe_49k.json")


def bins_of(plan, counts):
    seen, bins = {}, {}
    for length, first, n, sequence, copies, offset in plan.rows:
        assert seen.get(length, 0) == first  # ranks are given out in a row
        seen[length] = first + n
        for k in range(n):
            bins.setdefault(sequence + k // copies, []).append((offset + k % copies * length, length))
    assert seen == {k: v for k, v in counts.items() if v} and set(bins) == set(range(plan.sequences))
    return bins


def fewest(counts, capacity):
    """The least number of bins, by search over what is left."""

    @cache
    def solve(left):
        rest = dict(left)
        items = sorted((k for k in rest if rest[k]), reverse=True)
        if not items:
            return 0
        best = 99

        def fill(room, top, now):
            nonlocal best
            options = [k for k in items if k <= min(room, top) and now[k]]
            if not options:  # nothing more fits: maximal bins are enough
                best = min(best, 1 + solve(tuple(sorted((k, v) for k, v in now.items() if v))))
            for k in options:
                fill(room - k, k, now | {k: now[k] - 1})

        fill(capacity - items[0], items[0], rest | {items[0]: rest[items[0]] - 1})
        return best

    return solve(tuple(sorted(counts.items())))


@settings(max_examples=60, deadline=None)
@given(st.integers(3, 40), st.randoms(use_true_random=False))
def test_reduction_keeps_an_optimum(capacity, rng):
    counts = {rng.randint(1, capacity): rng.randint(1, 2) for _ in range(5)}
    plan = packing.Plan(np.array([counts.get(i, 0) for i in range(capacity + 1)]))
    packing._reduce(plan, capacity)
    left = {i: int(n) for i, n in enumerate(plan.left) if n}
    assert plan.sequences + fewest(left, capacity) == fewest(counts, capacity)


def test_plans_hold_every_piece_without_gaps():
    rng = random.Random(3)
    for _ in range(300):
        capacity = rng.randint(2, 60)
        counts = {rng.randint(1, capacity): rng.randint(1, 9) for _ in range(rng.randint(0, 12))}
        plan = packing.make_plan(counts, capacity)
        for pieces in bins_of(plan, counts).values():
            end = 0
            for offset, length in sorted(pieces):
                assert offset == end
                end += length
            assert end <= capacity
        total = sum(k * v for k, v in counts.items())
        assert plan.sequences <= 11 / 9 * max(1, -(-total // capacity)) * 1.5 + 1


def test_plans_do_not_grow_with_the_number_of_pieces():
    rng = np.random.default_rng(0)
    lengths, n = np.unique(np.minimum(4096, rng.lognormal(6, 1.2, 100_000).astype(int) + 1), return_counts=True)
    few, many = (packing.make_plan(dict(zip(lengths.tolist(), (n * k).tolist())), 4096) for k in (1, 1_000_000))
    assert len(many.rows) < 2 * len(few.rows) < 60_000
    assert many.sequences < 1.001 * (lengths * n).sum() / 4096 * 1_000_000


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(codec="utf-8"), max_size=60) | st.text("aB'stvemdl .,!é<|>0²\n\t\x85\xa0\x1c-ÀßİǅΣ", max_size=60))
def test_ids_by_words_are_the_tokenizers(text):
    got = packing.Ids(PATH, True)([text, "the same word word"])[0]
    assert np.frombuffer(got, "<u4").tolist() == Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids


def test_forgetting_words_changes_nothing():
    texts = [f"word{i} of many{i * 7}" for i in range(200)]
    small, plain = packing.Ids(PATH, True, most_words=50), packing.Ids(PATH, False)
    assert [small([x])[0] for x in texts] == plain(texts) and small(texts) == plain(texts)


def whole(spark, docs, capacity):
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as length", "2 as task", "3 as rank", "4 as n", "5 as piece").repartition(3)
    return packing.pack(df, PATH, capacity=capacity, by_words=True, chars=2_000).collect()


@pytest.mark.parametrize("capacity", [5, 64, 4096])
def test_pieces_are_whole(spark, capacity):
    rng = random.Random(capacity)
    docs = [(i, " ".join(rng.choices(["Hello", "wörld,", "it's", "42", "日本", "x"], k=rng.randint(0, 90)))) for i in range(150)] + [(200, None), (201, ""), (202, "a " * 9000), (203, "a " * (capacity - 1)), (204, "a " * (2 * capacity - 1)), (205, "zz" * 40_000)]
    rows, t = whole(spark, docs, capacity), Tokenizer.from_file(PATH)
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert set(by_doc) == {i for i, _ in docs}
    for i, text in docs:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        pieces = sorted(by_doc[i], key=lambda r: r["piece"])
        assert [r["piece"] for r in pieces] == list(range(-(-len(ids) // capacity)))
        for r in pieces:
            part = ids[r["start"] : r["start"] + r["length"]]
            assert r["start"] == r["piece"] * capacity and len(part) == min(capacity, len(ids) - r["start"]) == r["length"] and r["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes())
    for pieces in by_sequence.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end <= capacity


def test_repeated_and_null_ids_and_empty_tables(spark):
    rows = whole(spark, [(1, "same text"), (1, "same text"), (None, "nobody"), (None, None)], 8)
    assert sorted(r["length"] for r in rows if r["doc_id"] == 1) == [3, 3] and sum(r["doc_id"] is None for r in rows) == 2
    assert len({(r["sequence_id"], r["offset"]) for r in rows}) == 4
    assert whole(spark, [], 8) == []


def test_registered_query_fills_its_sequences(spark):
    rows = queries.op13_packing(spark, "/root/testdata/sf0.001").collect()
    total = sum(r["length"] for r in rows)
    assert len({r["sequence_id"] for r in rows}) <= 1.02 * total / 4096 + 1
