"""The trie of conversations against plain Python, with oversized parts and odd rows."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import pytest

from meridia.llm import prefix_trie, queries

SCHEMA = "conv_id long, turn long, role string, text string"
NAMES = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def brute(rows, rebuild=True):
    turns = {}
    for c, t, role, text in rows:
        if c is not None:
            digest = hashlib.md5(f"{len((role or '').encode())}:{role or ''}{text or ''}".encode()).hexdigest()
            turns.setdefault(c, []).append(((t is not None, t or 0), digest, (role or "", text or "")))
    turns = {c: [x[2] for x in sorted(v)] for c, v in turns.items()}
    made = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 4 if rebuild else 0
        first = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        made[c] = tuple(turns.get(first, [])[:h] + own[h:])
    members = {}
    for c, q in made.items():
        for d in range(len(q) + 1):
            members.setdefault(q[:d], []).append(c)
    out = []
    for p, who in members.items():
        below = [q for q in members if q[: len(p)] == p]
        words = lambda q: len(re.findall(r"[^\x20\x09-\x0D]+", q[-1][1])) if q else 0
        ends = ",".join(map(str, sorted(c for c in who if made[c] == p)))
        leaves = [q for q in below if not any(len(x) == len(q) + 1 and x[: len(q)] == q for x in below)]
        out.append((min(who), len(p), min(members[p[:-1]]) if p else None, len(who), sum(len(x) == len(p) + 1 for x in below), len(leaves), sum((len(members[q]) - 1) * words(q) for q in below), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def found(spark, rows, **how):
    out = prefix_trie.conversation_trie(spark.createDataFrame(rows, SCHEMA), **how)
    assert tuple(out.columns[:8]) == ("conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256", "parent_conv_id") or set(out.columns) == set(NAMES)
    return sorted((tuple(r[c] for c in NAMES) for r in out.collect()), key=str)


@pytest.mark.parametrize("most", [1, 7, 40, 10_000])
def test_against_plain_python(spark, most):
    rng = random.Random(most)
    rows = [(c, t, rng.choice(["user", "bot"]), " ".join(rng.choice("ab") for _ in range(rng.randint(1, 3)))) for c in range(70) for t in range(rng.randint(1, 6))]
    assert found(spark, rows, most_turns=most) == brute(rows)


def test_one_first_turn_and_one_conversation_for_most(spark):
    same = [(c, t, "user", f"turn {t} of all") for c in range(100, 400) for t in range(4)]
    rows = same + [(c, 0, "user", "turn 0 of all") for c in range(400, 460)] + [(c, 1, "bot", f"own {c % 30}") for c in range(400, 460)] + [(460, t, "bot", "long") for t in range(60)]
    assert found(spark, rows, rebuild=False, most_turns=20) == brute(rows, rebuild=False)


def test_odd_rows(spark):
    rows = [(0, None, "user", "first"), (0, 0, None, "x  y\n"), (0, 1, "user", None), (0, 1, "user", None), (20, 5, "", ""), (20, 5, "bot", "z"), (None, 0, "user", "nobody"), (41, 0, "user", "alone"), (-25, 0, "user", "below zero"), (-25, 1, "user", "again"), (7, 0, "user", "w " * 50_000)]
    assert found(spark, rows) == brute(rows)
    assert found(spark, []) == []
    extra = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as path", "2 as words", "3 as n", "4 as at", "5 as depth", "'k' as key")
    assert sorted((tuple(r[c] for c in NAMES) for r in prefix_trie.conversation_trie(extra).collect()), key=str) == brute(rows)


def test_turnless_conversations_are_members_of_the_root(spark):
    # no conversation 20, and so few own turns that nothing is left of some
    rows = [(c, 0, "user", "hello") for c in range(21, 39)]
    got = found(spark, rows)
    assert got == brute(rows)
    root = next(r for r in got if r[1] == 0)
    assert root[3] == 18 and root[7] != prefix_trie.EMPTY


def test_a_path_longer_than_any_stack(spark):
    rows = [(c, t, "user", "go") for c in (1, 2) for t in range(3000)]
    got = found(spark, rows, rebuild=False)
    assert len(got) == 3001 and max(r[1] for r in got) == 3000 and next(r for r in got if r[1] == 0)[6] == 3000


def test_registered_query(spark):
    assert queries.op11_prefix_trie(spark, "/root/testdata/sf0.001").count() > 1
