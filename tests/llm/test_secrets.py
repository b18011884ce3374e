"""Secret scans: what a forest that doesn't see names makes of unnamed secrets and of named harmless strings."""

from __future__ import annotations

import random

from meridia.llm import secret_scan


def made():
    rng, rows, truth = random.Random(5), [], {}
    words = ["der", "anstalt", "und", "river", "mountain", "speak", "of", "internationalization", "counterrevolutionaries", "misunderstandings"]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    code = lambda: "".join(rng.choice("0123456789abcdef") for _ in range(40))
    for i in range(200):
        kind = ("named", "plain", "number", "plain", "bare" if i % 50 == 4 else "number", "harmless" if i % 40 == 5 else "plain")[i % 6]
        if kind == "named":
            x, text = code(), '{} token = "{}" {}'
        elif kind == "bare":
            x, text = code(), "{} {} {}"
        elif kind == "number":
            x, text = "".join(rng.choice("0123456789") for _ in range(16)), "{} {} {}"
        elif kind == "harmless":
            x, text = rng.choice(words[-3:]), '{} token = "{}" {}'
        else:
            x, text = rng.choice(words[-3:]), "{} {} {}"
        rows.append((i, text.format(say(8), x, say(8))))
        truth[i] = (kind, x)
    return rows, truth


def test_names_are_no_feature(spark):
    rows, truth = made()
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as features", "2 as named", "3 as score", "4 as label")
    got = secret_scan.scan(docs).collect()
    said = {}
    for r in got:
        if rows[r["doc_id"]][1].encode()[r["start"] : r["start"] + r["length"]].decode() == truth[r["doc_id"]][1]:
            said.setdefault(truth[r["doc_id"]][0], []).append(r["secret"])
    true = sum(said["named"]) + sum(said["bare"])
    assert true / (len(said["named"]) + len(said["bare"])) >= 0.95, said  # recall, the unnamed ones included
    wrong = sum(r["secret"] for r in got) - true
    assert wrong / sum(r["secret"] for r in got) <= 0.05, said  # the named harmless ones included


def test_passwords_with_other_marks(spark):
    rows = [(1, 'password = "p$9!kX#2@mQ"'), (2, "see https://user:hunter2hunter2@host.example.com/x"), (3, None), (4, ""), (None, 'token = "0123456789abcdef0123"'), (1, 'password = "p$9!kX#2@mQ"')]
    got = secret_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or 0, r["length"]) for r in got) == [(0, 20), (1, 11), (1, 11), (2, 14)]


def test_long_text(spark):
    docs = spark.createDataFrame([(1, "ab " * 300_000 + 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"'), (2, "x" * 1_000_000)], "doc_id long, text string")
    got = {r["doc_id"]: (r["start"], r["length"]) for r in secret_scan.scan(docs).collect()}
    assert got == {1: (900_009, 40), 2: (0, 1_000_000)}
