"""Mined URL rules and the index that matches them, on planted combinations, against plain Python."""

from __future__ import annotations

import itertools
import math
import random
import re

from meridia.llm import url_filter


def tokens(url):
    host, _, rest = url.partition("://")[2].partition("/")
    path, _, query = rest.partition("?")
    zero = lambda s: re.sub(r"\d+", "0", s)
    return {f"h:{x}" for x in re.split(r"[.-]", zero(host)) if x} | {f"p:{x}" for x in re.split(r"[^A-Za-z0-9]+", zero(path)) if x} | {f"q:{x.split('=')[0]}" for x in zero(query).split("&") if x}


def brute_rules(rows, min_count, min_confidence, min_lift, z):
    base, seen = sum(b for _, b in rows) / len(rows), {}
    for url, bad in rows:
        t = sorted(tokens(url))
        for k in range(1, len(t) + 1):
            for c in itertools.combinations(t, k):
                x = seen.setdefault(c, [0, 0])
                x[0] += 1
                x[1] += bad
    good = set()
    for c, (n, bad) in seen.items():
        p = bad / n
        low = (p + z * z / (2 * n) - z * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)
        if bad >= min_count and p >= min_confidence and low >= min_lift * base:
            good.add(frozenset(c))
    return {c for c in good if not any(d < c for d in good)}


def made():
    rng, rows = random.Random(3), []
    for i in range(600):
        host = rng.choice(("a.example.com", "b.example.net", "casino-win.example.com", "c.example.org"))
        path = rng.choice(("en", "fr", "de"))
        url = f"https://{host}/{path}/{i}" + rng.choice(("", "?utm=1", "?page=2&ref=x"))
        # a host on its own, and a combination of a host, a path and a query field
        bad = "casino" in host and rng.random() < 0.9 or host.startswith("b.") and path == "de" and "utm" in url or rng.random() < 0.05
        rows.append((url, bool(bad)))
    return rows


def test_rules_and_matches_as_brute_force(spark):
    rows = made()
    how = {"min_count": 8, "min_confidence": 0.5, "min_lift": 2.0, "z": 2.0}
    want = brute_rules(rows, **how)
    table = spark.createDataFrame([*rows, (None, True), ("https://x.example.com/", None)], "url string, bad boolean")
    found = url_filter.mine_rules(table, **how, min_support=0.0)
    assert {frozenset(r["tokens"]) for r in found.collect()} == want
    assert frozenset({"h:casino"}) in want and any(len(c) > 1 for c in want)
    pages = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(rows)] + [(9000, None), (9001, ""), (9002, "casino"), (0, rows[0][0]), (None, rows[1][0])], "page_id long, url string").selectExpr("*", "1 as mined", "2 as host", "3 as tokens", "4 as verdict")
    got = url_filter.filter_urls(pages, table, rules=(), **how, min_support=0.0).collect()
    assert len(got) == pages.count()
    verdict = lambda u: "block" if u and any(c <= tokens(u) for c in want) else "allow"
    assert all(r["verdict"] == (verdict(rows[r["page_id"]][0]) if r["page_id"] is not None and r["page_id"] < 600 else verdict(rows[1][0]) if r["page_id"] is None else "allow") for r in got)
    assert {r["verdict"] for r in got} == {"allow", "block"}


def test_no_rules_without_signal(spark):
    rng = random.Random(4)
    rows = [(f"https://h{i % 7}x.example.com/en/{i}", rng.random() < 0.15) for i in range(400)]
    assert url_filter.mine_rules(spark.createDataFrame(rows, "url string, bad boolean")).count() == 0


def test_odd_tables(spark):
    none = spark.createDataFrame([], "url string, bad boolean")
    assert url_filter.filter_urls(spark.createDataFrame([], "page_id long, url string"), none).count() == 0
    long = "https://a.example.net/" + "xx/" * 30_000
    got = url_filter.filter_urls(spark.createDataFrame([(1, long), (1, long)], "page_id long, url string"), none).collect()
    assert [r["verdict"] for r in got] == ["block", "block"]
