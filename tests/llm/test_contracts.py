"""Base figures, archives and hosts against plain Python."""

from __future__ import annotations

import hashlib
import random
import re

from meridia.llm import quality, url_filter, warc


def figures(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_base_figures(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice("ab c\n #d é\t\U0001f600 e".split(" ")) for _ in range(rng.choice((0, 4, 5, 12, 60))))) for i in range(80)]
    rows += [(100, None), (101, ""), (102, "\u00a0 x\u2003y"), (None, "a b c d e a b c d e"), (1, rows[1][1]), (103, "x\n\n x\nx\r\nx")]
    got = quality.base_features(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'z' as stratum"))
    got = [tuple(r) for r in got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect()]
    assert sorted(got, key=str) == sorted([(d, *figures(t)) for d, t in rows], key=str)


def test_archives(spark):
    rows = [(1, "a" * 1000), (2, "a" * 1000), (3, "é" * 500), (4, "b" * 999), (5, "b" * 999), (6, None), (7, ""), (8, "é" * 500), (9, "a" * 1000)]
    pages = spark.createDataFrame([(i, f"http://x/{i}", h) for i, h in rows], "page_id long, url string, html string")
    want = []
    for i, h in rows:
        data = (h or "").encode()
        last = max(j for j, g in rows if (g or "") == (h or ""))
        again = len(data) >= 1000 and last != i
        want.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", last if again else None))
    got = warc.round_trip(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted(map(tuple, got)) == want


def test_hosts_and_fixed_rules(spark):
    urls = {1: "http://A.NET/x?q", 2: "http://example.net/en/a", 3: "x://b.example.com/de/", 4: "h://k.org/fr/#z", 5: "noscheme", 6: None, 7: "http://notnet", 8: "http://example.com?a=://net/", 9: "://net"}
    want = {1: ("a.net", "/x", "net/", "block"), 2: ("example.net", "/en/a", "example.net/en/", "allow"), 3: ("b.example.com", "/de/", "example.com/de/", "block"), 4: ("k.org", "/fr/", "org/fr/", "allow"), 5: ("", "", None, "allow"), 6: ("", "", None, "allow"), 7: ("notnet", "", None, "allow"), 8: ("example.com", "", None, "allow")}
    pages = spark.createDataFrame(list(urls.items()), "page_id long, url string")
    got = {r["page_id"]: tuple(r)[1:] for r in url_filter.filter_urls(pages, spark.createDataFrame([], "url string, bad boolean")).collect()}
    assert {k: got[k] for k in want} == want and got[9][:2] == ("net", "")
