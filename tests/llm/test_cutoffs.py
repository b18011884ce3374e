"""Fitted cutoffs of the quality rules, and what is kept by them, against binomials summed in plain Python."""

from __future__ import annotations

import math
import random
import re

from meridia.llm import quality

GAP = re.compile(r"[\x20\x09-\x0D]+")


def made():
    rng = random.Random(6)
    vocabulary = [f"w{i:03}" for i in range(500)]
    rows, labels = [], []
    for d in range(3600):
        lang, bad = ("en", "de", None)[d % 12 // 5], rng.random() < 0.3
        words = rng.sample(vocabulary, rng.randint(8, 30))
        if bad and rng.random() < 0.7:
            words = [w + "#" * rng.randint(0, 2) for w in words]
        if rng.random() < (0.5 if bad else 0.02):
            words = [w + "!" for w in words]
        rows.append((d, " ".join(words), lang))
        if d % 8:
            labels.append((d, int(not bad), 0))
    labels += [(5, 0, 0), (7, None, 0), (None, 1, 0), (99_999, 1, 0)]  # a second label, no label, no document
    return rows, labels


def measure(text):
    w = [x for x in GAP.split(text) if x]
    n, chars = max(1, len(w)), sum(map(len, w))
    seen = {}
    for i in range(len(w) - 4):
        seen.setdefault(tuple(w[i : i + 5]), []).append(i)
    again = len({i + k for at in seen.values() if len(at) > 1 for i in at for k in range(5)})
    lines = [x for x in text.split("\n") if GAP.sub("", x)]
    rules = {"symbols": len(re.findall(r"[#*$%&|<>]", text)) / n, "upper": sum(c.isupper() for c in text) / max(1, chars), "bangs": text.count("!") / n, "repeats": again / n, "dup_lines": (len(lines) - len(set(lines))) / max(1, len(lines)), "long_words": chars / n}
    return rules, len(w) < 10 or 100 * again > 20 * len(w)


def cutoffs(rows, labels, risk=0.05, error=0.05):
    worst = {}
    for d, q, _ in labels:
        if d is not None and q is not None:
            worst[d] = min(q, worst.get(d, 1))
    known = {}
    for d, text, lang in rows:
        rules, base = measure(text)
        if d in worst and not base:
            known.setdefault(lang or "", []).append((rules, worst[d]))
    out, share = {}, risk / len(quality.CUTOFFS)
    for stratum, docs in known.items():
        n = sum(q > 0 for _, q in docs)
        for rule, cuts in quality.CUTOFFS.items():
            best = None
            for step, cut in enumerate(cuts, 1):
                k = sum(q > 0 and r[rule] > cut for r, q in docs)
                hit = sum(q == 0 and r[rule] > cut for r, q in docs)
                tail = sum(math.comb(n, i) * share**i * (1 - share) ** (n - i) for i in range(k + 1)) if k <= share * n else 1.0
                if tail > error / (len(quality.CUTOFFS) * len(known)):
                    break
                if hit > k and (best is None or hit - k > best[0]):
                    best = (hit - k, step)
            if best:
                out[stratum, rule] = best[1]
    return out


def test_cutoffs_and_verdicts(spark):
    rows, labels = made()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labelled = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    want = cutoffs(rows, labels)
    found = {(r["stratum"], r["rule"]): r["step"] for r in quality.safe_cutoffs(quality.base_features(docs), labelled).collect()}
    assert found == want and len(want) >= 2
    verdicts = {r["doc_id"]: (r["kept"], sorted(r["failed_rules"])) for r in quality.apply_rules(docs, labelled).collect()}
    for d, text, lang in rows:
        rules, base = measure(text)
        failed = sorted(r for r in rules if (lang or "", r) in want and rules[r] > quality.CUTOFFS[r][want[lang or "", r] - 1])
        assert verdicts[d] == (not base and not failed, failed), d
    assert 0 < sum(not k for k, _ in verdicts.values()) < 0.5 * len(rows)
