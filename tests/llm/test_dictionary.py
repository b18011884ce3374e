"""The dictionary of the secret scan against counts in plain Python."""

from __future__ import annotations

import random
import re
from collections import Counter

from meridia.llm import secret_scan


def test_words_of_all_documents(spark):
    rng = random.Random(2)
    letters = "abcdefghijklmnopqrstuvwxyz"
    vocabulary = ["".join(rng.choice(letters) for _ in range(rng.choice((2, 3, 5, 9, 16, 24)))) for _ in range(900)]
    docs = [(d, " ".join(rng.choice(vocabulary[:400] if d % 7 else vocabulary) for _ in range(6)).title()) for d in range(2_600)] + [(9_000, None), (9_001, "")]
    count = Counter(w for _, t in docs if t for w in re.findall(r"\b[a-z]{3,}\b", t.lower()))
    want = sorted(count, key=lambda w: (-count[w], w))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for most in (50, 5_000):
        assert secret_scan.common_words(df, most_words=most) == want[:most]
    long = next(w for w in want if len(w) >= 16).encode()
    m = secret_scan.CANDIDATE.search(long)
    assert secret_scan.measure(long, m, frozenset(w.encode() for w in want))[1][secret_scan.FEATURES.index("dictionary")] == 1.0
