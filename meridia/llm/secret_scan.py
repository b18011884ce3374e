"""Secret scans: candidates by pattern, false positives removed by a random forest."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import Scratch, column

#: Long runs of the letters of keys; quoted strings without spaces; passwords in addresses.
CANDIDATE = re.compile(rb"(?<=[\"'])[^\s\"']{8,256}(?=[\"'])|(?<=:)[^\s:@/\"']{6,256}(?=@[A-Za-z0-9.-]+)|[A-Za-z0-9+/_=-]{16,}")
#: A name that tells of a secret, and what assigns it; both lead up to the candidate.
NAMED = re.compile(rb"(?i)\b[\w.-]{0,30}(?:token|secret|passw(?:or)?d|passwd|api.?key|auth|credential|private.?key|bearer)[\w.-]{0,20}[\"']?\s{0,3}(?:[=:]|=>)?\s{0,3}[\"']?$")
AROUND = 60
CLASSES = ("digit", "upper", "lower", "mark")
#: What the forest sees. Neither the name before a candidate nor its quotes are among them: they make labels.
FEATURES = ("length", "digits", "upper", "lower", "marks", "hex", "entropy", "distinct", *(f"{a}_{b}" for a in CLASSES for b in CLASSES), "vowels", "dictionary", "longest_word", "path", "wordy_before", "wordy_after", "numbers_near")
SCHEMA = "doc_id long, start long, length int, digest string, named boolean, features array<double>"
CLASS = bytes(0 if 48 <= c < 58 else 1 if 65 <= c < 91 else 2 if 97 <= c < 123 else 3 for c in range(256))


def measure(text: bytes, m: re.Match, dictionary: frozenset[bytes]) -> tuple[bool, list[float]]:
    """Whether a telling name leads up to the candidate, and its features in the order of FEATURES."""
    x, a, b = m[0], m.start(), m.end()
    before, after = text[max(0, a - AROUND) : a], text[b : b + AROUND]
    n, kinds = len(x), x.translate(CLASS)
    name = NAMED.search(before)
    lead = before[: name.start()] if name else before  # words ahead of the name, so that they don't tell of it
    count, seen, turns = Counter(kinds), Counter(x), Counter(zip(kinds, kinds[1:]))
    low = x.lower()
    parts = re.findall(rb"[a-z]{3,}", low)
    covered = sum(len(p) for p in parts if p in dictionary)
    wordy = lambda t: sum(w.strip(b".,;\"'").isalpha() for w in t) / max(1, len(t))
    words, later = lead.split(), after.strip(b"\"'").split()
    return name is not None, [
        float(min(n, 256)), count[0] / n, count[1] / n, count[2] / n, count[3] / n,
        sum(v for c, v in seen.items() if c in b"0123456789abcdefABCDEF") / n,
        -sum(v / n * math.log2(v / n) for v in seen.values()), len(seen) / n,
        *(turns[i, j] / max(1, n - 1) for i in range(4) for j in range(4)),
        sum(v for c, v in Counter(low).items() if c in b"aeiou") / n,
        covered / n, float(max(map(len, parts), default=0)),
        float(before.endswith((b"/", b".")) or b"/" in x or after[:1] == b"/"),
        wordy(words), wordy(later), float(any(w.isdigit() for w in words[-3:] + later[:3])),
    ]


def _find(dictionary: frozenset[bytes]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, starts, sizes, digests, names, rows = [], [], [], [], [], []
            for doc, text in zip(column(batch, "doc_id"), column(batch, "text")):
                for m in CANDIDATE.finditer(text or b""):
                    ids.append(doc)
                    starts.append(m.start())
                    sizes.append(len(m[0]))
                    digests.append(hashlib.sha256(m[0]).hexdigest())
                    named, row = measure(text, m, dictionary)
                    names.append(named)
                    rows.append(row)
            flat = pa.array(np.array(rows, float).reshape(-1))
            values = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * len(FEATURES)), flat)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(sizes, pa.int32()), pa.array(digests, pa.string()), pa.array(names, pa.bool_()), values], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return run


def common_words(docs: DataFrame, *, most_words: int = 5_000) -> list[str]:
    """A dictionary: the commonest lower-case words of all documents, of three letters or more; of equal ones the first by letters."""
    tables = Scratch(docs.sparkSession, "words")
    words = docs.where("text is not null").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\b[a-z]{3,}\b"), F.lit(0))).alias("w"))
    counts = tables.save(words.groupBy("w").agg(F.count("*").alias("n")), "counts")
    # the least count first: the top is then taken from few rows, however many tasks have counted
    least, have = 1, 0
    for least, n in sorted(map(tuple, counts.groupBy("n").agg(F.count("*")).collect()), reverse=True):
        if (have := have + n) >= most_words:
            break
    out = [r["w"] for r in counts.where(F.col("n") >= least).orderBy(F.desc("n"), "w").limit(most_words).collect()]
    tables.drop("counts")
    return out


def candidates(docs: DataFrame, dictionary: list[str]) -> DataFrame:
    """doc_id, start (byte), length, sha-256 of the finding, whether a name tells of it, and features; a row a candidate."""
    words = frozenset(w.encode() for w in dictionary)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(_find(words), SCHEMA)


def weak_labels(found: DataFrame) -> DataFrame:
    """Labelled findings where none are given: 1 where a telling name leads up to the candidate, else 0.

    The forest doesn't see the name, so it has to tell the two apart by the candidate and the words
    around: named strings that look like the harmless ones get low scores, and secrets without a
    name high ones.
    """
    return found.select("doc_id", "start", F.col("named").cast("double").alias("label"))


def scan(docs: DataFrame, labelled: DataFrame | None = None, *, trees: int = 30, depth: int = 8, most_labels: int = 20_000, cutoff: float = 0.5, seed: int = 1) -> DataFrame:
    """doc_id, start, length, digest, score and secret of every candidate in docs(doc_id, text).

    start and length are bytes of the text in UTF-8. labelled has (doc_id, start, label 0 or 1); if it
    is missing, weak_labels makes it. The forest learns from at most `most_labels` of its rows, those
    first by a hash, half of them of either kind if there are as many. With labels of one kind, or
    none, the score is 1 where a telling name leads up to a candidate with a digit in it, else 0. Null
    and empty texts have no candidates; rows with equal ids keep theirs each, rows with a null id too,
    which no label can name. The dictionary is of the commonest words of all documents. Other columns
    are ignored.
    """
    tables = Scratch(docs.sparkSession, "secrets")
    docs = docs.select("doc_id", "text")
    found = tables.save(candidates(docs, common_words(docs)), "candidates")
    given = weak_labels(found) if labelled is None else labelled.where("label is not null").select(F.col("doc_id"), F.col("start"), F.col("label").cast("double").alias("label"))
    given = given.where("doc_id is not null").distinct()
    order = [F.xxhash64("doc_id", "start"), F.col("doc_id"), F.col("start")]
    half = lambda label: given.where(F.col("label") == label).orderBy(*order).limit(most_labels // 2)
    some = half(1.0).union(half(0.0))
    rows = tables.save(found.select("doc_id", "start", "features").distinct().join(F.broadcast(some), ["doc_id", "start"]).select(array_to_vector("features").alias("x"), "label"), "labelled")  # at most most_labels rows
    kinds = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if kinds.keys() == {0.0, 1.0}:
        # either kind weighs the same, however rare findings are
        rows = rows.withColumn("w", F.when(F.col("label") == 1, 1.0 / kinds[1.0]).otherwise(1.0 / kinds[0.0]) * F.lit(float(sum(kinds.values()))))
        model = RandomForestClassifier(featuresCol="x", labelCol="label", weightCol="w", numTrees=trees, maxDepth=depth, seed=seed, probabilityCol="p").fit(rows)
        scored = model.transform(found.withColumn("x", array_to_vector("features"))).withColumn("score", F.round(F.element_at(vector_to_array("p"), 2), 9))
    else:
        digits = F.element_at("features", FEATURES.index("digits") + 1)
        scored = found.withColumn("score", (F.col("named") & (digits > 0)).cast("double"))
    return scored.select("doc_id", "start", "length", "digest", "score", (F.col("score") >= cutoff).alias("secret"))
