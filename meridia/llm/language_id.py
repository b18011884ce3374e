"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import column, mix

#: Buckets of n-grams as a power of two; lengths of n-grams; characters handled at once.
BITS, ORDERS, CHARS = 15, 3, 1 << 20
SPACE = 32


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def buckets(texts: list[str], letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and text number of every n-gram of letters; runs of anything else are one space."""
    codes = np.frombuffer("".join(f" {x.lower()}  " for x in texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    sizes = np.fromiter((len(x.lower()) + 3 for x in texts), np.int64, len(texts))
    text = np.repeat(np.arange(len(texts)), sizes)
    known = letters[np.minimum(codes, len(letters) - 1)]
    codes = np.where(known, codes, SPACE)
    keep = known | np.concatenate([[True], known[:-1] | (text[1:] != text[:-1])])
    codes, text = codes[keep].astype(np.uint64), text[keep]
    out, of, h = [], [], np.zeros(len(codes), np.uint64)
    for k in range(ORDERS):
        n = len(codes) - k
        if n <= 0:
            break
        h = mix(h[:n] + codes[k:])
        whole = text[:n] == text[k:]
        if k == 0:
            whole = whole & (codes != SPACE)
        out.append((h[whole] >> np.uint64(64 - BITS)).astype(np.int64))
        of.append(text[:n][whole])
    return np.concatenate(out), np.concatenate(of)


def _pieces(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    at = size = 0
    for i, x in enumerate(texts):
        size += len(x or "")
        if size >= CHARS:
            yield at, i + 1
            at, size = i + 1, 0
    if at < len(texts):
        yield at, len(texts)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    letters, counts, docs = _letters(), {}, {}
    for batch in batches:
        langs, texts = column(batch, "lang"), column(batch, "text")
        for a, b in _pieces(texts):
            which, of = buckets(texts[a:b], letters)
            names, number = np.unique(np.array(langs[a:b], object), return_inverse=True)
            found = np.bincount(number[of] << BITS | which, minlength=len(names) << BITS).reshape(len(names), -1)
            for i, x in enumerate(names):
                counts[x] = counts.get(x, 0) + found[i]
                docs[x] = docs.get(x, 0) + int((number == i).sum())
    yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(docs.values()), pa.int64()), pa.array([np.asarray(c, np.int64).tobytes() for c in counts.values()], pa.binary())], names=["lang", "docs", "counts"])


def _add(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums a group's counts as they come."""
    total, docs = np.zeros(1 << BITS, np.int64), 0
    for batch in batches:
        docs += sum(column(batch, "docs"))
        for c in column(batch, "counts"):
            total += np.frombuffer(c, np.int64)
    yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.string()), pa.array([docs], pa.int64()), pa.array([total.tobytes()], pa.binary())], names=["lang", "docs", "counts"])


def train(labelled: DataFrame, *, smooth: float = 0.5, most_languages: int = 500) -> tuple[list[str], np.ndarray]:
    """(languages, log probabilities of each bucket, the prior last) from all rows of (text, lang).

    The model has a row of fixed size a language; with more than `most_languages` values lang isn't a
    language, and that raises.
    """
    rows = labelled.where("text is not null and lang is not null").select("lang", "text").mapInArrow(_count, "lang string, docs long, counts binary")
    # tasks' counts in two steps, the first in up to 256 groups a language
    rows = rows.withColumn("part", F.spark_partition_id() % 256).groupBy("lang", "part").applyInArrow(_add, "lang string, docs long, counts binary")
    rows = sorted(rows.groupBy("lang").applyInArrow(_add, "lang string, docs long, counts binary").limit(most_languages + 1).collect())
    if len(rows) > most_languages:
        raise ValueError(f"over {most_languages} languages")
    if not rows:
        return [], np.zeros((0, (1 << BITS) + 1), np.float32)
    counts = np.stack([np.frombuffer(bytes(r["counts"]), np.int64) for r in rows]) + smooth
    docs = np.array([r["docs"] for r in rows], float)
    return [r["lang"] for r in rows], np.concatenate([np.log(counts / counts.sum(1, keepdims=True)), np.log(docs / docs.sum())[:, None]], 1).astype(np.float32)


def _predict(langs: list[str], shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, model = _letters(), np.frombuffer(shared.value, np.float32).reshape(len(langs), (1 << BITS) + 1)
        for batch in batches:
            texts = column(batch, "text")
            lang, score = ["und"] * len(texts), np.zeros(len(texts))
            for a, b in _pieces(texts) if langs else ():
                which, of = buckets([x or "" for x in texts[a:b]], letters)
                total = np.stack([np.bincount(of, row[which].astype(np.float64), minlength=b - a) + row[-1] for row in model], 1)
                seen = np.bincount(of, minlength=b - a) > 0
                p = np.exp(total - total.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                best = p.argmax(1)
                for i in np.flatnonzero(seen):
                    lang[a + i], score[a + i] = langs[best[i]], p[i, best[i]]
            keep = [batch.column(i) for i in range(batch.num_columns) if batch.schema.names[i] != "text"]
            names = [x for x in batch.schema.names if x != "text"]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(lang, pa.string()), pa.array(score)], names=[*names, "lang_pred", "score"])

    return run


def identify(docs: DataFrame, **how) -> DataFrame:
    """doc_id, held_out, lang_pred and score (posterior, 0 to 1) of every row of docs(doc_id, text, lang).

    Learns from rows whose crc32(doc_id as text) mod 5 is not 0 and whose lang is not null, a null
    doc_id's left out. `und` with score 0 for a null text, one without letters, or if nothing was learned.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang", held_out(F.col("doc_id")).alias("held_out"))
    langs, model = train(rows.where("doc_id is not null and not held_out"), **how)
    shared = docs.sparkSession.sparkContext.broadcast(model.tobytes())
    return rows.select("doc_id", "held_out", "text").mapInArrow(_predict(langs, shared), "doc_id long, held_out boolean, lang_pred string, score double")
