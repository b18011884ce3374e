"""Substring deduplication by content-defined chunks.

A gear hash rolls over the bytes and cuts where its top bits are zero, so chunks depend on the text
around them alone and come out the same after insertions elsewhere.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import Scratch, column, mix

#: A number for each byte; from a rule, not a table.
GEAR = (mix(np.arange(256, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)
#: Shortest and longest chunk in bytes; bits that are zero at a cut, so chunks have about 2^BITS + LEAST bytes.
LEAST, MOST, BITS = 16, 512, 5


def cuts(text: bytes) -> list[int]:
    """Ends of the chunks of a text."""
    if not text:
        return []
    h = GEAR[np.frombuffer(text, np.uint8)]
    for k in (1, 2, 4, 8, 16):  # h[i] becomes the sum of gear[i - j] << j over the last 32 bytes
        h[k:] = h[k:] + (h[:-k] << np.uint32(k))
    out, last = [], 0
    for i in (np.flatnonzero(h >> np.uint32(32 - BITS) == 0) + 1).tolist():
        while i - last > MOST:
            last += MOST
            out.append(last)
        if i - last >= LEAST:
            out.append(i)
            last = i
    while len(text) - last > MOST:
        last += MOST
        out.append(last)
    if last < len(text):
        out.append(len(text))
    return out


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, starts, sizes, digests = [], [], [], []

        def flush():
            d = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(sizes, pa.int32()), pa.array(d[:, 0].copy()), pa.array(d[:, 1].copy())], names=["doc_id", "start", "size", "d1", "d2"])

        for doc, text in zip(column(batch, "doc_id"), column(batch, "text")):
            a = 0
            for b in cuts(text):
                ids.append(doc)
                starts.append(a)
                sizes.append(b - a)
                digests.append(hashlib.blake2b(text[a:b], digest_size=16).digest())
                a = b
            if len(ids) > 200_000:
                yield flush()
                ids, starts, sizes, digests = [], [], [], []
        if ids:
            yield flush()


def repeated_spans(docs: DataFrame, *, least_bytes: int = 80) -> DataFrame:
    """doc_id, start, length, source_ids: byte spans of texts that occurred before, in doc_id order.

    A chunk occurred before if one with its digest lies in a document with a smaller doc_id, or
    earlier in its own. Neighbouring such chunks are one span; spans under `least_bytes` are left
    out. source_ids are the documents with the first occurrences. Null texts and doc_ids have none;
    rows with equal ids are one document, and the same place of two such rows is no repetition.
    """
    tables = Scratch(docs.sparkSession, "chunk-dedup")
    raw = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    chunks = tables.save(raw.mapInArrow(_chunks, "doc_id long, start long, size int, d1 long, d2 long"), "chunks")
    # first document of each digest that occurs again: plain minima, which are taken ahead of the shuffle
    first = chunks.groupBy("d1", "d2").agg(F.min("doc_id").alias("source"), F.max("doc_id").alias("last"), F.min("start").alias("s1"), F.max("start").alias("s2")).where("source < last or s1 < s2").select("d1", "d2", "source")
    first = tables.save(first, "repeated")
    shared = tables.save(chunks.join(first, ["d1", "d2"]), "shared")
    home = tables.save(shared.where("doc_id = source").groupBy("d1", "d2").agg(F.min("start").alias("home")), "homes")
    later = shared.join(home, ["d1", "d2"]).where("doc_id > source or start > home").select("doc_id", "start", "size", "source").distinct()
    runs = later.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("start", "size", "source"))).alias("c"))  # at most a document's own chunks
    begins = F.filter(F.sequence(F.lit(0), F.size("c") - 1), lambda i: (i == 0) | F.coalesce(F.get("c", i - 1)["start"] + F.get("c", i - 1)["size"] < F.get("c", i)["start"], F.lit(True)))
    runs = runs.select("doc_id", "c", begins.alias("b"))
    spans = runs.select("doc_id", F.explode_outer(F.transform("b", lambda i, k: F.slice("c", i + 1, F.coalesce(F.get("b", k + 1), F.size("c")) - i))).alias("run"))
    last = F.element_at("run", -1)
    start = F.element_at("run", 1)["start"]
    spans = spans.select("doc_id", start.alias("start"), (last["start"] + last["size"] - start).alias("length"), F.array_sort(F.array_distinct(F.transform("run", lambda x: x["source"]))).alias("source_ids"))
    return spans.where(F.col("length") >= least_bytes)
