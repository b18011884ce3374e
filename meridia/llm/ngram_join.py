"""Exact Jaccard join on word shingles, by token-combination prefixes.

Shingles are ordered by rarity. Two sets that overlap enough share shingles near the front of that
order, within a prefix. Rare shingles of the prefix are indexed one by one, frequent ones in
combinations of two, for which the prefix grows so that one shared entry stays certain. Entries are
dealt by key into buckets, where each document keeps its likeliest matches; pairs are verified on the
texts. What a bucket leaves out is searched again among documents that are not in one component yet.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._buckets import BUCKET, FIELDS, GATHER, HEADS, MOST, PAIRS, WIDE, count_keys, deal, pack, search, unpack
from ._common import Scratch, Sketch, WordHash, column, components, merge_sketches, mix, rarity, released, shingles, tidy, without

#: Counter cells of each sketch row; prefix tokens to a group, about; size classes below that combine nothing.
CELLS, GROUP, SMALL = 1 << 21, 6, 20


#: Bits of the parity bitmaps: bit i tells whether an odd number of a set's shingles fall on i.
PARITY = 1024


def shingle_set(h: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct k-word shingles of a text's word hashes."""
    return np.unique(shingles(h, k))


def parity(s: np.ndarray) -> np.ndarray:
    """Two sets differ in at least as many shingles as their bitmaps do in bits."""
    return np.packbits(np.bincount((s >> np.uint64(54)).astype(np.int64), minlength=PARITY) & 1).view(np.int64)


def levels(num: int, den: int, most: int = 400) -> np.ndarray:
    """Lower ends of size classes, such that sets that may be linked are in the same or adjacent ones."""
    out = [1]
    while len(out) < most and out[-1] < 1 << 40:
        out.append(max(out[-1] + 1, -(-out[-1] * den // num)))
    return np.array(out)


def prefix_entries(tokens: np.ndarray, rare: np.ndarray, limit: int, num: int, den: int, bounds: np.ndarray) -> np.ndarray:
    """Index entries of one set. tokens: distinct; rare: their levels; those above `limit` are frequent.

    With t = num/den, linked sets x and y share at least t/(1+t) (|x|+|y|) tokens, so of x's tokens at
    most e = |x| - that are missing in y. A prefix in which every frequent group of c tokens counts
    for c - 1, and every rare token for 1, and that counts for e + 1 in all, must share a rare token
    or two tokens of one group. How tokens form groups depends on the size class of the larger set
    alone, so a set makes its pairs for its own class and the next. Small classes combine nothing.
    """
    n = len(tokens)
    order = np.lexsort((tokens, rare))
    tokens, often = tokens[order], rare[order] > limit
    own = int(np.searchsorted(bounds, n, "right")) - 1
    longest, out = 0, []
    for at in (own, own + 1):
        other = -(-num * n // den) if at == own else max(int(bounds[at]), n)
        if den * n < num * other:
            continue
        errors = n - -(-num * (n + other) // (num + den))
        if bounds[at] < SMALL:
            out.append(tokens[: errors + 1])
            continue
        if not often[: errors + 1].any():
            longest = max(longest, errors + 1)
            continue
        groups = np.uint64(max(1, int(bounds[at]) * (den - num) // (den * GROUP)))
        where = np.flatnonzero(often)
        group = ((tokens[where] >> np.uint64(20)) % groups).astype(np.int64)
        counts = np.ones(n, bool)  # the first token of a frequent group counts for nothing
        counts[where[np.unique(group, return_index=True)[1]]] = False
        m = min(n, int(np.searchsorted(np.cumsum(counts), errors + 1)) + 1)
        longest = max(longest, m)
        group, t = group[where < m], tokens[where[where < m]]
        sort = np.argsort(group, kind="stable")
        g, t, salt = group[sort], t[sort], np.uint64(at + 1)
        for step in range(1, len(g)):
            same = g[step:] == g[:-step]
            if not same.any():
                break
            a, b = t[step:][same], t[:-step][same]
            out.append(mix(mix(np.minimum(a, b)) + np.maximum(a, b) * np.uint64(0xD6E8FEB86659FD93) + salt))
    out.append(tokens[:longest][~often[:longest]])
    return np.unique(np.concatenate(out))


SEEN = ["doc_id", "n", "key", "parity", "block", "counts"]
SEEN_SCHEMA = "doc_id long, n long, key binary, parity array<long>, block int, counts binary"


def _sets(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[tuple[int, int | None, np.ndarray, bytes]]:
    """Batch number, doc_id, shingles and their digest of each text."""
    words = WordHash(lower=True)
    for i, batch in enumerate(batches):
        for doc, h in zip(column(batch, "doc_id"), words.texts(column(batch, "text"))):
            s = shingle_set(h, k)
            yield i, doc, s, hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def _measure(k: int, cells: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch, seen, rows = Sketch(cells), set(), []

        def flush():
            ids, sizes, keys, bits = zip(*rows)
            values = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * (PARITY // 64)), pa.array(np.concatenate(bits)))
            none = pa.nulls(len(rows))
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), values, none.cast(pa.int32()), none.cast(pa.binary())], names=SEEN)

        for _, doc, s, key in _sets(batches, k):
            rows.append((doc, len(s), key if len(s) else None, parity(s)))
            if len(s) and key not in seen:
                seen.add(key)
                sketch.add(s)
            if len(rows) == 5000:
                yield flush()
                rows = []
        if rows:
            yield flush()
        for block, counts in sketch.blocks():
            none = pa.nulls(1)
            yield pa.RecordBatch.from_arrays([none.cast(pa.int64()), none.cast(pa.int64()), none.cast(pa.binary()), none.cast(pa.list_(pa.int64())), pa.array([block], pa.int32()), pa.array([counts], pa.binary())], names=SEEN)

    return run


INDEX = "doc_id long, n int, k long, p1 long, p2 long, words binary"


def _index(k: int, num: int, den: int, shared, limit: int):
    """Each set's index keys, packed, with its size, part of its digest and a small bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, bounds, counts = set(), levels(num, den), np.frombuffer(shared.value, np.uint8).reshape(2, -1)
        rows, waiting = [], 0

        def flush() -> pa.RecordBatch:
            ids, n, digest, p1, p2, keys = zip(*rows)
            sizes = np.array([len(x) for x in keys])
            packed = pack(np.concatenate(keys), sizes, np.ones(len(rows), bool))
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int32()), pa.array(digest, pa.int64()), pa.array(np.array(p1)), pa.array(np.array(p2)), packed], names=[x.split()[0] for x in INDEX.split(", ")])

        for _, doc, s, key in _sets(batches, k):
            if not len(s) or key in seen:
                continue
            seen.add(key)
            e = mix(prefix_entries(s, rarity(counts, s), limit, num, den, bounds)) >> np.uint64(16)
            # folded, it is still a bitmap of parities; it tells small sets apart, and pairs of large ones meet the whole bitmaps later
            rows.append((doc, len(s), int.from_bytes(key[:4], "little"), np.bitwise_xor.reduce(parity(s)), np.int64(0), np.unique(e)))
            waiting += len(e)
            if waiting > 500_000 or len(rows) == 5000:
                yield flush()
                rows, waiting = [], 0
        if rows:
            yield flush()

    return run


def _deal(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, waiting = {f: [] for f in FIELDS}, 0
        for batch in batches:
            key, size = unpack(batch.column("words"))
            row = np.repeat(np.arange(len(size)), size)
            values = {c: batch.column(c).to_numpy(zero_copy_only=False)[row] for c in ("n", "k", "p1", "p2")} | {"doc": batch.column("doc_id").to_numpy(zero_copy_only=False)[row]}
            for f, v in (values | {"key": key, "line": np.zeros(len(row), np.int32), "at": np.full(len(row), -1, np.int32)}).items():
                parts[f].append(v.view(np.uint64) if f in ("p1", "p2") else v)
            waiting += len(key)
            if waiting > GATHER:
                yield deal(parts, buckets)
                parts, waiting = {f: [] for f in FIELDS}, 0
        if waiting:
            yield deal(parts, buckets)

    return run


def _wanted(asked):
    """(key, doc_id) of the index keys that `asked` may have counted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = np.frombuffer(asked.value, np.uint8).reshape(2, -1)
        for batch in batches:
            key, size = unpack(batch.column("words"))
            hit = rarity(rows, mix(key)) > 0
            doc = np.repeat(batch.column("doc_id").to_numpy(zero_copy_only=False), size)[hit]
            yield pa.RecordBatch.from_arrays([pa.array(key[hit].astype(np.int64)), pa.array(doc, pa.int64())], names=["key", "doc_id"])

    return run


def _shrink(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts compressed, as they are shuffled twice."""
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([zlib.compress(x, 1) for x in column(batch, "text")], pa.binary())], names=["rep", "text"])


def _verify(k: int):
    """(a, b, both, union): intersection and union sizes of the pairs' shingle sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, last = WordHash(lower=True), (None, None)
        for batch in batches:
            both, union = [], []
            for x, y in zip(column(batch, "text_a"), column(batch, "text_b")):
                if last[0] != y:
                    last = (y, shingle_set(words.text(zlib.decompress(y)), k))
                s, t = shingle_set(words.text(zlib.decompress(x)), k), last[1]
                i = len(s) + len(t) - len(np.unique(np.concatenate([s, t])))
                both.append(i)
                union.append(len(s) + len(t) - i)
            yield pa.RecordBatch.from_arrays([pa.array(column(batch, "a"), pa.int64()), pa.array(column(batch, "b"), pa.int64()), pa.array(both, pa.int64()), pa.array(union, pa.int64())], names=["a", "b", "both", "union"])

    return run


def jaccard_components(docs: DataFrame, *, k: int = 5, num: int = 80, den: int = 100, often: int = 4096, first: int = 2, most: int = MOST, heads: int = HEADS) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of docs(doc_id, text).

    Two rows are linked when den * intersection >= num * union of their sets of k-word shingles
    (A-Z lower-cased; a shorter text is one shingle). component_id is the smallest doc_id that links
    reach, the row's own included. Texts without words, null ones too, link with nothing. Rows with
    the same doc_id are one document. A null doc_id links with nothing and has a null component.
    Other columns are ignored.

    Tokens count as frequent in over `often` documents, or 8 times the mean load of the sketch's cells
    where that is more. In the first search a document has its `first` likeliest matches under a key
    compared, and of a key of over `heads` documents, or one that makes its bucket exceed `most`
    entries, all meet the first ones only. Keys under which that left out a pair are then searched in
    full, less the pairs within one component. So these four decide how much is compared, never the
    result. Bitmaps of a fixed size
    rule out most candidates before texts are compared, and never a link.
    """
    if not den <= 2 * num <= 2 * den:
        raise ValueError("num / den must lie between 0.5 and 1")
    spark = docs.sparkSession
    tables = Scratch(spark, "ngram-join")
    raw = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    seen = tables.save(raw.mapInArrow(tidy(_measure(k, CELLS)), SEEN_SCHEMA), "measured", dictionary=False)
    counts = merge_sketches(seen.where("block is not null").select("block", "counts"), CELLS)
    load = seen.where("block is null").agg(F.sum("n")).first()[0] or 0
    limit = int(np.ceil(4 + 2.2 * np.log2(max(4.0, often, 16 + 8 * load / CELLS if often else 0) / 4)))
    shared = spark.sparkContext.broadcast(counts.tobytes())
    sets = seen.where("block is null").select("doc_id", "n", "key", "parity")
    linked = sets.where("key is not null and doc_id is not null")
    reps = tables.save(linked.groupBy("key").agg(F.min("doc_id").alias("rep")), "reps")
    node = tables.save(linked.join(reps, "key").select("doc_id", "rep", "n", "parity"), "nodes", dictionary=False)  # doc -> the first document with its set
    ids = raw.where("doc_id is not null and text is not null")
    index = tables.save(ids.mapInArrow(tidy(_index(k, num, den, shared, limit)), INDEX), "index", dictionary=False)
    entries = index.agg(F.sum(F.length("words"))).first()[0] or 0
    buckets = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(entries) // (WIDE * BUCKET)))
    met = index.mapInArrow(tidy(_deal(buckets)), "bucket int, entries binary").groupBy("bucket").applyInArrow(search(num, den, first, most, heads), PAIRS)
    met = tables.save(met.select("doc_id", "doc2", "key").distinct(), "met")
    # rows with one id and different sets belong together
    least = node.groupBy("doc_id").agg(F.min("rep").alias("b"), F.max("rep").alias("c")).where("b < c").select("doc_id", "b")
    links = tables.save(node.join(least, "doc_id").where("rep <> b").select(F.col("rep").alias("a"), "b"), "links-same")

    differ = sum((F.bit_count(F.get("parity", F.lit(i)).bitwiseXOR(F.get("parity2", F.lit(i)))) for i in range(PARITY // 64)), F.lit(0))
    able = (den * F.least("n", "m") >= num * F.greatest("n", "m")) & ((num + den) * differ <= (den - num) * (F.col("n") + F.col("m")))
    pair = [F.greatest("rep", "other").alias("a"), F.least("rep", "other").alias("b")]

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        """Of pairs (a, b), those that are linked."""
        wanted = tables.save(pairs.select(F.col("a").alias("doc_id")).union(pairs.select(F.col("b").alias("doc_id"))).distinct(), f"{name}-wanted")
        texts = ids.join(wanted.hint("merge"), "doc_id").select(F.col("doc_id").alias("rep"), "text").mapInArrow(tidy(_shrink), "rep long, text binary")
        texts = tables.save(texts, f"{name}-texts", dictionary=False)
        near = pairs.join(texts.select(F.col("rep").alias("a"), F.col("text").alias("text_a")), "a").join(texts.select(F.col("rep").alias("b"), F.col("text").alias("text_b")), "b")
        out = tables.save(near.mapInArrow(tidy(_verify(k)), "a long, b long, both long, union long").where(f"both * {den} >= union * {num}").select("a", "b").distinct(), name)
        tables.drop(f"{name}-texts", f"{name}-wanted")
        return out

    def grouped(links: DataFrame, name: str) -> DataFrame:
        return tables.save(components(spark, links, tables, f"cc-{name}"), name).select(F.col("node").alias("rep"), "component")

    them = node.select(F.col("doc_id").alias("doc2"), F.col("rep").alias("other"), F.col("n").alias("m"), F.col("parity").alias("parity2"))
    met_pairs = tables.save(met.where("doc2 is not null").select("doc_id", "doc2").distinct(), "met-pairs")
    mine = tables.save(node.join(met_pairs.hint("merge"), "doc_id"), "met-facts", dictionary=False)
    pairs = them.join(mine.hint("merge"), "doc2").where((F.col("rep") != F.col("other")) & able).select(*pair).distinct()
    pairs = tables.save(pairs, "pairs")
    tables.drop("met-pairs", "met-facts")
    links = links.union(verified(pairs, "links"))
    group = grouped(links, "groups")
    left = tables.save(met.where("key is not null").select("key").distinct(), "left")
    tables.drop("met")
    if left.take(1):
        asked = spark.sparkContext.broadcast(merge_sketches(left.mapInArrow(tidy(count_keys), "block int, counts binary"), CELLS).tobytes())
        rows = index.mapInArrow(tidy(_wanted(asked)), "key long, doc_id long").join(left, "key").join(node.select("doc_id", "rep"), "doc_id")
        rows = tables.save(rows.select("key", "rep").distinct().join(group, "rep", "left").select("key", "rep", F.coalesce("component", "rep").alias("component")), "rows")
        mixed = tables.save(rows.groupBy("key").agg(F.min("component").alias("c1"), F.max("component").alias("c2")).where("c1 < c2").select("key"), "mixed")
        facts = node.where("doc_id = rep").select("rep", "n", "parity").distinct()  # a document with one id and several sets has as many rows
        rows = tables.save(rows.join(mixed, "key").join(facts, "rep"), "rows-mixed")
        # of a key, every pair of two components has a row outside the largest one
        main = rows.groupBy("key", "component").agg(F.count("*").alias("c")).groupBy("key").agg(F.max_by("component", F.struct("c", "component")).alias("main"))
        minor = tables.save(rows.join(main, "key").where("component <> main").drop("main"), "rows-minor")
        them = rows.select("key", F.col("rep").alias("other"), F.col("n").alias("m"), F.col("parity").alias("parity2"), F.col("component").alias("c2"))
        more = tables.save(minor.join(them, "key").where((F.col("component") != F.col("c2")) & able).select(*pair).distinct().join(pairs, ["a", "b"], "left_anti"), "more")
        tables.drop("rows", "mixed", "rows-mixed", "rows-minor")
        if more.take(1):
            group = grouped(links.union(verified(more, "links-more")), "groups-more")
    tables.drop("pairs", "index", "left", "more")
    whole = node.select("doc_id", "rep").distinct().join(group, "rep", "left").groupBy("doc_id").agg(F.min(F.coalesce("component", "rep")).alias("component_id"))
    out = sets.join(tables.save(whole, "whole"), "doc_id", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_first(docs: DataFrame, **how) -> DataFrame:
    """The documents without those that are linked, over any way, to one with a smaller doc_id."""
    tables = Scratch(docs.sparkSession, "ngram-keep")
    with released():
        copies = tables.save(jaccard_components(docs.select("doc_id", "text"), **how).where("component_id < doc_id").select("doc_id").distinct(), "copies")
    return without(docs, copies)
