"""Line deduplication by an exact set-similarity join.

The words of a line are ordered by rarity; two lines whose word sets reach the similarity share one of
their rarest words within a prefix, or, where those are frequent, a pair of them. Entries are dealt by
key into buckets; there length, position and parity bitmaps bound the overlap before word sets are
compared. Of similar lines the later one goes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._buckets import BUCKET, FIELDS, GATHER, HEADS, MOST, PAIRS, count_keys, deal, pack, search, starts, unpack
from ._common import Scratch, Sketch, WordHash, column, free_name, merge_sketches, mix, rarity, released, tidy
from .ngram_join import GROUP, SMALL, levels

CELLS = 1 << 21
#: Lines and bytes of text handled at once.
LINES, BYTES = 1 << 12, 1 << 20
#: Digests that a task remembers to pass over exact copies early.
SEEN = 300_000
#: Bits of a word hash that tell words of a line apart, next to 12 for the line and 6 for its rarity.
BITS = 46
#: Lines under so many distinct words have digests of whole word hashes.
SHORT = 3
#: Parity bits of a line in the second search.
PARITY = 1024


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list]]:
    """(ids, texts) of a bounded number of lines and bytes; a longer text comes alone."""
    ids, texts, lines, size = [], [], 0, 0
    for batch in batches:
        for doc, text in zip(column(batch, "doc_id"), column(batch, "text")):
            n = text.count(b"\n") + 1
            if ids and (lines + n > LINES or size + len(text) > BYTES):
                yield ids, texts
                ids, texts, lines, size = [], [], 0, 0
            ids.append(doc)
            texts.append(text)
            lines += n
            size += len(text)
    if ids:
        yield ids, texts


def _words(ids: list, texts: list[bytes], hashes: WordHash) -> Iterator[tuple[np.ndarray, ...]]:
    """(ids, line numbers, hashes of all words, words per line) of the lines that have words; at most LINES at once."""
    for i, line_no, h, n in _lines_of(ids, texts, hashes):
        for a in range(0, len(n), LINES):
            part = n[a : a + LINES]
            before = int(n[:a].sum())
            yield i[a : a + LINES], line_no[a : a + LINES], h[before : before + int(part.sum())], part


def _lines_of(ids: list, texts: list[bytes], hashes: WordHash) -> Iterator[tuple[np.ndarray, ...]]:
    if len(texts) == 1 and len(texts[0]) > BYTES:  # a long text, by blocks of its lines
        lines, at = texts[0].split(b"\n"), 0
        while at < len(lines):
            stop, size = at, 0
            while stop < len(lines) and (stop == at or size + len(lines[stop]) <= BYTES):
                size += len(lines[stop])
                stop += 1
            h = [hashes.text(x) for x in lines[at:stop]]
            n = np.array([len(x) for x in h])
            keep = np.flatnonzero(n)
            if len(keep):
                yield np.full(len(keep), ids[0]), keep + at, np.concatenate(h), n[keep]
            at = stop
        return
    data = np.frombuffer(b"\n".join(texts), np.uint8)
    sizes = np.array([len(x) for x in texts])
    first = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    h, start = hashes.piece(data, np.zeros(1, np.int64))
    breaks = np.flatnonzero(data == 10)
    many = np.diff(np.searchsorted(start, breaks), prepend=0, append=len(start))
    which = np.flatnonzero(many)
    if len(which):
        begin = np.where(which > 0, breaks[which - 1] + 1, 0) if len(breaks) else np.zeros(len(which), np.int64)
        doc = np.searchsorted(first, begin, "right") - 1
        yield np.array(ids)[doc], which - np.searchsorted(breaks, first)[doc], h, many[which]


def _sets(h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(distinct words of each line, their number, two digests of the set) from all words of some lines."""
    code = np.repeat(np.arange(len(n), dtype=np.uint64) << np.uint64(64 - 12), n) | (h >> np.uint64(64 - BITS))
    code.sort()
    code = code[np.concatenate([[True], code[1:] != code[:-1]])]
    size = np.bincount((code >> np.uint64(64 - 12)).astype(np.int64), minlength=len(n))
    token, start = code & np.uint64((1 << BITS) - 1), starts(size)
    one = mix(token)
    k1, k2 = np.add.reduceat(one, start), np.add.reduceat(one * one, start)
    if len(short := np.flatnonzero(size < SHORT)):  # nothing compares their words: digests of whole hashes
        many = n[short]
        owner = np.repeat(np.arange(len(short)), many)
        w = h[np.arange(len(owner)) + np.repeat(starts(n)[short] - starts(many), many)]
        order = np.lexsort((w, owner))
        owner, w = owner[order], w[order]
        new = np.concatenate([[True], (owner[1:] != owner[:-1]) | (w[1:] != w[:-1])])
        owner, w = owner[new], mix(w[new])
        begin = np.searchsorted(owner, np.arange(len(short)))
        k1[short], k2[short] = np.add.reduceat(w, begin), np.add.reduceat(w * w, begin)
    return token, size, k1, k2


SEEN_LINES = "doc_id long, line_no int, n int, k1 long, k2 long, words binary, block int, counts binary"


def _measure(least: int, near: int):
    """Lines of `least` distinct words or more; those of `near` or more come with their words, and the sketch counts these."""
    names = [x.split()[0] for x in SEEN_LINES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, sketch, seen, high = WordHash(), Sketch(CELLS), {}, None
        for ids, nos, h, n in (y for x in _chunks(batches) for y in _words(*x, hashes)):
            token, size, k1, k2 = _sets(h, n)
            fresh = size >= near
            # a copy is passed over if its first one stands before it; ids that rise within the task show that
            rises = high is None or (ids[0] >= high and (ids[1:] >= ids[:-1]).all())
            high = max(int(ids.max()), high if high is not None else int(ids.max()))
            if rises:
                for i, a, b in zip(np.flatnonzero(fresh).tolist(), k1[fresh].tolist(), k2[fresh].tolist()):
                    if seen.get(a) == b:
                        fresh[i] = False
                    elif len(seen) < SEEN:
                        seen[a] = b
            sketch.add(mix(token[np.repeat(fresh, size)]))
            keep = size >= least
            none = pa.nulls(int(keep.sum()))
            words = pack(token[np.repeat(keep, size)], size[keep], fresh[keep])
            yield pa.RecordBatch.from_arrays([pa.array(ids[keep], pa.int64()), pa.array(nos[keep].astype(np.int32)), pa.array(size[keep].astype(np.int32)), pa.array(k1[keep].view(np.int64)), pa.array(k2[keep].view(np.int64)), words, none.cast(pa.int32()), none.cast(pa.binary())], names=names)
        for block, counts in sketch.blocks():
            none = pa.nulls(1)
            yield pa.RecordBatch.from_arrays([none.cast(pa.int64()), none.cast(pa.int32()), none.cast(pa.int32()), none.cast(pa.int64()), none.cast(pa.int64()), none.cast(pa.binary()), pa.array([block], pa.int32()), pa.array([counts], pa.binary())], names=names)

    return run


class _Ordered:
    """Of some lines: words rarest first, one line after the other, with their rarity; sizes and starts."""

    def __init__(self, token: np.ndarray, size: np.ndarray, rows: np.ndarray):
        code = np.repeat(np.arange(len(size), dtype=np.uint64) << np.uint64(64 - 12), size) | (rarity(rows, mix(token)).astype(np.uint64) << np.uint64(BITS)) | token
        code.sort()
        self.token, self.level = code & np.uint64((1 << BITS) - 1), ((code >> np.uint64(BITS)) & np.uint64(63)).astype(np.uint8)
        self.size, self.start = size, starts(size)
        self.line = np.repeat(np.arange(len(size)), size)
        self.at = np.arange(len(token)) - self.start[self.line]
        self.one = mix(token)  # within a line in another order, which sums and parities don't see

    def parities(self) -> tuple[np.ndarray, np.ndarray]:
        """Two lines differ in at least as many words as their bitmaps of 128 bits do in bits."""
        bit, half = np.uint64(1) << (self.one & np.uint64(63)), (self.one & np.uint64(64)) > 0
        return tuple(np.bitwise_xor.reduceat(np.where(x, bit, np.uint64(0)), self.start) for x in (half, ~half))

    def digests(self) -> np.ndarray:
        return np.add.reduceat(self.one, self.start)

    def prefix(self, num: int, den: int) -> np.ndarray:
        """For each word, how many words of its line make entries, if none of them is frequent."""
        return (self.size - -(-num * self.size // den) + 1)[self.line]

    def entries(self, num: int, den: int, limit: int, bounds: np.ndarray) -> tuple[np.ndarray, ...]:
        """(key of 48 bits, line, position or -1 of a pair of words, place of its word, place of its other word or the same) of all index entries.

        Lines without a frequent word in their prefix have its words one by one. Lines with one have
        the entries of ngram_join.prefix_entries, made here for all lines at once: a word frequent for
        one line is so for all, so the two kinds of lines meet in single rare words.
        """
        inside, frequent = self.at < self.prefix(num, den), self.level > limit
        often = np.zeros(len(self.size), bool)
        often[self.line[inside & frequent]] = True
        # a word counted once is in no other line; its place in the prefix is spent all the same
        single = inside & ~often[self.line]
        n, rare = self.size.astype(np.int64), np.add.reduceat((~frequent).astype(np.int64), self.start)
        own = np.searchsorted(bounds, n, "right") - 1
        every, rarer = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)  # places up to which all words, or those not frequent, make entries
        keys, words, others = [], [], []
        for step in (0, 1) if often.any() else ():
            low = bounds[own + step]
            other = np.maximum(low, n) if step else -(-num * n // den)
            able = often & (den * n >= num * other)
            errors = n - -(-num * (n + other) // (num + den))
            every = np.where(able & (low < SMALL), np.maximum(every, errors + 1), every)
            able &= low >= SMALL
            rarer = np.where(able, np.maximum(rarer, errors + 1), rarer)
            if len(w := np.flatnonzero(frequent & (able & (rare <= errors))[self.line])):
                key, a, b, end = self._combined(w, np.maximum(1, low * (den - num) // (den * GROUP)), errors, rare, own + step)
                rarer = np.maximum(rarer, end)
                keys.append(key)
                words.append(a)
                others.append(b)
        single |= (self.at < every[self.line]) | ((self.at < rarer[self.line]) & ~frequent)
        alone = np.flatnonzero(single & (self.level > 1))
        word, other = np.concatenate([alone, *words]), np.concatenate([alone, *others])
        at = np.concatenate([self.at[alone], *(np.full(len(x), -1) for x in keys)])
        return mix(np.concatenate([self.token[alone], *keys])) >> np.uint64(16), self.line[word], at, word, other

    def _combined(self, w: np.ndarray, groups: np.ndarray, errors: np.ndarray, rare: np.ndarray, salt: np.ndarray) -> tuple[np.ndarray, ...]:
        """(token, word, other word) of the pairs of frequent words w of one group, and where each line's prefix ends."""
        line = self.line[w]
        group = ((self.token[w] >> np.uint64(20)) % groups[line].astype(np.uint64)).astype(np.int64)
        order = np.lexsort((group, line))
        new = np.concatenate([[True], (line[order][1:] != line[order][:-1]) | (group[order][1:] != group[order][:-1])])
        counts = np.ones(len(w), np.int64)  # the first word of a frequent group counts for nothing
        counts[order[new]] = 0
        total = np.cumsum(counts)
        begin = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]]))
        total -= np.repeat(total[begin] - counts[begin], np.diff([*begin, len(w)]))
        short = np.bincount(line[rare[line] + total <= errors[line]], minlength=len(rare))
        end = np.zeros(len(rare), np.int64)
        end[line[begin]] = np.minimum(self.size, rare + short + 1)[line[begin]]
        order = order[(self.at[w] < end[line])[order]]
        line, group, w = line[order], group[order], w[order]
        new = np.flatnonzero(np.concatenate([[True], (line[1:] != line[:-1]) | (group[1:] != group[:-1])]))
        before = np.arange(len(w)) - np.repeat(new, np.diff([*new, len(w)]))
        i = np.repeat(np.arange(len(w)), before)
        j = np.arange(len(i)) - np.repeat(starts(before), before) + np.repeat(np.arange(len(w)) - before, before)
        a, b = self.token[w[i]], self.token[w[j]]
        return mix(mix(np.minimum(a, b)) + np.maximum(a, b) * np.uint64(0xD6E8FEB86659FD93) + (salt[line[i]] + 1).astype(np.uint64)), w[i], w[j], end


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Parts of at most LINES rows and about BYTES of words; a longer row comes alone."""
    at = np.frombuffer(batch.column("words").buffers()[1], np.int32)[batch.column("words").offset :]
    a = 0
    while a < batch.num_rows:
        b = int(np.searchsorted(at[: batch.num_rows + 1], int(at[a]) + BYTES, "right")) - 1
        b = min(max(b, a + 1), a + LINES, batch.num_rows)
        yield batch.slice(a, b - a)
        a = b


def _index(num: int, den: int, shared, limit: int, buckets: int):
    """Blobs of entries by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, bounds = np.frombuffer(shared.value, np.uint8).reshape(2, -1), levels(num, den, 1 << 16)
        parts, waiting = {k: [] for k in FIELDS}, 0
        for part in (y for x in batches for y in _slices(x)):
            x = _Ordered(*unpack(part.column("words")), rows)
            key, line, at, _, _ = x.entries(num, den, limit, bounds)
            p1, p2 = x.parities()
            doc, no = (part.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "line_no"))
            for k, v in (("key", key), ("doc", doc[line]), ("line", no[line]), ("n", x.size[line]), ("at", at), ("k", (x.digests() >> np.uint64(32))[line]), ("p1", p1[line]), ("p2", p2[line])):
                parts[k].append(v)
            waiting += len(key)
            if waiting > GATHER:
                yield deal(parts, buckets)
                parts, waiting = {k: [] for k in FIELDS}, 0
        if waiting:
            yield deal(parts, buckets)

    return run


def _verify(num: int, den: int):
    """Rows (doc_id, line_no) whose two word sets x and y are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, LINES):
                part = batch.slice(a, LINES)
                x, n = unpack(part.column("x"))
                y, m = unpack(part.column("y"))
                code = np.concatenate([np.repeat(np.arange(part.num_rows, dtype=np.uint64) << np.uint64(64 - 12), s) | t for t, s in ((x, n), (y, m))])
                code.sort()
                twice = (code[1:][code[1:] == code[:-1]] >> np.uint64(64 - 12)).astype(np.int64)
                both = np.bincount(twice, minlength=part.num_rows)
                yield part.select(["doc_id", "line_no"]).filter(pa.array(den * both >= num * (n + m - both)))

    return run


ENTRIES = "key long, doc_id long, line_no int, n int, parity array<long>"


def _key_words(num: int, den: int, shared, limit: int, keys):
    """Counts the words of entries under keys that may be among the counted ones, with all size classes that similar lines are in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch, bounds = Sketch(CELLS), levels(num, den, 1 << 16)
        rows, asked = (np.frombuffer(x.value, np.uint8).reshape(2, -1) for x in (shared, keys))
        for part in (y for x in batches for y in _slices(x)):
            x = _Ordered(*unpack(part.column("words")), rows)
            key, _, _, word, other = x.entries(num, den, limit, bounds)
            hit = rarity(asked, mix(key)) > 0
            word = np.union1d(word[hit], other[hit])
            own = np.searchsorted(bounds, x.size, "right")[x.line[word]]
            for near in (own - 1, own, own + 1):
                sketch.add(_classed(x.token[word], near))
        for block, counts in sketch.blocks():
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([counts], pa.binary())], names=["block", "counts"])

    return run


def _classed(token: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Hashes of words with size classes."""
    return mix(token | (own.astype(np.uint64) << np.uint64(BITS)))


def _with_words(asked: np.ndarray, token: np.ndarray, size: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Whether a line has a word that may be among the counted ones of its size class."""
    one = _classed(token, np.repeat(np.searchsorted(bounds, size, "right"), size))
    at = np.flatnonzero(asked[0][(one & np.uint64(asked.shape[1] - 1)).astype(np.int64)])
    at = at[rarity(asked, one[at]) > 0]
    out = np.zeros(len(size), bool)
    out[np.searchsorted(starts(size), at, "right") - 1] = True
    return out


def _rows(num: int, den: int, shared, limit: int, words=None, keys=None):
    """Entries as rows with wide bitmaps; where counts of words and keys are given, those that may be among them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, bounds = np.frombuffer(shared.value, np.uint8).reshape(2, -1), levels(num, den, 1 << 16)
        asked = [None if x is None else np.frombuffer(x.value, np.uint8).reshape(2, -1) for x in (words, keys)]
        for part in (y for x in batches for y in _slices(x)):
            token, size = unpack(part.column("words"))
            if words is not None:
                hit = _with_words(asked[0], token, size, bounds)
                if not hit.any():
                    continue
                part, token, size = part.filter(pa.array(hit)), token[np.repeat(hit, size)], size[hit]
            x = _Ordered(token, size, rows)
            key, line, _, _, _ = x.entries(num, den, limit, bounds)
            if keys is not None:
                hit = rarity(asked[1], mix(key)) > 0
                key, line = key[hit], line[hit]
            doc, no = (part.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "line_no"))
            used, line = np.unique(line, return_inverse=True)
            if not len(used):
                continue
            row = np.full(len(x.size), -1)
            row[used] = np.arange(len(used))
            mine = np.flatnonzero(row[x.line] >= 0)
            bits = np.bincount(row[x.line[mine]] * PARITY + (x.one[mine] >> np.uint64(54)).astype(np.int64), minlength=len(used) * PARITY) & 1
            bits = np.packbits(bits.astype(np.uint8)).view(np.int64).reshape(len(used), -1)
            for a in range(0, len(key), 50_000):
                i = line[a : a + 50_000]
                values = pa.ListArray.from_arrays(pa.array(np.arange(len(i) + 1, dtype=np.int32) * bits.shape[1]), pa.array(bits[i].reshape(-1)))
                yield pa.RecordBatch.from_arrays([pa.array(key[a : a + 50_000].astype(np.int64)), pa.array(doc[used[i]]), pa.array(no[used[i]]), pa.array(x.size[used[i]].astype(np.int32)), values], names=[x.split()[0] for x in ENTRIES.split(", ")])

    return run


#: Bits for a row that is looked for, and in all (8 MB); bits of a bitmap of Spark's functions.
EACH, BITMAP, MOST_BITS = 16, 1 << 15, 1 << 26


def likely(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """rows less most of those whose (doc_id, line_no) is none of wanted's, a written table's.

    By one bit for each hash, so that few of many rows need no shuffle of all of them. Beyond
    MOST_BITS / EACH wanted rows more others stay, and no wanted row ever goes.
    """
    bits = min(max(EACH * wanted.count(), 2 * BITMAP), MOST_BITS)
    at = F.pmod(F.xxhash64("doc_id", "line_no"), F.lit(bits))
    place = F.pmod(at, F.lit(BITMAP))
    found = wanted.groupBy(F.floor(at / BITMAP).alias("bitmap")).agg(F.bitmap_construct_agg(place).alias("bits"))
    byte = F.conv(F.hex(F.substring("bits", F.floor(place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    mine = byte.bitwiseAND(F.element_at(F.array(*[F.lit(1 << i) for i in range(8)]), F.pmod(place, F.lit(8)).cast("int") + 1)) != 0
    return rows.join(F.broadcast(found), (F.floor(at / BITMAP) == F.col("bitmap")) & mine).select(*rows.columns)


def later_lines(docs: DataFrame, *, num: int = 80, den: int = 100, min_words: int = 3, first: int = 4, frequent: int = 1024, most: int = MOST, heads: int = HEADS) -> DataFrame:
    """(doc_id, line_no) of the lines that repeat an earlier one, line_no from 0 by newlines.

    A line is the set of its words, told apart by 46 bits of their hashes. One of at least `min_words`
    distinct words repeats an earlier line, in the order of doc_id and line_no, when
    den * intersection >= num * union; whether the earlier line goes too makes no difference. Rows
    with a null doc_id or text have no lines here. Rows with equal ids are one document: what goes
    from one of them goes from all. Other columns are ignored.

    Words in about `frequent` lines or more are indexed in pairs. In the first search a line has its
    `first` likeliest matches under a key compared, and of a key of over `heads` lines, or one that
    makes its bucket exceed `most` entries, all meet the first ones only; lines that this leaves with
    something to look at, and without a similar one, are searched for among all others in a join. So
    these four decide how much is compared, never the result.
    """
    spark = docs.sparkSession
    tables = Scratch(spark, "line-dedup")
    raw = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    # sets of fewer words than this are similar to equal sets only, which the digests find: no index entries
    near = max(min_words, -(-num // (den - num))) if num < den else 1 << 30
    seen = tables.save(raw.mapInArrow(tidy(_measure(min_words, near)), SEEN_LINES), "measured", dictionary=False)
    counts = merge_sketches(seen.where("block is not null").select("block", "counts"), CELLS, tables)
    shared, limit = spark.sparkContext.broadcast(counts.tobytes()), int(4 + 2.2 * np.log2(max(8, frequent) / 4))
    lines = seen.where("block is null").select("doc_id", "line_no", "k1", "k2")
    copied = tables.save(lines.groupBy("k1", "k2").agg(F.min(F.struct("doc_id", "line_no")).alias("first"), F.count("*").alias("copies")).where("copies > 1"), "copied")
    copies = lines.join(copied, ["k1", "k2"]).where(F.struct("doc_id", "line_no") != F.col("first")).select("doc_id", "line_no")
    sets = seen.where("words is not null").select("doc_id", "line_no", "words")
    load = seen.where("words is not null").agg(F.sum(F.col("n") - F.ceil(F.col("n") * num / den) + 1)).first()[0] or 0
    buckets = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(load) // BUCKET))
    blobs = sets.mapInArrow(tidy(_index(num, den, shared, limit, buckets)), "bucket int, entries binary")
    pairs = tables.save(blobs.groupBy("bucket").applyInArrow(search(num, den, first, most, heads), PAIRS).distinct(), "pairs")

    def words_of(wanted: DataFrame, name: str) -> DataFrame:
        """(doc_id, line_no, words) of some lines."""
        wanted = tables.save(wanted.distinct(), f"{name}-wanted")
        # these grow with the corpus and are never broadcast, so plans are the same at every size
        return tables.save(likely(sets, wanted).join(wanted.hint("merge"), ["doc_id", "line_no"]).select("doc_id", "line_no", "words"), name)

    def similar(pairs: DataFrame, words: DataFrame, name: str) -> DataFrame:
        """(doc_id, line_no) of the later lines of pairs of similar lines."""
        x, y = words.withColumnRenamed("words", "x"), words.select(F.col("doc_id").alias("doc2"), F.col("line_no").alias("line2"), F.col("words").alias("y"))
        both = pairs.join(y, ["doc2", "line2"]).join(x, ["doc_id", "line_no"]).select("doc_id", "line_no", "x", "y")
        return tables.save(both.mapInArrow(tidy(_verify(num, den)), "doc_id long, line_no int").distinct(), name)

    met = pairs.where("doc2 is not null").select("doc_id", "line_no", "doc2", "line2")
    words = words_of(pairs.select("doc_id", "line_no").union(met.select("doc2", "line2")), "words")
    found = similar(met.hint("merge"), words.hint("merge"), "found")
    # lines and the keys under which they have others to look at; what the second search leaves is small
    open_ = tables.save(pairs.where("doc2 is null").select("doc_id", "line_no", "key").join(found, ["doc_id", "line_no"], "left_anti"), "open")
    still = tables.save(open_.select("doc_id", "line_no").distinct().join(words, ["doc_id", "line_no"]), "still")
    tables.drop("pairs", "words", "words-wanted")
    if still.take(1):
        mine = tables.save(still.mapInArrow(tidy(_rows(num, den, shared, limit)), ENTRIES).distinct().join(open_, ["doc_id", "line_no", "key"]), "mine")
        keys = spark.sparkContext.broadcast(merge_sketches(mine.select("key").mapInArrow(tidy(count_keys), "block int, counts binary"), CELLS, tables).tobytes())
        asked = spark.sparkContext.broadcast(merge_sketches(still.mapInArrow(tidy(_key_words(num, den, shared, limit, keys)), "block int, counts binary"), CELLS, tables).tobytes())
        theirs = sets.mapInArrow(tidy(_rows(num, den, shared, limit, asked, keys)), ENTRIES).select("key", F.col("doc_id").alias("doc2"), F.col("line_no").alias("line2"), F.col("n").alias("m"), F.col("parity").alias("parity2"))
        differ = sum((F.bit_count(F.get("parity", F.lit(i)).bitwiseXOR(F.get("parity2", F.lit(i)))) for i in range(PARITY // 64)), F.lit(0))
        able = (den * F.least("n", "m") >= num * F.greatest("n", "m")) & ((num + den) * differ <= (den - num) * (F.col("n") + F.col("m")))
        rest = mine.join(theirs, "key").where((F.struct("doc2", "line2") < F.struct(F.col("doc_id").alias("doc2"), F.col("line_no").alias("line2"))) & able)
        rest = tables.save(rest.select("doc_id", "line_no", "doc2", "line2").distinct(), "rest")
        words = words_of(rest.select("doc_id", "line_no").union(rest.select("doc2", "line2")), "words-rest")
        found = found.union(similar(rest, words, "found-rest"))
        tables.drop("rest", "mine", "words-rest", "words-rest-wanted")
    out = tables.save(copies.union(found).distinct(), "later")
    tables.drop("measured", "copied", "open", "still", "found", "found-rest")
    return out


def dedup_lines(docs: DataFrame, **how) -> DataFrame:
    """docs with `text` less its later lines, and n_lines and n_removed (long; 0 for null texts).

    All rows and all other columns stay, but that columns n_lines and n_removed of the input are
    replaced, and so does the order of lines; a text may end up empty.
    """
    id_, gone, split = (free_name(x, docs) for x in ("gone_id", "gone_lines", "lines"))
    tables = Scratch(docs.sparkSession, "line-keep")
    with released():
        later = tables.save(later_lines(docs.select("doc_id", "text"), **how), "later")
    later = later.groupBy(F.col("doc_id").alias(id_)).agg(F.collect_set("line_no").alias(gone)).hint("shuffle_hash")
    out = docs.join(later, F.col("doc_id") == F.col(id_), "left").withColumn(split, F.split("text", "\n"))
    left = F.array_except(F.sequence(F.lit(0), F.size(split) - 1), F.col(gone))
    text = F.when(F.col(gone).isNull(), F.col("text")).otherwise(F.array_join(F.transform(left, lambda i: F.get(F.col(split), i)), "\n"))
    counts = {"n_lines": F.when(F.col("text").isNull(), 0).otherwise(F.size(split)).cast("long"), "n_removed": F.when(F.col(gone).isNull(), 0).otherwise(F.size(gone)).cast("long")}
    return out.select(*[F.col(f"`{c}`") if c != "text" else text.alias("text") for c in docs.columns if c not in counts], *[c.alias(k) for k, c in counts.items()])
