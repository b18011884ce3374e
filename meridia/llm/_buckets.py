"""Candidate search of similarity joins: index entries dealt by key into buckets, and compared there.

An entry is a key of 48 bits and what is needed to rule a pair out: who has it (a document and a
line), the size of the set, the place of the token, part of a digest, and a parity bitmap.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from ._common import Sketch, mix

CELLS = 1 << 21
#: Entries that a task gathers before it deals them out, of a bucket on average, and of one in memory at most.
GATHER, BUCKET, MOST = 1 << 18, 1 << 17, 1 << 20
#: Lines of a key that stay in memory when a bucket exceeds MOST.
HEADS = 4096
#: Pairs of entries compared at once.
TESTS = 1 << 18
#: Bytes of a word or key.
WIDE = 6
#: What an entry holds, each field as that many planes of bytes.
FIELDS = {"key": ("<u8", 6), "doc": ("<i8", 8), "line": ("<i4", 4), "n": ("<i4", 4), "at": ("<i4", 4), "k": ("<u4", 4), "p1": ("<u8", 8), "p2": ("<u8", 8)}
PLANES = sum(w for _, w in FIELDS.values())


def starts(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)


def pack(tokens: np.ndarray, sizes: np.ndarray, have: np.ndarray) -> pa.Array:
    """Word sets as bytes, one value a line; null where `have` is false."""
    data = np.ascontiguousarray(tokens[np.repeat(have, sizes)].view(np.uint8).reshape(-1, 8)[:, :WIDE])
    offsets = np.concatenate([[0], np.cumsum(np.where(have, sizes, 0))]) * WIDE
    bits = np.packbits(have, bitorder="little")
    return pa.Array.from_buffers(pa.binary(), len(sizes), [pa.py_buffer(bits), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data)])


def unpack(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(words of all lines, number of each line's) of pack's values, none of them null."""
    at = np.frombuffer(values.buffers()[1], np.int32)[values.offset : values.offset + len(values) + 1].astype(np.int64)
    data = np.frombuffer(values.buffers()[2] or b"", np.uint8)[at[0] : at[-1]].reshape(-1, WIDE)
    out = np.zeros((len(data), 8), np.uint8)
    out[:, :WIDE] = data
    return out.view("<u8").reshape(-1), np.diff(at) // WIDE


def deal(parts: dict[str, list], buckets: int) -> pa.RecordBatch:
    """A blob of entries for each bucket, their fields as planes of bytes, so that equal bytes stand together."""
    flat = {k: np.concatenate(parts[k]).astype(kind) for k, (kind, _) in FIELDS.items()}
    bucket = flat["key"] % np.uint64(buckets)
    order = np.argsort(bucket.astype(np.uint16) if buckets <= 1 << 16 else bucket, kind="stable")
    planes, row = np.empty((PLANES, len(order)), np.uint8), 0
    for k, (kind, w) in FIELDS.items():
        planes[row : row + w] = flat[k][order].view(np.uint8).reshape(len(order), -1)[:, :w].T
        row += w
    which, first = np.unique(bucket[order], return_index=True)
    blobs = [np.ascontiguousarray(planes[:, a:b]).tobytes() for a, b in zip(first, [*first[1:], len(order)])]
    return pa.RecordBatch.from_arrays([pa.array(which.astype(np.int32)), pa.array(blobs, pa.binary())], names=["bucket", "entries"])


def arranged(e: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Entries by key and size, without keys of one line; of exact copies the earliest stays."""
    order = np.argsort((e["key"] << np.uint64(16)) | (e["k"] >> np.uint32(16)).astype(np.uint64))
    key = e["key"][order]
    same = np.concatenate([[False], key[1:] == key[:-1]])
    order = order[same | np.concatenate([same[1:], [False]])]
    if not len(order):
        return {k: v[:0] for k, v in e.items()}
    e = {k: v[order] for k, v in e.items()}
    new = np.concatenate([[True], np.logical_or.reduce([e[k][1:] != e[k][:-1] for k in ("key", "k", "n", "p1", "p2")])])
    if not new.all():
        run, owner = np.flatnonzero(new), np.cumsum(new) - 1
        doc = np.minimum.reduceat(e["doc"], run)
        line = np.minimum.reduceat(np.where(e["doc"] == doc[owner], e["line"], np.iinfo(np.int32).max), run)
        e = {k: v[run] for k, v in e.items()} | {"doc": doc, "line": line}
    order = np.argsort((e["key"] << np.uint64(16)) | np.minimum(e["n"], 65535).astype(np.uint64))
    e = {k: v[order] for k, v in e.items()}
    if len(e["n"]) and e["n"].max() >= 65535:  # sizes beyond the bits above
        order = np.lexsort((e["n"], e["key"]))
        e = {k: v[order] for k, v in e.items()}
    return e


def ranks(e: dict[str, np.ndarray]) -> np.ndarray:
    """How many lines of its key each entry has before it."""
    order = np.lexsort((e["line"], e["doc"], e["key"]))
    key = e["key"][order]
    new = np.concatenate([[True], key[1:] != key[:-1]])
    out = np.empty(len(order), np.int64)
    out[order] = np.arange(len(order)) - np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    return out


def spans_of(low: np.ndarray, high: np.ndarray, mine: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of each of `mine` with the places from its low up to its high, about TESTS at once."""
    many = np.maximum(high - low, 0)
    total = np.cumsum(many)
    a = 0
    while a < len(mine):
        b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + TESTS, "right")))
        if many[a:b].sum():
            yield np.repeat(mine[a:b], many[a:b]), np.arange(int(many[a:b].sum())) + np.repeat(low[a:b] - starts(many[a:b]), many[a:b])
        a = b


def candidates(e: dict[str, np.ndarray], num: int, den: int, first: int, heads: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(later, earlier, open): places of pairs that may be similar, and of lines left with others not looked at.

    Lines meet those of their key whose sizes allow it; of the possible matches before a line the
    `first` with the least differing bitmaps are kept. Of a key of over `heads` lines, all meet the first ones only.
    """
    size = len(e["key"])
    if not size:
        return (np.zeros(0, np.int64),) * 3
    key, n, at = e["key"], e["n"].astype(np.int64), e["at"].astype(np.int64)
    new = np.concatenate([[True], key[1:] != key[:-1]])
    group = np.cumsum(new) - 1
    count = np.bincount(group)
    wide = np.int64(n.max() * den // num + 2)
    place = group * wide + n
    every = np.arange(size)
    if count.max() <= heads:
        spans = [spans_of(every + 1, np.searchsorted(place, group * wide + n * den // num, "right"), every)]
        crowded = np.zeros(0, np.int64)
    else:
        head = (count[group] <= heads) | (ranks(e) < heads)
        some, rest = every[head], every[~head]
        spans = [((some[x] if x is not None else None, some[y]) for x, y in spans_of(np.arange(len(some)) + 1, np.searchsorted(place[some], group[some] * wide + n[some] * den // num, "right"), np.arange(len(some)))),
                 ((x, some[y]) for x, y in spans_of(np.searchsorted(place[some], group[rest] * wide - (-n[rest] * num // den)), np.searchsorted(place[some], group[rest] * wide + n[rest] * den // num, "right"), rest))]
        crowded = np.flatnonzero(count[group] > heads)
    before, after = np.where(at < 0, 1 << 30, at), n - np.maximum(at, 0)  # most shared words ahead of this one, and from it on
    pairs, waiting, more = [(np.zeros(0, np.int64),) * 3], 0, np.zeros(size, bool)

    def best() -> None:
        nonlocal pairs, waiting
        later, earlier, differ = (np.concatenate(x) for x in zip(*pairs))
        order = np.lexsort((earlier, differ, later))
        later = later[order]
        start = np.concatenate([[True], later[1:] != later[:-1]]) if len(later) else np.zeros(0, bool)
        rank = np.arange(len(later)) - np.maximum.accumulate(np.where(start, np.arange(len(later)), 0))
        more[later[rank >= first]] = True
        order, keep = order[rank < first], rank < first
        pairs, waiting = [(later[keep], earlier[order], differ[order])], len(order)

    for i, j in (x for span in spans for x in span):
        differ = np.bitwise_count(e["p1"][i] ^ e["p1"][j]).astype(np.int16) + np.bitwise_count(e["p2"][i] ^ e["p2"][j])
        good = (num + den) * differ.astype(np.int64) <= (den - num) * (n[i] + n[j])
        i, j, differ = i[good], j[good], differ[good]
        shared = np.minimum(before[i], before[j]) + np.minimum(after[i], after[j])
        good = ((num + den) * shared >= num * (n[i] + n[j])) & ((e["doc"][i] != e["doc"][j]) | (e["line"][i] != e["line"][j]))
        i, j, differ = i[good], j[good], differ[good]
        swap = (e["doc"][i] > e["doc"][j]) | ((e["doc"][i] == e["doc"][j]) & (e["line"][i] > e["line"][j]))
        pairs.append((np.where(swap, i, j), np.where(swap, j, i), differ))
        waiting += len(i)
        if waiting > TESTS:
            best()
    best()
    return pairs[0][0], pairs[0][1], np.union1d(np.flatnonzero(more), crowded)


PAIRS = "doc_id long, line_no int, doc2 long, line2 int, key long"


def search(num: int, den: int, first: int, most: int, heads: int):
    """Pairs (later, earlier) of one bucket; rows without an earlier line name those with more to look at, and under which key."""

    def found(e: dict[str, np.ndarray], crowded: np.ndarray) -> pa.RecordBatch:
        later, earlier, more = candidates(e, num, den, first, heads)
        more = np.union1d(more, np.flatnonzero(np.isin(e["key"], crowded)))
        i = np.concatenate([later, more])
        lost = pa.nulls(len(more))
        return pa.RecordBatch.from_arrays([pa.array(e["doc"][i]), pa.array(e["line"][i]), pa.chunked_array([pa.array(e["doc"][earlier], pa.int64()), lost.cast(pa.int64())]).combine_chunks(), pa.chunked_array([pa.array(e["line"][earlier], pa.int32()), lost.cast(pa.int32())]).combine_chunks(), pa.chunked_array([pa.nulls(len(later), pa.int64()), pa.array(e["key"][more].astype(np.int64))]).combine_chunks()], names=[x.split()[0] for x in PAIRS.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, waiting, crowded = {k: [] for k in FIELDS}, 0, np.zeros(0, np.uint64)
        for blob in (x.as_py() for batch in batches for x in batch.column(batch.schema.get_field_index("entries"))):
            planes = np.frombuffer(blob, np.uint8).reshape(PLANES, -1)
            row = 0
            for k, (kind, w) in FIELDS.items():
                out = np.zeros((planes.shape[1], np.dtype(kind).itemsize), np.uint8)
                out[:, :w] = planes[row : row + w].T
                parts[k].append(out.view(kind).reshape(-1))
                row += w
            waiting += planes.shape[1]
            if waiting > most:  # only a key of very many lines does that: its first lines stay for the others to meet
                e = arranged({k: np.concatenate(v) for k, v in parts.items()})
                rank = ranks(e)
                crowded = np.union1d(crowded, e["key"][rank >= heads])
                yield found(e, crowded)
                parts, waiting = {k: [v[rank < heads]] for k, v in e.items()}, int((rank < heads).sum())
        if waiting:
            yield found(arranged({k: np.concatenate(v) for k, v in parts.items()}), crowded)

    def bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)

    return bucket


def count_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sketch = Sketch(CELLS)
    for batch in batches:
        sketch.add(mix(batch.column("key").to_numpy().view(np.uint64)))
    for block, counts in sketch.blocks():
        yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([counts], pa.binary())], names=["block", "counts"])
