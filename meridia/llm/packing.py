"""Best-fit packing of documents into sequences, after reduction by dominance.

What is packed are pieces, and all that decides where one fits is its length. So the plan is made of
how many pieces there are of each length, a table of at most `capacity` rows whatever the corpus:
first small sets are fixed that dominate every other set with the same largest piece (Martello and
Toth's reduction), then the rest is packed by best fit, longest first. The plan says which ranks
among the pieces of a length go to which sequences, and every piece finds its place by its rank.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import Scratch, column, tidy

# --- the plan ----------------------------------------------------------------------------------


class Plan:
    """Groups of equal sequences, and for each length which ranks go where.

    `rows` are (length, first rank, ranks, first sequence, copies a sequence, offset): the k-th piece
    after the first rank lies in sequence first + k // copies at offset + (k % copies) * length.
    """

    def __init__(self, counts: np.ndarray):
        self.left, self.used, self.rows, self.sequences = counts.astype(np.int64).copy(), np.zeros(len(counts), np.int64), [], 0

    def place(self, length: int, bins: int, copies: int, first: int, offset: int) -> None:
        n = bins * copies
        self.rows.append((length, int(self.used[length]), n, first, copies, offset))
        self.used[length] += n
        self.left[length] -= n

    def fix(self, lengths: list[int], bins: int) -> None:
        """`bins` sequences of their own, each of these pieces."""
        offset = 0
        for length in sorted(set(lengths), reverse=True):
            copies = lengths.count(length)
            self.place(length, bins, copies, self.sequences, offset)
            offset += copies * length
        self.sequences += bins


def _floors(left: np.ndarray) -> np.ndarray:
    """For each size the longest length at most as long that there is; 0 if none."""
    return np.maximum.accumulate(np.where(left > 0, np.arange(len(left)), 0))


def _times(lengths: list[int], left: np.ndarray) -> int:
    return min(int(left[x]) // lengths.count(x) for x in set(lengths))


def _dominant(j: int, left: np.ndarray, capacity: int) -> list[int] | None:
    """A set with j, the longest, that dominates every other feasible set with j; None if none of up to three pieces does."""
    rest = left.copy()
    rest[j] -= 1
    room = capacity - j
    floors = _floors(rest)
    if not floors[room]:
        return [j]
    best = int(floors[room])
    if best == room:
        return [j, best]
    # how many of the shortest pieces fit at once: 1, 2, or more
    fit, space = 0, room
    for x in np.flatnonzero(rest > 0)[:3].tolist():
        take = min(int(rest[x]), space // x)
        fit, space = fit + take, space - take * x
        if take < rest[x]:
            break
    if fit == 1:
        return [j, best]
    if fit > 2:
        return None
    # the fullest triple: for each first piece the longest second one that still fits
    a = np.flatnonzero(rest[: room + 1] > 0)
    b = floors[np.minimum(room - a, a)]
    same = (b == a) & (rest[a] < 2)  # the only one of its length can't be taken twice
    if same.any():
        b[same] = floors[a[same] - 1]
    total = np.where(b > 0, a + b, 0)
    top = int(total.max(initial=0))
    if best >= top:
        return [j, best]
    i = int(np.flatnonzero(total == top)[-1])
    first, second = int(a[i]), int(b[i])
    if first != best:
        return None
    # pairs of lengths strictly between these two aren't covered, if they fit
    between = [x for x in range(second + 1, first) if rest[x] > 0][:2]
    two = [x for x in between for _ in range(min(2, int(rest[x])))][:2]
    return [j, first, second] if len(two) < 2 or sum(two) > room else None


def _reduce(plan: Plan, capacity: int) -> None:
    """Fixes dominating sets until none is found. What is taken away only leaves fewer alternatives, so a set dominates as long as its pieces last."""
    found = True
    while found:
        found = False
        for j in range(capacity, 0, -1):
            while plan.left[j] > 0 and (chosen := _dominant(j, plan.left, capacity)):
                # alone, a piece stays alone; a pair of equal ones may leave one
                plan.fix(chosen, _times(chosen, plan.left))
                found = True


def _best_fit(plan: Plan, capacity: int) -> None:
    """The rest, longest first, each into the open sequence that it fills most. Equal sequences are one group, and equal pieces are placed together."""
    open_: dict[int, list[tuple[int, int]]] = {}  # by room: (first sequence, number)
    for length in range(capacity, 0, -1):
        for room in sorted(r for r in open_ if r >= length):
            groups = open_.pop(room)
            copies = room // length
            while groups and plan.left[length] > 0:
                first, n = groups.pop()
                full = min(n, int(plan.left[length]) // copies)
                if full:
                    plan.place(length, full, copies, first, capacity - room)
                    open_.setdefault(room - copies * length, []).append((first, full))
                last = min(copies, int(plan.left[length])) if full < n else 0
                if last:  # fewer than a whole sequence takes
                    plan.place(length, 1, last, first + full, capacity - room)
                    open_.setdefault(room - last * length, []).append((first + full, 1))
                if n - full - bool(last) > 0:
                    groups.append((first + full + bool(last), n - full - bool(last)))
            if groups:
                open_.setdefault(room, []).extend(groups)
            if plan.left[length] == 0:
                break
        copies = capacity // length
        if full := int(plan.left[length]) // copies:
            plan.place(length, full, copies, plan.sequences, 0)
            open_.setdefault(capacity - copies * length, []).append((plan.sequences, full))
            plan.sequences += full
        if last := int(plan.left[length]):
            plan.place(length, 1, last, plan.sequences, 0)
            open_.setdefault(capacity - last * length, []).append((plan.sequences, 1))
            plan.sequences += 1
        open_.pop(0, None)


def make_plan(counts: dict[int, int], capacity: int) -> Plan:
    """The plan for so many pieces of each length, 1 to capacity."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    plan = Plan(left)
    _reduce(plan, capacity)
    _best_fit(plan, capacity)
    return plan


# --- tokens ------------------------------------------------------------------------------------

_KIND = {c: "".join(chr(i) for i in range(256) if unicodedata.category(chr(i))[0] == c) for c in "LN"}
_BLANK = "\t\n\x0b\x0c\r \x85\xa0"
#: What the tokenizer of lower-cased words splits text into, for the first 256 characters, where its normal form changes nothing.
_WORDS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_KIND['L']}]+|[{_KIND['N']}]|[^{_BLANK}{_KIND['L']}{_KIND['N']}]+")


class Ids:
    """Token ids of texts as little-endian bytes of 32 bits each.

    With `by_words`, texts of the first 256 characters are looked up word by word, and only new words
    go to the tokenizer; this holds for a tokenizer that lower-cases, splits as _WORDS does, drops white
    space and marks the last token of a word. Other texts are encoded whole. `most_words` bounds what is remembered.
    """

    def __init__(self, path: str, by_words: bool, most_words: int = 1_000_000):
        from tokenizers import Tokenizer

        self.tokenizer, self.by_words, self.most, self.known = Tokenizer.from_file(path), by_words, most_words, {}
        names = sorted(self.tokenizer.get_vocab().items(), key=lambda x: x[1])
        self.last = np.array([name.endswith("</w>") for name, _ in names])  # tokens that end a word

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def learn(self, words: list[str]) -> None:
        if len(self.known) + len(words) > self.most:
            self.known.clear()
        for i in range(0, len(words), 1000):
            part = words[i : i + 1000]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, np.int64)
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) == len(part):
                data, at = ids.astype("<u4").tobytes(), 0
                for word, end in zip(part, (ends * 4).tolist()):
                    self.known[word] = data[at:end]
                    at = end
            else:  # a word that is split otherwise
                self.known.update((w, self.whole(w)) for w in part)

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        out: list = [None] * len(texts)
        split: dict[int, list[str]] = {}
        for i, text in enumerate(texts):
            text = text or ""
            try:
                plain = self.by_words and "<|" not in text and bool(text.encode("latin-1")) is bool(text)
            except UnicodeEncodeError:
                plain = False
            if plain:
                split[i] = _WORDS.findall(text.lower())
            else:
                out[i] = self.whole(text)
        new = list(set().union(*split.values()).difference(self.known)) if split else []
        if len(self.known) + len(new) > self.most:
            new = list(set().union(*split.values()))  # what was known will be forgotten
        if new:
            self.learn(new)
        known = self.known
        for i, words in split.items():
            out[i] = b"".join([known[w] for w in words])
        return out


@cache
def _ids(path: str, by_words: bool) -> Ids:
    """One for each worker, so that what a task has looked up the next one knows."""
    return Ids(path, by_words)


PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, nth long"


def _cut(path: str, by_words: bool, capacity: int, end_id: int, chars: int):
    """Pieces of each text, each with the task that cut it and how many of its length that task cut before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, seen, task = _ids(path, by_words), np.zeros(capacity + 1, np.int64), TaskContext.get().partitionId()
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            docs, texts = column(batch, "doc_id"), column(batch, "text")
            at = 0
            while at < len(docs):
                stop = size = 0
                stop = at
                while stop < len(docs) and (stop == at or size + len(texts[stop] or "") <= chars):
                    size += len(texts[stop] or "")
                    stop += 1
                rows = []
                for doc, found in zip(docs[at:stop], ids(texts[at:stop])):
                    found += end
                    for k, a in enumerate(range(0, len(found), 4 * capacity)):
                        part = found[a : a + 4 * capacity]
                        n = len(part) // 4
                        rows.append((doc, k, a // 4, n, zlib.crc32(part), task, int(seen[n])))
                        seen[n] += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()))], names=["doc_id", "piece", "start", "length", "ids_crc32", "task", "nth"])
                at = stop

    return tidy(run)


# --- the operator ------------------------------------------------------------------------------


def _placed(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length, first, _, sequence, copies, offset = np.frombuffer(shared.value, np.int64).reshape(6, -1)
        lengths = np.searchsorted(length, np.arange(int(length.max(initial=0)) + 2))
        for batch in batches:
            if not batch.num_rows:
                continue
            n, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            row = np.zeros(len(n), np.int64)
            order = np.argsort(n, kind="stable")
            edges = np.flatnonzero(np.diff(n[order], prepend=-1))
            for a, b in zip(edges, [*edges[1:], len(n)]):
                i = order[a:b]
                lo, hi = lengths[n[i[0]]], lengths[n[i[0]] + 1]
                row[i] = lo + np.searchsorted(first[lo:hi], rank[i], "right") - 1
            k = rank - first[row]
            keep = [batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(sequence[row] + k // copies[row]), pa.array(offset[row] + k % copies[row] * n)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, tokenizer: str, *, capacity: int = 4096, end_id: int = 1, by_words: bool = False, chars: int = 1 << 22) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of docs(doc_id, text).

    A document is the ids of its text by the tokenizer file, without special ones, then end_id; only one
    longer than capacity is cut, every capacity tokens. Sequences hold whole pieces without gaps. A null
    text is empty, so it is end_id alone; rows are documents of their own, with equal or null ids too.
    The tokenizer file must have the same path on every machine. `by_words` is described at Ids;
    `chars` of text are split at once, or one text if it is longer.

    The driver sees the number of pieces by length and makes the plan, whose size depends on capacity alone.
    """
    spark = docs.sparkSession
    tables = Scratch(spark, "packing")
    cut = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_cut(tokenizer, by_words, capacity, end_id, chars), PIECE)
    pieces = tables.save(cut, "pieces")
    by_task = tables.save(pieces.groupBy("task", "length").agg(F.count("*").alias("n")), "counts")
    counts = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most capacity rows
    plan = np.array(sorted(make_plan(counts, capacity).rows) or np.zeros((0, 6)), np.int64).reshape(-1, 6)
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    starts = by_task.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    ranked = pieces.join(starts, ["task", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("nth")).alias("rank"))
    shared = spark.sparkContext.broadcast(np.ascontiguousarray(plan.T).tobytes())
    return ranked.mapInArrow(_placed(shared), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
