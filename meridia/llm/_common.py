"""Shared parts: scratch tables, word hashing, a bounded frequency sketch."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What separates words, everywhere in this package.
SPACE = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local one only where none is set and everything runs in one process."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="meridia-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def sweep(spark: SparkSession) -> int:
    """Deletes the folders of all finished runs of this session: results that still read from them are lost. How many there were."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for at in Scratch.made:
        p = hadoop(at)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    n = len(Scratch.made)
    Scratch.made.clear()
    return n


def tidy(run):
    """run, after which what its task has freed goes back to the system: workers live on and share an executor's memory."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except (OSError, AttributeError):  # another C library
                pass

    return wrapped


#: What operators have made inside the innermost `released` block of this thread.
_INSIDE: ContextVar[list | None] = ContextVar("inside", default=None)


@contextmanager
def released():
    """Tables that operators write inside the block are deleted at its end; what is needed later must be saved inside it to a Scratch made before."""
    mine: list[Scratch] = []
    token = _INSIDE.set(mine)
    try:
        yield
    finally:
        _INSIDE.reset(token)
        for made in mine:
            made.delete()


class Scratch:
    """Tables of one run in the shared folder. Writing cuts the lineage, and survives lost executors."""

    #: While a table is written: its shuffle files go when it is done.
    CLEAN = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
    #: Folders of this session, for sweep.
    made: list[str] = []

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.at = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        Scratch.made.append(self.at)
        if (inside := _INSIDE.get()) is not None:
            inside.append(self)

    def delete(self) -> None:
        """All tables of the run: results that still read from them are lost."""
        self.drop("")
        Scratch.made.remove(self.at)

    def path(self, name: str) -> str:
        return f"{self.at}/{name}" if name else self.at

    def save(self, df: DataFrame, name: str, dictionary: bool = True) -> DataFrame:
        """Write and reread; the shuffle files behind the table can go at once. Hashes want no dictionary."""
        was = {k: self.spark.conf.get(k, None) for k in self.CLEAN}
        try:
            for k, v in self.CLEAN.items():
                self.spark.conf.set(k, v)
            df.write.mode("overwrite").option("compression", "zstd").option("parquet.enable.dictionary", dictionary).parquet(self.path(name))
        finally:
            for k, v in was.items():
                self.spark.conf.unset(k) if v is None else self.spark.conf.set(k, v)
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        for name in names:
            p = hadoop(self.path(name))
            p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


#: Rows of a written table, of ids and numbers, that may be broadcast after a count.
FEW = 100_000


def if_few(df: DataFrame, most: int = FEW) -> DataFrame:
    """df, to be broadcast if a count shows that it has at most `most` rows."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id, null or not, is none of ids(doc_id). Always by a shuffle, as ids grow with the corpus."""
    id_ = free_name("gone_id", docs)
    gone = ids.select(F.col("doc_id").alias(id_)).hint("merge")
    return docs.join(gone, F.col("doc_id").eqNullSafe(F.col(id_)), "left_anti")


def free_name(name: str, *frames: DataFrame) -> str:
    """`name`, or with underscores after it what no column of the frames is called, in any case of letters."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def spread(df: DataFrame, spark: SparkSession, *by) -> DataFrame:
    """Rows dealt evenly over as many partitions as shuffles have."""
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *by) if by else df.repartition(n)


# --- words -------------------------------------------------------------------------------------

#: The step and the multipliers of a well-known mixer of 64 bits.
M1, M2, M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (splitmix64)."""
    x = x + M1
    x = (x ^ (x >> np.uint64(30))) * M2
    x = (x ^ (x >> np.uint64(27))) * M3
    return x ^ (x >> np.uint64(31))


#: A number for each byte, by a rule; A-Z count as a-z in the second row. Bytes that separate words.
BYTE = mix(np.arange(256, dtype=np.uint64) + np.uint64(1))
BYTE = np.stack([BYTE, BYTE[np.array([i + 32 if 65 <= i < 91 else i for i in range(256)])]])
GAP = np.zeros(256, bool)
GAP[[32, 9, 10, 11, 12, 13]] = True
#: Bytes of text whose words are hashed at once.
PIECE = 1 << 20


class WordHash:
    """64-bit hashes of words: a polynomial in numbers of their bytes, mixed. Remembers nothing of the text."""

    def __init__(self, lower: bool = False):
        self.byte = BYTE[int(lower)]
        self.up = self.down = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.up) <= n:
            up, down = np.full(n + 1, 0xD6E8FEB86659FD93, np.uint64), np.full(n + 1, pow(0xD6E8FEB86659FD93, -1, 1 << 64), np.uint64)
            up[0] = down[0] = 1
            self.up, self.down = np.multiply.accumulate(up), np.multiply.accumulate(down)

    def piece(self, data: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(hashes, start places) of the words of some bytes; words also end where `first` begins a text."""
        n = len(data)
        self._powers(n)
        word = ~GAP[data]
        begin = word.copy()
        begin[1:] &= GAP[data[:-1]]
        end = word.copy()
        end[:-1] &= GAP[data[1:]]
        first = first[first < n]
        begin[first] = word[first]
        last = first[first > 0] - 1
        end[last] = word[last]
        a, b = np.flatnonzero(begin), np.flatnonzero(end)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.byte[data] * self.up[:n])])
        return mix((total[b + 1] - total[a]) * self.down[a] + (b - a + 1).astype(np.uint64)), a

    def text(self, text: bytes | None) -> np.ndarray:
        """Hashes of the words of one text, of any length."""
        data = np.frombuffer(text or b"", np.uint8)
        if len(data) <= 4 * PIECE:
            return self.piece(data, np.zeros(1, np.int64))[0]
        out, at = [], 0
        while at < len(data):
            end = min(len(data), at + PIECE)
            while end < len(data) and not GAP[data[end]]:  # to the next gap
                gaps = np.flatnonzero(GAP[data[end : end + PIECE]])
                end = end + int(gaps[0]) if len(gaps) else min(len(data), end + PIECE)
            out.append(self.piece(data[at:end], np.zeros(1, np.int64))[0])
            at = end
        return np.concatenate(out)

    def texts(self, texts: list[bytes | None]) -> Iterator[np.ndarray]:
        """Hashes of the words of each text, many texts at a time."""
        at = 0
        while at < len(texts):
            stop = size = 0
            stop = at
            while stop < len(texts) and (stop == at or size + len(texts[stop] or b"") <= PIECE):
                size += len(texts[stop] or b"")
                stop += 1
            if stop == at + 1:
                yield self.text(texts[at])
            else:
                sizes = np.fromiter((len(x or b"") for x in texts[at:stop]), np.int64, stop - at)
                ends = np.cumsum(sizes)
                h, start = self.piece(np.frombuffer(b"".join(x or b"" for x in texts[at:stop]), np.uint8), ends - sizes)
                cut = np.searchsorted(start, ends)
                yield from np.split(h, cut[:-1])
            at = stop


def shingles(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k-word windows of a sequence; of the whole sequence if it is shorter."""
    if not len(h):
        return h
    m = max(1, len(h) - k + 1)
    out = mix(h[:m])
    for i in range(1, min(k, len(h))):
        out = mix(out * M2 + h[i : i + m])
    return out if len(h) >= k else mix(out + np.uint64(len(h)))


def column(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


# --- counts ------------------------------------------------------------------------------------


class Sketch:
    """How often each 64-bit token occurs, never too low: two rows of `cells` counters.

    Its size is fixed, whatever the corpus, so it may be broadcast. An estimate of 1 is exact.
    """

    BLOCK = 1 << 15

    def __init__(self, cells: int = 1 << 21):
        self.cells, self.count = cells, np.zeros((2, cells), np.uint32)

    @staticmethod
    def places(tokens: np.ndarray, cells: int) -> tuple[np.ndarray, np.ndarray]:
        m = np.uint64(cells - 1)
        return (tokens & m).astype(np.int64), ((tokens >> np.uint64(32)) & m).astype(np.int64)

    def add(self, tokens: np.ndarray) -> None:
        for row, at in zip(self.count, self.places(tokens, self.cells)):
            np.add.at(row, at, np.uint32(1))

    def blocks(self) -> Iterator[tuple[int, bytes]]:
        flat = self.count.reshape(-1)
        for i in range(0, len(flat), self.BLOCK):
            if (part := flat[i : i + self.BLOCK]).any():
                yield i // self.BLOCK, part.tobytes()


def level(counts: np.ndarray) -> np.ndarray:
    """Counts as 0 to 63: exact up to 4, then four steps a doubling. Order is kept."""
    x = np.maximum(counts, 1).astype(np.float64)
    return np.where(counts <= 4, counts, np.minimum(63, 4 + np.ceil(2.2 * np.log2(x / 4)))).astype(np.uint8)


def _added(kind: str, as_levels: bool):
    """Sums the counts of a group's rows as they come, 32-bit numbers of tasks or 64-bit sums; as levels of a byte each if they are the last."""

    def add(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(Sketch.BLOCK, np.uint64)
        for batch in batches:
            for c in column(batch, "counts"):
                part = np.frombuffer(c, kind)
                total[: len(part)] += part
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([(level(total) if as_levels else total).tobytes()], pa.binary())], names=["block", "counts"])

    return add


#: Groups in which the tasks' counts of a block are added up first.
GROUPS = 256


def merge_sketches(blocks: DataFrame, cells: int, tables: Scratch | None = None) -> np.ndarray:
    """Sums (block, counts) rows of all tasks, in two steps; 2 x cells levels, one byte each, come to the driver.

    With `tables` the sums are written first, so that the shuffle files of all tasks' counts go at once.
    """
    part = blocks.withColumn("part", F.spark_partition_id() % GROUPS).groupBy("block", "part").applyInArrow(_added("u4", False), "block int, counts binary")
    out = np.zeros(2 * cells, np.uint8)
    sums = part.groupBy("block").applyInArrow(_added("u8", True), "block int, counts binary")
    if tables is not None:
        sums = tables.save(sums, name := f"counts-{uuid.uuid4().hex}")
    for r in sums.toLocalIterator():
        found = np.frombuffer(bytes(r["counts"]), np.uint8)[: 2 * cells - r["block"] * Sketch.BLOCK]
        out[r["block"] * Sketch.BLOCK :][: len(found)] = found
    if tables is not None:
        tables.drop(name)
    return out.reshape(2, cells)


def rarity(levels: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    a, b = Sketch.places(tokens, levels.shape[1])
    return np.minimum(levels[0][a], levels[1][b])


# --- components --------------------------------------------------------------------------------


def components(spark: SparkSession, edges: DataFrame, tables: Scratch, name: str = "cc") -> DataFrame:
    """(node, component) of every node of edges (a, b); component is the smallest node that it reaches.

    Alternates large-star and small-star steps, each a grouped minimum, until no edge changes; no
    node's neighbours are ever gathered in one place.
    """
    e = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    e, at, seen = tables.save(e, f"{name}0"), 0, None
    while True:
        both = e.union(e.select(F.col("b"), F.col("a")))
        # written, so that the join below is between plain exchanges, whose hot keys Spark can split
        least = tables.save(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), f"{name}-least{at}")
        large = e.select(F.col("a").alias("v"), F.col("b").alias("u")).join(least.withColumnRenamed("a", "u"), "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        # every larger neighbour v of u points to the least neighbour of u; u itself keeps its own edge to it
        large = large.union(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
        small = small.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        at += 1
        e = tables.save(small, f"{name}{at}")
        tables.drop(f"{name}{at - 1}", f"{name}-least{at - 1}")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).union(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
