"""Prefix trie of conversations: which leading turns they share, and what sharing them saves.

Conversations are dealt by the digest of their first turn, and each task builds pointer tries of what
it gets. First turns with too many turns below them are dealt again by the turns that follow, until
every part fits a task; the few nodes above such parts, the spine, are put together from their tops.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import Scratch, column, if_few

#: Characters of a turn's digest.
WIDE = 32
EMPTY = hashlib.sha256(b"").hexdigest()
NODE = "conv_id long, depth long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, parent_conv_id long, above string"


def turns_of(conversations: DataFrame) -> DataFrame:
    """conv_id, path (digests of the turns, joined) and words (of each turn), turns in order: a null one first, equal ones by their digest."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    role, said = text("role"), text("text")
    digest = F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, said).cast("binary"))
    one = F.struct(F.col("turn").cast("long").alias("turn"), digest.alias("digest"), F.regexp_count(said, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"))
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), one.alias("one"))
    rows = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("one")).alias("turns"))
    return rows.select("conv_id", F.array_join("turns.digest", "").alias("path"), F.col("turns.words").alias("words"))


def regenerate(turns: DataFrame, family: int = 20, heads: int = 4) -> DataFrame:
    """Every conversation c with its first h turns from conversation c - c % family, h = crc32(c) % heads."""
    head = turns.where(F.col("conv_id") % family == 0).select(F.col("conv_id").alias("from_"), F.substring("path", 1, WIDE * (heads - 1)).alias("path_"), F.slice("words", 1, heads - 1).alias("words_"))
    h = (F.crc32(F.col("conv_id").cast("string")) % heads).cast("int")
    each = turns.withColumn("h", h).withColumn("from_", F.col("conv_id") - F.col("conv_id") % family).join(head, "from_", "left")
    path = F.concat(F.substring(F.coalesce("path_", F.lit("")), F.lit(1), F.col("h") * WIDE), F.substring(F.col("path"), F.col("h") * WIDE + 1, F.length("path")))
    words = F.concat(F.slice(F.coalesce("words_", F.array().cast("array<bigint>")), F.lit(1), F.col("h")), F.slice("words", F.col("h") + 1, F.greatest(F.size("words"), F.lit(1))))
    return each.select("conv_id", path.alias("path"), words.alias("words"))


# --- equal conversations -----------------------------------------------------------------------


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Streams blocks of ids, sorted by key, into one digest a key."""

    def blocks():
        for batch in batches:
            yield from zip(*(column(batch, c) for c in ("key", "ids", "least", "n")))

    rows = []
    for key, parts in groupby(blocks(), lambda b: b[0]):
        sha, least, total = hashlib.sha256(), None, 0
        for _, ids, first, n in parts:
            sha.update((b"," if total else b"") + ids.encode())
            least, total = first if least is None else least, total + n
        rows.append((key, least, total, sha.hexdigest()))
        if len(rows) == 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=["key", "conv_id", "n", "ends"])
            rows = []
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=["key", "conv_id", "n", "ends"])


def distinct_paths(convs: DataFrame, tables: Scratch, block: int = 256) -> DataFrame:
    """path, words, conv_id (the smallest), n and ends (digest of all ids) of each distinct sequence of turns.

    Ids are joined in blocks of at most `block` first, so that a sequence of very many conversations is
    few rows where its digest is made, which streams over them in order.
    """
    keyed = tables.save(convs.withColumn("key", F.md5(F.col("path").cast("binary"))), "rebuilt")
    ids = F.sort_array(F.collect_list("conv_id"))
    blocks = keyed.groupBy("key", F.floor(F.col("conv_id") / block).alias("block")).agg(ids.alias("c"), F.count("*").alias("n"))
    blocks = blocks.select("key", "block", F.array_join(F.col("c").cast("array<string>"), ",").alias("ids"), F.col("c")[0].alias("least"), "n")
    spread = blocks.repartition("key").sortWithinPartitions("key", "block")
    classes = tables.save(spread.mapInArrow(_digests, "key string, conv_id long, n long, ends string"), "classes")
    return tables.save(keyed.select("conv_id", "path", "words").join(classes.select("conv_id", "n", "ends"), "conv_id"), "paths")


# --- tries -------------------------------------------------------------------------------------


class Node:
    __slots__ = ("children", "parent", "depth", "words", "conv", "n", "ends", "leaves", "saved")

    def __init__(self, parent: Node | None, depth: int, words: int):
        self.children, self.parent, self.depth, self.words = {}, parent, depth, words
        self.conv, self.n, self.ends, self.leaves, self.saved = None, 0, EMPTY, 0, 0


def build(rows: Iterator[tuple[str, list[int], int, int, str, int]]) -> list[tuple[Node, str]]:
    """Tops of the tries of (path, words, conv_id, n, ends, depth of the top), each with the path above it."""
    tops: dict[str, Node] = {}
    for path, words, conv, n, ends, top in rows:
        start = path[: WIDE * top]
        node = tops.get(start)
        if node is None:
            node = tops[start] = Node(None, top, int(words[top - 1]))
        for d in range(top, len(words) + 1):
            if d > top:
                turn = path[WIDE * (d - 1) : WIDE * d]
                below = node.children.get(turn)
                if below is None:
                    below = node.children[turn] = Node(node, d, int(words[d - 1]))
                node = below
            node.n += n
            node.conv = conv if node.conv is None else min(node.conv, conv)
        node.ends = ends
    return [(node, start[:-WIDE]) for start, node in tops.items()]


def postorder(top: Node) -> Iterator[Node]:
    """Children before their parent, without recursion: paths may be longer than any stack."""
    stack = [(top, iter(top.children.values()))]
    while stack:
        node, rest = stack[-1]
        below = next(rest, None)
        if below is None:
            stack.pop()
            yield node
        else:
            stack.append((below, iter(below.children.values())))


def _tries(frame: pd.DataFrame) -> pd.DataFrame:
    out = []
    for top, above in build(zip(frame["path"], frame["words"], frame["conv_id"].tolist(), frame["n"].tolist(), frame["ends"], frame["top"].tolist())):
        for node in postorder(top):
            node.leaves = node.leaves or 1
            node.saved += (node.n - 1) * node.words
            if node is not top:
                node.parent.leaves += node.leaves
                node.parent.saved += node.saved
            out.append((node.conv, node.depth, node.n, len(node.children), node.leaves, node.saved, node.ends, node.parent.conv if node.parent else None, above if node is top else None))
    found = pd.DataFrame(out, columns=["conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256", "parent_conv_id", "above"])
    return found.astype({"parent_conv_id": "Int64"})


def trie(paths: DataFrame, tables: Scratch, most_turns: int = 2_000) -> DataFrame:
    """Nodes of the trie of distinct paths(path, words, conv_id, n, ends); see conversation_trie."""
    spark = paths.sparkSession
    size = F.size("words")
    root = paths.agg(F.min("conv_id").alias("conv_id"), F.sum("n").alias("n_convs"), F.max(F.when(size == 0, F.col("ends"))).alias("ends"), F.sum(size).alias("turns")).first()
    if root["n_convs"] is None:
        return spark.createDataFrame([], NODE).drop("above")
    spine, settled, depth = [], [], 1
    rest = paths.where(size > 0)
    while True:
        at: Column = F.substring(F.col("path"), 1, WIDE * depth)
        keyed = rest.withColumn("at", at)
        sums = keyed.groupBy("at").agg(F.sum(size - depth + 1).alias("turns"), F.count("*").alias("paths"), F.sum("n").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.max(F.get("words", F.lit(depth - 1))).alias("own"))
        large = tables.save(sums.where((F.col("turns") > most_turns) & (F.col("paths") > 1)), f"spine{depth}")
        if large.isEmpty():
            settled.append(rest.withColumn("top", F.lit(depth)))
            break
        marks = if_few(large.select("at"))
        spine.append(large.join(tables.save(keyed.where(size == depth).join(marks, "at", "left_semi").select("at", "ends"), f"ends{depth}"), "at", "left"))
        settled.append(keyed.join(marks, "at", "left_anti").drop("at").withColumn("top", F.lit(depth)))
        # those that end here are the spine's own; the others go one turn further
        rest = tables.save(keyed.join(marks, "at", "left_semi").where(size > depth).drop("at"), f"rest{depth}")
        depth += 1
    parts = settled[0]
    for more in settled[1:]:
        parts = parts.union(more)
    n_parts = int(root["turns"]) // most_turns + 1
    dealt = parts.withColumn("part", F.pmod(F.xxhash64(F.substring("path", F.lit(1), WIDE * F.col("top"))), F.lit(n_parts)))
    below = tables.save(dealt.groupBy("part").applyInPandas(_tries, NODE), "below")
    # the spine, from its deepest nodes to the root: a node is put together from the tops right below it
    out, tops = below.where("above is null"), below.where("above is not null")
    for d in range(len(spine), -1, -1):
        here = spine[d - 1].select("at", "n_convs", "conv_id", "ends", "own") if d else spark.createDataFrame([("", root["n_convs"], root["conv_id"], root["ends"], 0)], "at string, n_convs long, conv_id long, ends string, own long")
        mine = tops.where(F.col("depth") == d + 1)
        sums = mine.groupBy(F.col("above").alias("at")).agg(F.count("*").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved"))
        here = here.join(sums, "at", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
        here = here.select("at", "conv_id", F.lit(d).cast("long").alias("depth"), "n_convs", "n_children", F.coalesce("n_leaves", F.lit(1)).alias("n_leaves"), (F.coalesce("saved", F.lit(0)) + (F.col("n_convs") - 1) * F.col("own")).alias("saved_tokens"), F.coalesce("ends", F.lit(EMPTY)).alias("ends_sha256"))
        here = tables.save(here, f"level{d}")
        parent = if_few(here.select(F.col("at").alias("above"), F.col("conv_id").alias("parent_")))
        out = out.unionByName(mine.join(parent, "above").withColumn("parent_conv_id", F.col("parent_")).drop("parent_"))
        node = here.withColumn("above", F.expr(f"left(at, {WIDE * (d - 1)})") if d else F.lit(None).cast("string")).withColumn("parent_conv_id", F.lit(None).cast("long")).drop("at")
        tops = tops.where(F.col("depth") <= d).unionByName(node) if d else node
    return out.unionByName(tops).drop("above")


def conversation_trie(conversations: DataFrame, *, rebuild: bool = True, family: int = 20, heads: int = 4, most_turns: int = 2_000) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of every node.

    A node is a distinct sequence of the first d turns (role, text) of conversations(conv_id, turn, role,
    text), known by d and the smallest conv_id that begins with it; the root has d = 0. n_convs counts
    conversations that begin so, n_leaves childless nodes in its subtree; saved_tokens adds up over the
    subtree the words of each node's last text, once for each conversation but the first; ends_sha256 is
    the digest of the ids, in order and joined by commas, of those that end there. With `rebuild` each
    conversation first takes up to heads - 1 turns from the first of its family (regenerate).

    A null role or text is empty, rows with a null conv_id are left out, a null turn comes first; equal
    turns are ordered by a digest of role and text; repeated rows are turns of their own; an empty table has no nodes. Turns are told apart by digests of 128 bits. No task
    gets much more than `most_turns` turns but those of a single path; a conversation is one row. The
    recursion is as deep as the longest prefix that so many turns of different paths lie below.
    """
    tables = Scratch(conversations.sparkSession, "prefix-trie")
    turns = turns_of(conversations)
    if rebuild:
        turns = regenerate(tables.save(turns, "turns"), family, heads)
    return trie(distinct_paths(turns, tables), tables, most_turns)
