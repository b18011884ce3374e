"""Benchmark decontamination by spaced seeds, in Spark's own operators throughout.

A mask such as 1110111 hashes the words at its ones and ignores those at its zeros, so a seed survives
substituted words there. Seeds of the benchmark and of the documents are joined; around each hit the
two texts are compared word by word, in place.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import Scratch, released, without

#: Found by greedy cover: every way to substitute a fifth of a window of 8 to 15 words leaves a seed of one of them.
MASKS = ("1111011", "110010111", "1110100011", "1011111", "11101101", "1101000111")


def normal_words(text: Column) -> Column:
    """Lower-case runs of letters and digits; none for null."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _run(length: int):
    return lambda x, i: F.xxhash64(x, *[F.get("run1", i + k) for k in range(1, length)])


def _seed(parts: list[tuple[int, int]], length: int):
    return lambda i: F.xxhash64(*[F.get(f"run{k}", i + o) for o, k in parts], F.lit(length))


def _seeds(df: DataFrame, masks: tuple[str, ...]) -> DataFrame:
    """Adds n and the seeds of all masks, one mask after the other, to rows with `words`."""
    out = df.select("*", F.size("words").alias("n"), F.transform("words", lambda w: F.xxhash64(w)).alias("run1"))
    runs = [[(m.start(), len(m[0])) for m in re.finditer("1+", mask)] for mask in masks]
    for r in sorted({k for mask in runs for _, k in mask} - {1}):
        out = out.select("*", F.transform("run1", _run(r)).alias(f"run{r}"))
    each = [F.when(F.col("n") >= len(mask), F.transform(F.sequence(F.lit(0), F.col("n") - len(mask)), _seed(parts, len(mask)))).otherwise(F.array().cast("array<bigint>")) for mask, parts in zip(masks, runs)]
    return out.select(*df.columns, "n", F.concat(*each).alias("seeds"))


def _place(pos: Column, n: Column, masks: tuple[str, ...]) -> Column:
    """Where in the text the seed at `pos` of the concatenated seeds starts."""
    out, before = pos, F.lit(0)
    for mask in masks:
        out = F.when(pos >= before, pos - before).otherwise(out)
        before = before + F.greatest(n - len(mask) + 1, F.lit(0))
    return out


def find_leaks(docs: DataFrame, benchmark: DataFrame, *, masks: tuple[str, ...] = MASKS, window: int = 15, percent: int = 80, min_words: int = 8, most_broadcast: int = 1_000_000) -> DataFrame:
    """(doc_id, item_id, matched, compared): the best window of each document and benchmark item.

    A pair counts when, at the offset of a shared seed, some window of `window` item words (the whole
    item if shorter) that overlaps the seed's start has at least `percent` of its words equal in
    place. With the defaults every such window has a seed, so none is missed; other windows and
    percentages need other masks for that. Items under `min_words` words, and null or shorter texts, match nothing. A null doc_id is
    an id like any other; rows with equal ids count as one document, and equal items as one.

    The benchmark's seeds are broadcast while they number at most `most_broadcast`; beyond, both
    sides are shuffled. Documents are never shuffled in the first case.
    """
    tables = Scratch(docs.sparkSession, "decontaminate")
    items = tables.save(benchmark.select("item_id", normal_words(F.col("text")).alias("item")).where(F.size("item") >= min_words).distinct(), "items")
    there = _seeds(items.withColumnRenamed("item", "words"), masks)
    # outer: else Spark tests the size of the seeds first, by a filter that it pushes down until the text is split in every lambda
    there = tables.save(there.select("item_id", "n", F.posexplode_outer("seeds").alias("p", "seed")).select("item_id", "seed", _place(F.col("p"), F.col("n"), masks).alias("j")).where("seed is not null").distinct(), "seeds")
    there = F.broadcast(there) if there.count() <= most_broadcast else there
    here = _seeds(docs.where("text is not null").select("doc_id", normal_words(F.col("text")).alias("words")), masks)
    here = here.select("doc_id", "n", F.posexplode_outer("seeds").alias("p", "seed"))
    hits = here.join(there, "seed").select("doc_id", "item_id", "j", (_place(F.col("p"), F.col("n"), masks) - F.col("j")).alias("d"))
    blocks = tables.save(hits.groupBy("doc_id", "item_id", "d", F.floor(F.col("j") / window).alias("block")).agg(F.min("j").alias("j1"), F.max("j").alias("j2")), "hits")
    # a written table: Spark knows its size, and moves the documents only if it is too large to broadcast
    text = docs.where("text is not null").select(F.col("doc_id").alias("id"), "text")
    both = text.join(blocks, text["id"].eqNullSafe(blocks["doc_id"])).join(items, "item_id")
    both = both.select("doc_id", "item_id", "d", "j1", "j2", "item", normal_words(F.col("text")).alias("words"), F.size("item").alias("m"))
    w = F.least(F.lit(window), F.col("m"))
    both = both.select("*", w.alias("w"), F.greatest(F.lit(0), F.col("j1") - w + 1).alias("lo"), F.least(F.col("j2"), F.col("m") - w).alias("hi"))
    # words and equal are each named twice, or Spark would fold them into the lambdas and split the text anew for every word
    at = lambda k: k + F.col("d")
    equal = F.transform(F.sequence(F.col("lo"), F.col("hi") + F.col("w") - 1), lambda k: F.when((at(k) >= 0) & (at(k) < F.size("words")) & (F.get("words", F.greatest(at(k), F.lit(0))) == F.get("item", k)), 1).otherwise(0))
    both = both.where("hi >= lo").select("doc_id", "item_id", "w", equal.alias("equal"))
    best = F.array_max(F.transform(F.sequence(F.lit(1), F.size("equal") - F.col("w") + 1), lambda s: F.aggregate(F.slice("equal", s, F.col("w")), F.lit(0), lambda a, x: a + x)))
    both = both.select("doc_id", "item_id", "w", best.alias("best"))
    enough = F.col("best") * 100 >= F.col("w") * percent  # tested in the aggregate: as a filter it would be pushed into the lambdas
    found = both.groupBy("doc_id", "item_id").agg(F.max(F.when(enough, F.col("best"))).cast("long").alias("matched"), F.max(F.when(enough, F.col("w"))).cast("long").alias("compared"))
    return found.where("matched is not null")


def drop_leaks(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """The documents that hold no benchmark passage, with their columns."""
    tables = Scratch(docs.sparkSession, "decontaminated")
    with released():
        bad = tables.save(find_leaks(docs, benchmark, **how).select("doc_id").distinct(), "ids")
    return without(docs, bad)
