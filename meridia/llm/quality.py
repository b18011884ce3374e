"""Quality rules with risk-controlled thresholds, in Spark's own operators throughout.

A rule rejects a document whose feature exceeds a cutoff. Labelled documents decide the cutoffs: in
each stratum a cutoff counts as safe when an exact binomial test shows, at a level corrected for all
rules and strata, that it rejects at most a stated share of good documents. Cutoffs are tested from
lenient to strict and testing stops at the first failure, which needs no further correction.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import SPACE, Scratch

#: Rule: cutoffs, from lenient to strict.
CUTOFFS = {
    "symbols": (2.0, 1.5, 1.0, 0.75, 0.5, 0.35, 0.25, 0.18, 0.12, 0.08),
    "upper": (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2, 0.15),
    "bangs": (2.0, 1.5, 1.0, 0.75, 0.5, 0.35, 0.25, 0.15),
    "repeats": (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2, 0.15, 0.1),
    "dup_lines": (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3),
    "long_words": (40.0, 30.0, 24.0, 20.0, 17.0, 15.0, 13.0, 12.0),
}


def base_features(docs: DataFrame) -> DataFrame:
    """doc_id, stratum, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_upper, n_bangs per row.

    Words are runs of characters other than space and U+0009 to U+000D. A null text has none.
    """
    text, lang = F.coalesce(F.col("text"), F.lit("")), F.coalesce(F.col("lang"), F.lit("")) if "lang" in docs.columns else F.lit("")
    a = docs.select("doc_id", lang.alias("stratum"), text.alias("text")).select("*", F.filter(F.split("text", SPACE), lambda w: w != "").alias("words"))
    a = a.select("*", F.size("words").alias("n"), F.transform("words", lambda w: F.xxhash64(w)).alias("wh"))
    at = lambda i, k: F.get("wh", i + k)
    a = a.select("*", F.when(F.col("n") >= 5, F.transform(F.sequence(F.lit(0), F.col("n") - 5), lambda i: F.xxhash64(at(i, 0), at(i, 1), at(i, 2), at(i, 3), at(i, 4)))).otherwise(F.array().cast("array<bigint>")).alias("win"))
    # windows that occur again, only where there are any: sorted by hash, equal ones are neighbours
    again = F.size(F.array_distinct("win")) < F.size("win")
    a = a.select("*", F.when(again, F.sort_array(F.transform("win", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).alias("sorted"))
    same = lambda j, k: F.coalesce(F.get("sorted", j)["h"] == F.get("sorted", j + k)["h"], F.lit(False))
    found = F.filter(F.sequence(F.lit(0), F.size("sorted") - 1), lambda j: same(j, -1) | same(j, 1))
    a = a.select("*", F.when(F.col("sorted").isNotNull(), F.sort_array(F.transform(found, lambda j: F.get("sorted", j)["i"]))).alias("starts"))
    covered = F.aggregate(F.transform("starts", lambda s, j: F.least(F.lit(5), F.coalesce(F.get("starts", j + 1), s + 5) - s)), F.lit(0), lambda x, y: x + y)
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    less = lambda pattern: F.length("text") - F.length(F.regexp_replace("text", pattern, ""))
    a = a.select("*", lines.alias("lines"))
    return a.select(
        "doc_id", "stratum", F.col("n").cast("long").alias("n_words"),
        F.aggregate("words", F.lit(0).cast("long"), lambda x, w: x + F.length(w)).alias("word_chars"),
        less(r"[#*$%&|<>]").cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(F.when(F.col("starts").isNotNull(), covered), F.lit(0)).cast("long").alias("n_repeat_words"),
        less(r"\p{Lu}+").cast("long").alias("n_upper"), less("!").cast("long").alias("n_bangs"),
        F.size("lines").cast("long").alias("n_lines"),
    )


def features() -> dict[str, Column]:
    n = F.greatest(F.col("n_words"), F.lit(1))
    return {
        "symbols": F.col("n_symbols") / n,
        "upper": F.col("n_upper") / F.greatest(F.col("word_chars"), F.lit(1)),
        "bangs": F.col("n_bangs") / n,
        "repeats": F.col("n_repeat_words") / n,
        "dup_lines": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
        "long_words": F.col("word_chars") / n,
    }


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def passed(rule: str, value: Column) -> Column:
    """The first of the rule's cutoffs, from 1, that the value exceeds, and with it all later ones; one beyond the last if none."""
    return F.aggregate(F.array(*map(F.lit, CUTOFFS[rule])), F.lit(1), lambda n, c: n + F.when(value > c, 0).otherwise(1))


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X of Binomial(n, p), exactly summed in logarithms."""
    first, odds = n * F.lit(math.log1p(-p)), F.lit(math.log(p) - math.log1p(-p))

    def more(acc, i):
        term = acc["term"] + F.log((n - i + 1) / i) + odds
        top = F.greatest(acc["sum"], term)
        return F.struct(term.alias("term"), (top + F.log1p(F.exp(F.least(acc["sum"], term) - top))).alias("sum"))

    start = F.struct(first.cast("double").alias("term"), first.cast("double").alias("sum"))
    steps = F.when(k >= 1, F.sequence(F.lit(1).cast("long"), F.greatest(k, F.lit(1)).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    return F.exp(F.aggregate(steps, start, more, lambda acc: acc["sum"]))


def safe_cutoffs(measured: DataFrame, labels: DataFrame, *, risk: float = 0.05, error: float = 0.05) -> DataFrame:
    """(stratum, rule, step): reject documents that exceed the rule's cutoff of number `step`; cutoffs are tried from the most lenient on.

    With probability 1 - error, over the draw of the labels, no stratum loses more than the share
    `risk` of its good documents, all rules taken together. Of the safe cutoffs of a rule the one with
    the most bad documents more than good ones rejected is taken, the most lenient of equal ones; a
    rule that rejects no more bad than good documents is left out. A document with several labels
    counts by its worst; null labels are left out.
    """
    one = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    known = measured.where(~base_failed()).join(one, "doc_id").select("stratum", "quality", *[passed(r, c).alias(r) for r, c in features().items()])
    rows = known.select("stratum", "quality", F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).alias("steps")) for r in CUTOFFS])).alias("x")).select("stratum", "quality", "x.*")
    counts = rows.groupBy("stratum", "rule", "steps").agg(F.sum(F.when(F.col("quality") > 0, 1).otherwise(0)).alias("good"), F.sum(F.when(F.col("quality") > 0, 0).otherwise(1)).alias("bad"))
    step = F.explode(F.sequence(F.lit(1), F.lit(max(map(len, CUTOFFS.values()))))).alias("step")
    at = counts.select("*", step).groupBy("stratum", "rule", "step").agg(
        F.sum("good").alias("n"), F.sum(F.when(F.col("steps") <= F.col("step"), F.col("good")).otherwise(0)).alias("k"), F.sum(F.when(F.col("steps") <= F.col("step"), F.col("bad")).otherwise(0)).alias("hit"))
    strata = known.select(F.count_distinct("stratum").alias("strata"))
    share = risk / len(CUTOFFS)
    p = F.when(F.col("k") <= share * F.col("n"), binomial_tail(F.col("k"), F.col("n"), share)).otherwise(1.0)
    most = F.element_at(F.create_map(*[x for r, c in CUTOFFS.items() for x in (F.lit(r), F.lit(len(c)))]), F.col("rule"))
    tested = at.where(F.col("step") <= most).join(strata).select("*", (p > error / (len(CUTOFFS) * F.col("strata"))).alias("fails"))
    first = tested.groupBy("stratum", "rule").agg(F.min(F.when(F.col("fails"), F.col("step"))).alias("stop"))
    safe = tested.join(first, ["stratum", "rule"]).where("(stop is null or step < stop) and hit > k")
    return safe.groupBy("stratum", "rule").agg(F.max_by("step", F.struct(F.col("hit") - F.col("k"), -F.col("step"))).alias("step"))


def apply_rules(docs: DataFrame, labels: DataFrame, *, risk: float = 0.05, error: float = 0.05, most_broadcast: int = 10_000) -> DataFrame:
    """One row per document: doc_id, the base figures, base_failed, failed_rules and kept.

    Needs doc_id and text, and lang for strata (null: a stratum of its own). base_failed: under 10
    words, or over a fifth of the words in repeated 5-word windows. A stratum without enough labels
    has no safe cutoff, so it loses nothing beyond base_failed. Rows stay one for one.
    """
    tables = Scratch(docs.sparkSession, "quality")
    measured = tables.save(base_features(docs), "features")
    cut = tables.save(safe_cutoffs(measured, labels, risk=risk, error=error).groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("rule", "step"))).alias("cut")), "cutoffs")
    cut = F.broadcast(cut) if cut.count() <= most_broadcast else cut  # a row a stratum; beyond, an ordinary join
    failed = F.filter(F.array(*[F.when(passed(r, c) <= F.element_at("cut", F.lit(r)), F.lit(r)) for r, c in features().items()]), lambda x: x.isNotNull())
    out = measured.join(cut, "stratum", "left").select("*", base_failed().alias("base_failed"), F.coalesce(failed, F.array().cast("array<string>")).alias("failed_rules"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & (F.size("failed_rules") == 0)).alias("kept"), "failed_rules")
