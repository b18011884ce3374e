"""Mixing to target weights with soft domains.

A classifier learned from a labelled table gives each document posteriors over domains. Projected
gradient steps then fit a nonnegative rate per document, such that expected tokens by domain match
the targets in the least-squares sense.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import Scratch, WordHash, column, mix, tidy

#: Buckets of hashed words as a power of two.
BITS = 16


def word_buckets(hashes: np.ndarray) -> np.ndarray:
    return (mix(hashes) >> np.uint64(64 - BITS)).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many documents of each domain have a word in each bucket."""
    hashes, counts, docs = WordHash(lower=True), {}, {}
    for batch in batches:
        for domain, words in zip(column(batch, "domain"), hashes.texts(column(batch, "text"))):
            counts.setdefault(domain, np.zeros(1 << BITS, np.int64))[np.unique(word_buckets(words))] += 1
            docs[domain] = docs.get(domain, 0) + 1
    yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(docs.values()), pa.int64()), pa.array([c.tobytes() for c in counts.values()], pa.binary())], names=["domain", "docs", "counts"])


def _add(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(c, np.int64) for c in table.column("counts").to_pylist())
    return pa.table({"domain": table.column("domain").slice(0, 1), "docs": pa.array([sum(table.column("docs").to_pylist())], pa.int64()), "counts": pa.array([total.tobytes()], pa.binary())})


#: How many documents' worth the whole weighs in a bucket's rate in a domain.
WEIGHT = 5.0


def evidence(counts: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Log ratios of how common a bucket is in each domain to how common it is in all; 0 where that may be chance.

    It may be up to as many standard deviations as the largest of so many normal variables is likely to have.
    """
    rate = (counts.sum(0) + 0.5) / (docs.sum() + 1.0)
    n = docs[:, None]
    most = np.sqrt(2 * np.log(max(2, (counts.sum(0) > 0).sum() * len(docs))))
    sure = np.abs(counts - n * rate) >= most * np.sqrt(n * rate * (1 - rate) + 1e-9)
    return np.where(sure, np.log((counts + WEIGHT * rate) / ((n + WEIGHT) * rate)), 0.0)


class Model:
    """A naive Bayes classifier over words that a document has, and what its posteriors owe to wrong labels."""

    def __init__(self, table: np.ndarray, prior: np.ndarray, scale: float, power: float, floor: np.ndarray):
        self.table, self.prior, self.scale, self.power, self.floor = table, prior, scale, power, floor

    def evidence(self, words: np.ndarray) -> tuple[np.ndarray, int]:
        """(evidence summed over the distinct words, the number of all words)"""
        return self.table[:, np.unique(word_buckets(words))].sum(1), len(words)

    def raw(self, words: np.ndarray) -> np.ndarray:
        z, n = self.evidence(words)
        return softmax(self.scale * z / max(1, n) ** self.power + self.prior)

    def posteriors(self, words: np.ndarray) -> np.ndarray:
        return corrected(self.raw(words), self.floor)


def softmax(z: np.ndarray) -> np.ndarray:
    p = np.exp(z - z.max())
    return p / p.sum()


def corrected(p: np.ndarray, floor: np.ndarray) -> np.ndarray:
    """Posteriors less what wrong labels alone give a domain; as they were if nothing is left."""
    q = np.maximum(0.0, p - floor)
    return q / q.sum() if q.sum() > 0 else p


def _score(model: Model, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, k = WordHash(lower=True), len(model.prior)
        for batch in batches:
            tokens, rows = [], []
            for words in hashes.texts(column(batch, "text")):
                tokens.append(len(words))
                rows.append(model.posteriors(words))
            flat = pa.array(np.concatenate(rows) if rows else np.zeros(0))
            posteriors = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * k), flat)
            keep = [batch.column(batch.schema.get_field_index(x)) for x in names]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(tokens, pa.int64()), posteriors], names=[*names, "tokens", "posteriors"])

    return run


def learn(docs: DataFrame, labelled: DataFrame, domains: list[str], *, most_labels: int = 20_000) -> Model:
    """A classifier of documents by domain, from at most `most_labels` labelled rows, those first in the order of a hash of doc_id.

    A fifth of them, which it doesn't learn from, tells how far to temper the evidence, by log loss,
    and what posterior a domain has in documents that look like another one: half of those have
    less. Where labels may be wrong, that much is theirs and not the documents', and is taken off, if
    some document has twice as much: else nothing tells the domain. A document with several domains
    counts by the first of `domains`.
    """
    rank = F.coalesce(*[F.when(F.col("domain") == d, F.lit(i)) for i, d in enumerate(domains)])
    known = labelled.where(F.col("domain").isin(domains) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(rank).alias("r"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_labels).select(F.col("doc_id").alias("label_id"), F.element_at(F.array(*map(F.lit, domains)), F.col("r") + 1).alias("domain"))
    docs = docs.select("doc_id", "text")
    rows = docs.join(F.broadcast(known), docs["doc_id"] == known["label_id"]).where("text is not null").select("doc_id", "domain", F.col("text").cast("binary").alias("text"))  # at most most_labels ids
    part = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(7)), F.lit(5)) == 0
    found = {r["domain"]: r for r in rows.where(~part).select("domain", "text").mapInArrow(tidy(_count), "domain string, docs long, counts binary").groupBy("domain").applyInArrow(_add, "domain string, docs long, counts binary").collect()}
    counts = np.stack([np.frombuffer(bytes(found[d]["counts"]), np.int64) if d in found else np.zeros(1 << BITS) for d in domains]).astype(float)
    docs_of = np.array([found[d]["docs"] if d in found else 0 for d in domains], float)
    prior = np.log((docs_of + 0.5) / (docs_of + 0.5).sum())
    model = Model(evidence(counts, docs_of).astype(np.float32), prior, 1.0, 0.0, np.zeros(len(domains)))
    held = rows.where(part).select("domain", "text").mapInArrow(tidy(_held(model)), "domain string, words long, evidence array<double>").collect()  # at most most_labels rows of a number a domain
    if held:
        true = np.array([domains.index(r["domain"]) for r in held])
        z, n = np.array([r["evidence"] for r in held]), np.maximum(1, np.array([r["words"] for r in held]))[:, None]
        grid = [(s, p) for p in (0.0, 0.5, 1.0) for s in (1.0, 0.7, 0.5, 0.3, 0.2, 0.1, 0.05, 0.02, 0.01)]
        logs = {}
        for s, p in grid:
            y = s * z / n**p + prior
            y -= y.max(1, keepdims=True)
            logs[s, p] = y - np.log(np.exp(y).sum(1, keepdims=True))
        loss = lambda g: round(float(-logs[g][np.arange(len(true)), true].mean()), 9)
        model.scale, model.power = min(grid, key=lambda g: (loss(g), grid.index(g)))
        p = np.exp(logs[model.scale, model.power])
        likely = p.argmax(1)
        floor = [np.median(p[likely != d, d]) if (likely != d).any() else 0.0 for d in range(len(domains))]
        model.floor = np.where(p.max(0) >= 2 * np.array(floor), floor, 0.0)
    return model


def _held(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHash(lower=True)
        for batch in batches:
            got = [model.evidence(words) for words in hashes.texts(column(batch, "text"))]
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("domain")), pa.array([n for _, n in got], pa.int64()), pa.array([z.tolist() for z, _ in got], pa.list_(pa.float64()))], names=["domain", "words", "evidence"])

    return run


def rates(p: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """Rates of rows with posteriors p: from 1 on, each step takes off posteriors times it, and stops at 0."""
    r = np.ones(len(p))
    for change in (p @ np.reshape(steps, (-1, p.shape[1])).T).T:
        r = np.maximum(0.0, r - change)
    return r


def _matrix(batch: pa.RecordBatch, name: str, k: int) -> np.ndarray:
    values = batch.column(batch.schema.get_field_index(name))
    return values.flatten().to_numpy(zero_copy_only=False).reshape(-1, k)


def _sums(k: int, done: np.ndarray, trials: np.ndarray):
    """After the steps done and each one of the trials: tokens by domain, and the Gram matrix of the rows above 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(trials), k + k * k))
        for batch in batches:
            p, tokens = _matrix(batch, "p", k), batch.column(batch.schema.get_field_index("tokens")).to_numpy().astype(np.float64)
            weighed, now = p * tokens[:, None], rates(p, done)
            for row, change in zip(total, (p @ trials.T).T):
                rate = np.maximum(0.0, now - change)
                row[:k] += rate @ weighed
                row[k:] += (weighed[rate > 0].T @ p[rate > 0]).reshape(-1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size, dtype=np.int32)), pa.array(total.reshape(-1))], names=["i", "x"])

    return run


#: Lengths of a step that are tried together, along the gradient scaled by all rows (1 is safe) and along that scaled by the rows above 0.
LENGTHS, FREE_LENGTHS = (1.0, 2.0, 4.0, 8.0, 16.0, 32.0, 64.0, 128.0), (1.0, 0.7, 0.4, 0.2, 0.05)


def _inverse(gram: np.ndarray) -> np.ndarray:
    return np.linalg.pinv(gram, rcond=1e-12, hermitian=True)


def fit_rates(scored: DataFrame, weights: np.ndarray, *, most_steps: int = 60, tolerance: float = 1e-6, least_gain: float = 1e-4) -> tuple[np.ndarray, np.ndarray, bool]:
    """Steps from which rates(p, steps) gives the rate of a row of scored(tokens, p); tokens by domain under them; whether the targets are met.

    Column d of A holds a row's tokens times its posteriors, and T is all tokens times the weights.
    Projected gradient steps from rates of 1 lower the squares of A r - T over all r >= 0. Misfits are
    measured by the inverse Gram matrix of the posteriors, every token counting the same: by how much
    the table as a whole can change them; a domain of which no row has anything is left out. A step is
    a number a domain, so a row's rate is found again from the steps and its posteriors, and only sums
    come to the driver, a few for each pair of domains. Each pass over the table tries several lengths
    along the gradient, in two scalings, and keeps the one of least squares. Ends when every domain is
    within `tolerance` of all tokens of its target, when a step takes less than the share
    `least_gain` off the squares, or after most_steps.
    """
    k = len(weights)

    def look(done: np.ndarray, trials: np.ndarray) -> np.ndarray:
        rows = scored.select("tokens", "p").mapInArrow(tidy(_sums(k, done, trials)), "i int, x double").groupBy("i").agg(F.sum("x").alias("x")).collect()
        out = np.zeros(len(trials) * (k + k * k))
        for r in rows:
            out[r["i"]] = float(f"{r['x']:.13g}")  # sums differ in their last digits by the order of tasks
        return out.reshape(len(trials), -1)

    steps = np.zeros((0, k))
    now = look(steps, np.zeros((1, k)))[0]
    total = float(now[:k].sum())
    if not total:
        return steps, np.zeros(k), False
    target, inverse = total * weights, _inverse(now[k:].reshape(k, k))
    square = lambda s: float((s[:k] - target) @ inverse @ (s[:k] - target))
    while len(steps) < most_steps and np.abs(now[:k] - target).max() > tolerance * total:
        miss = now[:k] - target
        trials = np.vstack([np.outer(LENGTHS, inverse @ miss), np.outer(FREE_LENGTHS, _inverse(now[k:].reshape(k, k)) @ miss)])
        seen = look(steps, trials)
        best = min(range(len(trials)), key=lambda i: (square(seen[i]), i))
        if square(seen[best]) >= square(now) * (1 - least_gain):
            break
        steps, now = np.vstack([steps, trials[best]]), seen[best]
    # within a thousandth of each target, and of all tokens for a target of nothing
    return steps, now[:k], bool((np.abs(now[:k] - target) <= 1e-3 * np.where(weights > 0, target, total)).all())


def _rate(k: int, steps: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = batch.column(batch.schema.get_field_index("tokens")).to_numpy()
            rate = np.where(tokens > 0, rates(_matrix(batch, "p", k), steps), 1.0)
            at = batch.schema.get_field_index("rate")
            yield batch.set_column(at, batch.schema.field(at), pa.array(np.round(rate, 6)))

    return run


#: Columns that mix_documents adds.
ADDED = ("tokens", "posteriors", "rate", "copies", "on_target", "residual")


def mix_documents(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], *, most_labels: int = 20_000, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep` columns, tokens, posteriors (in the order of `targets`), rate, copies, on_target and residual of every row.

    labelled has (doc_id, domain); targets are weights by domain, scaled to sum 1. rate is how often a
    document should be seen, and copies its whole number, rounded up for the share of documents that
    its fraction says, by a hash of doc_id. A null or empty text has no tokens and the rate 1. Rows of
    a null doc_id are scored and rated as others; so are rows of repeated ids, one for one. on_target
    and residual are the same in every row: whether each target is met within a thousandth, and the
    share of the mixture's tokens that each domain has beyond its target (in the order of `targets`). Where no
    rates meet the targets they are those of least squares. Kept columns named as the added ones are
    left out.
    """
    domains, tables = list(targets), Scratch(docs.sparkSession, "mixing")
    if not domains or min(targets.values()) < 0 or not sum(targets.values()):
        raise ValueError("targets must be nonnegative weights, and not all 0")
    weights = np.array([targets[d] for d in domains], float)
    weights /= weights.sum()
    shared = docs.sparkSession.sparkContext.broadcast(learn(docs, labelled, domains, most_labels=most_labels))
    names = [c for c in keep if c not in ADDED]
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    inner = {c: f"k{i}" for i, c in enumerate(names) if c != "text"}  # names of their own, whatever the columns are called
    rows = docs.select(*[F.col(f"`{c}`").alias(k) for c, k in inner.items()], F.col("text").cast("binary").alias("text"))
    carry = [*inner.values(), *(["text"] if "text" in names else [])]
    kept = ", ".join([*[f"{k} {kinds[c]}" for c, k in inner.items()], *(["text binary"] if "text" in names else [])])
    scored = tables.save(rows.mapInArrow(tidy(_lazy(shared, carry)), f"{kept}, tokens long, posteriors array<double>".lstrip(", ")).withColumnRenamed("posteriors", "p"), "scored")
    steps, share, met = fit_rates(scored, weights)
    rated = scored.withColumn("rate", F.lit(0.0)).mapInArrow(tidy(_rate(len(domains), steps)), f"{kept}, tokens long, p array<double>, rate double".lstrip(", "))
    residual = np.round(share / max(1.0, share.sum()) - weights, 9).tolist()
    key = F.col(inner["doc_id"]) if "doc_id" in inner else F.monotonically_increasing_id()
    extra = (F.pmod(F.xxhash64(key, F.lit(11)), F.lit(1_000_003)) / 1_000_003) < F.col("rate") - F.floor("rate")
    out = [F.col("text").cast("string").alias("text") if c == "text" else F.col(inner[c]).alias(c) for c in names]
    return rated.select(*out, "tokens", F.col("p").alias("posteriors"), "rate", (F.floor("rate") + extra.cast("long")).alias("copies"), F.lit(met).alias("on_target"), F.array(*map(F.lit, residual)).alias("residual"))


def _lazy(shared, names: list[str]):
    def run(batches):
        yield from _score(shared.value, names)(batches)

    return run
