"""Fitted rates against a small dense solver, with targets in and out of reach, and odd rows."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from meridia.llm import mixing, queries


def table(spark, tokens, p):
    rows = [(int(t), [float(x) for x in q]) for t, q in zip(tokens, p)]
    return spark.createDataFrame(rows, "tokens long, p array<double>").repartition(3)


def dense(tokens, p, weights, steps=200_000):
    """Plain projected gradient with one safe length, to the end."""
    target, rate = tokens.sum() * weights, np.ones(len(tokens))
    inverse = np.linalg.pinv((p * tokens[:, None]).T @ p, rcond=1e-12)
    for _ in range(steps):
        new = np.maximum(0, rate - p @ (inverse @ ((rate * tokens) @ p - target)))
        if np.abs(new - rate).max() < 1e-12:
            break
        rate = new
    return rate


def square(tokens, p, weights, rate):
    miss = (rate * tokens) @ p - tokens.sum() * weights
    return miss @ np.linalg.pinv((p * tokens[:, None]).T @ p, rcond=1e-12) @ miss


@pytest.mark.parametrize("seed", range(4))
def test_reachable_targets_are_met(spark, seed):
    rng = np.random.default_rng(seed)
    tokens, p = rng.integers(1, 3000, 400), rng.dirichlet((0.2, 0.5, 2.0), 400)
    weights = np.array([0.01, 0.04, 0.95])
    steps, share, met = mixing.fit_rates(table(spark, tokens, p), weights)
    assert met and np.allclose(share, tokens.sum() * weights, rtol=1e-3)
    rates = mixing.rates(p, steps)
    assert (rates >= 0).all() and np.allclose((rates * tokens) @ p, share)
    assert square(tokens, p, weights, rates) <= square(tokens, p, weights, dense(tokens, p, weights, 2_000)) + 1e-9  # both go to 0


@pytest.mark.parametrize("seed", range(3))
def test_targets_out_of_reach_leave_the_least_squares(spark, seed):
    rng = np.random.default_rng(seed)
    tokens = rng.integers(1, 3000, 300)
    p = 0.2 + 0.4 * rng.dirichlet((1, 1, 1), 300)  # no row has under a fifth of any domain
    p /= p.sum(1, keepdims=True)
    weights = np.array([0.01, 0.04, 0.95])
    steps, share, met = mixing.fit_rates(table(spark, tokens, p), weights)
    rates = mixing.rates(p, steps)
    assert not met and np.allclose((rates * tokens) @ p, share)
    assert square(tokens, p, weights, rates) <= 1.05 * square(tokens, p, weights, dense(tokens, p, weights))


def test_a_domain_without_any_document_is_left_out(spark):
    tokens, p = np.full(1000, 100), np.tile([0.0, 0.3, 0.7], (1000, 1))
    p[::2] = (0.0, 0.0, 1.0)
    steps, share, met = mixing.fit_rates(table(spark, tokens, p), np.array([0.1, 0.1, 0.8]))
    assert not met and np.allclose(share / tokens.sum(), [0.0, 0.1, 0.8], atol=1e-3)


def test_residuals_are_told(spark):
    docs = [(i, "apple pear plum " * 20 if i % 2 else "iron zinc lead " * 20) for i in range(200)]
    labelled = spark.createDataFrame([(i, "fruit" if i % 2 else "metal") for i in range(200)], "doc_id long, domain string")
    out = mixing.mix_documents(spark.createDataFrame(docs, "doc_id long, text string"), labelled, {"fruit": 0.3, "metal": 0.5, "wood": 0.2}).collect()
    shares = np.array([r["tokens"] * r["rate"] * np.array(r["posteriors"]) for r in out]).sum(0) / sum(r["tokens"] for r in out)
    assert not out[0]["on_target"] and len({tuple(r["residual"]) for r in out}) == 1
    # as it is stated: the share of all tokens that a domain has, and its target
    total = np.array([r["tokens"] * r["rate"] for r in out]).sum() / sum(r["tokens"] for r in out)
    assert np.allclose(shares / total - [0.3, 0.5, 0.2], out[0]["residual"], atol=1e-4) and out[0]["residual"][2] < -0.1


def test_wrong_labels_do_not_thin_out_clean_documents(spark):
    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(1500):
        bad = i % 20 == 0
        text = " ".join(rng.choice(words, 40)) + (" vile nasty" if bad else "")
        rows.append((i, text))
        labels.append((i, "bad" if bad != (rng.random() < 0.1) else "good"))  # a tenth of the labels are wrong
    out = mixing.mix_documents(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, domain string"), {"bad": 0.01, "good": 0.99}).collect()
    assert all(r["on_target"] for r in out)
    clean = [r["rate"] for r in out if r["doc_id"] % 20]
    assert min(clean) > 0.9 and max(clean) < 1.3 and max(r["rate"] for r in out if r["doc_id"] % 20 == 0) < 0.5


def test_registered_targets(spark):
    rows = queries.op7_mixing(spark, "/root/testdata/sf0.001").collect()
    total = sum(r["tokens"] for r in rows)
    if all(r["on_target"] for r in rows):
        for i, weight in enumerate(queries.TARGETS.values()):
            assert sum(r["tokens"] * r["rate"] * r["posteriors"][i] for r in rows) == pytest.approx(total * weight, rel=2e-3)


def test_odd_rows_and_names(spark):
    docs = [(i, ("apple pear " if i % 2 else "iron zinc ") * 30) for i in range(40)] + [(None, "apple pear"), (3, "apple pear " * 30), (99, None), (98, ""), (97, "apple " * 200_000)]
    docs = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as tokens", "2 as rate", "3 as p", "4 as label_id", "'x' as domain", "5 as k0", "6 as posteriors")
    labelled = spark.createDataFrame([(i, "fruit" if i % 2 else "metal") for i in range(30)] + [(5, "metal"), (None, "fruit"), (7, None), (8, "other")], "doc_id long, domain string")
    out = mixing.mix_documents(docs, labelled, {"fruit": 1, "metal": 1}, keep=tuple(docs.columns))
    assert out.columns == ["doc_id", "text", "p", "label_id", "domain", "k0", "tokens", "posteriors", "rate", "copies", "on_target", "residual"]
    rows = out.collect()
    assert len(rows) == 45 and all(r["rate"] == 1 for r in rows if r["doc_id"] in (98, 99)) and all(r["domain"] == "x" and r["k0"] == 5 for r in rows)
    assert out.where(F.col("doc_id").isNull()).count() == 1
    with pytest.raises(ValueError):
        mixing.mix_documents(docs, labelled, {"fruit": 0, "metal": 0})
