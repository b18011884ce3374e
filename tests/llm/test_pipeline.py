"""The pipeline's stages one after the other, and run(), against plain Python on a small table."""

from __future__ import annotations

import random
import re

import corpus_pipeline
from test_leaks_without_seeds import brute as leaks
from test_line_dedup import brute as lines
from test_pairs import brute as groups

GAP = re.compile(r"[\x20\x09-\x0D]+")


def made():
    rng = random.Random(21)
    vocabulary = [f"w{i}" for i in range(700)]
    say = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(say(18))) for i in range(3)]
    common = [" ".join(say(9)) for _ in range(4)]
    rows = []
    for d in range(90):
        text = [" ".join(say(rng.choice((4, 9, 14)))) for _ in range(rng.randrange(1, 7))]
        if d % 4 == 0:
            text.insert(rng.randrange(len(text) + 1), rng.choice(common))
        if d % 9 == 0:
            text.append("before " + rng.choice(items)[1] + " after")
        if d % 10 == 3 and rows:  # near copies
            w = rng.choice(rows[: max(1, len(rows) // 2)])[1].split(" ")
            if len(w) > 30:
                w[rng.randrange(len(w))] = "changed"
            text = [" ".join(w)]
        if d % 13 == 5:
            text = [" ".join(say(6))]
        if d % 17 == 6:
            text = [" ".join(say(5) * 8)]
        rows.append((d, "\n".join(text)))
    return rows + [(200, None), (201, ""), (202, " \n ")], items


def fails(text):
    w = [x for x in GAP.split(text or "") if x]
    seen = {}
    for i in range(len(w) - 4):
        seen.setdefault(tuple(w[i : i + 5]), []).append(i)
    again = {i + k for at in seen.values() if len(at) > 1 for i in at for k in range(5)}
    return len(w) < 10 or 100 * len(again) > 20 * len(w)


def stages(rows, items):
    """(doc_id, text) after each of the stages before mixing."""
    rows = [r for r in rows if not fails(r[1])]
    yield rows
    gone = lines(rows, least=1)
    cut = [(d, "\n".join(x for i, x in enumerate(t.split("\n")) if (d, i) not in gone)) for d, t in rows]
    rows = [(d, t) for (d, t), (_, old) in zip(cut, rows) if t == old or GAP.sub("", t)]
    yield rows
    first = {d: top for d, _, top in groups(rows, 5, 80, 100)}
    rows = [r for r in rows if first[r[0]] == r[0]]
    yield rows
    bad = {r[0] for r in leaks(rows, items)}
    rows = [r for r in rows if r[0] not in bad]
    yield rows


def test_stages_and_run(spark, tmp_path):
    rows, items = made()
    docs = spark.createDataFrame([(d, t, "en", "s", None if t is None else len(t)) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    left = []
    for (name, stage), want in zip(corpus_pipeline.STAGES, stages(rows, items)):
        docs = stage(spark, docs, str(tmp_path))
        docs.write.mode("overwrite").parquet(str(tmp_path / name.replace(" ", "-")))
        docs = spark.read.parquet(str(tmp_path / name.replace(" ", "-")))
        assert sorted((r["doc_id"], r["text"]) for r in docs.collect()) == sorted(want), name
        assert all(r["n_chars"] == len(r["text"]) for r in docs.collect()), name
        left.append(len(want))
    assert len(rows) > left[0] > left[2] > left[3] > 30  # each stage has something to do
    # without labels every document has the same posteriors, so mixing keeps them all
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r["doc_id"], r["text"]) for r in out) == sorted(want) and all(r["copies"] >= 1 for r in out)


def test_run_with_labels_takes_toxic_documents_away_and_leaves_the_others(spark, tmp_path):
    rng = random.Random(8)
    vocabulary = [f"word{i}" for i in range(400)]
    rows, labels = [], []
    for d in range(900):
        toxic = d % 15 == 0
        text = " ".join(rng.choice(vocabulary) for _ in range(40)) + (" vile nasty foul" if toxic else "")
        rows.append((d, text, "en", "s", len(text)))
        if d % 3:
            labels.append((d, 1, int(toxic != (rng.random() < 0.03))))  # a few labels are wrong
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([*labels, *[(d, 1, int(d % 15 == 0)) for d in range(0, 900, 3)]], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert all(r["on_target"] for r in out) and set(out[0].asDict()) == {*corpus_pipeline.COLUMNS, "tokens", "posteriors", "rate", "copies", "on_target", "residual"}
    kept = {r["doc_id"] for r in out}
    clean, toxic = {d for d, *_ in rows if d % 15}, {d for d, *_ in rows if d % 15 == 0}
    assert len(clean & kept) > 0.97 * len(clean) and len(toxic & kept) < 0.4 * len(toxic)
    assert max(abs(x) for x in out[0]["residual"]) < 1e-3
