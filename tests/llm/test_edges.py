"""Every operator on odd rows: nulls anywhere, empty and very long texts, repeated rows and ids, empty tables, columns named as the operators' own."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from meridia.llm import chunk_dedup, decontaminate, language_id, line_dedup, mixing, ngram_join, quality, queries, secret_scan, url_filter, warc
from meridia.llm._common import SPACE, free_name, sweep

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use inside or give to their results.
CLASH = (
    "n k1 k2 words key rep parity entry token first gone_id gone_lines lines line_no bad_id leaked_id tokens rate copies p posteriors label_id domain stratum cut steps rule features x w label score held_out "
    "lang_pred item_id seeds seed run1 block counts bucket component component_id n_shingles kept n_words word_chars rank mined host path start size digest id other j d item matched on_target k0 t quality toxic"
).split()
LONG = "alpha beta gamma delta epsilon zeta eta theta iota kappa " * 2_000


def rows():
    text = "the quick brown fox jumps over the lazy dog and runs away from the big bad wolf today"
    base = [(i, f"{text} number {i}\nline two of text {i % 3}\n{text}", "en", "s", 9) for i in range(12)]
    return base + [(3, base[3][1], "en", "s", 9), (4, "another text of id four", "de", None, None), (None, text, None, None, None), (None, None, None, None, None), (50, None, "fr", "s", 1), (51, "", "fr", "s", 0), (52, " \n\t\n", None, "s", 4), (53, LONG, "en", "s", 7), (54, LONG + "omega", "en", "s", 7), (55, "x" * 200_000, "en", "s", 7), (56, "\n" * 5_000, "en", "s", 7), (57, "é \x00\x0b ß", "de", "s", 3)]


def documents(spark, some=True):
    df = spark.createDataFrame(rows() if some else [], COLUMNS)
    return df.selectExpr("*", *[f"cast(7 as int) as `{c}`" for c in CLASH])


def labels(spark, some=True):
    return spark.createDataFrame([(i, i % 2, int(i % 5 == 0)) for i in range(12)] + [(3, 0, 1), (None, 1, 0), (5, None, None), (999, 1, 1)] if some else [], "doc_id long, quality int, toxic int")


def benchmark(spark, some=True):
    return spark.createDataFrame([(1, "jumps over the lazy dog and runs away from the big bad wolf"), (1, "jumps over the lazy dog and runs away from the big bad wolf"), (2, None), (3, ""), (None, "short")] if some else [], "item_id long, text string").selectExpr("*", "1 as words", "2 as n", "3 as doc_id")


def per_document(spark, docs, some):
    yield "components", ngram_join.jaccard_components(docs)
    yield "lines", line_dedup.dedup_lines(docs)
    yield "language", language_id.identify(docs)
    yield "quality", quality.apply_rules(docs, labels(spark, some))
    yield "mixing", mixing.mix_documents(docs, queries.domains(labels(spark, some)), queries.TARGETS, keep=tuple(docs.columns))


@pytest.mark.parametrize("some", [True, False])
def test_one_row_a_document(spark, some):
    docs = documents(spark, some)
    n = docs.count()
    ids = sorted((r[0] is not None, r[0] or 0) for r in docs.select("doc_id").collect())
    for name, out in per_document(spark, docs, some):
        assert sorted((r[0] is not None, r[0] or 0) for r in out.select("doc_id").collect()) == ids, name
        assert out.count() == n, name


def test_results_of_odd_rows(spark):
    docs = documents(spark)
    parts = {r["doc_id"]: r for r in ngram_join.jaccard_components(docs).where("doc_id >= 50").collect()}
    assert [parts[i]["n_shingles"] for i in (50, 51, 52)] == [0, 0, 0] and parts[54]["component_id"] == 53
    lines = {r["doc_id"]: r for r in line_dedup.dedup_lines(docs).where("doc_id >= 50").collect()}
    assert (lines[50]["n_lines"], lines[50]["text"], lines[51]["text"], lines[56]["n_lines"]) == (0, None, "", 5_001)
    und = {r["doc_id"]: r["lang_pred"] for r in language_id.identify(docs).where("doc_id >= 50").collect()}
    assert und[50] == und[51] == und[52] == "und" and und[53] != "und"
    rules = {r["doc_id"]: r for r in quality.apply_rules(docs, labels(spark)).where("doc_id >= 50").collect()}
    assert all(rules[i]["base_failed"] and not rules[i]["kept"] for i in (50, 51, 52)) and rules[53]["n_repeat_words"] == 20_000
    leaks = {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(docs, benchmark(spark)).collect()}
    assert {(i, 1) for i in range(12)} | {(None, 1)} == leaks
    kept = decontaminate.drop_leaks(docs, benchmark(spark))
    assert kept.columns == docs.columns and {r[0] for r in kept.select("doc_id").collect()} == {50, 51, 52, 55, 56, 57, None} or kept.where("doc_id = 4").count() == 0
    spans = chunk_dedup.repeated_spans(docs).collect()
    assert any(r["doc_id"] == 54 for r in spans) and all(r["doc_id"] is not None and r["doc_id"] not in (50, 51) for r in spans)
    assert secret_scan.scan(docs).where("doc_id in (50, 51, 52)").count() == 0


def test_empty_tables(spark):
    none = documents(spark, False)
    assert decontaminate.find_leaks(none, benchmark(spark)).count() == 0
    assert decontaminate.find_leaks(documents(spark), benchmark(spark, False)).count() == 0
    assert chunk_dedup.repeated_spans(none).count() == 0 and secret_scan.scan(none).count() == 0 and ngram_join.keep_first(none).count() == 0
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.round_trip(pages).count() == 0
    assert url_filter.filter_urls(pages, spark.createDataFrame([], "url string, bad boolean")).count() == 0


def test_odd_pages(spark):
    html = "<p>" + "page " * 400
    table = [(1, "http://a.example.net/en/1", html), (2, None, html), (3, "", None), (4, "no scheme", ""), (5, "http://b/" + "p" * 100_000, "x" * 2_000_000), (6, "http://é/ ß", "short"), (6, "http://é/ ß", "short"), (7, "://", html)]
    pages = spark.createDataFrame(table, "page_id long, url string, html string").selectExpr("*", "1 as file", "2 as offset", "3 as length", "4 as digest", "5 as payload", "6 as record_type", "7 as refers_to")
    got = {r["page_id"]: r for r in warc.round_trip(pages).collect()}
    assert (got[1]["refers_to"], got[2]["refers_to"], got[7]["record_type"]) == (7, 7, "response")
    assert [got[i]["payload_bytes"] for i in (3, 4, 5, 6)] == [0, 0, 2_000_000, 5] and got[1]["payload_digest"] == got[7]["payload_digest"]
    verdicts = {r["page_id"]: (r["host"], r["path"]) for r in url_filter.filter_urls(pages, spark.createDataFrame([], "url string, bad boolean")).collect()}
    assert verdicts[2] == verdicts[3] == verdicts[4] == ("", "") and verdicts[7] == ("", "") and verdicts[5][0] == "b"


@pytest.mark.parametrize("some", [True, False])
def test_stages(spark, tmp_path, some):
    for name, df in (("labels", labels(spark, some)), ("benchmark", benchmark(spark, some))):
        df.write.parquet(str(tmp_path / f"{name}.parquet"))
    docs = documents(spark, some)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        assert out.count() <= docs.count(), name
    last = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
    assert {"doc_id", "text", "rate", "copies"} <= set(last.columns) and last.where("copies < 1").count() == 0


def test_shared_folder(spark):
    assert free_name("Key", spark.createDataFrame([(1, 2)], "key int, key_ int")) == "Key__" and SPACE
    line_dedup.dedup_lines(spark.createDataFrame([(1, "a b c")], "doc_id long, text string")).count()
    assert sweep(spark) > 0 and sweep(spark) == 0
    assert ngram_join.keep_first(spark.createDataFrame([(1, "a b")], "doc_id long, text string")).where(F.col("doc_id") == 1).count() == 1
