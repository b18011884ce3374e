"""Learned operators: held-out accuracy, targets that are met, and defined results for odd rows."""

import zlib

from pyspark.sql import functions as F

from meridia.llm import language_id, mixing, secret_scan

SF = "/root/testdata/sf0.001/documents.parquet"


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet(SF)
    rows = language_id.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == docs.count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r["held_out"] and r["lang"] is not None and r["lang_pred"] != "und"]
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.95 * len(held) > 0
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_of_odd_rows(spark):
    docs = spark.read.parquet(SF).select("doc_id", "text", "lang")
    odd = spark.createDataFrame([(-1, None, "xx"), (-2, "", None), (-3, "12 34 !", None), (-4, "ab " * 200_000, None)], docs.schema)
    rows = {r["doc_id"]: r for r in language_id.identify(docs.union(odd)).where("doc_id < 0").collect()}
    assert {rows[i]["lang_pred"] for i in (-1, -2, -3)} == {"und"}
    assert rows[-4]["lang_pred"] != "und"


def test_rates_meet_the_targets(spark):
    docs = [(i, ("apple pear plum " if i % 2 else "iron zinc lead ") * 20) for i in range(60)] + [(100, None), (101, "")]
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    labelled = spark.createDataFrame([(i, "fruit" if i % 2 else "metal") for i in range(0, 40)], "doc_id long, domain string")
    out = mixing.mix_documents(docs, labelled, {"fruit": 3, "metal": 1})
    rows = out.collect()
    assert len(rows) == 62 and all(r["rate"] >= 0 for r in rows)
    total = sum(r["tokens"] * r["rate"] for r in rows)
    fruit = sum(r["tokens"] * r["rate"] * r["posteriors"][0] for r in rows)
    assert abs(fruit / total - 0.75) < 0.001
    assert all(r["tokens"] == 0 and r["rate"] == 1 for r in rows if r["doc_id"] >= 100)


def test_secrets_under_a_telling_name(spark):
    secret, word = "aB3dE6gH9jK2mN5pQ8sT1v", "internationalization"
    rows = [(i, f'the api_key = "{secret}{i:03d}" of a server') for i in range(40)]
    rows += [(100 + i, f"they spoke about {word} and counterrevolutionaries {i}") for i in range(40)] + [(200, None), (201, "")]
    out = secret_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"] for r in out if r["secret"]} == set(range(40))
    assert all(rows[r["doc_id"]][1].encode()[r["start"] : r["start"] + r["length"]].startswith(secret.encode()) for r in out if r["secret"])
    assert all(r["doc_id"] < 200 for r in out)


def test_without_rows(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert language_id.identify(docs).count() == 0
    assert secret_scan.scan(docs).count() == 0
    assert mixing.mix_documents(docs, spark.createDataFrame([], "doc_id long, domain string"), {"a": 1, "b": 1}).select(F.sum("rate")).first()[0] is None
