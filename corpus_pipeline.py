"""From raw documents to a training mixture: five stages, each written before the next begins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meridia.llm import decontaminate, line_dedup, mixing, ngram_join, quality
from meridia.llm._common import SPACE, Scratch, released, without

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Shares of tokens over what the other stages leave. Poor documents are gone by then, so quality is no domain here.
TARGETS = {"toxic": 0.01, "clean": 0.99}


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    tables = Scratch(spark, "pipeline-quality")
    with released():
        verdict = quality.apply_rules(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
        bad = tables.save(verdict.where("not kept").select("doc_id").distinct(), "rejected")
    return without(docs, bad)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of lines go; documents that lose all their words go with them."""
    out = line_dedup.dedup_lines(docs, min_words=1).withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.where((F.col("n_removed") == 0) | (F.regexp_replace("text", SPACE, "") != "")).select(*docs.columns)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of linked documents that of the smallest doc_id stays."""
    return ngram_join.keep_first(docs, k=5, num=80, den=100)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    return decontaminate.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_domains(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document with the rate at which it is to be seen, and its number of copies; those of no copy go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    labelled = labels.select("doc_id", F.when(F.col("toxic") > 0, "toxic").when(F.col("toxic") == 0, "clean").alias("domain"))
    return mixing.mix_documents(docs, labelled, TARGETS, keep=tuple(docs.columns)).where("copies > 0")


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", dedup_lines),
    ("n-gram Jaccard join", dedup_documents),
    ("benchmark decontamination", drop_benchmark),
    ("mixing sources to target weights", mix_domains),
]

#: Exact similarity joins, fitted thresholds and rates are beyond SQL; tests hold run() against plain Python on a small table without labels.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, tables = spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark, "pipeline")
    for i, (_, stage) in enumerate(STAGES):
        docs = tables.save(stage(spark, docs, sf_dir), str(i))
        if i:
            tables.drop(str(i - 1))
    return docs
