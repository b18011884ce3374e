"""Importance resampling towards a target distribution of hashed word n-grams.

DuckDB runs inside each task: its SQL unnests the words of a batch, windows them to n-grams and hashes
these with a registered function; the counts of each document by bucket are spilled to Parquet, by
Spark's writer, as only that commits a task once and reaches any file system. Spark then adds the
counts up, derives a gain for each bucket, scores the documents and draws the highest scores.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import Scratch, column, tidy

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A word is a run of ASCII letters and digits and of everything beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
COUNTS = "doc_id long, n_words long, n_features long, buckets array<int>, times array<int>"


def _crc(words: pa.Array) -> pa.Array:
    words = words.combine_chunks() if isinstance(words, pa.ChunkedArray) else words
    return pa.array([None if w is None else zlib.crc32(w) for w in words.cast(pa.binary()).to_pylist()], pa.int64())


def feature_sql(least: int, most: int, buckets: int) -> str:
    """SQL over part(nr, text): nr, number of words and features, and lists of buckets and how often each occurs."""
    grams = ["SELECT nr, w AS g FROM words"] if least == 1 else []
    for n in range(max(2, least), most + 1):
        nexts = " || ' ' || ".join(["w", *[f"lead(w, {i}) OVER o" for i in range(1, n)]])
        grams.append(f"SELECT nr, {nexts} AS g FROM words WINDOW o AS (PARTITION BY nr ORDER BY i)")
    return f"""WITH split AS MATERIALIZED (SELECT nr, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{WORD}') AS w FROM part),
    words AS (SELECT nr, unnest(w) AS w, unnest(range(len(w))) AS i FROM split),
    grams AS ({" UNION ALL ".join(grams)}),
    counted AS MATERIALIZED (SELECT nr, g, count(*) AS n FROM grams WHERE g IS NOT NULL GROUP BY 1, 2),
    hashed AS (SELECT g, CAST(crc(g) % {buckets} AS INTEGER) AS b FROM (SELECT DISTINCT g FROM counted)),
    binned AS (SELECT nr, b, CAST(sum(n) AS INTEGER) AS n FROM counted JOIN hashed USING (g) GROUP BY 1, 2),
    listed AS (SELECT nr, CAST(sum(n) AS BIGINT) AS n, list(b ORDER BY b) AS buckets, list(n ORDER BY b) AS times FROM binned GROUP BY 1)
    SELECT nr, CAST(coalesce(len(w), 0) AS BIGINT) AS n_words, coalesce(n, 0) AS n_features, coalesce(buckets, []) AS buckets, coalesce(times, []) AS times FROM split LEFT JOIN listed USING (nr) ORDER BY nr"""


def _count(sql: str, chars: int, memory: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        with duckdb.connect(config={"threads": 1, "memory_limit": memory, "temp_directory": "", "preserve_insertion_order": False}) as con:
            con.create_function("crc", _crc, ["VARCHAR"], "BIGINT", type="arrow")
            for batch in batches:
                docs, texts = column(batch, "doc_id"), column(batch, "text")
                at = 0
                while at < len(docs):
                    stop = size = 0
                    stop = at
                    while stop < len(docs) and (stop == at or size + len(texts[stop] or "") <= chars):
                        size += len(texts[stop] or "")
                        stop += 1
                    part = pa.table({"nr": pa.array(range(stop - at), pa.int32()), "text": pa.array(texts[at:stop], pa.string())})
                    con.register("part", part)
                    out = con.sql(sql).to_arrow_table().combine_chunks()
                    con.unregister("part")
                    lists = pa.list_(pa.int32())
                    cols = [pa.array(docs[at:stop], pa.int64()), *[out.column(c).combine_chunks().cast(t) for c, t in (("n_words", pa.int64()), ("n_features", pa.int64()), ("buckets", lists), ("times", lists))]]
                    yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_words", "n_features", "buckets", "times"])
                    at = stop

    return tidy(run)


def bucket_counts(rows: DataFrame, key: str | None, least: int, most: int, buckets: int, chars: int, memory: str) -> DataFrame:
    """doc_id, n_words, n_features and the counts by bucket of each row's text."""
    id_ = F.col(key).cast("long") if key else F.lit(None).cast("long")
    part = rows.select(id_.alias("doc_id"), F.col("text").cast("string").alias("text"))
    return part.mapInArrow(_count(feature_sql(least, most, buckets), chars, memory), COUNTS)


def _totals(counted: DataFrame, buckets: int) -> list[int]:
    """How often each bucket occurs: `buckets` numbers, whatever the corpus."""
    pairs = counted.select(F.explode(F.arrays_zip("buckets", "times")).alias("p"))
    out = [0] * buckets
    for r in pairs.groupBy(F.col("p.buckets").alias("b")).agg(F.sum(F.col("p.times").cast("long")).alias("n")).collect():
        out[r["b"]] = r["n"]
    return out


def _constants(values: list, kind: str) -> Column:
    """A constant array, as one literal."""
    return F.split(F.lit(",".join(map(repr, values))), ",").cast(f"array<{kind}>")


def rank_rows(rows: DataFrame, tables: Scratch, by: list[Column], name: str = "ranked") -> DataFrame:
    """rows with `rank`, 1, 2, 3... in the order of `by`: ranges are sorted where they lie, and start after those before them."""
    part = rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("part_", F.spark_partition_id()).withColumn("rank", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) + 1)
    part = tables.save(part, name)
    starts, at = {}, 0
    for p, n in sorted(map(tuple, part.groupBy("part_").agg(F.count("*")).collect())):  # a row for each task
        starts[p], at = at, at + n
    before = _constants([starts.get(p, 0) for p in range(max(starts, default=0) + 1)], "long")
    return part.withColumn("rank", F.col("rank") + F.get(before, F.col("part_"))).drop("part_")


def resample(docs: DataFrame, target: DataFrame, *, share: float = 0.1, least_words: int = 20, ngrams: tuple[int, int] = (1, 1), buckets: int = 10_000, seed: int = 2024, chars: int = 1 << 22, memory: str = "400MB") -> DataFrame:
    """doc_id, n_features, weight, score, rank of each document of docs(doc_id, text); rank is null for those not drawn.

    Features are the runs of ngrams[0] to ngrams[1] words, in `buckets` buckets by their CRC-32. A bucket's
    gain is the logarithm of its share in target(text) by that in docs, each count raised by one, in
    thousandths rounded down; a document's weight is the sum of its features' gains. To it comes Gumbel
    noise from the seed and the doc_id alone, so the draw is the same on any cluster, and without
    replacement. Of the documents with least_words words or more the given share is drawn, highest scores
    first, ties to the smaller doc_id. Null texts have no words; rows with a null doc_id are no
    documents: they aren't counted, scored or returned. Rows with equal ids are documents of their own.

    `chars` of text, or one longer text, are unnested at once, in at most `memory` of DuckDB's.
    """
    tables = Scratch(docs.sparkSession, "resampling")
    how = dict(least=ngrams[0], most=ngrams[1], buckets=buckets, chars=chars, memory=memory)
    counted = tables.save(bucket_counts(docs.where("doc_id is not null"), "doc_id", **how), "documents")
    wanted = tables.save(bucket_counts(target, None, **how), "target")
    s, t = _totals(counted, buckets), _totals(wanted, buckets)
    sums = F.lit(float(sum(s) + buckets)), F.lit(float(sum(t) + buckets))
    at = docs.sparkSession.range(buckets).select("id", F.get(_constants(s, "double"), F.col("id").cast("int")).alias("s"), F.get(_constants(t, "double"), F.col("id").cast("int")).alias("t"))
    gain = F.floor(1000 * F.log((F.col("t") + 1) * sums[0] / ((F.col("s") + 1) * sums[1])))
    gains = [r["g"] for r in at.select("id", gain.alias("g")).orderBy("id").collect()]
    each = F.zip_with("buckets", "times", lambda b, n: F.get(_constants(gains, "long"), b) * n)
    weight = F.aggregate(each, F.lit(0).cast("long"), lambda a, x: a + x)
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = counted.select("doc_id", "n_features", weight.alias("weight"), (weight + noise).alias("score"), (F.col("n_words") >= least_words).alias("long_enough"))
    n = counted.where(F.col("n_words") >= least_words).count()
    draw = n * round(share * 1_000_000) // 1_000_000
    # those that can't be drawn come last
    ranked = rank_rows(scored, tables, [F.col("long_enough").desc(), F.col("score").desc(), F.col("doc_id").asc()])
    return ranked.select("doc_id", "n_features", "weight", "score", F.when(F.col("long_enough") & (F.col("rank") <= draw), F.col("rank")).alias("rank"))
