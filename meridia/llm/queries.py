"""The queries op1 to op13: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chunk_dedup, decontaminate, language_id, line_dedup, mixing, ngram_join, packing, prefix_trie, quality, resampling, secret_scan, url_filter, warc


#: Share of tokens by domain that op7 and the pipeline aim at.
TARGETS = {"toxic": 0.01, "poor": 0.04, "good": 0.95}


def domains(labels: DataFrame) -> DataFrame:
    """(doc_id, domain) of labels(doc_id, quality, toxic); null where either is null."""
    return labels.select("doc_id", F.when(F.col("quality").isNull() | F.col("toxic").isNull(), None).when(F.col("toxic") > 0, "toxic").when(F.col("quality") > 0, "good").otherwise("poor").alias("domain"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"), k=4, num=85, den=100)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), min_words=1)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.apply_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(table(spark, sf_dir, "documents"), domains(table(spark, sf_dir, "labels")), TARGETS)


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_dedup.repeated_spans(table(spark, sf_dir, "documents"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf_dir, "documents"))


def labelled_urls(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(url, bad) of pages whose path ends in the number of a labelled document: bad if a label of it has quality 0."""
    number = F.regexp_extract(url_filter.path_of(F.col("url")), r"/(\d+)(?:\.html)?/?$", 1)
    worst = labels.groupBy("doc_id").agg((F.min("quality") == 0).alias("bad"))
    return pages.select("url", number.try_cast("long").alias("doc_id")).join(worst, "doc_id").select("url", "bad")


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return url_filter.filter_urls(pages, labelled_urls(pages, table(spark, sf_dir, "labels")))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.conversation_trie(table(spark, sf_dir, "conversations"))


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), by_words=True)


QUERIES = {
    f.__name__: f
    for f in (op1_ngram_join, op2_line_dedup, op3_warc, op4_decontaminate, op5_language_id, op6_quality_rules, op7_mixing, op8_substring_dedup, op9_secret_scan, op10_url_filters, op11_prefix_trie, op12_resampling, op13_packing)
}


def _components_sql() -> str:
    """All pairs of documents that share a shingle, counted; then the least document that links reach, level by level."""
    words = "SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents"
    sets = f"SELECT doc_id, list_distinct(CASE WHEN len(w)=0 THEN [] WHEN len(w)<4 THEN [array_to_string(w, chr(10))] ELSE list_transform(range(1, len(w)-2), lambda i: array_to_string(w[i:i+3], chr(10))) END) AS s FROM ({words})"
    return f"""WITH RECURSIVE sets AS MATERIALIZED (SELECT doc_id, s, CAST(len(s) AS BIGINT) AS n FROM ({sets})),
    one AS MATERIALIZED (SELECT DISTINCT md5(array_to_string(list_sort(s), chr(30))) AS k, n, min(doc_id) OVER (PARTITION BY md5(array_to_string(list_sort(s), chr(30)))) AS rep, doc_id FROM sets WHERE n>0),
    each AS MATERIALIZED (SELECT doc_id, n, unnest(s) AS t FROM sets WHERE doc_id IN (SELECT rep FROM one)),
    pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS n, b.n AS m, count(*) AS common FROM each a JOIN each b ON a.t=b.t AND a.doc_id<b.doc_id AND 100*least(a.n, b.n)>=85*greatest(a.n, b.n) GROUP BY 1, 2, 3, 4),
    links AS MATERIALIZED (SELECT a, b FROM pairs WHERE 100*common>=85*(n+m-common) UNION SELECT b, a FROM pairs WHERE 100*common>=85*(n+m-common) UNION SELECT rep, doc_id FROM one UNION SELECT doc_id, rep FROM one),
    reach(doc_id, c) AS (SELECT doc_id, doc_id FROM sets UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a=r.c WHERE l.b<>r.doc_id)
    SELECT s.doc_id, s.n AS n_shingles, min(r.c) AS component_id FROM sets s JOIN reach r ON r.doc_id=s.doc_id GROUP BY 1, 2"""


_PAYLOADS = "SELECT page_id, encode(coalesce(html, '')) AS p FROM pages"
_ARCHIVE_SQL = f"""SELECT page_id, CAST(octet_length(p) AS BIGINT) AS payload_bytes, sha1(p) AS payload_digest, CASE WHEN octet_length(p)>=1000 AND page_id<last THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN octet_length(p)>=1000 AND page_id<last THEN last END AS refers_to
    FROM (SELECT *, max(page_id) OVER (PARTITION BY p) AS last FROM ({_PAYLOADS}))"""


def _crc_sql(x: str) -> str:
    """Unsigned CRC-32 of the UTF-8 bytes of a text, bit by bit."""
    bytes_ = f"list_transform(range(octet_length(encode({x}))), lambda i: CAST('0x' || substr(hex(encode({x})), 2*i+1, 2) AS BIGINT))"
    eight = "list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: xor(v >> 1, CASE WHEN v & 1 = 1 THEN 3988292384 ELSE 0 END))"
    return f"xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], {bytes_}), lambda a, b: {eight}), 4294967295)"


#: All prefixes of all rebuilt conversations, grouped; a node's subtree by the prefixes of the conversation that names it.
_TRIE_SQL = f"""WITH own AS MATERIALIZED (SELECT conv_id, list({{'role': coalesce(role, ''), 'text': coalesce(text, '')}} ORDER BY turn NULLS FIRST) AS q FROM conversations WHERE conv_id IS NOT NULL GROUP BY 1),
    drawn AS (SELECT *, {_crc_sql("CAST(conv_id AS VARCHAR)")}%4 AS h FROM own),
    rebuilt AS (SELECT c.conv_id, list_concat(coalesce(b.q[1:c.h], []), c.q[c.h+1:]) AS q FROM drawn c LEFT JOIN own b ON b.conv_id=c.conv_id-c.conv_id%20),
    each AS (SELECT conv_id, q, unnest(range(len(q)+1)) AS d FROM rebuilt),
    prefixes AS MATERIALIZED (SELECT conv_id, d, CASE WHEN d=0 THEN '' ELSE md5(to_json(q[1:d])) END AS k, CASE WHEN d=1 THEN '' WHEN d>1 THEN md5(to_json(q[1:d-1])) END AS above, CASE WHEN d>0 THEN len(regexp_extract_all(q[d].text, '[^\\x20\\x09-\\x0D]+')) ELSE 0 END AS words, d=len(q) AS ends FROM each),
    nodes AS MATERIALIZED (SELECT d, k, above, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*)-1)*max(words) AS saved, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM prefixes GROUP BY 1, 2, 3),
    children AS (SELECT d-1 AS d, above AS k, count(*) AS n FROM nodes WHERE d>0 GROUP BY 1, 2),
    whole AS (SELECT m.*, coalesce(n, 0) AS n_children FROM nodes m LEFT JOIN children USING (d, k)),
    sums AS (SELECT p.d, p.k, sum(m.saved) AS saved, sum(CAST(m.n_children=0 AS BIGINT)) AS leaves FROM whole m JOIN prefixes p ON p.conv_id=m.conv_id AND p.d<=m.d GROUP BY 1, 2)
    SELECT m.conv_id, m.d AS depth, u.conv_id AS parent_conv_id, m.n_convs, m.n_children, CAST(s.leaves AS BIGINT) AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, m.ends_sha256
    FROM whole m JOIN sums s USING (d, k) LEFT JOIN nodes u ON u.d=m.d-1 AND u.k=m.above"""

_FOLDED = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
_RESAMPLE_SQL = f"""WITH mine AS MATERIALIZED (SELECT doc_id, {_FOLDED} AS w FROM documents WHERE doc_id IS NOT NULL),
    a AS MATERIALIZED (SELECT doc_id, g, count(*) AS n FROM (SELECT doc_id, unnest(w) AS g FROM mine) GROUP BY 1, 2),
    b AS MATERIALIZED (SELECT g, count(*) AS n FROM (SELECT unnest({_FOLDED}) AS g FROM benchmark) GROUP BY 1),
    hashed AS MATERIALIZED (SELECT g, {_crc_sql("g")}%10000 AS k FROM (SELECT g FROM a UNION SELECT g FROM b)),
    s AS (SELECT k, sum(n) AS n FROM a JOIN hashed USING (g) GROUP BY 1), t AS (SELECT k, sum(n) AS n FROM b JOIN hashed USING (g) GROUP BY 1),
    sums AS (SELECT CAST((SELECT coalesce(sum(n), 0) FROM s)+10000 AS DOUBLE) AS ss, CAST((SELECT coalesce(sum(n), 0) FROM t)+10000 AS DOUBLE) AS tt),
    gains AS MATERIALIZED (SELECT k, CAST(floor(1000*ln((CAST(coalesce(t.n, 0) AS DOUBLE)+1)*ss/((CAST(coalesce(s.n, 0) AS DOUBLE)+1)*tt))) AS BIGINT) AS gain FROM (SELECT unnest(range(10000)) AS k) LEFT JOIN s USING (k) LEFT JOIN t USING (k), sums),
    weights AS (SELECT doc_id, sum(n*gain) AS weight FROM a JOIN hashed USING (g) JOIN gains USING (k) GROUP BY 1),
    scored AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight, CAST(coalesce(weight, 0) AS BIGINT)+CAST(floor(-1000*ln(-ln((CAST('0x' || substr(sha256('2024:' || CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT)+0.5::DOUBLE)/4294967296::DOUBLE))) AS BIGINT) AS score FROM mine LEFT JOIN weights USING (doc_id)),
    ranked AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM scored WHERE n_features>=20)
    SELECT doc_id, n_features, weight, score, r.rank FROM scored LEFT JOIN (SELECT * FROM ranked WHERE rank<=10*n//100) r USING (doc_id)"""

#: Where SQL can express the whole result.
ORACLE_SQL: dict[str, str] = {"op1_ngram_join": _components_sql(), "op3_warc": _ARCHIVE_SQL, "op11_prefix_trie": _TRIE_SQL, "op12_resampling": _RESAMPLE_SQL}
