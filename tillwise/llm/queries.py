"""The registered queries of the operators, over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillwise.llm import (
    bpe,
    decontaminate,
    jaccard,
    language_model,
    quality,
    resample,
    rtree,
    secrets,
    simhash,
    unigram,
    urls,
    voronoi,
    warc,
)

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_warc(spark: SparkSession, folder: str) -> DataFrame:
    return warc.archive(_table(spark, folder, "pages"), smallest=0)


def op2_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.rate(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


def op3_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.contaminated(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


def op4_language_model(spark: SparkSession, folder: str) -> DataFrame:
    return language_model.evaluate(_table(spark, folder, "documents"))


def op5_top_k(spark: SparkSession, folder: str) -> DataFrame:
    return voronoi.top_k(_table(spark, folder, "embeddings"))


def op6_urls(spark: SparkSession, folder: str) -> DataFrame:
    return urls.judge(_table(spark, folder, "pages"))


def op7_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, folder, "documents"))


def op8_secrets(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.report(_table(spark, folder, "documents"))


def op9_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.digests(_table(spark, folder, "documents"))


def op10_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return unigram.token_counts(_table(spark, folder, "documents"))


def op11_ngram_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.similar(_table(spark, folder, "documents"))


def op12_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return rtree.mine(_table(spark, folder, "embeddings").withColumn("label", label))


def op13_resample(spark: SparkSession, folder: str) -> DataFrame:
    return resample.resample(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


def queries() -> dict[str, Query]:
    found = (
        op1_warc, op2_quality, op3_decontaminate, op4_language_model, op5_top_k,
        op6_urls, op7_simhash, op8_secrets, op9_bpe, op10_token_counts,
        op11_ngram_jaccard, op12_hard_negatives, op13_resample,
    )
    return {f.__name__: f for f in found}


OP1 = """
WITH p AS (SELECT page_id, coalesce(encode(html), ''::BLOB) AS payload FROM pages),
d AS (SELECT page_id, octet_length(payload) AS n, payload, sha1(payload) AS hex FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload) AS first FROM d),
b AS (
    SELECT page_id, array_to_string(list_transform(range(32), lambda i: substr(
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        1 + ((('0x' || substr(hex, 1 + 5 * (i // 4)::INT, 5))::INT >> (15 - 5 * (i % 4)::INT)) & 31), 1)), '') AS digest
    FROM d
)
SELECT f.page_id, n::BIGINT AS payload_bytes, digest AS payload_digest,
    CASE WHEN f.page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN f.page_id <> first THEN first END AS refers_to
FROM f JOIN b ON f.page_id = b.page_id
"""

OP3 = """
WITH w AS MATERIALIZED (
    SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS w
    FROM documents
),
v AS MATERIALIZED (
    SELECT DISTINCT item_id,
        list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS v
    FROM benchmark
),
-- The masks of items of at least 13 words; the given ones have no less.
masks(m, k) AS (VALUES (0, [0, 1, 3, 5, 6, 7]), (1, [0, 1, 2, 3, 6, 7])),
ds AS (
    SELECT doc_id, p, m, list_transform(k, lambda o: w[p + 1 + o]) AS seed
    FROM (SELECT doc_id, w, unnest(range(len(w))) AS p FROM w), masks WHERE p + k[6] < len(w)
),
bs AS (
    SELECT item_id, q, m, list_transform(k, lambda o: v[q + 1 + o]) AS seed
    FROM (SELECT item_id, v, unnest(range(len(v))) AS q FROM v), masks WHERE q + k[6] < len(v)
),
hit AS (SELECT DISTINCT doc_id, item_id, p - q AS d FROM ds JOIN bs ON ds.m = bs.m AND ds.seed = bs.seed),
rated AS (
    SELECT doc_id, item_id, d, len(w) AS n, s, list_sum(list_transform(range(s, s + 13),
        lambda i: CASE WHEN d + i >= 0 AND w[d + i + 1] = v[i + 1] THEN 1 ELSE 0 END)) / 13 AS share
    FROM (SELECT hit.*, w, v, unnest(range(len(v) - 12)) AS s FROM hit JOIN w USING (doc_id) JOIN v USING (item_id))
)
SELECT doc_id, item_id, min(greatest(0, d + s))::BIGINT AS first_word, max(least(n - 1, d + s + 12))::BIGINT AS last_word,
    max(share) AS share
FROM rated WHERE share >= 0.8 GROUP BY doc_id, item_id
"""

OP5 = """
WITH q AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
s AS (
    SELECT a.vec_id AS query_id, b.vec_id,
        list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * b.v[i]))::BIGINT AS score
    FROM q a JOIN q b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""

OP11 = """
WITH RECURSIVE w AS (
    SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w
    FROM documents
),
s AS MATERIALIZED (
    SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
        ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: concat(w[i], ' ', w[i + 1], ' ', w[i + 2]))) END AS s
    FROM w
),
e AS MATERIALIZED (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
link AS MATERIALIZED (
    SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id
        AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n)
    GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 90 * (any_value(a.n) + any_value(b.n) - count(*))
),
reach AS (
    SELECT a, b FROM link UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a
),
least AS (SELECT a, min(b) AS b FROM reach GROUP BY a),
degree AS (SELECT a, count(*) AS n FROM link GROUP BY a)
SELECT s.doc_id, len(s)::BIGINT AS n_shingles, least(s.doc_id, coalesce(least.b, s.doc_id)) AS component_id,
    coalesce(degree.n, 0)::BIGINT AS n_links
FROM s LEFT JOIN least ON s.doc_id = least.a LEFT JOIN degree ON s.doc_id = degree.a
"""

OP12 = """
WITH v AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
s AS MATERIALIZED (
    SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same,
        list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * b.v[i]))::BIGINT AS score
    FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
),
p AS (
    SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, positive_id, row_number() OVER w::INT AS rank, s.vec_id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same
    AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score
WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id)
QUALIFY row_number() OVER w <= 3
"""

OP13 = """
WITH texts AS (SELECT doc_id, text, true AS doc FROM documents UNION ALL SELECT NULL, text, false FROM benchmark),
w AS MATERIALIZED (
    SELECT row_number() OVER () AS r, doc_id, doc, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w
    FROM texts
),
f AS MATERIALIZED (
    SELECT r, doc, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: concat(w[i], ' ', w[i + 1])))) AS f FROM w
),
-- CRC-32 bit by bit, the lowest bit of a byte first.
crc AS MATERIALIZED (
    SELECT f, xor(4294967295, list_reduce(
        list_transform(range(8 * octet_length(encode(f))), lambda i: get_bit(encode(f)::BIT, (8 * (i // 8) + 7 - i % 8)::INT)::BIGINT),
        lambda c, b: xor(c >> 1, 3988292384 * (xor(c, b) & 1)), 4294967295)) % 10000 AS b
    FROM (SELECT DISTINCT f FROM f)
),
counted AS MATERIALIZED (SELECT r, doc, b, count(*) AS n FROM f JOIN crc USING (f) GROUP BY r, doc, b),
bucket AS (
    SELECT b, coalesce(sum(n) FILTER (WHERE doc), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (WHERE NOT doc), 0)::DOUBLE AS t
    FROM counted GROUP BY b
),
total AS (SELECT sum(s) AS s, sum(t) AS t FROM bucket),
gain AS (
    SELECT b, floor(1000 * ln((bucket.t + 1) * (total.s + 10000) / ((bucket.s + 1) * (total.t + 10000))))::BIGINT AS gain
    FROM bucket, total
),
weight AS (SELECT r, sum(n * gain)::DOUBLE AS g, sum(n) AS n FROM counted JOIN gain USING (b) WHERE doc GROUP BY r),
d AS (
    SELECT doc_id, len(w) AS words, coalesce(n, 0)::BIGINT AS n_features, coalesce(floor(g / n), 0)::BIGINT AS weight,
        ('0x' || substr(sha256('7:' || doc_id), 1, 8))::BIGINT AS h
    FROM w LEFT JOIN weight USING (r) WHERE doc
),
scored AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM d),
placed AS (SELECT *, row_number() OVER (PARTITION BY words >= 20 ORDER BY score DESC, doc_id) AS place,
    count(*) OVER (PARTITION BY words >= 20) AS n FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN words >= 20 AND place <= 25 * n // 100 THEN place END AS rank FROM placed
"""


def oracles() -> dict[str, str]:
    """SQL of the operators that SQL can express."""
    return {"op1_warc": OP1, "op3_decontaminate": OP3, "op5_top_k": OP5, "op11_ngram_jaccard": OP11, "op12_hard_negatives": OP12, "op13_resample": OP13}
