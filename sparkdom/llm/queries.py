"""The opN_ queries of this subpackage and the SQL that DuckDB can run against them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkdom.llm import ann, bpe, decontaminate, ppm, quality, simhash, suffix_dedup, toxicity, url_filter, warc
from sparkdom.llm.common import fold, table

URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = fold("doc_id", 5) == 0
    out = quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ~held)
    return out.select("doc_id", held.alias("held_out"), "score", "predicted")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = fold("doc_id", 3) == 1
    out = toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ~held)
    return out.select("doc_id", held.alias("held_out"), "score", "predicted")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = fold("doc_id", 4) == 2
    out = ppm.identify(table(spark, sf_dir, "documents"), ~held)
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), URL_RULES, "page_id")


def op6_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove(table(spark, sf_dir, "documents"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(spark, table(spark, sf_dir, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_bpe": op2_bpe,
    "op3_toxicity": op3_toxicity,
    "op4_url_filter": op4_url_filter,
    "op5_language_id": op5_language_id,
    "op6_ann": op6_ann,
    "op7_decontaminate": op7_decontaminate,
    "op8_simhash": op8_simhash,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_warc": op10_warc,
}

ORACLE_SQL: dict[str, str] = {
    "op10_warc": r"""
        WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
        d AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS top, sha1(html) AS hex FROM p),
        b AS (SELECT *, list_transform(range(0, 32), lambda i: substring(array_to_string(list_transform(range(1, 41), lambda j: array_extract(['0000','0001','0010','0011','0100','0101','0110','0111','1000','1001','1010','1011','1100','1101','1110','1111'], CAST(strpos('0123456789abcdef', substring(hex, CAST(j AS INT), 1)) AS INT))), ''), CAST(5 * i + 1 AS INT), 5)) AS five FROM d)
        SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
               array_to_string(list_transform(five, lambda f: substring('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (CASE WHEN f[1] = '1' THEN 16 ELSE 0 END) + (CASE WHEN f[2] = '1' THEN 8 ELSE 0 END) + (CASE WHEN f[3] = '1' THEN 4 ELSE 0 END) + (CASE WHEN f[4] = '1' THEN 2 ELSE 0 END) + (CASE WHEN f[5] = '1' THEN 1 ELSE 0 END), 1)), '') AS payload_digest,
               CASE WHEN page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN page_id < top THEN top END AS refers_to
        FROM b""",
    "op4_url_filter": r"""
        WITH u AS (
          SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                 coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
          FROM pages),
        r(r_host, r_path, r_verdict) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
        m AS (
          SELECT host, path, max_by(r_host || r_path, length(r_host || r_path)) AS rule, max_by(r_verdict, length(r_host || r_path)) AS verdict
          FROM (SELECT DISTINCT host, path FROM u) d JOIN r
            ON (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path)
          GROUP BY host, path)
        SELECT page_id, u.host, u.path, m.rule, coalesce(m.verdict, 'allow') AS verdict
        FROM u LEFT JOIN m ON u.host = m.host AND u.path = m.path""",
    # exact neighbours: what the search finds wherever no more vectors are there than it ranks exactly
    "op6_ann": r"""
        WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
        s AS (SELECT len(e) AS dim FROM v GROUP BY 1 ORDER BY count(*) DESC, dim LIMIT 1),
        u AS (SELECT v.* FROM v, s WHERE len(e) = dim)
        SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM (
          SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS rank FROM (
            SELECT q.vec_id AS query_id, c.vec_id, sqrt(list_reduce(list_transform(list_zip(q.e, c.e), lambda p: (p[1] - p[2]) * (p[1] - p[2])), lambda x, y: x + y)) AS score
            FROM u q JOIN u c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0)) WHERE rank <= 10""",
    "op9_suffix_dedup": r"""
        WITH d AS (SELECT doc_id, row_number() OVER () AS r, hex(encode(coalesce(text, ''))) AS h FROM documents),
        o AS (SELECT r, low, substring(h, CAST(2 * low + 1 AS BIGINT), 1398) AS x, length(h) // 2 AS nb FROM (SELECT r, h, unnest(range(0, length(h) // 2 - 199, 500)) AS low FROM d WHERE length(h) >= 400)),
        w AS (SELECT r, low + j AS s, hash(substring(x, CAST(2 * j + 1 AS BIGINT), 400)) AS k FROM (SELECT r, low, x, unnest(range(0, least(500, nb - low - 199))) AS j FROM o)),
        c AS (SELECT r, s FROM w WHERE k IN (SELECT k FROM w GROUP BY k HAVING count(*) > 1)),
        g AS (SELECT r, s, CASE WHEN s <= lag(s) OVER (PARTITION BY r ORDER BY s) + 200 THEN 0 ELSE 1 END AS fresh FROM c),
        p AS (SELECT r, min(s) AS a, max(s) + 200 AS b FROM (SELECT r, s, sum(fresh) OVER (PARTITION BY r ORDER BY s) AS run FROM g) GROUP BY r, run),
        k AS (SELECT r, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS f, a AS t FROM p UNION ALL SELECT r, max(b), NULL FROM p GROUP BY r),
        t AS (SELECT k.r, string_agg(substring(h, CAST(2 * f + 1 AS BIGINT), CAST(2 * (coalesce(t, length(h) // 2) - f) AS BIGINT)), '' ORDER BY f) AS kept FROM k JOIN d ON k.r = d.r GROUP BY k.r),
        n AS (SELECT r, CAST(sum(b - a) AS BIGINT) AS n_removed, count(*) AS n_spans FROM p GROUP BY r)
        SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
        FROM d LEFT JOIN n ON d.r = n.r LEFT JOIN t ON d.r = t.r""",
}
