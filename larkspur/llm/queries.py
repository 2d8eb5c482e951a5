"""The queries of this package and, where SQL can express one, its DuckDB text."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm.common import crc_mod, table
from larkspur.llm.exact_dedup import exact_dedup
from larkspur.llm.language_id import identify, learnable, train
from larkspur.llm.license_scan import scan_licenses
from larkspur.llm.line_dedup import line_report
from larkspur.llm.mixing import mix
from larkspur.llm.near_join import similar_classes
from larkspur.llm.quality import score_quality
from larkspur.llm.sentencepieces import encode
from larkspur.llm.topk import exact_topk
from larkspur.llm.url_filter import filter_urls


def tokenizer() -> str:
    """The SentencePiece model file: LARKSPUR_SENTENCEPIECE, or the installed public one."""
    import public_tokenizers

    return os.environ.get("LARKSPUR_SENTENCEPIECE") or public_tokenizers.path("piece_bpe_32k.model")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    found = identify(documents.select("doc_id", "text"), train(documents, learnable()))
    return found.select("doc_id", F.coalesce(crc_mod("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score", "bits_per_byte")


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer(), digest=True)


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages").select("page_id", "url")).drop("url")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_quality(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"), crc_mod("doc_id", 5) != 0)
    return scored.select("doc_id", F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", "predicted")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_report(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("spans")


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=("doc_id",))


def op9_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_topk(table(spark, sf_dir, "embeddings"))


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_classes(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {f.__name__: f for f in (op1_language_id, op2_mix_sources, op3_sentencepiece, op4_url_filter, op5_quality, op6_line_dedup, op7_license_scan, op8_exact_dedup, op9_exact_topk, op10_ngram_jaccard)}

ORACLE = {
    "op2_mix_sources": r"""
        WITH s AS (
            SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
                   substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':17'), 1, 16) AS h FROM documents),
        per AS (
            SELECT source, CAST(sum(size) AS BIGINT) AS source_size, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight FROM s GROUP BY source),
        filled AS (
            SELECT *, 3 * source_size AS cap,
                   CAST(sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (ORDER BY 3 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
                   / sum(weight) OVER (ORDER BY 3 * source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM per),
        aims AS (
            SELECT source, source_size, weight, least(CAST(cap AS DOUBLE), max(CASE WHEN level * weight <= cap THEN level END) OVER () * weight) AS target FROM filled),
        q AS (
            SELECT s.doc_id, size, source_size, target, weight,
                   sum(size) OVER (PARTITION BY s.source ORDER BY h, doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
            FROM s JOIN aims a ON s.source IS NOT DISTINCT FROM a.source),
        e AS (SELECT CAST(upto + pass * source_size AS DOUBLE) / weight AS finish, sum(size) AS words FROM q, (VALUES (0), (1), (2)) v(pass) WHERE size > 0 GROUP BY 1),
        c AS (SELECT coalesce(max(finish), -1) AS last FROM (SELECT finish, sum(words) OVER (ORDER BY finish) AS words FROM e) WHERE words <= (SELECT sum(size) FROM s))
        SELECT doc_id, size, source_size, target,
               CAST(size * ((CAST(upto AS DOUBLE) / weight <= last)::INT + (CAST(upto + source_size AS DOUBLE) / weight <= last)::INT + (CAST(upto + 2 * source_size AS DOUBLE) / weight <= last)::INT) AS BIGINT) AS taken
        FROM q, c""",
    "op4_url_filter": r"""
        WITH u AS (
            SELECT page_id, url, CASE WHEN instr(coalesce(url, ''), '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS after, CASE WHEN instr(coalesce(url, ''), '://') > 0 THEN after ELSE coalesce(url, '') END AS rest FROM pages),
        p AS (
            SELECT *, translate(regexp_extract(after, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   regexp_extract(substr(after, length(regexp_extract(after, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM u),
        r AS (
            SELECT p.*, (SELECT {'rule': h || p1, 'said': v} FROM (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')) x(v, h, p1)
                         WHERE (p.host = h OR ends_with(p.host, '.' || h)) AND starts_with(p.path, p1) ORDER BY length(h || p1) DESC LIMIT 1) AS best FROM p),
        k AS (
            SELECT page_id, url, rest, host, path, best.rule AS rule, best.said AS said,
                   [38, 38] || list_transform(CASE WHEN rest = '' THEN [] ELSE string_split(rest, '') END, lambda c:
                       CASE WHEN c >= 'a' AND c <= 'z' THEN ascii(c) - 97 WHEN c >= 'A' AND c <= 'Z' THEN ascii(c) - 65 WHEN c >= '0' AND c <= '9' THEN 26
                            WHEN instr('/.-_?&=#%:', c) > 0 THEN 26 + instr('/.-_?&=#%:', c) ELSE 37 END) AS codes FROM r),
        g AS (SELECT page_id, url, said, unnest(list_transform(range(3, len(codes) + 1), lambda i: {'x': codes[i - 2], 'y': codes[i - 1], 'z': codes[i]})) AS t FROM k),
        n3 AS (SELECT said, t.x AS x, t.y AS y, t.z AS z, count(*) AS c FROM g WHERE said IS NOT NULL AND md5(url)[1] NOT IN ('0', '1', '2') GROUP BY ALL),
        t1 AS (SELECT said, z, sum(c) AS c FROM n3 GROUP BY ALL), s1 AS (SELECT said, sum(c) AS n, count(*) AS d FROM t1 GROUP BY ALL),
        t2 AS (SELECT said, y, z, sum(c) AS c FROM n3 GROUP BY ALL), s2 AS (SELECT said, y, sum(c) AS n, count(*) AS d FROM t2 GROUP BY ALL),
        s3 AS (SELECT said, x, y, sum(c) AS n, count(*) AS d FROM n3 GROUP BY ALL),
        m0 AS (SELECT s1.said, a.x, a.y, a.z, (coalesce(t1.c, 0) + s1.d * (1e0 / 39)) / (s1.n + s1.d) AS p
               FROM (SELECT DISTINCT t.x AS x, t.y AS y, t.z AS z FROM g) a CROSS JOIN s1 LEFT JOIN t1 ON t1.said = s1.said AND t1.z = a.z),
        m1 AS (SELECT m0.said, m0.x, m0.y, m0.z, CASE WHEN s2.n IS NULL THEN m0.p ELSE (coalesce(t2.c, 0) + s2.d * m0.p) / (s2.n + s2.d) END AS p
               FROM m0 LEFT JOIN s2 ON s2.said = m0.said AND s2.y = m0.y LEFT JOIN t2 ON t2.said = m0.said AND t2.y = m0.y AND t2.z = m0.z),
        m2 AS (SELECT m1.said, m1.x, m1.y, m1.z, CASE WHEN s3.n IS NULL THEN m1.p ELSE (coalesce(n3.c, 0) + s3.d * m1.p) / (s3.n + s3.d) END AS p
               FROM m1 LEFT JOIN s3 ON s3.said = m1.said AND s3.x = m1.x AND s3.y = m1.y LEFT JOIN n3 ON n3.said = m1.said AND n3.x = m1.x AND n3.y = m1.y AND n3.z = m1.z),
        lr AS (SELECT a.x, a.y, a.z, CAST(round_even(log2(a.p / b.p) * 65536, 0) AS BIGINT) AS v FROM m2 a JOIN m2 b ON a.said = 'allow' AND b.said = 'block' AND a.x = b.x AND a.y = b.y AND a.z = b.z),
        sums AS (SELECT page_id, CAST(sum(coalesce(v, 0)) AS DOUBLE) AS total FROM g LEFT JOIN lr ON t.x = lr.x AND t.y = lr.y AND t.z = lr.z GROUP BY page_id),
        scored AS (SELECT k.*, coalesce(total, 0) / length(rest) / 65536 AS ratio, floor(coalesce(total, 0) / length(rest) / 1024) AS step FROM k LEFT JOIN sums USING (page_id)),
        bins AS (SELECT said, step, count(*) AS n FROM scored WHERE said IS NOT NULL AND rest <> '' AND md5(url)[1] IN ('0', '1', '2') GROUP BY ALL),
        edges AS (SELECT step FROM bins UNION SELECT max(step) + 1 FROM bins),
        found AS (
            SELECT e.step, round(coalesce(sum(n) FILTER (WHERE said = 'block' AND b.step < e.step), 0)::DOUBLE / sum(n) FILTER (WHERE said = 'block')
                               + (1 - coalesce(sum(n) FILTER (WHERE said = 'allow' AND b.step < e.step), 0)::DOUBLE / sum(n) FILTER (WHERE said = 'allow')), 12) AS share
            FROM edges e CROSS JOIN bins b GROUP BY e.step),
        least AS (SELECT coalesce((SELECT step FROM found WHERE share IS NOT NULL ORDER BY share DESC, step LIMIT 1), 0) AS step)
        SELECT page_id, host, path, rule, coalesce(said, CASE WHEN rest = '' OR scored.step >= least.step THEN 'allow' ELSE 'block' END) AS verdict,
               CASE WHEN rest <> '' THEN ratio END AS ratio
        FROM scored, least""",
    "op8_exact_dedup": """
        WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents)
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, text_sha256
        FROM d WINDOW g AS (PARTITION BY text_sha256)""",
    "op9_exact_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(embedding) > 0),
        s AS (
            SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
            FROM (SELECT DISTINCT vec_id, v FROM v WHERE vec_id % 100 = 0) q JOIN v c ON c.vec_id <> q.vec_id)
        SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score FROM s
        WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 10""",
    "op10_ngram_jaccard": r"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
        sets AS (
            SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
                   ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS s FROM w),
        grams AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
        links AS (
            SELECT a.doc_id AS a, b.doc_id AS b FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id
            GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING count(*) >= 0.8 * (a.n + b.n - count(*)) - 1e-6),
        reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
        SELECT doc_id, least(doc_id, coalesce((SELECT min(b) FROM reach WHERE a = doc_id), doc_id)) AS class_id, (SELECT count(*) FROM links WHERE a = doc_id) AS n_links FROM sets""",
}
