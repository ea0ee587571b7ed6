"""Registered queries opN_<name> and their DuckDB SQL.

Every query applies its operator, with production parameters, to the whole
table and derives the contract's columns from the operator's result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kvloom.llm import decontaminate, exact_dedup, language_id, language_model, line_dedup, mixing, near_dedup, token_count, toxicity, url_filter


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


#: The contract's list: (host, path, verdict).
URL_RULES = [
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
]


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), rules)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_count.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_groups(table(spark, sf_dir, "documents")).drop("body")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated_pairs(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("body")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_plan(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score_texts(table(spark, sf_dir, "documents"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.drop_repeated_lines(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_url_filter": op2_url_filter,
    "op3_toxicity": op3_toxicity,
    "op4_token_count": op4_token_count,
    "op5_near_dedup": op5_near_dedup,
    "op6_language_id": op6_language_id,
    "op7_decontamination": op7_decontamination,
    "op8_mixing": op8_mixing,
    "op9_lm_score": op9_lm_score,
    "op10_line_dedup": op10_line_dedup,
}

ORACLE_SQL: dict[str, str] = {
    "op2_url_filter": r"""
        WITH r(host, path, verdict) AS (
            VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'block'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
        p AS (
            SELECT row_number() OVER () AS i, page_id,
                   translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   coalesce(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 2, 's'), '') AS path
            FROM pages)
        SELECT page_id, p.host AS host, p.path AS path, r.host || r.path AS rule, coalesce(r.verdict, 'allow') AS verdict
        FROM p LEFT JOIN r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)
        QUALIFY row_number() OVER (PARTITION BY i ORDER BY length(r.host || r.path) DESC NULLS LAST, length(r.host) DESC, r.verdict DESC) = 1""",
    "op7_decontamination": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM documents),
        i AS (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM benchmark),
        s AS (
            SELECT DISTINCT item_id, array_to_string(w[n : n + 4], ' ') AS h
            FROM (SELECT item_id, w, unnest(range(1, greatest(2, len(w) - 3))) AS n FROM i WHERE len(w) > 0)),
        c AS (SELECT item_id, count(*) AS n_item FROM s GROUP BY item_id),
        e AS (SELECT DISTINCT doc_id, array_to_string(w[n : n + 4], ' ') AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS n FROM d WHERE len(w) >= 5)),
        p AS (SELECT doc_id, item_id, count(*) AS n_shared FROM e JOIN s USING (h) GROUP BY ALL)
        SELECT doc_id, item_id, n_shared, n_item, n_shared / n_item AS containment
        FROM p JOIN c USING (item_id) WHERE n_shared >= n_item * 0.8 - 1e-9""",
    "op10_line_dedup": r"""
        WITH l AS (
            SELECT doc_id, i, line,
                   translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
            FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents)),
        g AS (SELECT k, min(doc_id) AS keep FROM l WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) >= 2),
        m AS (SELECT l.*, g.keep IS NOT NULL AND g.keep <> l.doc_id AS gone FROM l LEFT JOIN g USING (k))
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
        FROM m GROUP BY doc_id""",
    "op1_exact_dedup": r"""
        WITH d AS (
            SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
        SELECT doc_id, min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
               count(*) OVER (PARTITION BY text_sha256) AS group_size,
               row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id NULLS LAST) = 1 AS kept, text_sha256
        FROM d""",
    "op8_mixing": r"""
        WITH d AS (
            SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
                   md5('mix-1|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || md5(coalesce(text, ''))) AS place
            FROM documents),
        s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
        n AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS source_no FROM s),
        w AS (SELECT *, CASE (source_no - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, source_size * 3 AS cap FROM n),
        o AS (
            SELECT *, row_number() OVER q AS position, sum(source_size) OVER () - coalesce(sum(cap) OVER (q ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS free,
                   sum(weight) OVER (q ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open
            FROM w WINDOW q AS (ORDER BY CAST(cap AS DOUBLE) / weight, source_no)),
        l AS (SELECT free, open FROM o WHERE free * weight <= cap * open ORDER BY position LIMIT 1),
        t AS (
            SELECT o.source, o.source_size,
                   CASE WHEN l.free IS NULL OR CAST(l.free AS DOUBLE) * o.weight / l.open > o.cap THEN CAST(o.cap AS DOUBLE) ELSE CAST(l.free AS DOUBLE) * o.weight / l.open END AS target
            FROM o LEFT JOIN l ON TRUE),
        p AS (
            SELECT d.doc_id, d.source, d.place, d.size, t.source_size, t.target,
                   CASE WHEN t.source_size > 0 THEN CAST(floor(t.target / t.source_size) AS BIGINT) ELSE 0 END AS whole,
                   coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.place, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
            FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
        SELECT doc_id, size, source_size, target,
               CAST(size * (whole + CASE WHEN bool_or(CAST(start AS DOUBLE) + size / 2.0 <= target - whole * source_size) OVER (PARTITION BY source, place) THEN 1 ELSE 0 END) AS BIGINT) AS taken
        FROM p""",
}
