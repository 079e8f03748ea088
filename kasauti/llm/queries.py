"""The operators over whole tables, as the driver runs them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import quality, toxicity
from .byte_bpe import round_trip
from .common import held_out, table
from .decontaminate import contaminations
from .exact_dedup import exact_dedup
from .html_extract import extract
from .line_dedup import line_dedup
from .simhash import near_duplicates
from .suffix_dedup import drop_repeats
from .token_alignment import alignment_counts
from .token_counts import token_counts
from .url_filters import filter_urls, rule
from .vector_codes import vector_codes

URL_RULES = [
    rule("block", "com/en/"),
    rule("allow", "example.com/en/7"),
    rule("allow", "net/de/"),
    rule("block", "example.net/de/8"),
    rule("block", "org/es/"),
]


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminations(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return round_trip(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN, keep=["doc_id"])


def op4_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    done = quality.score(docs, quality.fit(docs, labels), keep=["doc_id"])
    return done.select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), keep=["doc_id"])


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    done = toxicity.score(docs, toxicity.fit(docs, labels), keep=["doc_id"])
    return done.select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = (public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    return alignment_counts(table(spark, sf_dir, "documents"), *paths)


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes(table(spark, sf_dir, "embeddings"))


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = drop_repeats(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {f.__name__: f for f in (op1_exact_dedup, op2_decontamination, op3_byte_bpe, op4_html_extract, op5_quality, op6_token_counts, op7_simhash, op8_toxicity, op9_line_dedup, op10_url_filters, op11_token_alignment, op12_vector_codes, op13_suffix_dedup)}

SPACE = r"[\x20\x09-\x0D]"


def _codes_sql(parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> str:
    """Every distance of every round, as vector_codes defines them."""
    sql = f"""
        WITH kept AS MATERIALIZED (
            SELECT row_number() OVER (ORDER BY vec_id, embedding) - 1 AS r, vec_id, label, len(embedding) // {parts} AS d,
                list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
            FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ),
        x AS MATERIALIZED (SELECT r, (i - 1) // d AS p, (i - 1) % d AS pos, v[i] AS x FROM (SELECT r, d, v, unnest(range(1, len(v) + 1)) AS i FROM kept)),
        b0 AS MATERIALIZED (SELECT p, r AS e, pos, x AS c FROM x WHERE r < {entries}),"""
    for n in range(rounds + 1):
        sql += f"""
        a{n} AS MATERIALIZED (
            SELECT r, p, min(dist * {entries} + e) % {entries} AS e, CAST(min(dist * {entries} + e) // {entries} AS BIGINT) AS dist
            FROM (SELECT r, p, e, CAST(sum((x - c) * (x - c)) AS BIGINT) AS dist FROM x JOIN b{n} USING (p, pos) GROUP BY r, p, e) GROUP BY r, p
        ),"""
        if n < rounds:
            sql += f"""
        m{n} AS MATERIALIZED (SELECT p, e, pos, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM x JOIN a{n} USING (r, p) GROUP BY p, e, pos),
        b{n + 1} AS MATERIALIZED (SELECT p, e, pos, coalesce((s - ((s % n) + n) % n) // n, c) AS c FROM b{n} LEFT JOIN m{n} USING (p, e, pos)),"""
    return sql + f"""
        coded AS (
            SELECT vec_id, label, string_agg(lpad(lower(to_hex(e)), 2, '0'), '' ORDER BY p) AS code, CAST(sum(dist) AS BIGINT) AS error
            FROM a{rounds} JOIN kept USING (r) GROUP BY r, vec_id, label
        )
        SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
            (SELECT sha256(string_agg(c, ',' ORDER BY p, e, pos)) FROM b{rounds}) AS codebooks_sha256
        FROM coded"""


ORACLES = {
    "op12_vector_codes": _codes_sql(),
    "op1_exact_dedup": rf"""
        WITH digests AS (
            SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '{SPACE}+', ' ', 'g')) AS text_sha256 FROM documents
        )
        SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256
        FROM digests WINDOW w AS (PARTITION BY text_sha256)""",
    "op9_line_dedup": rf"""
        WITH texts AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
        lines AS (
            SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM texts
        ),
        keyed AS (
            SELECT *, translate(regexp_replace(line, '^{SPACE}+|{SPACE}+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines
        ),
        repeated AS (
            SELECT key, max(doc_id) AS last_id FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
        ),
        judged AS (
            SELECT k.doc_id, k.pos, k.line, r.key IS NOT NULL AND k.doc_id <> r.last_id AS dropped FROM keyed k LEFT JOIN repeated r USING (key)
        )
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
            sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
        FROM judged GROUP BY doc_id""",
    "op10_url_filters": r"""
        WITH parts AS (
            SELECT page_id,
                translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
            FROM pages
        ),
        rules(verdict, rule_host, rule_path) AS (
            VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('block', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')
        ),
        fits AS (
            SELECT page_id, verdict, rule_host || rule_path AS rule,
                row_number() OVER (PARTITION BY page_id ORDER BY length(rule_host || rule_path) DESC, rule_host, rule_path) AS nth
            FROM parts, rules
            WHERE (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
        )
        SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.verdict, 'allow') AS verdict
        FROM parts p LEFT JOIN fits f ON f.page_id = p.page_id AND f.nth = 1""",
}
