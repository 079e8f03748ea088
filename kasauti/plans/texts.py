"""Queries over text metrics and the orthographic gate, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..sources import tables
from ..sources.tables import CTE_CLAIMS, with_ctes


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document beside the benchmark item that its id falls to."""
    docs, items = tables.read(spark, sf_dir, "documents"), tables.read(spark, sf_dir, "benchmark")
    n = items.count()
    return docs.select("doc_id", F.col("text").alias("doc"), F.pmod("doc_id", F.lit(n)).alias("item_id")).join(items.select("item_id", F.col("text").alias("item")), "item_id")


def token_jaccard_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    one, two = (F.array_distinct(text.tokens(F.col(c))) for c in ("doc", "item"))
    return _pairs(spark, sf_dir).select("doc_id", "item_id", F.round(text.jaccard(one, two), 6).alias("jaccard"))


def char_ngram_fscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.claims(spark, sf_dir).select("row_id", F.round(text.char_fscore_of_texts(F.col("claim"), F.col("evidence")), 6).alias("char_f"))


def orthographic_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables.read(spark, sf_dir, "documents").select("lang", text.orthography(F.coalesce("text", F.lit(""))).alias("verdict"))
    return docs.groupBy("lang", "verdict").agg(F.count(F.lit(1)).alias("n"))


def deterministic_gate_pass_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims with their words turned round (no gate), cut to half (meaning) and with a fourfold letter (orthography)."""
    c = tables.claims(spark, sf_dir).select("claim")
    words = text.tokens(F.col("claim"))
    changed = F.array(
        F.struct(F.lit("reversed").alias("change"), F.lit("none").alias("mode"), F.array_join(F.reverse(words), " ").alias("after")),
        F.struct(F.lit("halved").alias("change"), F.lit("meaning").alias("mode"), F.array_join(F.slice(words, 1, (F.size(words) / 3).cast("int")), " ").alias("after")),
        F.struct(F.lit("stretched").alias("change"), F.lit("fluency").alias("mode"), F.concat("claim", F.lit("zzzz")).alias("after")),
    )
    judged = c.select("claim", F.explode(changed).alias("x")).select("x.change", text.quality_gate(F.col("claim"), F.col("x.after"), F.col("x.mode")).alias("verdict"))
    return judged.groupBy("change", "verdict").agg(F.count(F.lit(1)).alias("n"))


def grapheme_cluster_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables.read(spark, sf_dir, "documents").select("lang", text.clusters(F.col("text")).alias("c"))
    each = docs.select("lang", F.size("c").alias("n"), F.size(F.filter("c", text.is_mark)).alias("marks"), F.size(F.filter("c", text.has_virama)).alias("viramas"))
    return each.groupBy("lang").agg(F.sum("n").alias("clusters"), F.max("n").alias("longest"), F.sum("marks").alias("marks"), F.sum("viramas").alias("viramas"))


def tokenize_strip_punct(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables.read(spark, sf_dir, "documents").select("lang", F.explode(text.tokens(F.col("text"))).alias("w"))
    w = F.col("w")
    each = docs.select("lang", text.core(w).alias("core"), text.lead_punct(w).alias("lead"), text.trail_punct(w).alias("trail"))
    return each.groupBy("lang").agg(
        F.count(F.lit(1)).alias("tokens"),
        F.countDistinct("core").alias("cores"),
        F.sum(F.char_length("core")).alias("core_chars"),
        F.sum(F.char_length("lead")).alias("lead_chars"),
        F.sum(F.char_length("trail")).alias("trail_chars"),
    )


def word_counts_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frequent words of each source (at least 20 times)."""
    words = tables.read(spark, sf_dir, "documents").select("source", F.explode(text.tokens(F.lower("text"))).alias("w")).select("source", text.core(F.col("w")).alias("word"))
    return words.groupBy("source", "word").agg(F.count(F.lit(1)).alias("n")).filter("n >= 20")


QUERIES = {f.__name__: f for f in (token_jaccard_pairs, char_ngram_fscore, orthographic_gate, deterministic_gate_pass_rate, grapheme_cluster_stats, tokenize_strip_punct, word_counts_by_source)}

EXTEND = r"\p{Mn}\p{Mc}\p{Me}\p{Cf}\p{Cc}\p{Sk}"
TOKENS = r"regexp_extract_all({x}, '[^ \t\n\v\f\r]+')"
SOLID = r"regexp_replace({x}, '[ \t\n\v\f\r]+', '', 'g')"
JACCARD = "CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0 ELSE len(list_intersect({a}, {b})) / len(list_distinct(list_concat({a}, {b}))) END"
GRAMS = "CASE WHEN length({x}) >= {n} THEN list_distinct(list_transform(range(1, length({x}) - {n} + 2), lambda i: substr({x}, i, {n}))) ELSE [] END"
CORE = r"CASE WHEN regexp_full_match({w}, '\p{{P}}+') THEN {w} ELSE regexp_replace({w}, '^\p{{P}}+|\p{{P}}+$', '', 'g') END"
REPEATED = "len(list_filter(range(1, len({l}) - 2), lambda i: {l}[i] <> chr(10) AND {l}[i] = {l}[i + 1] AND {l}[i] = {l}[i + 2] AND {l}[i] = {l}[i + 3])) > 0"


def orthography_sql(x: str, letters: str) -> str:
    solid = SOLID.format(x=x)
    return rf"""CASE WHEN trim({x}) = '' THEN 'empty_text'
        WHEN length(regexp_replace({solid}, '[^\x{{0900}}-\x{{097F}}\x00-\x7F\p{{P}}]', '', 'g')) / nullif(length({solid}), 0) < 0.85 THEN 'invalid_script_encoding'
        WHEN {REPEATED.format(l=letters)} THEN 'excessive_character_repetition'
        WHEN regexp_matches({x}, '[\x{{093E}}-\x{{094C}}]{{2}}') THEN 'illegal_stacked_diacritics'
        WHEN starts_with(ltrim({x}), chr(2381)) THEN 'leading_virama' ELSE 'valid_orthography' END"""


def fscore_ctes(source: str, keys: str) -> tuple[str, ...]:
    """CTE scored: keys and char_f of the columns a and b of ``source``."""
    both = ", ".join(f"{GRAMS.format(x=x, n=n)} AS {x}{n}" for n in (2, 3, 4) for x in ("a", "b"))
    f = lambda n: f"CASE WHEN len(list_intersect(a{n}, b{n})) > 0 THEN 2.0 * len(list_intersect(a{n}, b{n})) / (len(a{n}) + len(b{n})) END"
    return (
        f"solid AS (SELECT {keys}, {SOLID.format(x='a')} AS a, {SOLID.format(x='b')} AS b FROM {source})",
        f"grams AS (SELECT {keys}, {both} FROM solid)",
        f"scored AS (SELECT {keys}, coalesce(list_avg([{f(2)}, {f(3)}, {f(4)}]), 0.0) AS char_f FROM grams)",
    )


ORACLES = {
    "token_jaccard_pairs": f"""WITH n AS (SELECT count(*) AS n FROM benchmark),
        p AS (SELECT doc_id, item_id, list_distinct({TOKENS.format(x='d.text')}) AS a, list_distinct({TOKENS.format(x='b.text')}) AS b
            FROM documents d, n, benchmark b WHERE d.doc_id % n.n = b.item_id)
        SELECT doc_id, item_id, round({JACCARD.format(a='a', b='b')}, 6) AS jaccard FROM p""",
    "char_ngram_fscore": with_ctes(CTE_CLAIMS, "cut AS (SELECT row_id, claim AS a, evidence AS b FROM claims)", *fscore_ctes("cut", "row_id"), then="SELECT row_id, round(char_f, 6) AS char_f FROM scored"),
    "orthographic_gate": f"""WITH d AS (SELECT lang, coalesce(text, '') AS t, string_split(coalesce(text, ''), '') AS l FROM documents)
        SELECT lang, {orthography_sql('t', 'l')} AS verdict, count(*) AS n FROM d GROUP BY ALL""",
    "deterministic_gate_pass_rate": with_ctes(
        CTE_CLAIMS,
        f"w AS (SELECT row_id, claim, {TOKENS.format(x='claim')} AS w FROM claims)",
        """x AS (SELECT row_id, 'reversed' AS change, 'none' AS mode, claim AS a, array_to_string(list_reverse(w), ' ') AS b FROM w
            UNION ALL SELECT row_id, 'halved', 'meaning', claim, array_to_string(w[1:CAST(floor(len(w) / 3) AS INT)], ' ') FROM w
            UNION ALL SELECT row_id, 'stretched', 'fluency', claim, claim || 'zzzz' FROM w)""",
        *fscore_ctes("x", "row_id, change"),
        f"j AS (SELECT x.*, char_f, {JACCARD.format(a='list_distinct(' + TOKENS.format(x='a') + ')', b='list_distinct(' + TOKENS.format(x='b') + ')')} AS jac, string_split(b, '') AS l FROM x JOIN scored USING (row_id, change))",
        then=f"""SELECT change, CASE WHEN mode = 'none' THEN 'pass' WHEN {orthography_sql('b', 'l')} <> 'valid_orthography' THEN 'poor_orthography'
            WHEN mode = 'meaning' AND NOT (jac >= 0.5 OR char_f >= 0.6) THEN 'meaning_drift' ELSE 'pass' END AS verdict, count(*) AS n FROM j GROUP BY ALL""",
    ),
    "grapheme_cluster_stats": rf"""WITH c AS (SELECT lang, regexp_extract_all(text, '(?s).[{EXTEND}]*') AS c FROM documents)
        SELECT lang, CAST(sum(len(c)) AS BIGINT) AS clusters, max(len(c)) AS longest,
            CAST(sum(len(list_filter(c, lambda x: regexp_full_match(x, '[{EXTEND}]+')))) AS BIGINT) AS marks,
            CAST(sum(len(list_filter(c, lambda x: regexp_matches(x, '[\x{{094D}}\x{{09CD}}\x{{0A4D}}\x{{0ACD}}\x{{0B4D}}\x{{0BCD}}\x{{0C4D}}\x{{0CCD}}\x{{0D4D}}]')))) AS BIGINT) AS viramas
        FROM c GROUP BY lang""",
    "tokenize_strip_punct": rf"""WITH t AS (SELECT lang, unnest({TOKENS.format(x='text')}) AS w FROM documents),
        c AS (SELECT lang, w, {CORE.format(w='w')} AS core, regexp_full_match(w, '\p{{P}}+') AS bare FROM t)
        SELECT lang, count(*) AS tokens, count(DISTINCT core) AS cores, CAST(sum(length(core)) AS BIGINT) AS core_chars,
            CAST(sum(CASE WHEN bare THEN 0 ELSE length(regexp_extract(w, '^\p{{P}}*')) END) AS BIGINT) AS lead_chars,
            CAST(sum(CASE WHEN bare THEN 0 ELSE length(regexp_extract(w, '\p{{P}}*$')) END) AS BIGINT) AS trail_chars FROM c GROUP BY lang""",
    "word_counts_by_source": rf"""WITH t AS (SELECT source, unnest({TOKENS.format(x='lower(text)')}) AS w FROM documents)
        SELECT source, {CORE.format(w='w')} AS word, count(*) AS n FROM t GROUP BY ALL HAVING count(*) >= 20""",
}
