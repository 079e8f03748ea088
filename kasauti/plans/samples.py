"""Queries over samples, splits and folds, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import sampling
from ..operators.asr import valid_claims
from ..sources import tables
from ..sources.tables import CTE_CLAIMS, CTE_VERIFIED, with_ctes
from .verification import verified

PER_DOMAIN = 12
RESAMPLES = 200


def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = tables.claims(spark, sf_dir).filter("label IS NOT NULL").select("row_id", "domain", "label")
    return sampling.stratified(labelled, "domain", "label", PER_DOMAIN, ["SUP", "REF", "NEI"]).select("row_id", "domain", "label")


#: Rows asked of some sources; others give none.
TARGETS = {"src0": 17, "src1": 18, "src2": 9, "src3": 1000, "src4": 1, "src5": 0}


def stratified_by_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = tables.claims(spark, sf_dir).filter("label IS NOT NULL").select("row_id", "domain", "label")
    targets = spark.createDataFrame(list(TARGETS.items()), "domain string, target int")
    return sampling.stratified(labelled, "domain", "label", targets, ["SUP", "REF", "NEI"]).select("row_id", "domain", "label")


def split_60_20_20(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.split_60_20_20(valid_claims(verified(spark, sf_dir))).select("row_id", "split")


def five_fold_ntile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.folds(valid_claims(verified(spark, sf_dir))).select("row_id", "fold")


def domain_label_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = tables.claims(spark, sf_dir).select("domain", F.coalesce("label", F.lit("NONE")).alias("label"))
    return c.cube("domain", "label").agg(F.count(F.lit(1)).alias("n")).select(F.coalesce("domain", F.lit("TOTAL")).alias("domain"), F.coalesce("label", F.lit("TOTAL")).alias("label"), "n")


def bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentile interval of the share of claims that any perturbation flips, over resamples of all claims."""
    hits = verified(spark, sf_dir).filter("NOT baseline_failed").groupBy("row_id").agg(F.max(F.col("gated_flip").cast("double")).alias("hit"))
    drawn = sampling.bootstrap_means(hits, RESAMPLES, "hit")
    return drawn.agg(F.round(F.percentile("mean", F.lit(0.025)), 6).alias("ci_low"), F.round(F.percentile("mean", F.lit(0.975)), 6).alias("ci_high"), F.round(F.avg("mean"), 6).alias("mean"))


QUERIES = {f.__name__: f for f in (stratified_sample, stratified_by_targets, split_60_20_20, five_fold_ntile, domain_label_cube, bootstrap_ci)}

VALID = "valid AS (SELECT DISTINCT row_id FROM verified WHERE NOT baseline_failed)"
NUMBERED = "numbered AS (SELECT row_id, row_number() OVER (ORDER BY md5('42:' || row_id || ':split'), row_id) AS nth, count(*) OVER () AS total FROM {})"

ORACLES = {
    "stratified_sample": with_ctes(CTE_CLAIMS, "l AS (SELECT row_id, domain, label FROM claims WHERE label IS NOT NULL)", "c AS (SELECT domain, label, count(*) AS have FROM l GROUP BY ALL)",
        f"w AS (SELECT *, {PER_DOMAIN // 3} + CASE WHEN row_number() OVER (PARTITION BY domain ORDER BY have DESC, label) = 1 THEN {PER_DOMAIN % 3} ELSE 0 END AS want FROM c)",
        "t AS (SELECT *, least(have, want) AS take, have - least(have, want) AS surplus FROM w)",
        f"""q AS (SELECT *, {PER_DOMAIN} - sum(take) OVER (PARTITION BY domain) AS short,
            coalesce(sum(surplus) OVER (PARTITION BY domain ORDER BY surplus DESC, label ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM t)""",
        "n AS (SELECT *, row_number() OVER (PARTITION BY domain, label ORDER BY md5('42:' || row_id || ':sample'), row_id) AS nth FROM l)",
        then="SELECT row_id, domain, label FROM n JOIN q USING (domain, label) WHERE nth <= take + greatest(0, least(surplus, short - before))"),
    "stratified_by_targets": with_ctes(CTE_CLAIMS, f"targets(domain, target) AS (VALUES {', '.join(map(str, TARGETS.items()))})", "l AS (SELECT row_id, domain, label FROM claims WHERE label IS NOT NULL)",
        "c AS (SELECT domain, label, target, count(*) AS have FROM l JOIN targets USING (domain) GROUP BY ALL)",
        "w AS (SELECT *, target // 3 + CASE WHEN row_number() OVER (PARTITION BY domain ORDER BY have DESC, label) = 1 THEN target % 3 ELSE 0 END AS want FROM c)",
        "t AS (SELECT *, least(have, want) AS take, have - least(have, want) AS surplus FROM w)",
        """q AS (SELECT *, target - sum(take) OVER (PARTITION BY domain) AS short,
            coalesce(sum(surplus) OVER (PARTITION BY domain ORDER BY surplus DESC, label ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM t)""",
        "n AS (SELECT *, row_number() OVER (PARTITION BY domain, label ORDER BY md5('42:' || row_id || ':sample'), row_id) AS nth FROM l)",
        then="SELECT row_id, domain, label FROM n JOIN q USING (domain, label) WHERE nth <= take + greatest(0, least(surplus, short - before))"),
    "split_60_20_20": with_ctes(CTE_VERIFIED, VALID, NUMBERED.format("valid"), then="""SELECT row_id, CASE WHEN nth <= floor(total * 6 / 10) THEN 'train'
        WHEN nth <= floor(total * 6 / 10) + floor(total * 2 / 10) THEN 'val' ELSE 'test' END AS split FROM numbered"""),
    "five_fold_ntile": with_ctes(CTE_VERIFIED, VALID, then="SELECT row_id, CAST(ntile(5) OVER (ORDER BY md5('42:' || row_id || ':split'), row_id) AS INT) AS fold FROM valid"),
    "domain_label_cube": with_ctes(CTE_CLAIMS, "c AS (SELECT domain, coalesce(label, 'NONE') AS label FROM claims)",
        then="SELECT coalesce(domain, 'TOTAL') AS domain, coalesce(label, 'TOTAL') AS label, count(*) AS n FROM c GROUP BY CUBE (domain, label)"),
    "bootstrap_ci": with_ctes(CTE_VERIFIED, "hits AS (SELECT row_id, max(CAST(gated_flip AS DOUBLE)) AS hit FROM verified WHERE NOT baseline_failed GROUP BY row_id)",
        f"draws AS (SELECT d AS draw, hit, ('0x' || substr(md5('42:' || (d // {sampling.DRAWS}) || ':' || row_id || ':bootstrap'), 1 + {sampling.DIGITS} * (d % {sampling.DRAWS}), {sampling.DIGITS}))::BIGINT AS u FROM hits, range({RESAMPLES}) r(d))",
        f"means AS (SELECT draw, sum(w * hit) / nullif(sum(w), 0) AS mean FROM (SELECT draw, hit, {' + '.join(f'(u >= {x})::INT' for x in sampling.poisson_steps())} AS w FROM draws) GROUP BY draw)",
        then="SELECT round(quantile_cont(mean, 0.025), 6) AS ci_low, round(quantile_cont(mean, 0.975), 6) AS ci_high, round(avg(mean), 6) AS mean FROM means"),
}
