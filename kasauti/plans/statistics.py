"""Queries over evaluation statistics, with their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import stats, tails
from ..operators import evaluation
from ..sources import tables
from ..streaming.rates import windowed_rates
from ..sources.tables import CTE_VERIFIED, with_ctes
from .verification import CTE_MEASURED, measured, measured_votes, verified

RULE = """CASE WHEN arm = 'LLM' AND family = 'Evidence' AND attack_id NOT LIKE '%Imperceptible%' THEN 'POS' WHEN attack_id LIKE '%FactMixing' THEN 'POS'
    WHEN attack_id LIKE '%Omission%' OR attack_id LIKE '%ClaimRewrite' OR attack_id LIKE '%Jumbling' THEN 'MID'
    WHEN family IN ('Char', 'Word') OR attack_id LIKE '%Imperceptible%' THEN 'NEG' END"""


def auroc_auprc_by_attack(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = verified(spark, sf_dir).filter("NOT baseline_failed AND verdict IS NOT NULL")
    out = evaluation.ranking(seen, "fluency", "flipped", "attack_id")
    return out.select("attack_id", "hits", "misses", F.round("auroc", 6).alias("auroc"), F.round("auprc", 6).alias("auprc"))


def leaderboard(votes: DataFrame, attacks: DataFrame) -> DataFrame:
    """How many tiers each model, and all together by majority, foretold."""
    told = votes.join(F.broadcast(attacks.select("attack_idx", "tier")), "attack_idx")
    together = evaluation.majority(told, "predicted", "attack_idx", "tier").select("attack_idx", F.lit("consensus").alias("model"), F.col("consensus").alias("predicted"), "tier")
    every = told.select("attack_idx", "model", "predicted", "tier").unionByName(together)
    return every.groupBy("model").agg(F.count_if(F.col("predicted") == F.col("tier")).alias("correct"), F.count(F.lit(1)).alias("n")).select("model", "correct", "n", F.round(100.0 * F.col("correct") / F.col("n"), 2).alias("accuracy_pct"))


def tier_prediction_leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaderboard(measured_votes(spark, sf_dir), measured(spark, sf_dir))


def rule_predictions(attacks: DataFrame) -> DataFrame:
    """Ordered rules, then the first other perturbation of the same granularity and arm, then NEG."""
    a = attacks.withColumn("rule", F.expr(RULE))
    other = a.select(F.col("attack_idx").alias("o"), F.col("family").alias("f"), F.col("arm").alias("r"), F.col("tier").alias("t"))
    near = a.join(F.broadcast(other), (F.col("attack_idx") != F.col("o")) & (F.col("family") == F.col("f")) & (F.col("arm") == F.col("r")), "left")
    first = near.groupBy("attack_id", "tier", "rule").agg(F.min_by("t", "o").alias("fallback"))
    return first.select("attack_id", "tier", F.coalesce("rule", "fallback", F.lit("NEG")).alias("predicted")).withColumn("correct", F.col("tier") == F.col("predicted"))


def rule_predictor_loo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rule_predictions(measured(spark, sf_dir))


def confusion_macro_f1_kappa(spark: SparkSession, sf_dir: str) -> DataFrame:
    votes = measured_votes(spark, sf_dir).join(F.broadcast(measured(spark, sf_dir).select("attack_idx", "tier")), "attack_idx")
    out = evaluation.agreement(votes, "tier", "predicted", "model")
    return out.select("model", "n", *[F.round(c, 6).alias(c) for c in ("accuracy", "macro_f1", "balanced_accuracy", "kappa")])


def mcnemar_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Character against word perturbations, claim by claim, of each domain's claims and of all."""
    hits = verified(spark, sf_dir).filter("NOT baseline_failed AND family IN ('Char', 'Word')").groupBy("row_id", "domain").agg(*[F.coalesce(F.bool_or(F.when(F.col("family") == f, F.col("gated_flip"))), F.lit(False)).alias(f.lower()) for f in ("Char", "Word")])
    b, c = F.count_if(F.col("char") & ~F.col("word")).alias("b"), F.count_if(~F.col("char") & F.col("word")).alias("c")
    each = hits.groupBy(F.col("domain").alias("part")).agg(b, c)
    both = each.unionByName(each.agg(F.lit("all").alias("part"), F.coalesce(F.sum("b"), F.lit(0)).alias("b"), F.coalesce(F.sum("c"), F.lit(0)).alias("c")))
    chi2 = stats.mcnemar_chi2(F.col("b"), F.col("c"))
    return both.select("part", "b", "c", F.round(stats.mcnemar_exact(F.col("b"), F.col("c")), 6).alias("p_exact"), F.round(chi2, 6).alias("chi2"), F.round(tails.chi2_tail(chi2, 1), 6).alias("p_chi2"))


def fisher_enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Domains whose claims are flipped more often than chance allows."""
    claims = verified(spark, sf_dir).filter("NOT baseline_failed").groupBy("row_id", "domain").agg(F.bool_or("gated_flip").alias("hit"))
    each = claims.groupBy("domain").agg(F.count_if("hit").alias("k"), F.count(F.lit(1)).alias("n"))
    total = each.agg(F.sum("k").alias("all_k"), F.sum("n").alias("all_n"))
    return evaluation.fisher_greater(each.join(F.broadcast(total)), 5).select("domain", "k", "n", F.round("p", 5).alias("p"), F.round("p_bonferroni", 5).alias("p_bonferroni"))


def paired_t_arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of flips by rules against that by models, over domains."""
    rate = lambda arm: F.avg(F.when(F.col("arm") == arm, F.col("gated_flip").cast("double"))).alias(arm.lower())
    each = verified(spark, sf_dir).filter("NOT baseline_failed").groupBy("domain").agg(rate("Rule"), rate("LLM"))
    return evaluation.paired_t(each, "rule", "llm").select("n", F.round("mean_difference", 6).alias("mean_difference"), F.round("t", 4).alias("t"), F.round("p", 6).alias("p"))


#: Words that parts' types stand for, so that each rule of the cascade applies to some.
STAND_INS = {"promo": "multi-hop", "economy": "gradient", "standard": "retrieval", "small": "keyboard"}


def unmeasured_rule_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts stand in for perturbations nobody measured, ranked by the probability that an ordered cascade on their names gives."""
    name = F.lower(F.concat_ws(" ", "p_type", "p_name"))
    for word, meant in STAND_INS.items():
        name = F.replace(name, F.lit(word), F.lit(meant))
    rated = evaluation.unmeasured(tables.read(spark, sf_dir, "part").select("p_partkey", name.alias("name")), "name")
    return evaluation.ranked(rated, "probability", "p_partkey").select("rank", "p_partkey", "tier", "probability", "scope", "priority")


def empirical_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tiers that the outcomes show."""
    return measured(spark, sf_dir).select("attack_id", "tier")


def event_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The streaming extension's aggregation over the events as a table."""
    return windowed_rates(tables.read(spark, sf_dir, "events"), "1 day")


QUERIES = {
    f.__name__: f
    for f in (auroc_auprc_by_attack, tier_prediction_leaderboard, rule_predictor_loo, confusion_macro_f1_kappa, mcnemar_families, fisher_enrichment, paired_t_arms, unmeasured_rule_ranking, empirical_tiers, event_rates)
}

#: Twice the upper tail of the normal distribution, and Student's two tails by the angle whose tangent is t / sqrt(v): integrals by Simpson's rule.
SIMPSON = "CASE WHEN i IN (0, 4000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END"
CHI2_SQL = f"(SELECT sum({SIMPSON} * exp(-0.5 * pow(sqrt(chi2) + i * 0.003, 2))) * 0.001 * 2 / sqrt(2 * pi()) FROM range(4001) g(i))"
STUDENT_SQL = f"""(SELECT 2 * exp(lgamma((v + 1) / 2) - lgamma(v / 2)) / sqrt(pi()) * sum({SIMPSON} * pow(greatest(0, cos(angle + i * (pi() / 2 - angle) / 4000)), v - 1)) * (pi() / 2 - angle) / 12000 FROM range(4001) g(i))"""

LF = "lf AS (SELECT 0 AS x, 0.0::DOUBLE AS v UNION ALL SELECT i, sum(ln(i)) OVER (ORDER BY i) FROM range(1, 400001) r(i))"

ORACLES = {
    "event_rates": """SELECT time_bucket(INTERVAL 1 day, ts) AS start, event_type, count(*) AS n, round(count(*) FILTER (value >= 50) / count(*), 6) AS rate FROM events GROUP BY ALL""",
    "auroc_auprc_by_attack": with_ctes(CTE_VERIFIED, "s AS (SELECT attack_id, fluency AS s, count(*) FILTER (flipped) AS p, count(*) FILTER (NOT flipped) AS q FROM verified WHERE NOT baseline_failed AND verdict IS NOT NULL GROUP BY ALL)",
        "r AS (SELECT *, sum(p) OVER w AS tp, sum(q) OVER w AS fp FROM s WINDOW w AS (PARTITION BY attack_id ORDER BY s DESC))",
        "t AS (SELECT attack_id, CAST(sum(p) AS BIGINT) AS hits, CAST(sum(q) AS BIGINT) AS misses, sum(q * (tp - p / 2)) AS wins, sum(p * tp / (tp + fp)) AS area FROM r GROUP BY attack_id)",
        then="""SELECT attack_id, hits, misses, round(CASE WHEN hits = 0 OR misses = 0 THEN 0.5 ELSE wins / (hits * misses) END, 6) AS auroc,
        round(CASE WHEN hits = 0 OR misses = 0 THEN hits / (hits + misses) ELSE area / hits END, 6) AS auprc FROM t"""),
    "tier_prediction_leaderboard": with_ctes(CTE_VERIFIED, CTE_MEASURED, "m AS (SELECT attack_idx, 'consensus' AS model, predicted FROM ballots GROUP BY attack_idx, predicted QUALIFY row_number() OVER (PARTITION BY attack_idx ORDER BY count(*) DESC, predicted) = 1)",
        "e AS (SELECT * FROM ballots UNION ALL SELECT * FROM m)", then="SELECT model, count(*) FILTER (predicted = tier) AS correct, count(*) AS n, round(100.0 * count(*) FILTER (predicted = tier) / count(*), 2) AS accuracy_pct FROM e JOIN measured USING (attack_idx) GROUP BY model"),
    "rule_predictor_loo": with_ctes(CTE_VERIFIED, CTE_MEASURED, f"a AS (SELECT *, {RULE} AS rule FROM measured)",
        "p AS (SELECT attack_id, tier, coalesce(rule, (SELECT arg_min(b.tier, b.attack_idx) FROM measured b WHERE b.attack_idx <> a.attack_idx AND b.family = a.family AND b.arm = a.arm), 'NEG') AS predicted FROM a)",
        then="SELECT *, tier = predicted AS correct FROM p"),
    "confusion_macro_f1_kappa": with_ctes(CTE_VERIFIED, CTE_MEASURED, "v AS (SELECT model, tier, predicted FROM ballots JOIN measured USING (attack_idx))",
        "l AS (SELECT DISTINCT model, x AS label FROM (SELECT model, tier AS x FROM v UNION ALL SELECT model, predicted FROM v))",
        """c AS (SELECT l.model, label, count(*) FILTER (tier = label) AS support, count(*) FILTER (predicted = label) AS guesses, count(*) FILTER (tier = label AND predicted = label) AS hits
            FROM l JOIN v USING (model) GROUP BY ALL)""",
        """t AS (SELECT model, CAST(sum(support) AS BIGINT) AS n, sum(hits) / sum(support) AS accuracy, avg(2 * hits / (support + guesses)) AS macro_f1, avg(hits / nullif(support, 0)) AS balanced_accuracy,
            sum(support * guesses) / (sum(support) * sum(support)) AS chance FROM c GROUP BY model)""",
        then="SELECT model, n, round(accuracy, 6) AS accuracy, round(macro_f1, 6) AS macro_f1, round(balanced_accuracy, 6) AS balanced_accuracy, round((accuracy - chance) / (1 - chance), 6) AS kappa FROM t"),
    "mcnemar_families": with_ctes(CTE_VERIFIED, LF, "h AS (SELECT row_id, domain, coalesce(bool_or(gated_flip) FILTER (family = 'Char'), FALSE) AS ch, coalesce(bool_or(gated_flip) FILTER (family = 'Word'), FALSE) AS wo FROM verified WHERE NOT baseline_failed AND family IN ('Char', 'Word') GROUP BY row_id, domain)",
        "d AS (SELECT domain AS part, count(*) FILTER (ch AND NOT wo) AS b, count(*) FILTER (wo AND NOT ch) AS c FROM h GROUP BY domain UNION ALL SELECT 'all', count(*) FILTER (ch AND NOT wo), count(*) FILTER (wo AND NOT ch) FROM h)",
        "x AS (SELECT part, unnest(range(least(b, c) + 1)) AS i, b + c AS n FROM d)",
        "p AS (SELECT part, sum(exp(ln.v - li.v - lr.v - n * ln(2.0))) AS tail FROM x JOIN lf ln ON ln.x = n JOIN lf li ON li.x = i JOIN lf lr ON lr.x = n - i GROUP BY part)",
        then="SELECT part, b, c, round(CASE WHEN b + c = 0 THEN 1.0 ELSE least(1.0, 2 * tail) END, 6) AS p_exact, round(chi2, 6) AS chi2, round(CASE WHEN chi2 IS NOT NULL THEN " + CHI2_SQL + " END, 6) AS p_chi2 FROM (SELECT *, pow(abs(b - c) - 1, 2) / nullif(b + c, 0) AS chi2 FROM d JOIN p USING (part))"),
    "fisher_enrichment": with_ctes(CTE_VERIFIED, LF, "c AS (SELECT row_id, domain, bool_or(gated_flip) AS hit FROM verified WHERE NOT baseline_failed GROUP BY ALL)", "e AS (SELECT domain, count(*) FILTER (hit) AS k, count(*) AS n FROM c GROUP BY domain)",
        "t AS (SELECT CAST(sum(k) AS BIGINT) AS kk, CAST(sum(n) AS BIGINT) AS nn FROM e)", "x AS (SELECT domain, k, n, kk, nn, unnest(range(k, least(n, kk) + 1)) AS i FROM e, t)",
        """p AS (SELECT domain, k, n, sum(exp(a.v - b.v - c2.v + d.v - e2.v - f.v - (g.v - h.v - m.v))) AS p FROM x
            JOIN lf a ON a.x = kk JOIN lf b ON b.x = i JOIN lf c2 ON c2.x = kk - i JOIN lf d ON d.x = nn - kk JOIN lf e2 ON e2.x = n - i JOIN lf f ON f.x = nn - kk - n + i
            JOIN lf g ON g.x = nn JOIN lf h ON h.x = n JOIN lf m ON m.x = nn - n GROUP BY domain, k, n)""",
        then="SELECT domain, k, n, round(least(1.0, p), 5) AS p, round(least(1.0, least(1.0, p) * 5), 5) AS p_bonferroni FROM p"),
    "paired_t_arms": with_ctes(CTE_VERIFIED, "d AS (SELECT domain, avg(CAST(gated_flip AS INT)) FILTER (arm = 'Rule') - avg(CAST(gated_flip AS INT)) FILTER (arm = 'LLM') AS x FROM verified WHERE NOT baseline_failed GROUP BY domain)",
        "m AS (SELECT count(*) AS n, avg(x) AS mean_difference, avg(x) * sqrt(count(*)) / stddev_samp(x) AS t, count(*) - 1 AS v FROM d)",
        then=f"SELECT n, round(mean_difference, 6) AS mean_difference, round(t, 4) AS t, round(CASE WHEN t IS NOT NULL THEN {STUDENT_SQL} END, 6) AS p FROM (SELECT *, atan(abs(t) / sqrt(v)) AS angle FROM m)"),
    "unmeasured_rule_ranking": f"""WITH n AS (SELECT p_partkey, {reduce(lambda x, w: f"replace({x}, '{w[0]}', '{w[1]}')", STAND_INS.items(), "lower(p_type || ' ' || p_name)")} AS name FROM part),
        k AS (SELECT p_partkey, CASE WHEN regexp_matches(name, 'hop') THEN 1 WHEN regexp_matches(name, 'gradient|hotflip|embedding') THEN 2
            WHEN regexp_matches(name, 'evidence|retrieval|corpus') THEN 3 WHEN regexp_matches(name, 'char|keyboard|visual') THEN 4 ELSE 5 END AS rule FROM n),
        r(rule, tier, probability, scope, priority) AS (VALUES (1, 'MID', 0.35::DOUBLE, 'untestable', 'Medium'), (2, 'POS', 0.70::DOUBLE, 'untestable', 'Low'), (3, 'POS', 0.58::DOUBLE, 'testable', 'High'), (4, 'NEG', 0.03::DOUBLE, 'testable', 'Low'), (5, 'MID', 0.22::DOUBLE, 'testable', 'Medium'))
        SELECT row_number() OVER (ORDER BY probability DESC, p_partkey) AS rank, p_partkey, tier, probability, scope, priority FROM k JOIN r USING (rule)""",
    "empirical_tiers": with_ctes(CTE_VERIFIED, CTE_MEASURED, then="SELECT attack_id, tier FROM measured"),
}
