"""Queries that replay selection policies, with their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ablation, policies, reinforce
from ..operators.sampling import exact_bootstrap, split_60_20_20
from ..sources import tables
from ..sources.fixed import STATIC_TOP5
from ..sources.tables import CTE_VERIFIED, with_ctes
from .verification import verified

SEEDS = (1, 2, 3)


def policy_static_top5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policies.summary(policies.replay(verified(spark, sf_dir), policies.fixed_list(spark, STATIC_TOP5)), "Static-Top5", 5)


def policy_random5_md5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policies.summary(policies.replay_drawn(verified(spark, sf_dir), [1], 5), "Random-5", 5)


def policy_oracle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policies.summary(policies.any_flip(verified(spark, sf_dir)), "Oracle-22", 22)


def policy_top2_plus_random(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policies.summary(policies.first_then(verified(spark, sf_dir), STATIC_TOP5[:2], 1, 5), "Top2+Random", 5)


def _mixed(sure: Column, k: Column) -> Column:
    """Chance that two fixed perturbations, or three drawn from the other twenty, flip a claim that ``k`` of these flip."""
    rest = F.lit(20) - k
    return F.when(sure, 1.0).otherwise(1.0 - F.greatest(F.lit(0), rest * (rest - 1) * (rest - 2)) / F.lit(20.0 * 19.0 * 18.0))


def claim_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five fixed perturbations against two fixed and three random ones: the gap over claims and its percentile interval, of 10,000 exact resamples of the claims."""
    seen, two = verified(spark, sf_dir).filter("NOT baseline_failed"), F.col("attack_idx").isin(STATIC_TOP5[:2])
    five = F.max((F.col("gated_flip") & F.col("attack_idx").isin(STATIC_TOP5)).cast("double"))
    each = seen.groupBy("row_id").agg(five.alias("fixed"), F.bool_or(F.col("gated_flip") & two).alias("sure"), F.count_if(F.col("gated_flip") & ~two).alias("k"))
    values = each.select("fixed", _mixed(F.col("sure"), F.col("k")).alias("mixed"))
    told = values.agg(F.count(F.lit(1)).alias("claims"), *[F.round(100 * F.avg(c), 6).alias(f"{c}_pct") for c in ("fixed", "mixed")])
    gap = 100 * (F.col("fixed") - F.col("mixed"))
    drawn = exact_bootstrap(values, ["fixed", "mixed"]).agg(F.count(F.lit(1)).alias("draws"), *[F.round(F.percentile(gap, F.lit(q)), 6).alias(c) for q, c in ((0.025, "ci_low"), (0.975, "ci_high"))], F.round(F.avg(gap), 6).alias("mean_gap"))
    return told.withColumn("one", F.lit(1)).join(F.broadcast(drawn.withColumn("one", F.lit(1))), "one").drop("one")


def hypergeometric_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected success of two fixed and three random perturbations, in closed form from each claim's number of flips."""
    seen = verified(spark, sf_dir).filter("NOT baseline_failed")
    top = F.col("attack_idx").isin(STATIC_TOP5[:2])
    each = seen.groupBy("row_id").agg(F.bool_or(F.col("gated_flip") & top).alias("sure"), F.count_if(F.col("gated_flip") & ~top).alias("k"))
    return each.groupBy("k").agg(F.count(F.lit(1)).alias("claims"), F.round(F.avg(_mixed(F.col("sure"), F.col("k"))), 6).alias("expected"))


def _flips(spark: SparkSession, sf_dir: str, split: str | None = None) -> DataFrame:
    seen = verified(spark, sf_dir).filter("NOT baseline_failed")
    if split:
        claims = split_60_20_20(seen.select("row_id").distinct()).filter(F.col("split") == split)
        seen = seen.join(claims.select("row_id"), "row_id", "left_semi")
    return seen.filter("gated_flip").select("row_id", "attack_idx")


def greedy_coverage_top5(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = policies.greedy_coverage(_flips(spark, sf_dir, "train"))
    return policies.fixed_list(spark, chosen)


def blind_spots_and_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims that some perturbation flips but none of the static five, and how many of them others find."""
    seen = verified(spark, sf_dir).filter("NOT baseline_failed")
    each = policies.first_then(seen, STATIC_TOP5[:2], 1, 5).select("row_id", F.col("first_step").isNotNull().alias("mixed"))
    random = policies.replay_drawn(seen, [1], 5).select("row_id", F.col("first_step").isNotNull().alias("random"))
    base = seen.groupBy("row_id").agg(F.bool_or("gated_flip").alias("any"), F.bool_or(F.col("gated_flip") & F.col("attack_idx").isin(STATIC_TOP5)).alias("top5"))
    blind = base.filter(F.col("any") & ~F.col("top5")).join(each, "row_id").join(random, "row_id")
    n = F.nullif(F.count(F.lit(1)), F.lit(0))
    return blind.agg(F.count(F.lit(1)).alias("blind_spots"), F.count_if("mixed").alias("found_by_mixed"), F.count_if("random").alias("found_by_random"), F.round(F.count_if("random") / n, 6).alias("random_recall"))


def discovery_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = policies.replay(verified(spark, sf_dir), policies.fixed_list(spark, STATIC_TOP5))
    ks = first.select("first_step", F.explode(F.sequence(F.lit(1), F.lit(5))).alias("k"))
    out = ks.groupBy("k").agg(F.count(F.lit(1)).alias("claims"), F.count_if(F.col("first_step") <= F.col("k")).alias("found"), F.avg(F.least(F.coalesce("first_step", "k"), "k")).alias("queries"))
    return out.select("k", "claims", "found", F.round(F.col("found") / F.col("claims"), 6).alias("discovery"), F.round("queries", 6).alias("mean_queries"))


def episode_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = verified(spark, sf_dir).filter("NOT baseline_failed").select("row_id", "attack_idx", "gated_flip")
    tried = seen.join(F.broadcast(policies.fixed_list(spark, STATIC_TOP5)), "attack_idx").withColumn("reward", policies.reward(F.col("gated_flip"), F.col("attack_idx")))
    back = policies.discounted_returns(tried, ["row_id"])
    return back.groupBy("step").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("reward"), 6).alias("mean_reward"), F.round(F.avg("back"), 6).alias("mean_return"))


def policy_table_mean_sd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Random-5 and Top2+Random over seeds: mean, population and sample deviation of success."""
    seen = verified(spark, sf_dir)
    methods = {"Random-5": [], "Top2+Random": STATIC_TOP5[:2]}
    runs = reduce(DataFrame.unionByName, [policies.summary(policies.replay_drawn(seen, list(SEEDS), 5, after), name, 5, "seed") for name, after in methods.items()])
    rate = F.col("success_rate_pct")
    return runs.groupBy("method").agg(F.count(F.lit(1)).alias("seeds"), F.round(F.avg(rate), 5).alias("mean_pct"), F.round(F.stddev_pop(rate), 5).alias("sd_pop"), F.round(F.stddev_samp(rate), 5).alias("sd_samp"), F.round(F.avg((22 - F.col("mean_calls")) / 22), 5).alias("call_reduction"))


def ucb_bandit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policies.ucb_bandit(verified(spark, sf_dir))


def reinforce_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reinforce.reinforce(verified(spark, sf_dir))


def hybrid_auditor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two fixed perturbations, then the learned policy."""
    return reinforce.reinforce(verified(spark, sf_dir), warm=STATIC_TOP5[:2])


def ablation_suite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learned policies with and without graph nodes, price, exploration and failed claims."""
    vectors = tables.read(spark, sf_dir, "embeddings").groupBy(F.col("vec_id").alias("row_id")).agg(F.min("embedding").alias("vector"))
    return ablation.suite(verified(spark, sf_dir), vectors, tables.attacks(spark))


QUERIES = {
    f.__name__: f
    for f in (
        policy_static_top5, policy_random5_md5, policy_oracle, policy_top2_plus_random, claim_bootstrap, hypergeometric_coverage, greedy_coverage_top5, blind_spots_and_recall, discovery_at_k,
        episode_returns, policy_table_mean_sd, ucb_bandit, reinforce_policy, hybrid_auditor, ablation_suite,
    )
}

TOP5 = ", ".join(f"({a}, {n})" for n, a in enumerate(STATIC_TOP5, 1))
SEEN = "seen AS (SELECT row_id, attack_idx, gated_flip FROM verified WHERE NOT baseline_failed)"
FIXED = f"steps(attack_idx, step) AS (VALUES {TOP5})"
FIRST_FIXED = "first AS (SELECT row_id, min(step) FILTER (gated_flip) AS first_step FROM seen LEFT JOIN steps USING (attack_idx) GROUP BY row_id)"


def hashed_first(name: str, seed: int, after: list[int], budget: int = 5) -> str:
    """CTE ``name``: first_step of ``after`` and then hashed perturbations."""
    fixed = ", ".join(map(str, after)) or "-1"
    place = "CASE attack_idx " + " ".join(f"WHEN {a} THEN {n}" for n, a in enumerate(after, 1)) + " ELSE NULL END" if after else "NULL"
    return f"""{name}_steps AS (SELECT row_id, CAST(a AS INT) AS attack_idx, {len(after)} + row_number() OVER (PARTITION BY row_id ORDER BY md5('{seed}:' || row_id || ':' || a), a) AS step
        FROM (SELECT DISTINCT row_id FROM seen), range(22) r(a) WHERE a NOT IN ({fixed}) QUALIFY step <= {budget}),
    {name} AS (SELECT row_id, min(coalesce({place}, step)) FILTER (gated_flip) AS first_step FROM seen LEFT JOIN {name}_steps USING (row_id, attack_idx) GROUP BY row_id)"""


def summary_sql(source: str, method: str, budget: int) -> str:
    return f"""SELECT '{method}' AS method, {budget} AS budget, count(*) AS total_claims, count(first_step) AS claims_with_flip, round(100.0 * count(first_step) / nullif(count(*), 0), 6) AS success_rate_pct,
        round(coalesce(median(first_step), 0.0), 6) AS median_steps, round(coalesce(avg(first_step), 0.0), 6) AS mean_steps, round(avg(coalesce(first_step, {budget})), 6) AS mean_calls FROM {source}"""


def greedy_sql(rounds: int = 5) -> str:
    parts = [f"train AS (SELECT row_id FROM (SELECT row_id, row_number() OVER (ORDER BY md5('42:' || row_id || ':split'), row_id) AS nth, count(*) OVER () AS total FROM (SELECT DISTINCT row_id FROM seen)) WHERE nth <= floor(total * 6 / 10))"]
    parts.append("f0 AS (SELECT row_id, attack_idx FROM seen JOIN train USING (row_id) WHERE gated_flip)")
    for n in range(1, rounds + 1):
        parts.append(f"b{n} AS (SELECT attack_idx FROM f{n - 1} GROUP BY attack_idx ORDER BY count(*) DESC, attack_idx LIMIT 1)")
        parts.append(f"f{n} AS (SELECT * FROM f{n - 1} WHERE row_id NOT IN (SELECT row_id FROM f{n - 1} WHERE attack_idx = (SELECT attack_idx FROM b{n})))")
    return ", ".join(parts)


ORACLES = {
    "policy_static_top5": with_ctes(CTE_VERIFIED, SEEN, FIXED, FIRST_FIXED, then=summary_sql("first", "Static-Top5", 5)),
    "policy_random5_md5": with_ctes(CTE_VERIFIED, SEEN, hashed_first("first", 1, []), then=summary_sql("first", "Random-5", 5)),
    "policy_oracle": with_ctes(CTE_VERIFIED, SEEN, "first AS (SELECT row_id, 1 + min(attack_idx) FILTER (gated_flip) AS first_step FROM seen GROUP BY row_id)", then=summary_sql("first", "Oracle-22", 22)),
    "policy_top2_plus_random": with_ctes(CTE_VERIFIED, SEEN, hashed_first("first", 1, STATIC_TOP5[:2]), then=summary_sql("first", "Top2+Random", 5)),
    "hypergeometric_coverage": with_ctes(CTE_VERIFIED, SEEN, f"c AS (SELECT row_id, bool_or(gated_flip AND attack_idx IN {tuple(STATIC_TOP5[:2])}) AS sure, count(*) FILTER (gated_flip AND attack_idx NOT IN {tuple(STATIC_TOP5[:2])}) AS k FROM seen GROUP BY row_id)",
        then="SELECT k, count(*) AS claims, round(avg(CASE WHEN sure THEN 1.0 ELSE CAST(1.0 - greatest(0, (20 - k) * (19 - k) * (18 - k)) / 6840.0 AS DOUBLE) END), 6) AS expected FROM c GROUP BY k"),
    "greedy_coverage_top5": with_ctes(CTE_VERIFIED, SEEN, greedy_sql(), then=" UNION ALL ".join(f"SELECT attack_idx, {n} AS step FROM b{n}" for n in range(1, 6))),
    "blind_spots_and_recall": with_ctes(CTE_VERIFIED, SEEN, hashed_first("mixed", 1, STATIC_TOP5[:2]), hashed_first("random", 1, []),
        f"base AS (SELECT row_id, bool_or(gated_flip) AS hit, bool_or(gated_flip AND attack_idx IN {tuple(STATIC_TOP5)}) AS top5 FROM seen GROUP BY row_id)",
        then="""SELECT count(*) AS blind_spots, count(mixed.first_step) AS found_by_mixed, count(random.first_step) AS found_by_random, round(count(random.first_step) / nullif(count(*), 0), 6) AS random_recall
        FROM base JOIN mixed USING (row_id) JOIN random USING (row_id) WHERE hit AND NOT top5"""),
    "discovery_at_k": with_ctes(CTE_VERIFIED, SEEN, FIXED, FIRST_FIXED, then="""SELECT CAST(k AS INT) AS k, count(*) AS claims, count(*) FILTER (first_step <= k) AS found, round(count(*) FILTER (first_step <= k) / count(*), 6) AS discovery,
        round(avg(least(coalesce(first_step, k), k)), 6) AS mean_queries FROM first, range(1, 6) r(k) GROUP BY k"""),
    "episode_returns": with_ctes(CTE_VERIFIED, SEEN, FIXED, f"r AS (SELECT row_id, step, -0.05::DOUBLE + CASE WHEN gated_flip THEN 1.0::DOUBLE + CASE WHEN attack_idx IN {tuple(policies.STRONG)} THEN 0.5 ELSE 0.0 END ELSE 0.0 END AS reward FROM seen JOIN steps USING (attack_idx))",
        "b AS (SELECT *, sum(reward * pow(0.99, step)) OVER (PARTITION BY row_id ORDER BY step ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) / pow(0.99, step) AS back FROM r)",
        then="SELECT step, count(*) AS n, round(avg(reward), 6) AS mean_reward, round(avg(back), 6) AS mean_return FROM b GROUP BY step"),
    "policy_table_mean_sd": with_ctes(CTE_VERIFIED, SEEN, *[hashed_first(f"{n}{s}", s, after) for s in SEEDS for n, after in (("r", []), ("m", STATIC_TOP5[:2]))],
        "runs AS (" + " UNION ALL ".join(summary_sql(f"{n}{s}", m, 5) for s in SEEDS for n, m in (("r", "Random-5"), ("m", "Top2+Random"))) + ")",
        then="""SELECT method, count(*) AS seeds, round(avg(success_rate_pct), 5) AS mean_pct, round(stddev_pop(success_rate_pct), 5) AS sd_pop, round(stddev_samp(success_rate_pct), 5) AS sd_samp,
        round(avg((22 - mean_calls) / 22), 5) AS call_reduction FROM runs GROUP BY method"""),
}
