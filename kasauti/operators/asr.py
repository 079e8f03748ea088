"""Verification, gating and success rates over claim x perturbation outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import ratio
from ..functions.verdicts import decide, gate


def verify(outcomes: DataFrame, attacks: DataFrame) -> DataFrame:
    """Outcomes with reason, flipped, gate_reason (of flips alone), excluded and gated_flip."""
    dim = F.broadcast(attacks.select("attack_idx", "attack_id", "family", "arm", "tier", "gate_mode", "gated_asr_pct"))
    reason = decide(F.col("baseline_failed"), F.col("verdict"), F.col("gold_label"))
    judged = outcomes.join(dim, "attack_idx").withColumn("reason", reason).withColumn("flipped", F.col("reason") == "flip")
    judged = judged.withColumn("gate_reason", F.when(F.col("flipped"), gate(F.col("gate_mode"), F.col("fluency"), F.col("meaning_preserved"))))
    return judged.withColumn("excluded", F.coalesce(F.col("flipped") & (F.col("gate_reason") != "pass"), F.lit(False))).withColumn("gated_flip", F.col("flipped") & ~F.col("excluded"))


def eligible() -> Column:
    return F.col("reason").isin("flip", "no_flip")


def success_rates(verified: DataFrame, *keys: str) -> DataFrame:
    """Raw and gated success rate of each group; null where nothing was eligible."""
    ok, lost = eligible(), F.col("excluded")
    counts = verified.groupBy(*keys).agg(
        F.count_if(ok).alias("eligible"),
        F.count_if("flipped").alias("flips_raw"),
        F.count_if(ok & ~lost).alias("gated_eligible"),
        F.count_if("gated_flip").alias("flips_gated"),
        F.count_if(lost).alias("excluded"),
    )
    return counts.withColumn("raw_asr", ratio(F.col("flips_raw"), F.col("eligible"))).withColumn("gated_asr", ratio(F.col("flips_gated"), F.col("gated_eligible")))


def valid_claims(verified: DataFrame) -> DataFrame:
    """row_id of the claims that the verifier had right without a perturbation."""
    return verified.filter(~F.col("baseline_failed")).select("row_id").distinct()
