"""Queries over verdicts, gates and success rates, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text, verdicts
from ..functions.stats import ratio, wilson, wilson_sql
from ..operators.asr import success_rates, valid_claims, verify
from ..sources import tables
from ..sources.fixed import INJECTED_SEPARATOR
from ..sources.tables import CTE_CLAIMS, CTE_VERIFIED, with_ctes

TIER_SQL = "CASE WHEN {x} >= 0.40 THEN 'POS' WHEN {x} >= 0.15 THEN 'MID' ELSE 'NEG' END"
RATE_SQL = "coalesce(count(*) FILTER (gated_flip)::DOUBLE / nullif(count(*) FILTER (reason IN ('flip', 'no_flip') AND NOT excluded), 0), 0.0)"
#: After the verified outcomes: ``measured`` as the perturbations and ``ballots`` as the votes.
CTE_MEASURED = f"""rated AS (SELECT attack_idx, {RATE_SQL} AS rate FROM verified GROUP BY attack_idx),
    measured AS (SELECT a.attack_idx, a.attack_id, a.family, a.arm, a.injected, 100.0::DOUBLE * rate AS gated_asr_pct, {TIER_SQL.format(x='rate')} AS tier FROM attacks a JOIN rated USING (attack_idx)),
    ballots AS (SELECT attack_idx, domain AS model, {TIER_SQL.format(x=RATE_SQL)} AS predicted FROM verified GROUP BY attack_idx, domain)"""


def verified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify(tables.outcomes(spark, sf_dir), tables.attacks(spark))


def measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The perturbations with the gated rate and tier that the outcomes show in place of the published ones."""
    rate = F.coalesce("gated_asr", F.lit(0.0))
    rates = success_rates(verified(spark, sf_dir), "attack_idx").select("attack_idx", (100.0 * rate).alias("gated_asr_pct"), verdicts.tier(rate).alias("tier"))
    return tables.attacks(spark).drop("gated_asr_pct", "tier").join(rates, "attack_idx")


def measured_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """attack_idx, model and predicted: each domain's outcomes stand for a model that foretells a tier by its own rate."""
    rates = success_rates(verified(spark, sf_dir), "attack_idx", "domain")
    return rates.select("attack_idx", F.col("domain").alias("model"), verdicts.tier(F.coalesce("gated_asr", F.lit(0.0))).alias("predicted"))


def six(column: str) -> Column:
    return F.round(column, 6).alias(column)


def asr_by_attack(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates = success_rates(verified(spark, sf_dir), "attack_id")
    tier = verdicts.tier(F.col("gated_asr")).alias("empirical_tier")
    return rates.select("attack_id", "eligible", "flips_raw", "gated_eligible", "flips_gated", "excluded", six("raw_asr"), six("gated_asr"), tier)


def decide_reason_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verified(spark, sf_dir).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def gate_reason_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verified(spark, sf_dir).filter("flipped").groupBy("gate_mode", "gate_reason").agg(F.count(F.lit(1)).alias("n"))


def baseline_accuracy_by_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    claims = tables.outcomes(spark, sf_dir).groupBy("row_id", "domain").agg(F.bool_or("baseline_failed").alias("failed"))
    out = claims.groupBy("domain").agg(F.count(F.lit(1)).alias("claims"), F.count_if(~F.col("failed")).alias("correct"))
    k, n = F.col("correct"), F.col("claims")
    return out.select("domain", "claims", "correct", F.round(ratio(k, n), 6).alias("accuracy"), F.round(wilson(k, n, "lo"), 6).alias("ci_low"), F.round(wilson(k, n, "hi"), 6).alias("ci_high"))


def unconditional_asr_wilson(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = verified(spark, sf_dir)
    total = valid_claims(seen).agg(F.count(F.lit(1)).alias("claims"))
    flips = seen.groupBy("attack_id").agg(F.count_if("gated_flip").alias("flips"))
    out = flips.join(F.broadcast(total))
    k, n = F.col("flips"), F.col("claims")
    return out.select("attack_id", "flips", "claims", F.round(ratio(k, n), 6).alias("asr"), F.round(wilson(k, n, "lo"), 6).alias("ci_low"), F.round(wilson(k, n, "hi"), 6).alias("ci_high"))


def family_asr(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = verified(spark, sf_dir).filter(~F.col("baseline_failed"))
    by_claim = seen.groupBy("row_id", "family").agg(F.bool_or("gated_flip").alias("hit"))
    return by_claim.groupBy("family").agg(F.count(F.lit(1)).alias("claims"), F.count_if("hit").alias("flipped")).select("family", "claims", "flipped", F.round(F.col("flipped") / F.col("claims"), 6).alias("asr"))


def gold_verdict_transition(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = tables.outcomes(spark, sf_dir).withColumn("verdict", F.coalesce("verdict", F.lit("NONE")))
    wide = seen.groupBy("gold_label").pivot("verdict", ["SUP", "REF", "NEI", "NONE"]).count().na.fill(0)
    return wide.select("gold_label", *[F.col(c).alias(f"to_{c.lower()}") for c in ("SUP", "REF", "NEI", "NONE")])


def robust_accuracy_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.orderBy(F.desc("gated_asr_pct"), "attack_idx")
    ranks = tables.attacks(spark).select("attack_idx", F.row_number().over(order).alias("strength"))
    seen = verified(spark, sf_dir).filter(~F.col("baseline_failed")).join(F.broadcast(ranks), "attack_idx")
    first = seen.groupBy("row_id").agg(F.min(F.when(F.col("gated_flip"), F.col("strength"))).alias("first_flip"))
    ks = first.select("first_flip", F.explode(F.array(*[F.lit(k) for k in (1, 2, 5, 22)])).alias("k"))
    out = ks.groupBy("k").agg(F.count(F.lit(1)).alias("claims"), F.count_if(F.coalesce(F.col("first_flip") > F.col("k"), F.lit(True))).alias("unflipped"))
    return out.select("k", "claims", "unflipped", F.round(F.col("unflipped") / F.col("claims"), 6).alias("robust_accuracy"))


def transfer_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 200 gated flips of each perturbation, confirmed where meaning is kept and fluency is 4 or more."""
    rank = F.row_number().over(Window.partitionBy("attack_id").orderBy("row_id"))
    audited = verified(spark, sf_dir).filter("gated_flip").withColumn("nth", rank).filter("nth <= 200")
    out = audited.groupBy("attack_id").agg(F.count(F.lit(1)).alias("audited"), F.count_if(F.col("meaning_preserved") & (F.col("fluency") >= 4)).alias("confirmed"))
    return out.select("attack_id", "audited", "confirmed", F.round(ratio(F.col("confirmed"), F.col("audited")), 6).alias("transfer_asr"))


def reciprocal_pilot(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = verified(spark, sf_dir).filter("NOT baseline_failed").groupBy("arm").agg(F.count(F.lit(1)).alias("n"), F.count_if("flipped").alias("raw_flips"), F.count_if("gated_flip").alias("gated_flips"), F.avg("fluency").alias("mean_fluency"))
    return out.select("arm", "n", "raw_flips", "gated_flips", six("mean_fluency"))


def parse_label_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = tables.read(spark, sf_dir, "conversations").select("role", F.coalesce(verdicts.parse_label(F.col("text")), F.lit("NONE")).alias("parsed"))
    return told.groupBy("role", "parsed").agg(F.count(F.lit(1)).alias("n"))


def _replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    reply = (
        F.when(k % 4 == 0, F.concat(F.lit('{"fluency": '), (k % 6).cast("string"), F.lit(', "meaning_preserved": true}')))
        .when(k % 4 == 1, F.concat(F.lit('Sure. "fluency": '), (k % 6).cast("string"), F.lit(", meaning preserved: FALSE")))
        .when(k % 4 == 2, F.concat(F.lit('{"fluency": "'), (k % 6).cast("string"), F.lit('"}')))
        .otherwise(F.lit("no idea"))
    )
    return tables.read(spark, sf_dir, "events").select("event_type", reply.alias("reply"))


def parse_quality_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = _replies(spark, sf_dir).select("event_type", verdicts.fluency(F.col("reply")).alias("fluency"), verdicts.meaning(F.col("reply")).alias("meaning_preserved"))
    return told.groupBy("event_type", "fluency", "meaning_preserved").agg(F.count(F.lit(1)).alias("n"))


def injected_evidence_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = tables.claims(spark, sf_dir)
    skip = F.when(F.col("row_id") % 7 == 0, "no_valid_perturbation")
    new_claim = F.when(F.col("row_id") % 3 == 0, F.upper("claim"))
    extra = F.when(F.col("row_id") % 3 != 0, F.col("claim"))
    flag = F.col("row_id") % 2 == 0
    put = c.select(verdicts.route(skip, new_claim, extra, flag).alias("route"), verdicts.injected(F.col("evidence"), extra, flag).alias("shown"), extra.alias("extra"), "evidence")
    shown = F.when(F.col("route") == "replaced_evidence", F.col("extra")).otherwise(F.col("shown"))
    return put.groupBy("route").agg(F.count(F.lit(1)).alias("n"), F.sum(F.char_length(shown)).alias("chars"))


def first_flipped_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each perturbation the first flipped claim, or the first claim."""
    best = F.min(F.struct((~F.col("flipped")).alias("no"), "row_id", "verdict", "gold_label")).alias("x")
    return verified(spark, sf_dir).groupBy("attack_id").agg(best).select("attack_id", F.col("x.row_id").alias("row_id"), (~F.col("x.no")).alias("flipped"), F.col("x.verdict").alias("verdict"), F.col("x.gold_label").alias("gold_label"))


def attack_filter(spark: SparkSession, sf_dir: str, arm: str = "Rule", family: str = "All") -> DataFrame:
    """The dashboard's table: filters where 'All' lets everything through, sorted by gated rate."""
    rates = success_rates(verified(spark, sf_dir), "attack_id", "arm", "family")
    for column, value in (("arm", arm), ("family", family)):
        rates = rates if value == "All" else rates.filter(F.col(column) == value)
    return rates.select("attack_id", "arm", "family", six("raw_asr"), six("gated_asr")).orderBy(F.desc("gated_asr"), "attack_id")


def alias_label_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables.read(spark, sf_dir, "documents").join(tables.read(spark, sf_dir, "labels"), "doc_id", "left")
    raw = docs.select(
        "doc_id",
        F.when(F.col("doc_id") % 5 == 0, "").otherwise(F.col("text")).alias("claim"),
        F.concat(F.lit(" "), F.col("text"), F.lit("  ")).alias("claim_text"),
        F.when(F.col("quality") == 1, " supported").when(F.col("toxic") == 1, "Not enough info ").when(F.col("quality") == 0, "refutes").otherwise("?").alias("gold_label"),
        F.when(F.col("lang") == "en", "hi-IN").when(F.col("lang") == "fr", "TE ").otherwise(F.col("lang")).alias("lang"),
    )
    picked = raw.select(
        "doc_id",
        text.squeeze(text.tidy(F.coalesce(F.nullif("claim", F.lit("")), F.nullif("claim_text", F.lit("")), F.lit("")))).alias("claim"),
        verdicts.fold_label(F.col("gold_label")).alias("label"),
        verdicts.language(F.col("lang")).alias("language"),
    )
    kept = picked.filter((F.col("claim") != "") & (F.col("label") != "") & F.col("language").isNotNull())
    return kept.groupBy("label", "language").agg(F.count(F.lit(1)).alias("n"), F.sum(F.char_length("claim")).alias("chars"))


def _responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = tables.read(spark, sf_dir, "conversations")
    dressed = (
        F.when(F.col("turn") % 4 == 0, F.concat(F.lit("```json\n"), "text", F.lit("\n```")))
        .when(F.col("turn") % 4 == 1, F.concat(F.lit('"'), "text", F.lit('"')))
        .when(F.col("turn") % 4 == 2, F.concat(F.lit("<think>hm</think> "), "text"))
        .otherwise(F.when(F.col("conv_id") % 2 == 0, F.lit("__ERROR__ timeout")).otherwise(F.lit("<think>never ends")))
    )
    return c.select("role", dressed.alias("raw"))


def clean_response_usable(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = _responses(spark, sf_dir).select("role", verdicts.clean_response(verdicts.strip_think(F.col("raw"))).alias("clean"))
    return done.groupBy("role", verdicts.is_usable(F.col("clean")).alias("usable"), F.coalesce(verdicts.normalise_label(F.col("clean")), F.lit("NONE")).alias("label")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.char_length("clean")).alias("chars"))


QUERIES = {
    f.__name__: f
    for f in (
        asr_by_attack, decide_reason_histogram, gate_reason_histogram, baseline_accuracy_by_domain, unconditional_asr_wilson, family_asr, gold_verdict_transition,
        robust_accuracy_at_k, transfer_audit, reciprocal_pilot, parse_label_counts, parse_quality_json, injected_evidence_lengths, first_flipped_sample, attack_filter,
        alias_label_normalise, clean_response_usable,
    )
}

COUNTS = """SELECT {keys}, count(*) FILTER (reason IN ('flip', 'no_flip')) AS eligible, count(*) FILTER (flipped) AS flips_raw,
    count(*) FILTER (reason IN ('flip', 'no_flip') AND NOT coalesce(excluded, FALSE)) AS gated_eligible, count(*) FILTER (gated_flip) AS flips_gated,
    count(*) FILTER (excluded) AS excluded FROM verified GROUP BY {keys}"""
TRIM_SQL = r"regexp_replace({x}, '^ +| +$', '', 'g')"

ORACLES = {
    "asr_by_attack": with_ctes(CTE_VERIFIED, f"c AS ({COUNTS.format(keys='attack_id')})", then=f"""SELECT *, round(flips_raw / nullif(eligible, 0), 6) AS raw_asr,
        round(flips_gated / nullif(gated_eligible, 0), 6) AS gated_asr, {TIER_SQL.format(x='flips_gated / nullif(gated_eligible, 0)')} AS empirical_tier FROM c"""),
    "decide_reason_histogram": with_ctes(CTE_VERIFIED, then="SELECT reason, count(*) AS n FROM verified GROUP BY reason"),
    "gate_reason_histogram": with_ctes(CTE_VERIFIED, then="SELECT gate_mode, gate_reason, count(*) AS n FROM verified WHERE flipped GROUP BY ALL"),
    "baseline_accuracy_by_domain": with_ctes(CTE_VERIFIED, "c AS (SELECT row_id, domain, bool_or(baseline_failed) AS failed FROM outcomes GROUP BY ALL)", "a AS (SELECT domain, count(*) AS claims, count(*) FILTER (NOT failed) AS correct FROM c GROUP BY domain)",
        then=f"SELECT *, round(correct / claims, 6) AS accuracy, {wilson_sql('lo', 'correct', 'claims')} AS ci_low, {wilson_sql('hi', 'correct', 'claims')} AS ci_high FROM a"),
    "unconditional_asr_wilson": with_ctes(CTE_VERIFIED, "a AS (SELECT attack_id, count(*) FILTER (gated_flip) AS flips, (SELECT count(DISTINCT row_id) FROM verified WHERE NOT baseline_failed) AS claims FROM verified GROUP BY attack_id)",
        then=f"SELECT *, round(flips / claims, 6) AS asr, {wilson_sql('lo', 'flips', 'claims')} AS ci_low, {wilson_sql('hi', 'flips', 'claims')} AS ci_high FROM a"),
    "family_asr": with_ctes(CTE_VERIFIED, "c AS (SELECT row_id, family, bool_or(gated_flip) AS hit FROM verified WHERE NOT baseline_failed GROUP BY ALL)",
        then="SELECT family, count(*) AS claims, count(*) FILTER (hit) AS flipped, round(count(*) FILTER (hit) / count(*), 6) AS asr FROM c GROUP BY family"),
    "gold_verdict_transition": with_ctes(CTE_VERIFIED, then="""SELECT gold_label, count(*) FILTER (verdict = 'SUP') AS to_sup, count(*) FILTER (verdict = 'REF') AS to_ref,
        count(*) FILTER (verdict = 'NEI') AS to_nei, count(*) FILTER (verdict IS NULL) AS to_none FROM outcomes GROUP BY gold_label"""),
    "robust_accuracy_at_k": with_ctes(CTE_VERIFIED, "ranks AS (SELECT attack_idx, row_number() OVER (ORDER BY gated_asr_pct DESC, attack_idx) AS strength FROM attacks)",
        "f AS (SELECT row_id, min(strength) FILTER (gated_flip) AS first_flip FROM verified JOIN ranks USING (attack_idx) WHERE NOT baseline_failed GROUP BY row_id)",
        then="""SELECT CAST(k AS INT) AS k, count(*) AS claims, count(*) FILTER (coalesce(first_flip > k, TRUE)) AS unflipped,
        round(count(*) FILTER (coalesce(first_flip > k, TRUE)) / count(*), 6) AS robust_accuracy FROM f, (VALUES (1), (2), (5), (22)) ks(k) GROUP BY k"""),
    "transfer_audit": with_ctes(CTE_VERIFIED, "a AS (SELECT *, row_number() OVER (PARTITION BY attack_id ORDER BY row_id) AS nth FROM verified WHERE gated_flip)",
        then="""SELECT attack_id, count(*) AS audited, count(*) FILTER (meaning_preserved AND fluency >= 4) AS confirmed,
        round(count(*) FILTER (meaning_preserved AND fluency >= 4) / count(*), 6) AS transfer_asr FROM a WHERE nth <= 200 GROUP BY attack_id"""),
    "reciprocal_pilot": with_ctes(CTE_VERIFIED, then="SELECT arm, count(*) AS n, count(*) FILTER (flipped) AS raw_flips, count(*) FILTER (gated_flip) AS gated_flips, round(avg(fluency), 6) AS mean_fluency FROM verified WHERE NOT baseline_failed GROUP BY arm"),
    "parse_label_counts": """SELECT role, CASE WHEN upper(text) LIKE '%NEI%' THEN 'NEI' WHEN upper(text) LIKE '%SUP%' THEN 'SUP' WHEN upper(text) LIKE '%REF%' THEN 'REF' ELSE 'NONE' END AS parsed, count(*) AS n
        FROM conversations GROUP BY ALL""",
    "parse_quality_json": """WITH k AS (SELECT event_type, CAST(props->>'$.k' AS INT) AS k FROM events)
        SELECT event_type, CASE WHEN k % 4 < 3 THEN CAST(k % 6 AS INT) END AS fluency, CASE k % 4 WHEN 0 THEN TRUE WHEN 1 THEN FALSE END AS meaning_preserved, count(*) AS n FROM k GROUP BY ALL""",
    "injected_evidence_lengths": with_ctes(CTE_CLAIMS, f"""r AS (SELECT *, CASE WHEN row_id % 3 <> 0 THEN claim END AS extra,
        CASE WHEN row_id % 7 = 0 THEN 'skip' WHEN row_id % 3 = 0 AND claim <> '' THEN 'claim' WHEN row_id % 3 <> 0 AND claim <> '' AND row_id % 2 = 0 THEN 'injected_evidence'
            WHEN row_id % 3 <> 0 AND claim <> '' THEN 'replaced_evidence' ELSE 'skip' END AS route FROM claims)""",
        then=f"""SELECT route, count(*) AS n, CAST(sum(length(CASE WHEN route = 'replaced_evidence' THEN extra WHEN row_id % 2 = 0 AND coalesce(extra, '') <> ''
        THEN evidence || '{INJECTED_SEPARATOR}' || extra ELSE evidence END)) AS BIGINT) AS chars FROM r GROUP BY route"""),
    "first_flipped_sample": with_ctes(CTE_VERIFIED, then="""SELECT attack_id, row_id, flipped, verdict, gold_label FROM verified
        QUALIFY row_number() OVER (PARTITION BY attack_id ORDER BY flipped DESC, row_id) = 1"""),
    "attack_filter": with_ctes(CTE_VERIFIED, f"c AS ({COUNTS.format(keys='attack_id, arm, family')})",
        then="SELECT attack_id, arm, family, round(flips_raw / nullif(eligible, 0), 6) AS raw_asr, round(flips_gated / nullif(gated_eligible, 0), 6) AS gated_asr FROM c WHERE arm = 'Rule'"),
    "alias_label_normalise": r"""WITH raw AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN ' ' || text || chr(160) || ' ' ELSE text END AS claim,
            CASE WHEN quality = 1 THEN 'SUP' WHEN toxic = 1 THEN 'NEI' WHEN quality = 0 THEN 'REF' ELSE '' END AS label,
            CASE WHEN lang = 'en' THEN 'hi' WHEN lang = 'fr' THEN 'te' WHEN lang LIKE 'hi%' THEN 'hi' END AS language
        FROM documents LEFT JOIN labels USING (doc_id)),
        tidy AS (SELECT *, trim(regexp_replace(trim(replace(claim, chr(160), ' ')), '[ \t\n\v\f\r]+', ' ', 'g')) AS c FROM raw)
        SELECT label, language, count(*) AS n, CAST(sum(length(c)) AS BIGINT) AS chars FROM tidy WHERE c <> '' AND label <> '' AND language IS NOT NULL GROUP BY label, language""",
    "clean_response_usable": r"""WITH raw AS (SELECT role, CASE turn % 4 WHEN 0 THEN '```json' || chr(10) || text || chr(10) || '```' WHEN 1 THEN '"' || text || '"' WHEN 2 THEN text
            ELSE CASE WHEN conv_id % 2 = 0 THEN '__ERROR__ timeout' ELSE '' END END AS t FROM conversations),
        bare AS (SELECT role, regexp_replace(regexp_replace(trim(t), '^```[a-zA-Z]*\s*', ''), '\s*```$', '') AS t FROM raw),
        clean AS (SELECT role, trim(regexp_replace(trim(t), '^"+|"+$', '', 'g')) AS t FROM bare)
        SELECT role, NOT starts_with(t, '__ERROR__') AND length(t) >= 3 AS usable,
            CASE WHEN upper(t) LIKE '%SUP%' THEN 'SUP' WHEN upper(t) LIKE '%REF%' THEN 'REF' WHEN upper(t) LIKE '%NEI%' OR upper(t) LIKE '%NOT ENOUGH%' THEN 'NEI' ELSE 'NONE' END AS label,
            count(*) AS n, CAST(sum(length(t)) AS BIGINT) AS chars FROM clean GROUP BY ALL""",
}
