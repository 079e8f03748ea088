"""Queries over generated texts, source records, feature vectors and exemplars, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph, linking, records, registry
from ..operators.evaluation import ranking
from ..operators.lineage import cut
from ..sources import tables
from ..sources.tables import CTE_CLAIMS, CTE_VERIFIED, with_ctes
from .graphs import FEATURED, MEASURED_FEATURES, cosine_sql
from .perturbations import GLYPH, JUMBLE, TABLE_LANGUAGES
from .verification import CTE_MEASURED, measured, verified

#: Numbers of an embedding.
DIMS = 64


def _generated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assistant turns stand in for generations: of each conversation the first, for each perturbation in turn."""
    c = tables.read(spark, sf_dir, "conversations").filter("role = 'assistant'").groupBy("conv_id").agg(F.min_by("text", "turn").alias("text"))
    ids = spark.createDataFrame([(i, a[0]) for i, a in enumerate(records.GENERATORS)], "n int, attack_id string")
    return c.join(F.broadcast(ids), F.col("conv_id") % len(records.GENERATORS) == F.col("n")).select(F.col("conv_id").alias("row_id"), "attack_id", "text")


def generated_attacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    claims = tables.claims(spark, sf_dir, has_evidence=F.coalesce(F.expr(tables.EVIDENCE), F.lit("")) != "")
    done = records.apply_generated(records.with_neighbours(claims, tables.evidences(spark, sf_dir), whole=False), _generated(spark, sf_dir))
    return done.groupBy("attack_id", F.coalesce("skip_reason", F.lit("applied")).alias("result"), F.coalesce("target_label", F.lit("NONE")).alias("target"), "injected_evidence_workaround").agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.char_length("adversarial_claim")), F.lit(0)).alias("claim_chars"), F.coalesce(F.sum(F.char_length("adversarial_evidence")), F.lit(0)).alias("evidence_chars")
    )


def sub_question_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    reply = F.when(F.col("conv_id") % 2 == 0, F.to_json(F.struct(F.array("role", F.lit("why?")).alias("sub_questions")))).otherwise(F.concat(F.lit("1. "), "role", F.lit("\n- ab\n* "), "text"))
    c = tables.read(spark, sf_dir, "conversations").select("role", records.sub_questions(reply).alias("q"))
    return c.groupBy("role", F.size("q").alias("questions")).agg(F.count(F.lit(1)).alias("n"))


def records_with_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = records.with_source(tables.outcomes(spark, sf_dir).select("row_id", "attack_idx", "verdict"), tables.claims(spark, sf_dir))
    return joined.groupBy(F.coalesce("skip_reason", F.lit("found")).alias("result"), F.coalesce("label", F.lit("NONE")).alias("label")).agg(F.count(F.lit(1)).alias("n"))


#: Perturbations of ``result_records`` and where their SQL finds the texts.
SHOWN = {"CA_CHAR_05_HomoglyphPerturbation": "(SELECT row_id, CASE WHEN language IN ('en', 'de') THEN changed END AS changed FROM glyph JOIN claims USING (row_id))", "CA_WORD_03_Jumbling": "(SELECT row_id, CASE WHEN language IN ('en', 'fr', 'de') THEN changed END AS changed FROM jumble JOIN claims USING (row_id))"}


def result_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result rows of two perturbations: how many of each outcome, and the length of their texts."""
    claims = tables.claims(spark, sf_dir)
    attacked = registry.perturb_all(claims, None, {a: registry.REGISTRY[a] for a in SHOWN}, TABLE_LANGUAGES)
    rows = records.results(attacked, claims, verified(spark, sf_dir))
    chars = lambda c: F.sum(F.char_length(c)).alias(f"{c}_chars")
    return rows.groupBy("attack_id", "gold_label", "verdict", "flipped", "reason", "excluded", "gate_reason").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.coalesce(F.expr("try_cast(fluency AS BIGINT)"), F.lit(0))).alias("fluency"), *map(chars, ["original_claim", "original_evidence", "adversarial_claim", "adversarial_evidence"])
    )


def embedding_mean_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = tables.read(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").alias("features"))
    pooled = records.mean_pool(v, "label", F.lit(True), graph.width(v, "features"))
    return pooled.select("label", F.posexplode("pooled").alias("dim", "value")).select("label", "dim", F.round("value", 5).alias("value"))


#: Tokens that an embedding is read as, and the numbers of each.
TOKENS, TOKEN_DIMS = 16, DIMS // 16


def token_mean_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector read as sixteen tokens of four numbers; those whose first number is above 0 are attended to."""
    e, d = F.col("embedding"), TOKEN_DIMS
    v = tables.read(spark, sf_dir, "embeddings").select("vec_id", F.array(*[F.slice(e, 1 + d * i, d) for i in range(TOKENS)]).alias("tokens"), F.array(*[(F.get(e, F.lit(d * i)) > 0).cast("int") for i in range(TOKENS)]).alias("mask"))
    pooled = records.pool_tokens(v, "vec_id", "tokens", "mask", d).select("vec_id", F.posexplode("pooled").alias("dim", "value"))
    return pooled.select("vec_id", "dim", F.round("value", 5).alias("value"))


def exemplar_pair_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = records.pair_state(measured(spark, sf_dir))
    return s.select("target", "candidate", F.size("state").alias("dims"), F.round(F.aggregate("state", F.lit(0.0), lambda a, x: a + x), 6).alias("total"), F.round(F.get("state", F.lit(28)), 6).alias("similarity"))


def state_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = tables.read(spark, sf_dir, "embeddings").select("vec_id", records.ablated(F.col("embedding"), 48).alias("a"))
    return v.select("vec_id", F.round(F.aggregate("a", F.lit(0.0), lambda s, x: s + x), 5).alias("total"), F.size(F.filter("a", lambda x: x == 0)).alias("zeros"))


def augmented_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A claim's 2 numbers, its vector and the mean features of the perturbations that do not flip it."""
    seen = verified(spark, sf_dir).filter("NOT baseline_failed").select("row_id", "attack_idx", "gated_flip")
    f = tables.attacks(spark).select("attack_idx", graph.attack_features().alias("f"))
    open_ = seen.join(F.broadcast(f), "attack_idx").groupBy("row_id").agg(F.count(F.lit(1)).cast("double").alias("tried"), F.count_if("gated_flip").cast("double").alias("flips"), F.collect_list(F.when(~F.col("gated_flip"), F.col("f"))).alias("rest"))
    v = tables.read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row_id"), F.transform("embedding", lambda x: x.cast("double")).alias("own"))
    s = open_.join(v, "row_id").select("row_id", records.augmented_state(F.array("tried", "flips"), F.col("own"), F.col("rest"), graph.width(f, "f")).alias("s"))
    return s.select("row_id", F.size("s").alias("dims"), F.round(F.aggregate("s", F.lit(0.0), lambda a, x: a + x), 5).alias("total"))


def random_exemplars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.random_exemplars(measured(spark, sf_dir), 8)


def epsilon_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of five thresholds on fluency the one whose gate agrees most with kept meaning; of equal ones the first."""
    seen = verified(spark, sf_dir).select("fluency", "meaning_preserved", F.explode(F.array(*[F.lit(k) for k in range(1, 6)])).alias("setting"))
    scored = seen.groupBy("setting").agg(F.round(F.avg(((F.col("fluency") >= F.col("setting")) == F.col("meaning_preserved")).cast("double")), 6).alias("score"))
    return records.best_setting(scored, "setting", "score")


def link_prediction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A logistic model of flips for each held-out perturbation, by its area under the curve: the idiomatic stand-in for the neural ones."""
    features = tables.attacks(spark).select("attack_idx", F.slice(graph.attack_features(), 1, 11).alias("f"))
    seen = verified(spark, sf_dir).filter("NOT baseline_failed AND verdict IS NOT NULL").select("attack_idx", "gold_label", F.col("gated_flip").alias("hit"))
    return ranking(linking.leave_one_out(seen, features, ["SUP", "REF"]), "p", "hit", "attack_idx")


def link_prediction_macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The folds of ``link_prediction`` averaged, each perturbation with equal weight."""
    return link_prediction(spark, sf_dir).agg(F.count(F.lit(1)).alias("folds"), F.round(F.avg("auroc"), 6).alias("auroc"), F.round(F.avg("auprc"), 6).alias("auprc"))


def link_mlp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A network of one hidden layer over a claim's whole vector and a perturbation's features, each perturbation held out in turn; of claims that have a vector. Part "all" averages the folds."""
    features = tables.attacks(spark).select("attack_idx", F.slice(graph.attack_features(), 1, 11).alias("f"))
    v = tables.read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row_id"), F.col("embedding").alias("vector"))
    seen = verified(spark, sf_dir).filter("NOT baseline_failed AND verdict IS NOT NULL").select("row_id", "attack_idx", F.col("gated_flip").alias("hit"))
    scored = linking.link_mlp(seen.join(v.select("row_id"), "row_id", "left_semi"), v, features, graph.width(v, "vector"))
    each = cut(ranking(scored, "p", "hit", "attack_idx"))
    total = each.agg(F.lit("all").alias("part"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("hits", "misses")], F.avg("auroc").alias("auroc"), F.avg("auprc").alias("auprc"))
    both = each.select(F.col("attack_idx").cast("string").alias("part"), "hits", "misses", "auroc", "auprc").unionByName(total)
    return both.select("part", "hits", "misses", F.round("auroc", 6).alias("auroc"), F.round("auprc", 6).alias("auprc"))


QUERIES = {
    f.__name__: f
    for f in (link_mlp, token_mean_pool, generated_attacks, sub_question_counts, records_with_source, result_records, embedding_mean_pool, exemplar_pair_state, state_ablation, augmented_state, random_exemplars, epsilon_grid, link_prediction, link_prediction_macro)
}

_spec = ", ".join(f"({i}, '{a}', '{w}', '{t}', {s}, {j}, '{n}', '{m}', '{f}')" for i, (a, w, t, s, j, n, m, f) in enumerate(records.GENERATORS))

ORACLES = {
    "generated_attacks": with_ctes(
        CTE_CLAIMS,
        f"spec(n, attack_id, writes, target, spares, injected, needs, missing, failed) AS (VALUES {_spec})",
        f"g AS (SELECT conv_id AS row_id, n, arg_min(text, turn) AS text FROM conversations JOIN spec ON conv_id % {len(records.GENERATORS)} = n WHERE role = 'assistant' GROUP BY ALL)",
        r"""c AS (SELECT row_id, n, trim(regexp_replace(trim(regexp_replace(regexp_replace(trim(text), '^```[a-zA-Z]*\s*', ''), '\s*```$', '')), '^"+|"+$', '', 'g')) AS t FROM g)""",
        r"w AS (SELECT row_id, domain, evidence, list_distinct(regexp_extract_all(coalesce(evidence, ''), '[^ \t\n\v\f\r]+')) AS t FROM claims)",
        """near AS (SELECT a.row_id, arg_min(b.evidence, (-round(coalesce(len(list_intersect(a.t, b.t)) / nullif(greatest(len(a.t), len(b.t)), 0), 0), 9), b.row_id)) AS other
            FROM w a JOIN w b ON a.domain = b.domain AND a.row_id <> b.row_id GROUP BY a.row_id)""",
        """x AS (SELECT claims.*, spec.*, t, CASE WHEN coalesce(claim, '') = '' OR (needs IN ('pair', 'evidence') AND coalesce(evidence, '') = '') OR (needs = 'pair' AND coalesce(other, '') = '') OR (needs = 'label' AND label IS NULL) THEN missing
            WHEN spares AND coalesce(label, '') = 'NEI' THEN 'nei_claim_not_targeted'
            WHEN t IS NULL OR starts_with(t, '__ERROR__') OR length(t) < 3 THEN failed ELSE 'applied' END AS result FROM claims LEFT JOIN near USING (row_id) CROSS JOIN spec LEFT JOIN c USING (row_id, n))""",
        then="""SELECT attack_id, result, coalesce(CASE WHEN target = 'same_as_gold' THEN label ELSE target END, 'NONE') AS target, injected AS injected_evidence_workaround, count(*) AS n,
            CAST(coalesce(sum(CASE WHEN result = 'applied' AND writes = 'claim' THEN length(t) WHEN result = 'applied' AND writes = 'trigger' THEN length(t) + 1 + length(claim) END), 0) AS BIGINT) AS claim_chars,
            CAST(coalesce(sum(CASE WHEN result = 'applied' AND writes = 'evidence' THEN length(t) END), 0) AS BIGINT) AS evidence_chars FROM x GROUP BY ALL""",
    ),
    "sub_question_counts": r"""WITH l AS (SELECT role, conv_id, CASE WHEN conv_id % 2 = 0 THEN 2 ELSE least(4, len(list_filter(list_transform(string_split('1. ' || role || chr(10) || '- ab' || chr(10) || '* ' || text, chr(10)),
            lambda x: trim(regexp_replace(x, '^[\d\-*\s.]+', ''))), lambda x: length(x) > 3))) END AS questions FROM conversations)
        SELECT role, questions, count(*) AS n FROM l GROUP BY ALL""",
    "records_with_source": with_ctes(CTE_VERIFIED, CTE_CLAIMS, then="""SELECT CASE WHEN c.row_id IS NULL THEN 'missing_source_row' ELSE 'found' END AS result, coalesce(c.label, 'NONE') AS label, count(*) AS n
        FROM outcomes o LEFT JOIN claims c USING (row_id) GROUP BY ALL"""),
    "result_records": with_ctes(CTE_VERIFIED, CTE_CLAIMS, JUMBLE, GLYPH, "made AS (" + " UNION ALL ".join(f"SELECT row_id, '{a}' AS attack_id, changed FROM {x}" for a, x in SHOWN.items()) + ")",
        "v AS (SELECT row_id, attack_id, verdict, flipped, reason, fluency, excluded, gate_reason FROM verified)",
        then="SELECT attack_id, coalesce(label, '') AS gold_label, " + ", ".join(f"coalesce({c}::VARCHAR, '') AS {c}" for c in ("verdict", "flipped", "reason", "excluded", "gate_reason"))
        + ", count(*) AS n, CAST(coalesce(sum(fluency), 0) AS BIGINT) AS fluency, "
        + ", ".join(rf"CAST(sum(length(coalesce(trim(regexp_replace({c}, '[ \t\n\v\f\r]+', ' ', 'g')), ''))) AS BIGINT) AS {n}_chars" for c, n in (("claim", "original_claim"), ("evidence", "original_evidence"), ("changed", "adversarial_claim")))
        + ", 0 AS adversarial_evidence_chars FROM made JOIN claims USING (row_id) LEFT JOIN v USING (row_id, attack_id) WHERE trim(coalesce(claim, '')) <> '' GROUP BY ALL"),
    "embedding_mean_pool": f"""SELECT label, CAST(dim AS INT) AS dim, round(avg(embedding[dim + 1]::DOUBLE), 5) AS value FROM embeddings, range({DIMS}) r(dim) GROUP BY label, dim""",
    "token_mean_pool": f"""WITH t AS (SELECT vec_id, d, len(list_filter(range({TOKENS}), lambda i: embedding[{TOKEN_DIMS} * i + 1] > 0)) AS n,
            coalesce(list_sum(list_transform(list_filter(range({TOKENS}), lambda i: embedding[{TOKEN_DIMS} * i + 1] > 0), lambda i: embedding[{TOKEN_DIMS} * i + d + 1]::DOUBLE)), 0) AS s FROM embeddings, range({TOKEN_DIMS}) r(d))
        SELECT vec_id, CAST(d AS INT) AS dim, round(s / greatest(n, 1), 5) + 0.0 AS value FROM t""",
    "exemplar_pair_state": with_ctes(CTE_VERIFIED, CTE_MEASURED, MEASURED_FEATURES, "p AS (SELECT a.attack_idx AS target, b.attack_idx AS candidate, a.f AS x, b.f AS y, m.family = n.family AS fam, m.arm = n.arm AS arm, m.injected AS inj FROM f a JOIN f b ON a.attack_idx <> b.attack_idx JOIN measured m ON m.attack_idx = a.attack_idx JOIN measured n ON n.attack_idx = b.attack_idx)",
        f"s AS (SELECT *, {cosine_sql('x[1:12]', 'y[1:12]')} AS sim FROM p)",
        then="SELECT target, candidate, 34 AS dims, round(list_sum(x[1:12]) + list_sum(y) + sim + 2 * fam::INT + arm::INT + inj::INT, 6) AS total, round(sim, 6) AS similarity FROM s"),
    "state_ablation": "SELECT vec_id, round(list_sum(embedding[49:]::DOUBLE[]), 5) AS total, 48 + len(list_filter(embedding[49:], lambda x: x = 0)) AS zeros FROM embeddings",
    "augmented_state": with_ctes(CTE_VERIFIED, FEATURED, f"""o AS (SELECT row_id, count(*) AS tried, count(*) FILTER (gated_flip) AS flips, coalesce(sum(list_sum(f.f)) FILTER (NOT gated_flip), 0) / greatest(count(*) FILTER (NOT gated_flip), 1) AS rest
        FROM verified JOIN f USING (attack_idx) WHERE NOT baseline_failed GROUP BY row_id)""",
        then=f"SELECT row_id, 82 AS dims, round(tried + flips + list_sum(embedding::DOUBLE[]) + rest, 5) AS total FROM o JOIN embeddings ON vec_id = row_id"),
    "random_exemplars": with_ctes(CTE_VERIFIED, CTE_MEASURED, then="""SELECT a.attack_idx AS target, b.attack_idx AS exemplar FROM measured a JOIN measured b ON a.attack_idx <> b.attack_idx
        QUALIFY row_number() OVER (PARTITION BY a.attack_idx ORDER BY md5('42:' || a.attack_idx || ':' || b.attack_idx)) <= 8"""),
    "epsilon_grid": with_ctes(CTE_VERIFIED, "s AS (SELECT k AS setting, round(avg(CAST((fluency >= k) = meaning_preserved AS INT)), 6) AS score FROM verified, range(1, 6) r(k) GROUP BY k)",
        then="SELECT CAST(setting AS INT) AS setting, score FROM s ORDER BY score DESC, setting LIMIT 1"),
}
