"""Queries over graphs and neighbours, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text
from ..operators import graph
from ..sources import tables
from ..sources.tables import CTE_CLAIMS, CTE_VERIFIED, with_ctes
from .verification import CTE_MEASURED, measured, verified

#: Numbers of an embedding.
DIMS = 64


def attack_similarity_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = [graph.similar_pairs(measured(spark, sf_dir), dims).select(F.lit(dims).alias("dims"), "src", "dst", F.round("similarity", 6).alias("similarity")) for dims in (11, 12)]
    return out[0].unionByName(out[1])


def bipartite_edges_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = graph.bipartite(verified(spark, sf_dir))
    return edges.groupBy("dst").agg(F.count(F.lit(1)).alias("degree"), F.count_if("gated_flip").alias("gated"), F.count_if("judge_pass_edge").alias("pass_edge"), F.count_if("judge_pass_env").alias("pass_env"))


def edge_mask(spark: SparkSession, sf_dir: str, held_out: int = 19) -> DataFrame:
    """Edges and flips that are left when one perturbation's node goes."""
    left = graph.without_node(graph.bipartite(verified(spark, sf_dir)), -1 - held_out)
    return left.agg(F.count(F.lit(1)).alias("edges"), F.countDistinct("src").alias("nodes"), F.count_if("gated_flip").alias("gated"))


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("features"), "label")


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perturbation nodes (below 0) hear the claims whose id is a vector's."""
    edges = graph.bipartite(verified(spark, sf_dir)).filter("dst < 0")
    return edges.select("src", "dst")


def sage_mean_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vectors(spark, sf_dir)
    means = graph.mean_aggregate(v, _edges(spark, sf_dir), graph.width(v, "features"))
    return means.select("dst", "degree", F.posexplode("mean").alias("dim", "value")).select("dst", "degree", "dim", (F.signum("value") * F.round(F.abs("value"), 5)).alias("value"))  # a small negative number is -0.0, as in IEEE 754


def attention_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A claim's score is a fixed linear form of its whole vector."""
    form = F.transform("features", lambda x, i: x.cast("double") * ((i % 7 - 3) / 10.0))
    v = _vectors(spark, sf_dir).select("id", F.aggregate(form, F.lit(0.0), lambda s, x: s + x).alias("score"))
    targets = tables.attacks(spark).select((-1 - F.col("attack_idx")).cast("long").alias("id"), (F.col("gated_asr_pct") / 100).alias("score"))
    w = graph.attention(_edges(spark, sf_dir), v, targets)
    return w.groupBy("dst").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("weight"), 6).alias("total"), F.round(F.max("weight"), 6).alias("largest"))


#: What a claim's vector and a perturbation's features, filled up with zeros, are multiplied by; any fixed numbers do.
GAT_LINEAR = [[((7 * o + 3 * i) % 11 - 5) / 10 for i in range(64)] for o in range(4)]
GAT_SOURCE, GAT_TARGET, GAT_BIAS = [0.3, -0.2, 0.1, 0.4], [-0.1, 0.2, 0.5, -0.3], [0.05, -0.5, 0.1, -0.2]


def gat_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One attention layer: what perturbations hear from the claims they were tried on."""
    edges = graph.bipartite(verified(spark, sf_dir)).filter("dst < 0")
    arms = tables.attacks(spark).select((-1 - F.col("attack_idx")).cast("long").alias("id"), graph.attack_features().alias("features"))
    vectors = _vectors(spark, sf_dir).select(F.col("id").cast("long").alias("id"), F.transform("features", lambda x: x.cast("double")).alias("features"))
    out = graph.gat(vectors.unionByName(arms), edges, GAT_LINEAR, GAT_SOURCE, GAT_TARGET, GAT_BIAS).filter("id < 0")
    return out.select("id", F.posexplode("h").alias("dim", "value")).select("id", "dim", F.round("value", 6).alias("value"))


def knn_tier_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors whose id is divisible by 50 take the label that their five nearest vote for, weighted by similarity."""
    v = _vectors(spark, sf_dir)
    near = graph.nearest(v.filter("id % 50 = 0"), v, 5).join(v.select(F.col("id").alias("other"), "label"), "other")
    votes = near.groupBy("id", "label").agg(F.round(F.sum(F.greatest(F.lit(0.1), "similarity")), 6).alias("score"))
    best = votes.groupBy("id").agg(F.min(F.struct((-F.col("score")).alias("no"), "label")).alias("x"))
    return best.select("id", F.col("x.label").alias("voted"), (-F.col("x.no")).alias("score"))


def exemplar_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each perturbation's tier by the vote of all others, without rules: weight at least 0.1, ties POS, MID, NEG."""
    a = measured(spark, sf_dir)
    f = a.select("attack_idx", "attack_id", "tier", F.slice(graph.attack_features(), 1, 12).alias("f"))
    other = f.select(F.col("attack_idx").alias("o"), F.col("tier").alias("vote"), F.col("f").alias("g"))
    votes = f.join(F.broadcast(other), F.col("attack_idx") != F.col("o")).groupBy("attack_id", "tier", "vote").agg(F.round(F.sum(F.greatest(F.lit(0.1), graph.cosine(F.col("f"), F.col("g")))), 9).alias("score"))
    order = F.expr("CASE vote WHEN 'POS' THEN 0 WHEN 'MID' THEN 1 ELSE 2 END")
    nth = F.row_number().over(Window.partitionBy("attack_id").orderBy(F.desc("score"), order))
    return votes.withColumn("nth", nth).filter("nth = 1").select("attack_id", "tier", F.col("vote").alias("predicted"))


def leave_attack_out_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each held-out perturbation the mean gated rate of its three nearest others."""
    rates = verified(spark, sf_dir).filter("NOT baseline_failed").groupBy("attack_idx").agg(F.avg(F.col("gated_flip").cast("double")).alias("rate"))
    pairs = graph.similar_pairs(tables.attacks(spark), 11, 0.0).withColumn("similarity", F.round("similarity", 9))
    near = pairs.withColumn("nth", F.row_number().over(Window.partitionBy("src").orderBy(F.desc("similarity"), "dst"))).filter("nth <= 3")
    guess = near.join(F.broadcast(rates.withColumnRenamed("attack_idx", "dst")), "dst").groupBy("src").agg(F.avg("rate").alias("predicted"))
    return guess.join(rates.withColumnRenamed("attack_idx", "src"), "src").select("src", F.round("predicted", 6).alias("predicted"), F.round("rate", 6).alias("actual"))


def leave_attack_out_macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The baseline's folds averaged, each perturbation with equal weight."""
    each = leave_attack_out_baseline(spark, sf_dir)
    six = lambda c, name: F.round(F.avg(c), 6).alias(name)
    return each.agg(F.count(F.lit(1)).alias("folds"), six(F.col("predicted"), "mean_predicted"), six(F.col("actual"), "mean_actual"), six(F.abs(F.col("predicted") - F.col("actual")), "mean_error"))


def neighbor_pairing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whose evidence is most like each labelled claim's; English claims have no domain here, so they look among all."""
    labelled = tables.claims(spark, sf_dir).filter("label IS NOT NULL").select("row_id", F.when(F.col("language") != "en", F.col("domain")).alias("domain"), F.array_distinct(text.tokens(F.col("evidence"))).alias("tokens"))
    return graph.pair_neighbours(labelled).select("row_id", "neighbour", F.round("overlap", 6).alias("overlap"))


QUERIES = {
    f.__name__: f
    for f in (attack_similarity_edges, bipartite_edges_degree, edge_mask, sage_mean_aggregate, attention_weights, gat_layer, knn_tier_vote, exemplar_vote, leave_attack_out_baseline, leave_attack_out_macro, neighbor_pairing)
}

ONE = lambda c, values: ", ".join(f"({c} = '{v}')::INT::DOUBLE" for v in values)
FEATURES = f"[{ONE('family', graph.CATEGORIES)}, {ONE('family', graph.CATEGORIES)}, {ONE('arm', graph.ARMS)}, injected::INT::DOUBLE, (gated_asr_pct / 100)::DOUBLE, {ONE('tier', graph.TIERS)}, 1.0::DOUBLE]"


def cosine_sql(a: str, b: str) -> str:
    return f"(list_dot_product({a}, {b}) / nullif(sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b})), 0))"


FEATURED = f"f AS (SELECT attack_idx, attack_id, tier, {FEATURES} AS f FROM attacks)"
MEASURED_FEATURES = FEATURED.replace("FROM attacks", "FROM measured")
EDGES = """edges AS (SELECT row_id AS src, CAST(-1 - attack_idx AS BIGINT) AS dst, gated_flip, NOT excluded AS pass_edge,
    coalesce((fluency >= 3 OR meaning_preserved) AND flipped AND NOT excluded, FALSE) AS pass_env FROM verified
    UNION ALL SELECT CAST(-1 - attack_idx AS BIGINT), row_id, gated_flip, NOT excluded, coalesce((fluency >= 3 OR meaning_preserved) AND flipped AND NOT excluded, FALSE) FROM verified)"""

ORACLES = {
    "attack_similarity_edges": with_ctes(CTE_VERIFIED, CTE_MEASURED, MEASURED_FEATURES, "d(dims) AS (VALUES (11), (12))", f"p AS (SELECT dims, a.attack_idx AS src, b.attack_idx AS dst, {cosine_sql('a.f[1:dims]', 'b.f[1:dims]')} AS s FROM f a, f b, d WHERE a.attack_idx <> b.attack_idx)",
        then="SELECT dims, src, dst, round(s, 6) AS similarity FROM p WHERE s >= 0.65 - 1e-12"),
    "bipartite_edges_degree": with_ctes(CTE_VERIFIED, EDGES, then="SELECT dst, count(*) AS degree, count(*) FILTER (gated_flip) AS gated, count(*) FILTER (pass_edge) AS pass_edge, count(*) FILTER (pass_env) AS pass_env FROM edges GROUP BY dst"),
    "edge_mask": with_ctes(CTE_VERIFIED, EDGES, then="SELECT count(*) AS edges, count(DISTINCT src) AS nodes, count(*) FILTER (gated_flip) AS gated FROM edges WHERE src <> -20 AND dst <> -20"),
    "sage_mean_aggregate": with_ctes(CTE_VERIFIED, EDGES, f"x AS (SELECT dst, unnest(range({DIMS})) AS dim, embedding FROM edges JOIN embeddings ON vec_id = src WHERE dst < 0)",
        then="SELECT dst, count(*) AS degree, CAST(dim AS INT) AS dim, round(avg(embedding[dim + 1]::DOUBLE), 5) AS value FROM x GROUP BY dst, dim"),
    "attention_weights": with_ctes(CTE_VERIFIED, EDGES, "e AS (SELECT src, dst, list_sum(list_transform(embedding, lambda x, i: x::DOUBLE * (((i - 1) % 7 - 3) / 10.0)::DOUBLE)) + (gated_asr_pct / 100)::DOUBLE AS e FROM edges JOIN embeddings ON vec_id = src JOIN attacks ON attack_idx = -1 - dst WHERE dst < 0)",
        "l AS (SELECT src, dst, CASE WHEN e > 0 THEN e ELSE 0.2 * e END AS e FROM e)", "x AS (SELECT src, dst, exp(e - max(e) OVER (PARTITION BY dst)) AS x FROM l)", "w AS (SELECT dst, x / sum(x) OVER (PARTITION BY dst) AS w FROM x)",
        then="SELECT dst, count(*) AS n, round(sum(w), 6) AS total, round(max(w), 6) AS largest FROM w GROUP BY dst"),
    "knn_tier_vote": f"""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e, label FROM embeddings),
        p AS (SELECT q.vec_id AS id, c.vec_id AS other, c.label, round({cosine_sql('q.e', 'c.e')}, 9) AS s FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
        n AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY s DESC, other) AS nth FROM p),
        t AS (SELECT id, label, round(sum(greatest(0.1, s)), 6) AS score FROM n WHERE nth <= 5 GROUP BY id, label)
        SELECT id, label AS voted, score FROM t QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, label) = 1""",
    "exemplar_vote": with_ctes(CTE_VERIFIED, CTE_MEASURED, MEASURED_FEATURES, f"v AS (SELECT a.attack_id, a.tier, b.tier AS vote, round(sum(greatest(0.1, {cosine_sql('a.f[1:12]', 'b.f[1:12]')})), 9) AS score FROM f a JOIN f b ON a.attack_idx <> b.attack_idx GROUP BY ALL)",
        then="""SELECT attack_id, tier, vote AS predicted FROM v
        QUALIFY row_number() OVER (PARTITION BY attack_id ORDER BY score DESC, CASE vote WHEN 'POS' THEN 0 WHEN 'MID' THEN 1 ELSE 2 END) = 1"""),
    "leave_attack_out_baseline": with_ctes(CTE_VERIFIED, FEATURED, "r AS (SELECT attack_idx, avg(CAST(gated_flip AS INT)) AS rate FROM verified WHERE NOT baseline_failed GROUP BY attack_idx)",
        f"p AS (SELECT a.attack_idx AS src, b.attack_idx AS dst, round({cosine_sql('a.f[1:11]', 'b.f[1:11]')}, 9) AS s FROM f a JOIN f b ON a.attack_idx <> b.attack_idx)",
        "n AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY src ORDER BY s DESC, dst) <= 3)",
        then="""SELECT src, round(avg(rate), 6) AS predicted, round(any_value(own), 6) AS actual FROM n JOIN r ON r.attack_idx = dst JOIN (SELECT attack_idx AS src, rate AS own FROM r) USING (src) GROUP BY src"""),
    "neighbor_pairing": with_ctes(CTE_CLAIMS, r"l AS (SELECT row_id, CASE WHEN language <> 'en' THEN domain END AS domain, list_distinct(regexp_extract_all(evidence, '[^ \t\n\v\f\r]+')) AS t FROM claims WHERE label IS NOT NULL)",
        "c AS (SELECT *, domain IS NOT NULL AND count(*) OVER (PARTITION BY domain) > 1 AS together FROM l)",
        "p AS (SELECT a.row_id, b.row_id AS neighbour, round(coalesce(len(list_intersect(a.t, b.t)) / nullif(greatest(len(a.t), len(b.t)), 0), 0), 9) AS overlap FROM c a JOIN l b ON a.row_id <> b.row_id AND (NOT a.together OR a.domain = b.domain))",
        "n AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY overlap DESC, neighbour) = 1)",
        then="SELECT l.row_id, n.neighbour, round(coalesce(n.overlap, 0.0), 6) AS overlap FROM l LEFT JOIN n USING (row_id)"),
}

_z = lambda f: "[" + ", ".join(f"list_dot_product({f}, {row}::DOUBLE[])" for row in GAT_LINEAR) + "]"
_out = lambda o: f"coalesce(sum(w * z[{o + 1}]), 0) + {GAT_BIAS[o]}"

ORACLES["gat_layer"] = with_ctes(CTE_VERIFIED, FEATURED, EDGES,
    f"nodes AS (SELECT id, {_z('x')} AS z FROM (SELECT vec_id::BIGINT AS id, embedding::DOUBLE[] AS x FROM embeddings UNION ALL SELECT (-1 - attack_idx)::BIGINT, list_concat(f, list_transform(range({64 - 16}), lambda i: 0.0::DOUBLE)) FROM f))",
    f"e AS (SELECT src, dst, a.z, list_dot_product(a.z, {GAT_SOURCE}::DOUBLE[]) + list_dot_product(b.z, {GAT_TARGET}::DOUBLE[]) AS e FROM edges JOIN nodes a ON a.id = src JOIN nodes b ON b.id = dst WHERE dst < 0)",
    "l AS (SELECT src, dst, z, CASE WHEN e > 0 THEN e ELSE 0.2 * e END AS e FROM e)", "x AS (SELECT dst, z, exp(e - max(e) OVER (PARTITION BY dst)) AS x FROM l)", "w AS (SELECT dst, z, x / sum(x) OVER (PARTITION BY dst) AS w FROM x)",
    f"s AS (SELECT id, unnest(range(4))::INT AS dim, unnest([{', '.join(map(_out, range(4)))}]) AS v FROM (SELECT id FROM nodes WHERE id < 0) LEFT JOIN w ON dst = id GROUP BY id)",
    then="SELECT id, dim, round(CASE WHEN v > 0 THEN v ELSE exp(v) - 1 END, 6) AS value FROM s")
ORACLES["leave_attack_out_macro"] = f"""SELECT count(*) AS folds, round(avg(predicted), 6) AS mean_predicted, round(avg(actual), 6) AS mean_actual, round(avg(abs(predicted - actual)), 6) AS mean_error
    FROM ({ORACLES["leave_attack_out_baseline"]})"""
