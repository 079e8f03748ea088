"""Generated texts, source records, feature vectors and exemplars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType
from pyspark.sql.window import Window

from ..functions.picks import digest
from ..functions.text import squeeze, tokens
from ..functions.verdicts import clean_response, is_usable
from .graph import attack_features, cosine, pair_neighbours

# What each model-backed perturbation writes and aims at, whether NEI claims are spared, whether evidence is injected, what a record must have,
# the reason where it has not, and where nothing usable was written.
GENERATORS = [
    ("CA_06_FactMixing", "claim", "NEI", False, False, "pair", "missing_evidence_pair", "llm_generation_failed"),
    ("CA_07_AdvTrigger", "trigger", "same_as_gold", False, False, "label", "missing_claim_or_label", "llm_generation_failed"),
    ("CA_16_Colloquial", "claim", "same_as_gold", False, False, "claim", "missing_claim", "llm_generation_failed"),
    ("EA_ADVADD_01_AdvAdd", "evidence", "REF", False, True, "claim", "missing_claim", "llm_generation_failed"),
    ("EA_CLAIMREWRITE_01_ClaimRewrite", "evidence", "SUP", True, False, "evidence", "missing_claim_or_evidence", "llm_generation_failed"),
    ("EA_CTXREP_01_ContextualizedReplace", "evidence", "REF", False, False, "evidence", "missing_claim_or_evidence", "llm_generation_failed"),
    ("EA_FACT2FICT_01_Fact2Fiction", "evidence", "REF", True, True, "claim", "missing_claim", "executor_failed"),
]


def apply_generated(claims: DataFrame, generated: DataFrame) -> DataFrame:
    """Attacked records from ``generated`` (row_id, attack_id, text): adversarial claim or evidence, target, and why one was skipped.

    Facts are mixed of the claim's evidence and its ``neighbor_evidence``
    (:func:`with_neighbours`); without that column there is no pair. Where a column
    ``has_evidence`` or ``has_neighbor_evidence`` says whether there is a text, the text is
    not read. The texts of a row meet its claim once, not once for each perturbation.
    """
    spec = claims.sparkSession.createDataFrame(GENERATORS, "attack_id string, writes string, target string, spares_nei boolean, injected boolean, needs string, missing string, failed string")

    def has(c: str) -> Column:
        if f"has_{c}" in claims.columns:
            return F.coalesce(F.col(f"has_{c}"), F.lit(False))
        return F.coalesce(F.col(c), F.lit("")) != "" if c in claims.columns else F.lit(False)

    own = claims.select("row_id", "claim", "label", has("evidence").alias("has_evidence"), has("neighbor_evidence").alias("has_neighbor"))
    texts = generated.groupBy("row_id").agg(F.collect_list(F.struct("attack_id", "text")).alias("texts"))
    one = F.transform(F.filter("texts", lambda x: x["attack_id"] == F.col("attack_id")), lambda x: x["text"])
    cells = own.join(texts, "row_id", "left").join(F.broadcast(spec)).withColumn("text", F.explode_outer(one))
    clean = clean_response(F.col("text"))
    empty = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    lacks = empty("claim") | (F.col("needs").isin("pair", "evidence") & ~F.col("has_evidence")) | ((F.col("needs") == "pair") & ~F.col("has_neighbor")) | ((F.col("needs") == "label") & empty("label"))
    skip = (
        F.when(lacks, F.col("missing"))
        .when(F.col("spares_nei") & F.col("label").eqNullSafe("NEI"), "nei_claim_not_targeted")
        .when(~F.coalesce(is_usable(clean), F.lit(False)), F.col("failed"))
    )
    told = cells.withColumn("clean", clean).withColumn("skip_reason", skip)
    ok = F.col("skip_reason").isNull()
    return told.select(
        "row_id",
        "attack_id",
        F.when(ok & (F.col("writes") == "claim"), F.col("clean")).when(ok & (F.col("writes") == "trigger"), F.concat_ws(" ", "clean", "claim")).alias("adversarial_claim"),
        F.when(ok & (F.col("writes") == "evidence"), F.col("clean")).alias("adversarial_evidence"),
        F.when(F.col("target") == "same_as_gold", F.col("label")).otherwise(F.col("target")).alias("target_label"),
        F.col("injected").alias("injected_evidence_workaround"),
        "skip_reason",
    )


def with_neighbours(claims: DataFrame, evidences: DataFrame | None = None, whole: bool = True) -> DataFrame:
    """``claims`` with neighbor_evidence: that of the row whose evidence is most like the own one (:func:`pair_neighbours`).

    ``evidences`` (row_id, domain, evidence) is where evidences are read, if not from ``claims``. Without ``whole`` only
    has_neighbor_evidence is told, whether there is such a text.
    """
    found = claims if evidences is None else evidences
    pairs = pair_neighbours(found.select("row_id", "domain", F.array_distinct(tokens(F.coalesce("evidence", F.lit("")))).alias("tokens"))).select("row_id", "neighbour")
    text = F.col("evidence").alias("neighbor_evidence") if whole else (F.coalesce("evidence", F.lit("")) != "").alias("has_neighbor_evidence")
    told = pairs.join(found.select(F.col("row_id").alias("neighbour"), text), "neighbour").drop("neighbour")
    return claims.join(told, "row_id", "left")


def sub_questions(c: Column, most: int = 4) -> Column:
    """The questions of a planner's JSON object (none if it names none), else up to ``most`` lines without bullets that have more than three characters."""
    is_object = F.try_parse_json(c).isNotNull() & F.ltrim(c).startswith("{")
    told = F.when(is_object, F.coalesce(F.from_json(c, "sub_questions array<string>")["sub_questions"], F.array().cast("array<string>")))
    lines = F.transform(F.split(c, "\n"), lambda x: F.trim(F.regexp_replace(x, r"^[\d\-*\s.]+", "")))
    return F.coalesce(told, F.slice(F.filter(lines, lambda x: F.char_length(x) > 3), 1, most))


def with_source(records: DataFrame, claims: DataFrame) -> DataFrame:
    """``records`` beside their claims; those without one say missing_source_row."""
    own = claims.select("row_id", F.lit(True).alias("found"), "claim", "label")
    return records.join(own, "row_id", "left").withColumn("skip_reason", F.when(F.col("found").isNull(), "missing_source_row")).drop("found")


def results(attacked: DataFrame, claims: DataFrame, verified: DataFrame) -> DataFrame:
    """A row of text for each attacked record, with its claim and what was made of it; '' where there is none, white space made single spaces.

    ``verified`` has each row_id and attack_id once; rows without a verdict keep their claim.
    """
    own = claims.select("row_id", F.col("claim").alias("original_claim"), F.col("evidence").alias("original_evidence"), F.col("label").alias("gold_label"))
    judged = ["flipped", "reason", "fluency", "meaning_preserved", "excluded", "gate_reason"]
    said = verified.select("row_id", "attack_id", "verdict", F.col("verdict_raw") if "verdict_raw" in verified.columns else F.lit("").alias("verdict_raw"), *judged)
    joined = attacked.drop("gold_label").join(own, "row_id", "left").join(said, ["row_id", "attack_id"], "left")
    one = lambda c: F.coalesce(squeeze(F.col(c)), F.lit("")).alias(c)
    told = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    texts = ["original_claim", "original_evidence", "adversarial_claim", "adversarial_evidence"]
    return joined.select("row_id", "attack_id", *map(one, texts), told("gold_label"), told("verdict"), one("verdict_raw"), *map(told, judged))


def mean_pool(vectors: DataFrame, key: str, mask: Column, dims: int, vector: str = "features") -> DataFrame:
    """key and pooled: the mean of each group's vectors that the mask lets through."""
    sums = vectors.filter(mask).groupBy(key).agg(*[F.avg(F.get(vector, F.lit(i)).cast("double")).alias(f"m{i}") for i in range(dims)])
    return sums.select(key, F.array(*[f"m{i}" for i in range(dims)]).alias("pooled"))


def pool_tokens(df: DataFrame, key: str, tokens: str, mask: str, dims: int, most: int = 128) -> DataFrame:
    """key and pooled: the mean of a text's token vectors that its attention mask counts, as a sentence encoder pools them.

    ``tokens`` is an array of arrays of ``dims`` numbers, ``mask`` an array of numbers
    beside it; tokens beyond the encoder's limit ``most`` count for nothing, as
    published. A token is not counted where its mask is 0, null or missing, or where it is null, has a null or another
    width. Without counted tokens the mean is all zeros; null tokens give null. A row
    for each row. The sums of all texts of an Arrow batch are taken at once.
    """
    token = lambda x, i: (F.coalesce(F.get(mask, i).cast("double"), F.lit(0.0)) != 0) & (F.size(F.filter(x, lambda v: v.isNotNull())) == dims) & (F.size(x) == dims)
    kept = df.select(key, F.filter(F.slice(tokens, 1, most), token).alias("kept"))

    def pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("kept")
            counts = pc.fill_null(pc.list_value_length(texts), 0).to_numpy(zero_copy_only=False)
            numbers = texts.flatten().flatten().to_numpy(zero_copy_only=False).reshape(-1, dims).astype(np.float64)
            means = np.zeros((len(counts), dims))
            some = counts > 0
            if some.any():
                means[some] = np.add.reduceat(numbers, (np.cumsum(counts) - counts)[some], axis=0) / counts[some, None]
            offsets = pa.array(np.arange(0, dims * len(counts) + 1, dims, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.ListArray.from_arrays(offsets, pa.array(means.ravel()), mask=texts.is_null())], names=[key, "pooled"])

    return kept.mapInArrow(pool, StructType([kept.schema[key], StructField("pooled", ArrayType(DoubleType()))]))


def pair_state(attacks: DataFrame) -> DataFrame:
    """target, candidate and the 34 numbers that describe a candidate exemplar of a target before any was chosen."""
    a = attacks.select("attack_idx", "family", "arm", "injected", attack_features().alias("f"))
    t = a.select(F.col("attack_idx").alias("target"), F.col("family").alias("tf"), F.col("arm").alias("ta"), F.col("injected").cast("double").alias("ti"), F.slice("f", 1, 12).alias("v"))
    c = a.select(F.col("attack_idx").alias("candidate"), "family", "arm", "f")
    same = lambda x, y: (F.col(x) == F.col(y)).cast("double")
    extra = F.array(cosine(F.col("v"), F.slice("f", 1, 12)), F.lit(0.0), same("tf", "family"), same("tf", "family"), same("ta", "arm"), F.col("ti"))
    return t.join(F.broadcast(c), F.col("target") != F.col("candidate")).select("target", "candidate", F.concat("v", "f", extra).alias("state"))


def ablated(vector: Column, first: int) -> Column:
    """``vector`` with its first numbers set to 0."""
    return F.transform(vector, lambda x, i: F.when(i < first, F.lit(0.0)).otherwise(x.cast("double")))


def augmented_state(state: Column, own: Column, untried: Column, dims: int) -> Column:
    """state, the claim's embedding, and the mean of the embeddings (an array of arrays) of what was not tried yet."""
    n = F.greatest(F.size(untried), F.lit(1))
    total = lambda i: F.aggregate(untried, F.lit(0.0), lambda s, v: s + F.get(v, F.lit(i)).cast("double"))
    mean = F.array(*[total(i) / n for i in range(dims)])
    return F.concat(state, own, mean)


def random_exemplars(attacks: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """target and exemplar: k others of each, without replacement, in hash order."""
    t, o = attacks.select(F.col("attack_idx").alias("target")), attacks.select(F.col("attack_idx").alias("exemplar"))
    order = Window.partitionBy("target").orderBy(digest(F.col("target"), F.col("exemplar"), seed=seed))
    return t.join(F.broadcast(o), F.col("target") != F.col("exemplar")).withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= k).select("target", "exemplar")


def best_setting(scores: DataFrame, setting: str, score: str) -> DataFrame:
    """The setting with the best score; of equal ones the first."""
    return scores.groupBy().agg(F.min(F.struct((-F.col(score)).alias("no"), F.col(setting).alias("s"))).alias("x")).select(F.col("x.s").alias(setting), (-F.col("x.no")).alias(score))
