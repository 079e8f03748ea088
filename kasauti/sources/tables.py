"""The claim, outcome and perturbation tables, derived from the test schema.

``CTES`` holds the same definitions in SQL, as the prefix of the oracles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fixed


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; documents in fewer partitions than there are cores are dealt out to all of them."""
    df, cores = spark.read.parquet(f"{sf_dir}/{name}.parquet"), spark.sparkContext.defaultParallelism
    return df.repartition(cores) if name == "documents" and df.rdd.getNumPartitions() < cores else df


def attacks(spark: SparkSession) -> DataFrame:
    """The 22 perturbations; small and of fixed size, so joins broadcast it."""
    rows = [(i, *a) for i, a in enumerate(fixed.ATTACKS)]
    return spark.createDataFrame(rows, "attack_idx int, attack_id string, family string, arm string, injected boolean, tier string, gated_asr_pct double, gate_mode string")


def model_votes(spark: SparkSession) -> DataFrame:
    rows = [(i, model, vote) for i, votes in enumerate(fixed.VOTES) for model, vote in zip(fixed.MODELS, votes.split())]
    return spark.createDataFrame(rows, "attack_idx int, model string, predicted string")


#: What the claims read from a document's text.
EVIDENCE = "substr(text, 201)"


def claims(spark: SparkSession, sf_dir: str, **more: Column) -> DataFrame:
    """row_id, claim, evidence, language, domain, label of every document, and ``more`` columns of it.

    All are taken from the text before the labels are joined, so only what is used later moves.
    """
    labels = read(spark, sf_dir, "labels")
    label = F.when(F.col("toxic") == 1, "NEI").when(F.col("quality") == 1, "SUP").when(F.col("quality") == 0, "REF")
    told = {"claim": F.substring("text", 1, 200), "evidence": F.expr(EVIDENCE), "language": F.col("lang"), "domain": F.col("source")} | more
    docs = read(spark, sf_dir, "documents").select("doc_id", *(c.alias(name) for name, c in told.items()))
    kept = [c for c in told if c not in more]
    return docs.join(labels, "doc_id", "left").select(F.col("doc_id").alias("row_id"), *kept, label.alias("label"), *more)


def evidences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """row_id, domain and evidence of every document, without its label."""
    return read(spark, sf_dir, "documents").select(F.col("doc_id").alias("row_id"), F.col("source").alias("domain"), F.expr(EVIDENCE).alias("evidence"))


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each claim (order) and perturbation tried on it (first line item of its part class)."""
    first = F.min(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_returnflag", "l_tax", "l_discount"))
    # Dealt out by claim once: the grouping, the join with the orders and later groupings by claim all keep to it.
    cells = (
        read(spark, sf_dir, "lineitem")
        .repartition("l_orderkey")
        .groupBy(F.col("l_orderkey").alias("row_id"), (F.col("l_partkey") % 22).cast("int").alias("attack_idx"))
        .agg(first.alias("x"))
        .select(
            "row_id",
            "attack_idx",
            F.expr("CASE WHEN x.l_tax >= 0.08 THEN NULL WHEN x.l_returnflag = 'A' THEN 'SUP' WHEN x.l_returnflag = 'R' THEN 'REF' WHEN x.l_returnflag = 'N' THEN 'NEI' END").alias("verdict"),
            F.expr("1 + CAST(x.l_quantity AS INT) % 5").alias("fluency"),
            F.expr("x.l_discount < 0.07").alias("meaning_preserved"),
        )
    )
    claim = read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("row_id"),
        F.expr("CASE o_custkey % 3 WHEN 0 THEN 'SUP' WHEN 1 THEN 'REF' ELSE 'NEI' END").alias("gold_label"),
        F.expr("o_orderstatus = 'P'").alias("baseline_failed"),
        F.col("o_orderpriority").alias("domain"),
    )
    return cells.join(claim, "row_id")


def _values(rows: list[tuple]) -> str:
    def show(v: object) -> str:
        return str(v).upper() if isinstance(v, bool) else f"'{v}'" if isinstance(v, str) else repr(v)

    return ", ".join(f"({', '.join(map(show, r))})" for r in rows)


CTE_ATTACKS = f"""attacks(attack_idx, attack_id, family, arm, injected, tier, gated_asr_pct, gate_mode) AS (
    VALUES {_values([(i, *a) for i, a in enumerate(fixed.ATTACKS)])})"""

CTE_VOTES = f"""votes(attack_idx, model, predicted) AS (
    VALUES {_values([(i, m, v) for i, votes in enumerate(fixed.VOTES) for m, v in zip(fixed.MODELS, votes.split())])})"""

CTE_CLAIMS = """claims AS (
    SELECT d.doc_id AS row_id, substr(d.text, 1, 200) AS claim, substr(d.text, 201) AS evidence, d.lang AS language, d.source AS domain,
        CASE WHEN l.toxic = 1 THEN 'NEI' WHEN l.quality = 1 THEN 'SUP' WHEN l.quality = 0 THEN 'REF' END AS label
    FROM documents d LEFT JOIN labels l USING (doc_id))"""

CTE_OUTCOMES = """cells AS (
    SELECT l_orderkey AS row_id, CAST(l_partkey % 22 AS INT) AS attack_idx, l_returnflag, l_tax, l_quantity, l_discount,
        row_number() OVER (PARTITION BY l_orderkey, l_partkey % 22
            ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_returnflag, l_tax, l_discount) AS nth
    FROM lineitem),
outcomes AS (
    SELECT row_id, attack_idx,
        CASE WHEN l_tax >= 0.08 THEN NULL WHEN l_returnflag = 'A' THEN 'SUP' WHEN l_returnflag = 'R' THEN 'REF' WHEN l_returnflag = 'N' THEN 'NEI' END AS verdict,
        1 + CAST(l_quantity AS INT) % 5 AS fluency, l_discount < 0.07 AS meaning_preserved,
        CASE o_custkey % 3 WHEN 0 THEN 'SUP' WHEN 1 THEN 'REF' ELSE 'NEI' END AS gold_label,
        o_orderstatus = 'P' AS baseline_failed, o_orderpriority AS domain
    FROM cells JOIN orders ON o_orderkey = row_id WHERE nth = 1)"""

CTE_VERIFIED = f"""{CTE_ATTACKS}, {CTE_OUTCOMES},
decided AS (
    SELECT o.*, a.attack_id, a.family, a.arm, a.tier, a.gate_mode, a.gated_asr_pct,
        CASE WHEN baseline_failed THEN 'baseline_failure' WHEN verdict IS NULL THEN 'unusable_verdict' WHEN verdict = gold_label THEN 'no_flip' ELSE 'flip' END AS reason
    FROM outcomes o JOIN attacks a USING (attack_idx)),
gated AS (
    SELECT *, reason = 'flip' AS flipped,
        CASE WHEN reason <> 'flip' THEN NULL WHEN gate_mode = 'none' THEN 'pass' WHEN fluency IS NULL THEN 'judge_unavailable'
            WHEN gate_mode = 'meaning' AND meaning_preserved = FALSE THEN 'meaning_drift' WHEN fluency < 3 THEN 'poor_fluency' ELSE 'pass' END AS gate_reason
    FROM decided),
verified AS (
    SELECT *, flipped AND gate_reason <> 'pass' AS excluded, flipped AND gate_reason = 'pass' AS gated_flip FROM gated)"""


def with_ctes(*ctes: str, then: str) -> str:
    return f"WITH {', '.join(ctes)} {then}"
