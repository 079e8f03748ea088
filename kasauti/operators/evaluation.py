"""Evaluation statistics over predictions: confusion, agreement, ranking and paired tests."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.stats import MORE, WIDE, kappa, log_factorial, ratio
from ..functions.tails import t_two_sided


def confusion(df: DataFrame, truth: str, predicted: str, *keys: str) -> DataFrame:
    return df.groupBy(*keys, F.col(truth).alias("truth"), F.col(predicted).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))


def agreement(df: DataFrame, truth: str, predicted: str, *keys: str) -> DataFrame:
    """Accuracy, macro-F1 (classes of truth or prediction, empty ones 0), balanced accuracy and Cohen's kappa of each group."""
    cells = confusion(df, truth, predicted, *keys)
    by_truth = cells.groupBy(*keys, F.col("truth").alias("label")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("truth") == F.col("predicted"), F.col("n")).otherwise(0)).alias("hits"))
    by_guess = cells.groupBy(*keys, F.col("predicted").alias("label")).agg(F.sum("n").alias("guesses"))
    each = by_truth.join(by_guess, [*keys, "label"], "full").na.fill(0, ["support", "hits", "guesses"])
    f1 = F.when(F.col("support") + F.col("guesses") > 0, 2.0 * F.col("hits") / (F.col("support") + F.col("guesses"))).otherwise(0.0)
    total = F.sum("support")
    out = each.groupBy(*keys).agg(
        total.alias("n"),
        (F.sum("hits") / total).alias("accuracy"),
        F.avg(f1).alias("macro_f1"),
        F.avg(F.when(F.col("support") > 0, F.col("hits") / F.col("support"))).alias("balanced_accuracy"),
        (F.sum(F.col("support").cast("double") * F.col("guesses")) / (total * total)).alias("chance"),
    )
    return out.withColumn("kappa", kappa(F.col("accuracy"), F.col("chance"))).drop("chance")


def ranking(df: DataFrame, score: str, hit: str, *keys: str, parts: int = 64) -> DataFrame:
    """AUROC (mid-ranks) and average precision; 0.5 and the base rate where all cases are of one class.

    Rows are met as counts of distinct scores. A key's scores are cut at approximate
    quantiles into at most ``parts`` + 2 spans: running totals of the spans, then of
    the scores within each, so that no key's scores meet in one task. Where the cuts
    fall changes the work alone. A null score comes last; null keys are a key.
    """
    steps = df.groupBy(*keys, F.col(score).alias("s")).agg(F.count_if(F.col(hit)).alias("p"), F.count_if(~F.col(hit)).alias("q")).withColumn("__all", F.lit(0))
    by = [*keys, "__all"]
    spanned = spans(steps, by, parts)
    down = Window.partitionBy(*by, "__span").orderBy(F.desc("s")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = spanned.withColumn("tp", F.sum("p").over(down) + F.col("__p")).withColumn("fp", F.sum("q").over(down) + F.col("__q"))
    wins = F.sum(F.col("q") * (F.col("tp") - F.col("p") / 2.0))
    out = run.groupBy(*by).agg(F.sum("p").alias("hits"), F.sum("q").alias("misses"), wins.alias("wins"), F.sum(F.col("p") * F.col("tp") / (F.col("tp") + F.col("fp"))).alias("area"))
    h, m = F.col("hits"), F.col("misses")
    one = (h == 0) | (m == 0)
    return out.select(*keys, "hits", "misses", F.when(one, 0.5).otherwise(F.col("wins") / (h * m)).alias("auroc"), F.when(one, h / (h + m)).otherwise(F.col("area") / h).alias("auprc"))


def spans(steps: DataFrame, by: list[str], parts: int) -> DataFrame:
    """``steps`` (s, p, q of each key ``by``) with __span, higher scores first, and the key's p and q in earlier spans."""
    cuts = steps.groupBy(*by).agg(F.percentile_approx("s", [i / parts for i in range(1, parts)], 100 * parts).alias("__cuts"))
    place = F.when(F.col("s").isNull(), parts + 1).otherwise(F.coalesce(F.size(F.filter("__cuts", lambda c: c > F.col("s"))), F.lit(0)))
    placed = _beside(steps, cuts, by).withColumn("__span", place).drop("__cuts")
    totals = placed.groupBy(*by, "__span").agg(F.sum("p").alias("__p"), F.sum("q").alias("__q"))
    earlier = Window.partitionBy(*by).orderBy("__span").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(*by, "__span", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(c) for c in ("__p", "__q")])
    return _beside(placed, before, [*by, "__span"])


def _beside(rows: DataFrame, table: DataFrame, by: list[str]) -> DataFrame:
    """``rows`` with the columns of ``table``, which has a row for each of their keys; nulls are equal."""
    named = table.select(*[F.col(c).alias(f"__of_{c}") for c in by], *[c for c in table.columns if c not in by])
    met = reduce(lambda x, c: x & c, [F.col(c).eqNullSafe(F.col(f"__of_{c}")) for c in by])
    return rows.join(named, met).drop(*[f"__of_{c}" for c in by])


def majority(votes: DataFrame, vote: str, *keys: str) -> DataFrame:
    """The most frequent vote; ties go to the first in the alphabet."""
    counts = votes.groupBy(*keys, vote).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(*keys).agg(F.min(F.struct((-F.col("n")).alias("no"), F.col(vote).alias("v"))).alias("x")).select(*keys, F.col("x.v").alias("consensus"))


def fisher_greater(counts: DataFrame, tests: int) -> DataFrame:
    """p and Bonferroni-corrected p that a group's hits exceed chance: columns k (hits), n (group), all_k (all hits), all_n (all).

    Terms further than ``WIDE`` deviations from both the mean and k are left out,
    so the sequence grows with the deviation and not with the counts.
    """
    choose = lambda a, b: log_factorial(a) - log_factorial(b) - log_factorial(a - b)
    k, n, big_k, big_n = (F.col(c).cast("long") for c in ("k", "n", "all_k", "all_n"))
    term = lambda i: F.exp(choose(big_k, i) + choose(big_n - big_k, n - i) - choose(big_n, n))
    mean = n.cast("double") * big_k / big_n
    spread = F.ceil(WIDE * F.sqrt(mean * (1 - big_k / big_n) * (big_n - n) / F.greatest(F.lit(1), big_n - 1))) + MORE
    first = F.greatest(k, n + big_k - big_n, F.floor(mean) - spread)
    last = F.greatest(first, F.least(n, big_k, F.greatest(k, F.ceil(mean)) + spread))
    tail = F.aggregate(F.sequence(first, last), F.lit(0.0), lambda s, i: s + term(i))
    p = F.when(k > F.least(n, big_k), 0.0).otherwise(F.least(F.lit(1.0), tail))
    return counts.withColumn("p", p).withColumn("p_bonferroni", F.least(F.lit(1.0), F.col("p") * tests))


#: Words in the name of a perturbation nobody measured, its tier, probability of success and scope, first match first; fixed values.
CASCADE = [
    (["multi-hop", "hop"], "MID", 0.35, "untestable"),
    (["gradient", "hotflip", "embedding"], "POS", 0.70, "untestable"),
    (["evidence", "retrieval", "corpus"], "POS", 0.58, "testable"),
    (["char", "keyboard", "visual"], "NEG", 0.03, "testable"),
]
OTHERWISE = ("MID", 0.22, "testable")


def unmeasured(df: DataFrame, name: str) -> DataFrame:
    """``df`` with tier, probability, scope and priority by the words in ``name`` (null: as a name without any)."""
    low = F.coalesce(F.lower(F.col(name)), F.lit(""))
    outcome = lambda t, p, s: F.struct(F.lit(t).alias("tier"), F.lit(p).alias("probability"), F.lit(s).alias("scope"))
    found = outcome(*OTHERWISE)
    for words, *given in reversed(CASCADE):
        found = F.when(reduce(or_, [F.contains(low, F.lit(w)) for w in words]), outcome(*given)).otherwise(found)
    rated = df.withColumn("__found", found).select(*df.columns, "__found.*")
    urgent = (F.col("tier") == "POS") & (F.col("scope") == "testable")
    return rated.withColumn("priority", F.when(urgent, "High").when(F.col("tier") == "MID", "Medium").otherwise("Low"))


def ranked(df: DataFrame, score: str, id_col: str) -> DataFrame:
    """``df`` with rank (from 1) by falling score, then rising integer id.

    Spans of 65,536 ids are numbered on their own; what stands before each comes
    from counts, so neither one score nor all rows meet in a task.
    """
    spans = df.withColumn("__span", F.shiftright(F.col(id_col).cast("long"), 16))
    sizes = spans.groupBy(score, "__span").agg(F.count(F.lit(1)).alias("__n"))
    whole = Window.partitionBy(F.lit(1)).orderBy(F.desc(score), "__span").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select(score, "__span", F.coalesce(F.sum("__n").over(whole), F.lit(0)).alias("__before"))
    own = F.row_number().over(Window.partitionBy(score, "__span").orderBy(id_col))
    return spans.withColumn("__own", own).join(before, [score, "__span"]).withColumn("rank", F.col("__own") + F.col("__before")).drop("__own", "__before", "__span")


def paired_t(df: DataFrame, a: str, b: str) -> DataFrame:
    """n, mean_difference, t and the two-sided p of the rows that have both; t and p are null of fewer than two, or of differences that are all the same."""
    d = F.col(a) - F.col(b)
    out = df.agg(F.count(d).alias("n"), F.avg(d).alias("mean_difference"), ratio(F.avg(d) * F.sqrt(F.count(d)), F.stddev_samp(d)).alias("t"))
    return out.withColumn("p", t_two_sided(F.col("t"), F.col("n") - 1))
