"""Stratified samples, splits of exact sizes, folds and resampling, all by hash order."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.picks import digest
from .lineage import cut


#: Hex digits of a hash range: 65,536 ranges of each stratum, so that none holds more than some millions of 100 billion rows.
RANGE_DIGITS = 4


def ranges(df: DataFrame, purpose: str, id_col: str, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """``df`` with its hash and range, and a row for each range of each stratum ``keys``: the rows before it and the stratum's total.

    Only counts meet the windows.
    """
    keyed = df.withColumn("__key", digest(F.col(id_col), purpose)).withColumn("__range", F.substring("__key", 1, RANGE_DIGITS))
    sizes = keyed.groupBy(*keys, "__range").agg(F.count(F.lit(1)).alias("__n"))
    stratum = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1))
    before = F.coalesce(F.sum("__n").over(stratum.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return keyed, sizes.select(*keys, "__range", before.alias("__before"), F.sum("__n").over(stratum).alias("total"))


def stratified(df: DataFrame, domain: str, label: str, per_domain: int | DataFrame, labels: list[str], id_col: str = "row_id") -> DataFrame:
    """``per_domain`` rows of each domain, as equal over labels as the rows allow.

    ``per_domain`` is a number for all domains or a table of domain and target (each
    domain once, of a size to broadcast; domains without a target give no rows). Each
    label may give a share of per_domain // len(labels), the largest label
    also the remainder; what a label lacks is filled from the others' surplus,
    largest surplus first. Counts of hash ranges tell which ranges reach into the
    sample; only their rows are ordered, so a stratum is never in one task.
    """
    keyed, sizes = ranges(df, "sample", id_col, [domain, label])
    counts = sizes.groupBy(domain, label).agg(F.max("total").alias("have"))
    if isinstance(per_domain, DataFrame):
        targets = per_domain.select(F.col(per_domain.columns[0]).alias(domain), F.greatest(F.lit(0), F.col("target")).cast("int").alias("__target"))
        counts = counts.join(F.broadcast(targets), domain)
    else:
        counts = counts.withColumn("__target", F.lit(per_domain))
    size_order = Window.partitionBy(domain).orderBy(F.desc("have"), label)
    base, rest = F.floor(F.col("__target") / len(labels)).cast("int"), F.col("__target") % len(labels)
    want = counts.withColumn("want", base + F.when(F.row_number().over(size_order) == 1, rest).otherwise(0))
    took = want.withColumn("take", F.least("have", "want")).withColumn("surplus", F.col("have") - F.col("take"))
    short = (F.col("__target") - F.sum("take").over(Window.partitionBy(domain))).alias("short")
    before = F.coalesce(F.sum("surplus").over(Window.partitionBy(domain).orderBy(F.desc("surplus"), label).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    filled = took.withColumn("short", short).withColumn("before", before)
    extra = F.greatest(F.lit(0), F.least(F.col("surplus"), F.col("short") - F.col("before")))
    quota = filled.select(domain, label, (F.col("take") + extra).alias("quota"))
    reached = sizes.join(quota, [domain, label]).filter(F.col("__before") < F.col("quota")).select(domain, label, "__range", "__before", "quota")
    nth = F.row_number().over(Window.partitionBy(domain, label, "__range").orderBy("__key", id_col))
    chosen = keyed.join(reached, [domain, label, "__range"]).withColumn("nth", nth + F.col("__before"))
    return chosen.filter(F.col("nth") <= F.col("quota")).drop("nth", "quota", "__key", "__range", "__before")


def numbered(df: DataFrame, order: list[Column], id_col: str = "row_id") -> DataFrame:
    """``df`` with nth (from 1) and total in hash order, without a window over all rows: counts of hash ranges are summed instead."""
    keyed, offsets = ranges(df, "split", id_col, [])
    own = F.row_number().over(Window.partitionBy("__range").orderBy("__key", *order))
    return keyed.join(F.broadcast(offsets), "__range").withColumn("nth", own + F.col("__before")).drop("__key", "__range", "__before")


def split_60_20_20(df: DataFrame, id_col: str = "row_id") -> DataFrame:
    """``df`` with split: train, val or test, of floor(.6 n), floor(.2 n) and the rest."""
    rows = numbered(df, [F.col(id_col)], id_col)
    train, val = F.floor(F.col("total") * 6 / 10), F.floor(F.col("total") * 2 / 10)
    return rows.withColumn("split", F.when(F.col("nth") <= train, "train").when(F.col("nth") <= train + val, "val").otherwise("test")).drop("nth", "total")


def folds(df: DataFrame, k: int = 5, id_col: str = "row_id") -> DataFrame:
    """``df`` with fold 1 to k; the first n % k folds have one row more."""
    rows = numbered(df, [F.col(id_col)], id_col)
    small, large = F.floor(F.col("total") / k), F.col("total") % k
    cut = large * (small + 1)
    fold = F.when(F.col("nth") <= cut, F.floor((F.col("nth") - 1) / (small + 1)) + 1).otherwise(large + F.floor((F.col("nth") - 1 - cut) / small) + 1)
    return rows.withColumn("fold", fold.cast("int")).drop("nth", "total")


def poisson_steps(bits: int = 16) -> list[int]:
    """Shares of 2 ** bits below which a draw of the Poisson distribution of mean 1 is 0, at most 1, at most 2, ..."""
    steps, share, term, n = [], 0.0, math.exp(-1.0), 0
    while not steps or steps[-1] < 2**bits - 1:
        share, n = share + term, n + 1
        term /= n
        steps.append(min(2**bits - 1, round(share * 2**bits)))
    return steps


#: Draws that one digest of 32 hex digits gives, and the digits of one.
DRAWS, DIGITS = 8, 4


def bootstrap_means(values: DataFrame, draws: int, value: str, id_col: str = "row_id") -> DataFrame:
    """draw and mean of ``draws`` resamples.

    How often a row stands in a resample is Poisson distributed with mean 1, by
    hash of row and draw: the form of resampling with replacement that needs no
    row to know the others. Sums are formed where the rows are and only
    draws x tasks of them are shuffled. A draw that takes no row has a null mean.
    """
    steps = [format(x, f"0{DIGITS}x") for x in poisson_steps(4 * DIGITS)]
    group = values.select(value, F.col(id_col).alias("__id"), F.explode(F.sequence(F.lit(0), F.lit((draws - 1) // DRAWS))).alias("__group"))
    hashed = group.withColumn("__key", digest(F.col("__group"), F.col("__id"), "bootstrap"))
    part = lambda i: F.substring("__key", 1 + DIGITS * i, DIGITS)
    times = lambda i: sum(((part(i) >= x).cast("long") for x in steps[1:]), (part(i) >= steps[0]).cast("long"))
    sums = [f(i).alias(f"{n}{i}") for i in range(DRAWS) for n, f in (("w", lambda i: F.sum(times(i))), ("s", lambda i: F.sum(times(i) * F.col(value))))]
    each = hashed.groupBy("__group").agg(*sums)
    rows = F.array(*[F.struct((F.col("__group") * DRAWS + i).alias("draw"), F.col(f"w{i}").alias("w"), F.col(f"s{i}").alias("s")) for i in range(DRAWS)])
    out = each.select(F.explode(rows).alias("x")).select("x.*").filter(F.col("draw") < draws)
    return out.select("draw", (F.col("s") / F.nullif(F.col("w"), F.lit(0))).alias("mean"))


class Splits:
    """How often each leaf is drawn in ``draws`` resamples of as many rows as there are.

    The leaves' rows are split in two again and again; at each node a binomial number
    of the draws goes left. A node has its own stream of random numbers, so every task
    finds the same numbers from the leaves' sizes alone, in as many steps as the tree
    is deep.
    """

    def __init__(self, sizes: np.ndarray, draws: int, seed: int):
        self.before = np.concatenate([[0], np.cumsum(sizes)])
        self.draws, self.seed = draws, seed

    def stream(self, *place: int) -> np.random.Generator:
        return np.random.default_rng([self.seed, *place])

    def drawn(self, leaf: int) -> np.ndarray:
        low, high, depth = 0, len(self.before) - 1, 0
        taken = np.full(self.draws, self.before[-1])
        while high - low > 1:
            middle = (low + high) // 2
            all_rows, left_rows = self.before[high] - self.before[low], self.before[middle] - self.before[low]
            left = self.stream(depth, low).binomial(taken, left_rows / all_rows)
            taken, low, high = (left, low, middle) if leaf < middle else (taken - left, middle, high)
            depth += 1
        return taken


def exact_bootstrap(values: DataFrame, columns: list[str], draws: int = 10_000, seed: int = 42, bits: int = 10) -> DataFrame:
    """draw, n and the mean of each column in ``draws`` resamples of exactly as many rows, with replacement.

    Rows that are alike are one cell and its count, formed where they are, so work
    grows with different rows and not with rows. Cells are dealt to 2 ** ``bits``
    leaves by hash; a leaf's share of each draw is split over its cells one by one, as
    they stream by. A task holds draws x columns sums, which are all that is shuffled;
    the leaves' sizes, at most 2 ** ``bits``, pass the driver. Rows with a null are
    left out; no rows give no draws.
    """
    cells = values.select(*[F.col(c).cast("double").alias(c) for c in columns]).na.drop().groupBy(*columns).agg(F.count(F.lit(1)).alias("__n"))
    cells = cut(cells.withColumn("__leaf", F.pmod(F.xxhash64(*columns), F.lit(2**bits)).cast("int")))
    sizes = np.zeros(2**bits, dtype=np.int64)
    for r in cells.groupBy("__leaf").agg(F.sum("__n").alias("n")).collect():
        sizes[r["__leaf"]] = r["n"]
    splits, total, apart = Splits(sizes, draws, seed), int(sizes.sum()), bits + 1

    def resample(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums, weight, leaf = np.zeros((draws, len(columns))), np.zeros(draws, dtype=np.int64), None
        for batch in batches:
            for at, n, *cell in zip(batch["__leaf"], batch["__n"], *[batch[c] for c in columns]):
                if at != leaf:
                    leaf, left, rows, stream = at, splits.drawn(at), int(sizes[at]), splits.stream(apart, at)
                taken = left if n == rows else stream.binomial(left, n / rows)
                left, rows = left - taken, rows - n
                weight += taken
                sums += taken[:, None] * np.array(cell)
        if leaf is not None:
            yield pd.DataFrame({"draw": np.arange(draws), "w": weight, **{f"s{i}": sums[:, i] for i in range(len(columns))}})

    schema = "draw int, w long, " + ", ".join(f"s{i} double" for i in range(len(columns)))
    parts = cells.repartition("__leaf").sortWithinPartitions("__leaf", *columns).mapInPandas(resample, schema)
    out = parts.groupBy("draw").agg(F.sum("w").alias("n"), *[F.sum(f"s{i}").alias(f"s{i}") for i in range(len(columns))])
    return out.select("draw", "n", *[(F.col(f"s{i}") / F.lit(total)).alias(c) for i, c in enumerate(columns)])
