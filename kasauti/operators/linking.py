"""Prediction of flips by perturbations that were held out: a logistic model on counts, and a network on all rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import cut


def logistic(x: np.ndarray, hits: np.ndarray, n: np.ndarray, ridge: float = 0.01, rounds: int = 50) -> np.ndarray:
    """Weights (the last the intercept, not shrunk) that minimise mean log loss + ridge / 2 x squared weights, by Newton's method."""
    z, w = np.hstack([x, np.ones((len(x), 1))]), np.zeros(x.shape[1] + 1)
    shrink = np.full(len(w), ridge)
    shrink[-1] = 1e-9
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-z @ w))
        slope = z.T @ (n * p - hits) / n.sum() + shrink * w
        bend = (z * (n * p * (1 - p) / n.sum())[:, None]).T @ z + np.diag(shrink)
        step = np.linalg.solve(bend, slope)
        w -= step * min(1.0, 2.0 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-10:
            break
    return w


def leave_one_out(seen: DataFrame, features: DataFrame, labels: list[str]) -> DataFrame:
    """``seen`` (attack_idx, gold_label, hit) with p, from a model that saw all perturbations but the row's own.

    Features are a perturbation's (attack_idx, f) and which of ``labels`` a claim
    has, so rows of one perturbation and label are alike: models are fitted on
    counts, at most perturbations x (labels + 1) rows of any number of outcomes.
    p is null where a perturbation is the only one.
    """
    cells = seen.withColumn("state", F.when(F.col("gold_label").isin(labels), F.col("gold_label")).otherwise(""))
    counted = cells.groupBy("attack_idx", "state").agg(F.count_if("hit").alias("hits"), F.count(F.lit(1)).alias("n")).join(F.broadcast(features), "attack_idx")

    def fit(given: pd.DataFrame) -> pd.DataFrame:
        given = given.sort_values(["attack_idx", "state"])
        x = np.array([[*f, *(float(s == v) for v in labels)] for f, s in zip(given["f"], given["state"])])
        arm, hits, n = (given[c].to_numpy(float) for c in ("attack_idx", "hits", "n"))
        p = np.full(len(given), np.nan)
        for a in np.unique(arm):
            rest = arm != a
            if rest.any():
                w = logistic(x[rest], hits[rest], n[rest])
                p[~rest] = 1 / (1 + np.exp(-(x[~rest] @ w[:-1] + w[-1])))
        return given[["attack_idx", "state"]].assign(p=np.round(p, 9))

    scores = counted.groupBy().applyInPandas(fit, "attack_idx int, state string, p double")
    scored = cells.join(F.broadcast(scores), ["attack_idx", "state"]).drop("state")
    return scored.withColumn("p", F.when(F.isnan("p"), None).otherwise(F.col("p")))


def unpack(w: np.ndarray, inputs: int, hidden: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """The hidden layer's matrix and shifts, the last layer's row and shift, as views of one array of weights."""
    cut = inputs * hidden
    return w[:cut].reshape(inputs, hidden), w[cut : cut + hidden], w[cut + hidden : cut + 2 * hidden], w[-1]


def raw_scores(w: np.ndarray, x: np.ndarray, hidden: int) -> np.ndarray:
    """Scores before the sigmoid."""
    matrix, shift, row, last = unpack(w, x.shape[1], hidden)
    return np.maximum(x @ matrix + shift, 0.0) @ row + last


def loss_and_slope(w: np.ndarray, x: np.ndarray, y: np.ndarray, hidden: int) -> tuple[float, np.ndarray]:
    """The rows' log loss and its gradient, both summed, so that those of several batches add up."""
    matrix, shift, row, last = unpack(w, x.shape[1], hidden)
    active = np.maximum(x @ matrix + shift, 0.0)
    z = active @ row + last
    off = 1 / (1 + np.exp(-np.clip(z, -500, 500))) - y
    back = np.outer(off, row) * (active > 0)
    slope = np.concatenate([(x.T @ back).ravel(), back.sum(axis=0), off @ active, [off.sum()]])
    return float((np.logaddexp(0.0, z) - y * z).sum()), slope


#: Partitions whose sums the driver adds itself; sums of more are first added by tasks, as many as the root of their number.
DIRECT = 16


class LinkModels:
    """A network of one hidden layer for each perturbation, fitted on the outcomes of all others.

    A row is a claim's vector beside the perturbation's features. Rows stay where they
    are: in a step each task sums the gradients of all models over its rows, and sums
    of the models' size are all that moves. The models, perturbations x weights
    numbers, go to the tasks with the step; ``features`` (attack_idx, f) is as small.
    """

    def __init__(self, features: DataFrame, width: int, hidden: int = 32, seed: int = 42, ridge: float = 1e-4):
        known = sorted((r["attack_idx"], list(r["f"])) for r in features.collect())
        self.arms = np.array([a for a, _ in known])
        self.table = np.array([f for _, f in known], dtype=float)
        self.width, self.hidden, self.ridge = width, hidden, ridge
        self.inputs = width + self.table.shape[1]
        drawn = np.random.default_rng(seed).normal(size=(self.inputs + 1) * hidden)
        first, last = drawn[: self.inputs * hidden] * np.sqrt(2 / self.inputs), drawn[self.inputs * hidden :] / np.sqrt(hidden)
        self.weights = np.tile(np.concatenate([first, np.zeros(hidden), last, [0.0]]), (len(self.arms), 1))
        self.losses: list[np.ndarray] = []

    def inputs_of(self, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which rows have a vector of the right width without gaps and a known perturbation; their inputs and perturbations."""
        vectors, arms = batch.column("vector"), batch.column("attack_idx").to_numpy(zero_copy_only=False)
        usable = np.nan_to_num(pc.list_value_length(vectors).to_numpy(zero_copy_only=False), nan=-1.0) == self.width
        usable &= np.isin(arms, self.arms)
        x = vectors.filter(pa.array(usable)).flatten().to_numpy(zero_copy_only=False).reshape(-1, self.width).astype(float)
        whole = np.isfinite(x).all(axis=1)
        usable[usable] = whole
        own = arms[usable].astype(self.arms.dtype)
        return usable, np.hstack([x[whole], self.table[np.searchsorted(self.arms, own)]]), own

    def sums(self, table: DataFrame) -> np.ndarray:
        """Of each model the loss, the rows and the gradient, over all rows it may see."""
        shape, parts = (len(self.arms), self.weights.shape[1] + 2), table.rdd.getNumPartitions()
        slots = int(np.ceil(np.sqrt(parts)))

        def own(batches):
            total, at = np.zeros(shape), TaskContext.get().partitionId()
            for batch in batches:
                usable, x, arms = self.inputs_of(batch)
                y = batch.column("hit").to_numpy(zero_copy_only=False)[usable].astype(float)
                for k, arm in enumerate(self.arms):
                    rest = arms != arm
                    loss, slope = loss_and_slope(self.weights[k], x[rest], y[rest], self.hidden)
                    total[k] += np.concatenate([[loss, rest.sum()], slope])
            yield pa.RecordBatch.from_pydict({"slot": pa.array([at % slots], pa.int32()), "sums": pa.array([total.tobytes()], pa.binary())})

        def added(batches):
            total = np.zeros(shape)
            for batch in batches:
                for one in batch.column("sums"):
                    total += np.frombuffer(one.as_buffer()).reshape(shape)
            yield pa.RecordBatch.from_pydict({"slot": pa.array([0], pa.int32()), "sums": pa.array([total.tobytes()], pa.binary())})

        each = table.mapInArrow(own, "slot int, sums binary")
        if parts > DIRECT:
            each = each.repartition(slots, "slot").mapInArrow(added, "slot int, sums binary")
        total = np.zeros(shape)
        for r in each.toLocalIterator():
            total += np.frombuffer(r["sums"]).reshape(shape)
        return total

    def fit(self, table: DataFrame, rounds: int = 60, rate: float = 0.03) -> LinkModels:
        """``rounds`` steps by Adam over all rows of ``table`` (attack_idx, hit, vector); a table that is read ``rounds`` times."""
        mean, square = np.zeros_like(self.weights), np.zeros_like(self.weights)
        for t in range(1, rounds + 1):
            total = self.sums(table)
            n = np.maximum(total[:, 1:2], 1)
            slope = total[:, 2:] / n + self.ridge * self.weights
            self.losses.append(total[:, 0] / n[:, 0])
            mean, square = 0.9 * mean + 0.1 * slope, 0.999 * square + 0.001 * slope**2
            self.weights = self.weights - rate * (mean / (1 - 0.9**t)) / (np.sqrt(square / (1 - 0.999**t)) + 1e-8)
        return self

    def score(self, table: DataFrame) -> DataFrame:
        """row_id, attack_idx, hit and p by the model that never saw the perturbation; null without a usable vector, or where there is no other perturbation."""

        def scored(batches):
            for batch in batches:
                usable, x, arms = self.inputs_of(batch)
                p = np.full(len(arms), np.nan)
                for k, arm in enumerate(self.arms if len(self.arms) > 1 else []):
                    mine = arms == arm
                    p[mine] = 1 / (1 + np.exp(-np.clip(raw_scores(self.weights[k], x[mine], self.hidden), -500, 500)))
                out = np.full(batch.num_rows, np.nan)
                out[usable] = p
                kept = [batch.column(c) for c in ("row_id", "attack_idx", "hit")]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(out, from_pandas=True)], names=["row_id", "attack_idx", "hit", "p"])

        return table.select("row_id", "attack_idx", "hit", "vector").mapInArrow(scored, "row_id long, attack_idx int, hit boolean, p double")


def link_mlp(seen: DataFrame, vectors: DataFrame, features: DataFrame, width: int, hidden: int = 32, rounds: int = 60) -> DataFrame:
    """``seen`` (row_id, attack_idx, hit) with p, each perturbation scored by a network that saw the outcomes of all others alone.

    ``vectors`` (row_id, vector) has each row_id once. The joined rows are computed
    once and read back in each round.
    """
    told = seen.select(F.col("row_id").cast("long").alias("row_id"), "attack_idx", "hit").join(vectors.select(F.col("row_id").cast("long").alias("row_id"), "vector"), "row_id", "left")
    table = cut(told.filter(F.col("hit").isNotNull()))
    return LinkModels(features, width, hidden).fit(table, rounds).score(table)
