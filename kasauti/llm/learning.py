"""Bounded training samples and a small logistic model, in numpy."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import held_out, text_or_empty

#: Bytes of all texts of one label in a sample.
TOTAL_BYTES = 16 << 20


def training_rows(
    docs: DataFrame, labels: DataFrame, label_col: str, per_class: int, max_bytes: int, id_col: str = "doc_id", text_col: str = "text", total_bytes: int = TOTAL_BYTES
) -> tuple[list[str], list[str], list[int]]:
    """Texts of label 0 and of label 1, and how many rows have each label.

    A bounded sample: of each label at most ``per_class`` rows of ``docs``, those
    whose ids hash lowest, of texts up to ``max_bytes`` and ``total_bytes`` together;
    never a held-out row. Rows without an id or a label of 0 or 1 teach nothing; a
    document with several labels counts with the smallest.
    """
    known = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").alias("label")).filter("label IN (0, 1) AND id IS NOT NULL")
    known = known.filter(~held_out("id")).groupBy("id").agg(F.min("label").alias("label"))
    counts = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), text_or_empty(f"`{text_col}`").alias("text")).filter(F.octet_length("text") <= max_bytes)
    met = known.join(texts.groupBy("id").agg(F.max(F.octet_length("text")).alias("size")), "id")
    lowest = [met.filter(F.col("label") == v).orderBy(F.xxhash64("id"), "id").limit(per_class) for v in (0, 1)]
    chosen, left = [], [total_bytes, total_bytes]
    for r in lowest[0].unionByName(lowest[1]).select("id", "label", "size", F.xxhash64("id").alias("hash")).collect():
        chosen.append((r["hash"], r["id"], r["label"], r["size"]))
    rows = []
    for n, (_, i, label, size) in enumerate(sorted(chosen)):
        left[label] -= size
        if left[label] >= 0:
            rows.append((n, i, label))
    sample = docs.sparkSession.createDataFrame(rows, StructType([StructField("nth", LongType()), known.schema["id"], StructField("label", LongType())]))
    # Of at most 2 * per_class ids; the sample's texts are the only ones that move.
    found = texts.join(F.broadcast(sample), "id").groupBy("nth", "label").agg(F.min("text").alias("text")).collect()
    by_label = [[r["text"] for r in sorted(found, key=lambda r: r["nth"]) if r["label"] == v] for v in (0, 1)]
    return by_label[0], by_label[1], [counts.get(0, 0), counts.get(1, 0)]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def platt(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3, steps: int = 100) -> np.ndarray:
    """Weights and bias of a logistic regression by Newton's method."""
    design = np.column_stack([x, np.ones(len(x))])
    theta = np.zeros(design.shape[1])
    for _ in range(steps):
        p = sigmoid(design @ theta)
        gradient = design.T @ (weight * (p - y)) + ridge * theta
        hessian = (design * (weight * p * (1 - p) + 1e-9)[:, None]).T @ design + ridge * np.eye(len(theta))
        step = np.linalg.solve(hessian, gradient)
        theta -= step
        if np.abs(step).max() < 1e-9:
            break
    return theta
