"""Bounded samples of labelled documents, and the optimiser the two classifiers share."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def remainder(id_col: str, folds: int) -> Column:
    """CRC-32 of the id as text modulo ``folds``; null without an id."""
    return F.crc32(F.col(id_col).cast("string")) % folds


def labelled_sample(
    docs: DataFrame,
    labels: DataFrame,
    label_col: str,
    learnable: Column,
    most: int,
    id_col: str = "doc_id",
    most_bytes: int = 32 << 20,
) -> DataFrame:
    """At most ``most`` rows of ``docs`` with a 0/1 ``label``, whose texts have at most ``most_bytes`` together.

    Ids are chosen in the order of their hash, one row each: of rows that repeat an id
    the one whose text has the smallest hash. Where the bytes of the texts so far exceed
    the bound, the sample ends. Null labels are left out; of several labels for an id the
    largest counts. What is chosen is a bounded table, so it is broadcast and texts shuffle
    only once chosen. ``docs`` has doc_id, text and columns that go with them.
    """
    chosen = (
        labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("label"))
        .filter(F.col("label").isNotNull() & F.col("doc_id").isNotNull())
        .filter(learnable)
        .groupBy("doc_id")
        .agg(F.max("label").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(most)
    )
    mark, size = F.xxhash64("text"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint")
    one = (
        docs.join(F.broadcast(chosen), "doc_id")
        .select("doc_id", "label", mark.alias("mark"), size.alias("size"))
        .groupBy("doc_id", "label")
        .agg(F.min("mark").alias("mark"), F.min_by("size", "mark").alias("size"))
    )
    # One task sorts at most ``most`` rows of numbers.
    so_far = F.sum("size").over(Window.orderBy(F.xxhash64("doc_id"), "doc_id"))
    within = one.withColumn("so_far", so_far).filter(F.col("so_far") <= most_bytes).drop("so_far", "size")
    matched = docs.withColumn("mark", mark).join(F.broadcast(within), ["doc_id", "mark"]).drop("mark")
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    return matched.groupBy("doc_id", "label", "text").agg(*[F.min(c).alias(c) for c in rest], F.count(F.lit(1)).alias("rows"))


class Adam:
    """Step sizes from running gradient moments, for arrays that are updated in place."""

    def __init__(self, arrays: list[np.ndarray], rate: float) -> None:
        self.arrays, self.rate, self.t = arrays, rate, 0
        self.mean = [np.zeros_like(a) for a in arrays]
        self.square = [np.zeros_like(a) for a in arrays]

    def step(self, gradients: list[np.ndarray]) -> None:
        self.t += 1
        scale = self.rate * np.sqrt(1 - 0.999**self.t) / (1 - 0.9**self.t)
        for a, g, m, s in zip(self.arrays, gradients, self.mean, self.square):
            m += 0.1 * (g - m)
            s += 0.001 * (g * g - s)
            a -= scale * m / (np.sqrt(s) + 1e-8)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))
