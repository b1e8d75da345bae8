"""Samples of a fixed size from groups of any size, as a mergeable sketch."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle.operators.aggregate import aggregate
from heddle.operators.scoring import hash_unit


class BottomK:
    """The k rows with the lowest (hash, number) of all, each a pair of doubles: two sketches merge into that of both."""

    def __init__(self, k: int):
        self.k = k

    def zero(self) -> np.ndarray:
        return np.zeros(0)

    def lowest(self, pairs: np.ndarray) -> np.ndarray:
        if len(pairs) > 4 * self.k:
            cut = np.partition(pairs[:, 0], self.k - 1)[self.k - 1]
            pairs = pairs[pairs[:, 0] <= cut]
        return pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))[: self.k]].ravel()

    def add(self, state: np.ndarray, hashes: np.ndarray, numbers: np.ndarray) -> np.ndarray:
        return self.lowest(np.vstack([state.reshape(-1, 2), np.stack([hashes, numbers], axis=1)]))

    def merge(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self.lowest(np.vstack([a.reshape(-1, 2), b.reshape(-1, 2)]))


def sample_rows(rows: DataFrame, by: str, number: str, k: int, seed: str = "0") -> DataFrame:
    """by and number of exactly min(k, rows) rows of each group, the same for any partitioning: those whose hash of (seed, by, number) is lowest. `by` is an integer
    without nulls, `number` tells the rows of a group apart and is below 2 ** 53. A group of any size leaves one sketch a task, and is never sorted."""
    if k < 1:
        raise ValueError("a sample has one row at least")
    hashed = rows.select(by, hash_unit(F.concat_ws(":", F.lit(seed), by, number)).alias("h"), F.col(number).cast("double").alias("n"))
    found = aggregate(hashed, [by], ["h", "n"], BottomK(k)).withColumn("i", F.explode(F.sequence(F.lit(1), (F.size("state") / 2).cast("int"))))
    return found.select(by, F.get("state", 2 * F.col("i") - 1).cast("long").alias(number))


def sample_tokens(docs: DataFrame, by: str, k: int, seed: str = "0", tokens: str = "tokens") -> DataFrame:
    """by, pos and token: k tokens of each document (all of a shorter one)."""
    placed = docs.select(by, F.posexplode(tokens).alias("pos", "token"))
    kept = sample_rows(placed, by, "pos", k, seed).groupBy(by).agg(F.collect_list("pos").alias("kept"))  # k numbers a document
    return docs.join(kept, by).select(by, F.explode("kept").alias("pos"), tokens).select(by, "pos", F.get(tokens, F.col("pos").cast("int")).alias("token"))
