"""Scores that solve small linear systems, one for each head. Sums over a head's rows are mergeable aggregates; rows are then scored in tiles, each with its
head's sums, so that no task holds a head."""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle.operators import scoring
from heddle.operators.aggregate import Moments, WeightedGram, aggregate
from heddle.operators.attention import block_scores, z_scores
from heddle.operators.tiles import scored_by_head
from heddle.sources.tables import HEAD, KEYS, WIDTH


def sketch_of(name: tuple, width: int, sketch: int, seed: int) -> np.ndarray:
    """A Gaussian (width, sketch) matrix that depends on the seed and the head alone."""
    return np.random.default_rng(zlib.crc32(f"{seed}:{':'.join(map(str, name))}".encode())).normal(size=(width, sketch)) / np.sqrt(sketch)


def leverage(kv: DataFrame, sketch: int = 16, jitter: float = 1e-3, seed: int = 0, width: int = WIDTH) -> DataFrame:
    """Leverage of centred keys after a Gaussian sketch, as a z-score over the layer."""

    def score(name: tuple, state: np.ndarray, keys: np.ndarray) -> np.ndarray:
        mean, project = state[1 : 1 + width] / state[0], sketch_of(name, width, sketch, seed)
        scatter = state[1 + width :].reshape(width, width) - state[0] * np.outer(mean, mean)
        x = (keys - mean) @ project
        return np.einsum("ij,jk,ik->i", x, np.linalg.inv(project.T @ scatter @ project + jitter * np.eye(sketch)), x)

    return z_scores(scored_by_head(kv, aggregate(kv, HEAD, ["key"], Moments(width)), ["key"], score))


def compactor(kv: DataFrame, ratio: float, chunk: int = 16, first: int = 8, last: int = 4) -> DataFrame:
    """ratio * leverage + block attention; both ends score the layer's maximum."""
    both = leverage(kv).withColumnRenamed("score", "l").join(block_scores(kv, chunk), KEYS).select(*KEYS, (ratio * F.col("l") + F.col("score")).alias("score"))
    top = both.groupBy("layer").agg(F.max("score").alias("top"), (F.max("pos") + 1).alias("n"))
    rows = both.join(F.broadcast(top), "layer")
    return rows.select(*KEYS, F.when((F.col("pos") < first) | (F.col("pos") >= F.col("n") - last), F.col("top")).otherwise(F.col("score")).alias("score"))


def capacity(kv: DataFrame, tau: float = 5.0, sinks: int = 4, width: int = WIDTH) -> DataFrame:
    """w v' M^-1 v with w = exp(tau * (s - max s)), s = -cos(k, anchor), and M = I + sum w v v'; the first positions score the head's maximum plus 1."""
    rows = kv.select(*KEYS, "value").join(scoring.key_difference(kv), KEYS).select(*KEYS, "value", (F.col("score") * tau).alias("s"))

    def score(name: tuple, state: np.ndarray, values: np.ndarray, s: np.ndarray) -> np.ndarray:
        m = np.eye(width) + state[1:].reshape(width, width)
        return np.exp(s[:, 0] - state[0]) * np.einsum("ij,ij->i", values, np.linalg.solve(m, values.T).T)

    states = aggregate(rows, HEAD, ["s", "value"], WeightedGram(width))
    found = scored_by_head(rows.withColumn("s", F.array("s")), states, ["value", "s"], score)
    top = found.groupBy(*HEAD).agg((F.max("score") + 1).alias("top"))
    return found.join(top, HEAD).select(*KEYS, F.when(F.col("pos") < sinks, F.col("top")).otherwise(F.col("score")).alias("score"))
