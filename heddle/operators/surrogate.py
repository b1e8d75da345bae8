"""Surrogates of expensive scores: ridge regressions, one for each layer, from a row's key and value to the logarithm of its score.

Each layer's Gram matrix is a mergeable aggregate, so rows are never gathered; what reaches the driver is one small matrix a layer. With hidden > 0 the input goes through a fixed random layer with a rectifier first."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle.operators.aggregate import aggregate
from heddle.sources.tables import KEYS, WIDTH


def features(keys: np.ndarray, values: np.ndarray, hidden: int, seed: int = 3) -> np.ndarray:
    x = np.hstack([keys, values])
    if hidden:
        x = np.maximum(x @ np.random.default_rng(seed).normal(size=(x.shape[1], hidden)) / np.sqrt(x.shape[1]), 0.0)
    return np.hstack([x, np.ones((len(x), 1))])


@dataclass
class Surrogate:
    """weights: for each layer a vector over the features, the intercept last."""

    weights: dict[int, np.ndarray]
    hidden: int = 0

    def apply(self, kv: DataFrame) -> DataFrame:
        weights, hidden = self.weights, self.hidden

        def score(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for rows in parts:
                if len(rows):
                    x = features(*(np.array(rows[c].tolist(), float) for c in ("key", "value")), hidden)
                    w = np.array([weights.get(k, np.zeros(x.shape[1])) for k in rows["layer"]])
                    yield rows[KEYS].assign(score=np.einsum("ij,ij->i", x, w))

        return kv.select(*KEYS, "key", "value").mapInPandas(score, "layer int, batch int, head int, pos int, score double")


class FeatureGram:
    """Gram matrix of the features of rows (key, value) and their target, the target last."""

    def __init__(self, width: int, hidden: int):
        self.size, self.hidden = (hidden or 2 * width) + 2, hidden

    def zero(self) -> np.ndarray:
        return np.zeros(self.size**2)

    def add(self, state: np.ndarray, keys: np.ndarray, values: np.ndarray, target: np.ndarray) -> np.ndarray:
        x = np.hstack([features(keys, values, self.hidden), target[:, None]])
        return state + (x.T @ x).ravel()

    def merge(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return a + b


def fit(kv: DataFrame, scores: DataFrame, hidden: int = 0, penalty: float = 1e-2, least: float = 1e-9, logged: bool = False, width: int = WIDTH) -> Surrogate:
    """Ridge regression of log(max(score, least)), or of scores that are logarithms (logged), on the rows of kv that have a score."""
    target = F.col("score") if logged else F.log(F.greatest("score", F.lit(least)))
    rows = kv.select(*KEYS, "key", "value").join(scores.select(*KEYS, target.alias("target")), KEYS)
    gram = FeatureGram(width, hidden)
    weights = {}
    for r in aggregate(rows, ["layer"], ["key", "value", "target"], gram).collect():  # a row for each layer
        g = np.array(r["state"]).reshape(gram.size, gram.size)
        weights[r["layer"]] = np.linalg.solve(g[:-1, :-1] + penalty * np.eye(gram.size - 1), g[:-1, -1])
    return Surrogate(weights, hidden)
