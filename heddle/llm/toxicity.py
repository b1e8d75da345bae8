"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams (operator 3).

Features of a text: its distinct words, neighbouring pairs of words and pairs that skip one word, A-Z lower-cased, hashed into
DIMS cells with value 1. Words are cut at all ASCII characters but letters, digits and the underscore. FTRL-proximal keeps z and n for each
cell: per-coordinate rates, and L1 that leaves most weights at exactly 0, so the model is a short list of (cell, weight).

Scale. Scoring reads each text where it lies and shuffles nothing; the model that is broadcast has DIMS cells at most (12 MB), whatever the
input. Learning is sequential by nature, so it sees a bounded number of labelled rows: all of them, or those whose id hashes below a
threshold chosen so that TRAIN_ROWS are expected. They are learned in one task in the order of that hash.

Defined cases: a null or blank text scores as the bias alone. Null labels and null ids teach nothing; several labels of
one id count as toxic if any is. Without a single labelled row every score is 0. Rows that repeat are scored alike.
An empty table gives no rows. Further columns are ignored; lang, source and doc_id are never features.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.llm.common import NO_LETTER, claim, hash_words, held_out, mix64, read, text_slices, tidy

DIMS, TRAIN_ROWS, SKIPS = 1 << 20, 16_000, 1
ALPHA, BETA, L1, L2, PASSES = 1.0, 1.0, 8.0, 0.1, 5
THRESHOLD = 0.3
HALF = 2**63


def cells(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Cells of the words, pairs and skip-pairs of texts, and the text that owns each; a cell may come twice."""
    h, counts = hash_words(column, lower=True, gaps=NO_LETTER)
    owner = np.repeat(np.arange(len(counts)), counts)
    first, second = h * np.uint64(0xD6E8FEB86659FD93), h * np.uint64(0xA0761D6478BD642F)
    grams, owners = [h], [owner]
    for skip in range(1, SKIPS + 2):
        one = owner[skip:] == owner[:-skip]
        grams.append(((first[:-skip] ^ np.uint64(skip)) + second[skip:])[one])
        owners.append(owner[skip:][one])
    return (mix64(np.concatenate(grams)) & np.uint64(DIMS - 1)).astype(np.int64), np.concatenate(owners)


class Ftrl:
    """FTRL-proximal for binary features; cell DIMS is the bias, which has no penalty."""

    def __init__(self, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2):
        self.z, self.n = np.zeros(DIMS + 1), np.zeros(DIMS + 1)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, l1 = self.z[at], np.where(at == DIMS, 0.0, self.l1)
        return np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / ((self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2))

    def learn(self, at: np.ndarray, label: int) -> None:
        w = self.weights(at)
        g = 1.0 / (1.0 + np.exp(-np.clip(w.sum(), -35, 35))) - label
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g


def train_rows(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> DataFrame:
    """hash, toxic, text of the labelled rows to learn from, the ids broadcast: about `most` at the most."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), 4, 2))
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    n = known.count()
    if n > most:
        known = known.where(F.xxhash64("doc_id") < F.lit(int(-HALF + 2 * HALF * (most / n))))
    return docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select(F.xxhash64("doc_id").alias("hash"), "toxic", "text")


def fit(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS, passes: int = PASSES) -> tuple[np.ndarray, np.ndarray, float] | None:
    """Cells, their weights and the bias; None without labelled rows."""

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("toxicity")
        for batch in batches:
            for part in text_slices(batch, "text"):
                at, owner = cells(part.column("text"))
                once = np.unique(owner * DIMS + at)
                ends = np.searchsorted(once, np.arange(1, part.num_rows + 1) * DIMS)
                sets = [x.astype("<i4").tobytes() for x in np.split(once % DIMS, ends[:-1])]
                yield pa.RecordBatch.from_arrays([part.column("hash"), part.column("toxic"), pa.array(sets, pa.binary())], ["hash", "toxic", "cells"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [(np.frombuffer(c, "<i4"), y) for b in batches for c, y in zip(b.column("cells").to_pylist(), b.column("toxic").to_pylist(), strict=True)]
        model = Ftrl()
        for _ in range(passes):
            for at, y in rows:
                model.learn(np.append(at, DIMS), y)
        if rows:
            at = np.flatnonzero(model.n)
            w = model.weights(at)
            at, w = at[w != 0], w[w != 0]
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(w, pa.float64())], ["cell", "weight"])

    sets = train_rows(docs, labels, most).mapInArrow(tidy(extract), "hash long, toxic int, cells binary")
    found = sets.repartition(1).sortWithinPartitions("hash", "toxic", "cells").mapInArrow(tidy(learn), "cell long, weight double").collect()
    if not found:
        return None
    bias = sum(r["weight"] for r in found if r["cell"] == DIMS)
    own = [r for r in found if r["cell"] != DIMS]
    return np.array([r["cell"] for r in own], np.int64), np.array([r["weight"] for r in own]), bias


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float] | None) -> DataFrame:
    """docs with score appended; a column of that name is replaced."""
    docs, held = docs.drop("score"), docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("toxicity")
        weights = np.zeros(DIMS)
        if held.value:
            weights[held.value[0]] = held.value[1]
        for batch in batches:
            for part in text_slices(batch, "text"):
                out = np.zeros(part.num_rows)
                if held.value:
                    at, owner = cells(part.column("text"))
                    hit = weights[at] != 0
                    once = np.unique(owner[hit] * DIMS + at[hit])
                    total = np.bincount(once // DIMS, weights[once % DIMS], part.num_rows) + held.value[2]
                    out = 1.0 / (1.0 + np.exp(-np.clip(total, -35, 35)))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out)], [*names, "score"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(tidy(apply), f"{fields}, score double")


def op3_ftrl_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, fit(docs, read(spark, sf_dir, "labels"))).drop("text")
    return scored.select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
