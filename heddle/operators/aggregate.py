"""User-defined mergeable aggregates over arrays of numbers.

An aggregate says what nothing is worth (`zero`), what rows add to a state (`add`) and how two states become one (`merge`); a state is a flat array of doubles.
Each task folds its rows of a key into one state and writes it once, at its end; the states of a key are then merged as they come, in two steps of
shuffling, the first over SPREAD parts of a key, so that neither rows nor states are ever gathered."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Parts of a key's states in the first step of merging, and states that a task holds before it writes them out.
SPREAD, HELD = 32, 4096


class Aggregate(Protocol):
    def zero(self) -> np.ndarray: ...

    def add(self, state: np.ndarray, *columns: np.ndarray) -> np.ndarray:
        """The state after some rows; vectors come as (rows, width), numbers as (rows,)."""

    def merge(self, a: np.ndarray, b: np.ndarray) -> np.ndarray: ...


class Moments:
    """Number of rows, sum of their vectors, sum of outer products: 1 + d + d * d numbers."""

    def __init__(self, width: int):
        self.width = width

    def zero(self) -> np.ndarray:
        return np.zeros(1 + self.width + self.width**2)

    def add(self, state: np.ndarray, x: np.ndarray) -> np.ndarray:
        return state + np.concatenate([[len(x)], x.sum(axis=0), (x.T @ x).ravel()])

    def merge(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return a + b


class WeightedGram:
    """Sum of exp(s) x x' for rows (s, x), kept as the largest s and the sum scaled by it, so that no exponential runs over: 1 + d * d numbers."""

    def __init__(self, width: int):
        self.width = width

    def zero(self) -> np.ndarray:
        return np.append(-np.inf, np.zeros(self.width**2))

    def add(self, state: np.ndarray, s: np.ndarray, x: np.ndarray) -> np.ndarray:
        top = s.max()
        return self.merge(state, np.append(top, ((x * np.exp(s - top)[:, None]).T @ x).ravel()))

    def merge(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        top = max(a[0], b[0])
        scaled = sum(x[1:] * np.exp(x[0] - top) for x in (a, b) if x[0] > -np.inf)
        return np.append(top, scaled) if top > -np.inf else a


def matrix(column: pa.Array) -> np.ndarray:
    """(rows, width) of a column of lists of one length, (rows,) of a column of numbers."""
    if pa.types.is_list(column.type):
        flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
        return flat.reshape(len(column), -1)
    return column.to_numpy(zero_copy_only=False).astype(float)


def aggregate(df: DataFrame, keys: list[str], columns: list[str], by: Aggregate) -> DataFrame:
    """keys and state: one row for each key. Keys are integers without nulls; the columns, vectors of one width or numbers, have no nulls either."""
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for k in keys for f in df.schema.fields if f.name == k), "state array<double>"])
    n = len(keys)

    def rows(held: dict[tuple, np.ndarray], types: list[pa.DataType]) -> pa.RecordBatch:
        parts = [pa.array([k[i] for k in held], t) for i, t in enumerate(types)]
        return pa.RecordBatch.from_arrays([*parts, pa.array([s.tolist() for s in held.values()], pa.list_(pa.float64()))], names=[*keys, "state"])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, types = {}, None
        for batch in batches:
            if not batch.num_rows:
                continue
            types = [c.type for c in batch.columns[:n]]
            ids = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[:n]], axis=1)
            values = [matrix(c) for c in batch.columns[n:]]
            found, at = np.unique(ids, axis=0, return_inverse=True)
            for k, key in enumerate(map(tuple, found.tolist())):
                own = at.ravel() == k
                held[key] = by.add(held.get(key, by.zero()), *(v[own] for v in values))
            if len(held) > HELD:
                yield rows(held, types)
                held = {}
        if held:
            yield rows(held, types)

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """States come sorted by key."""
        key, state, types = None, None, None
        for batch in batches:
            types = [c.type for c in batch.columns[:n]]
            for k, one in zip(zip(*(c.to_pylist() for c in batch.columns[:n]), strict=True), batch.column(n), strict=True):
                other = np.asarray(one.values, float)
                if k == key:
                    state = by.merge(state, other)
                    continue
                if key is not None:
                    yield rows({key: state}, types)
                key, state = k, other
        if key is not None:
            yield rows({key: state}, types)

    states = df.select(*keys, *columns).mapInArrow(partial, schema)
    spread = states.withColumn("_part", F.spark_partition_id() % SPREAD).repartition(*keys, "_part").sortWithinPartitions(*keys).drop("_part").mapInArrow(merged, schema)
    return spread.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(merged, schema)
