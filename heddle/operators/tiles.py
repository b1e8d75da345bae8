"""Attention in tiles, for queries of any number.

Queries and keys of a head are packed into tiles, matrices of TILE rows. A task holds the query tiles of one part of a head (PART of them) and lets the
key tiles pass by: the softmax of a query is a running maximum and a sum scaled by it, which merge from tile to tile. A second pass with the
finished sums gives what each key receives from the part, in all and at the most; parts are merged by sum and maximum. Work is matrix
products; there is never a row for a pair of positions.

Shuffled in each pass: the queries once, the keys once for each part. Memory: PART query tiles and one key tile."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle.sources.tables import HEAD, KEYS, WIDTH

TILE, PART = 256, 16
_SIDE = [*HEAD, "part", "side", "tile", "causal", "shown", "pos", "vectors", "weight", "top", "total"]


def key_tiles(kv: DataFrame, column: str = "key", size: int = TILE, within: list[str] = HEAD) -> DataFrame:
    """within, tile, pos ARRAY and vectors ARRAY (end to end), in the order of positions: a row for each `size` positions of a head."""
    rows = kv.groupBy(*within, F.expr(f"cast(pos div {size} AS int)").alias("tile")).agg(F.array_sort(F.collect_list(F.struct("pos", column))).alias("r"))
    return rows.select(*within, "tile", F.col("r.pos").alias("pos"), F.flatten(F.col(f"r.{column}")).alias("vectors"))


def query_tiles(queries: DataFrame, size: int = TILE, within: list[str] = HEAD) -> DataFrame:
    """As key_tiles, for the queries of all query heads of a head, with the weight that each query's attention counts with (1 without a column `weight`)."""
    weighted = queries if "weight" in queries.columns else queries.withColumn("weight", F.lit(1.0))
    rows = weighted.groupBy(*within, F.expr(f"cast(q_pos div {size} AS int)").alias("tile")).agg(F.array_sort(F.collect_list(F.struct("q_pos", "qhead", "q", "weight"))).alias("r"))
    return rows.select(*within, "tile", F.col("r.q_pos").alias("pos"), F.flatten("r.q").alias("vectors"), F.col("r.weight").alias("weight"))


def _sides(q: DataFrame, k: DataFrame) -> DataFrame:
    """Both sides as one table, dealt by head and part, queries before keys. k: with causal and shown."""
    none = F.lit(None).cast("array<double>")
    finished = [F.col("top"), F.col("total")] if "top" in q.columns else [none.alias("top"), none.alias("total")]
    queries = q.select(*HEAD, "part", F.lit(0).alias("side"), "tile", F.lit(False).alias("causal"), F.lit(False).alias("shown"), "pos", "vectors", "weight", *finished)
    keys = k.select(*HEAD, "part", F.lit(1).alias("side"), "tile", "causal", "shown", "pos", "vectors", none.alias("weight"), none.alias("top"), none.alias("total"))
    return queries.unionByName(keys).repartition(*HEAD, "part").sortWithinPartitions(*HEAD, "part", "side", "tile").select(*_SIDE)


class _Queries:
    """The query tiles of one part as one matrix, with their softmax so far."""

    def __init__(self) -> None:
        self.tiles: list[tuple] = []
        self.pos = None

    def gather(self, width: int) -> None:
        self.pos = np.concatenate([t[1] for t in self.tiles])
        self.x = np.concatenate([t[2].reshape(-1, width) for t in self.tiles])
        self.weight = np.concatenate([t[5] for t in self.tiles])
        done = self.tiles[0][3] is not None
        self.top = np.concatenate([t[3] for t in self.tiles]) if done else np.full(len(self.pos), -np.inf)
        self.total = np.concatenate([t[4] for t in self.tiles]) if done else np.zeros(len(self.pos))

    def logits(self, keys: np.ndarray, pos: np.ndarray, causal: bool, scale: float) -> np.ndarray:
        x = self.x @ keys.T * scale
        return np.where(pos[None, :] <= self.pos[:, None], x, -np.inf) if causal else x


def _array(x) -> np.ndarray | None:
    return None if not x.is_valid else np.asarray(x.values)


def _parts(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple]:
    """(name, queries, None) once a part's queries are there, then (name, queries, key tile) for each key tile, then (name, queries, "end")."""
    name, held, ready = None, None, False
    for batch in batches:
        at = {n: batch.column(n) for n in _SIDE}
        names = list(zip(*(at[c].to_pylist() for c in (*HEAD, "part")), strict=True))
        sides, tiles, causal, shown = (at[c].to_pylist() for c in ("side", "tile", "causal", "shown"))
        for k, own in enumerate(names):
            if own != name:
                if ready:
                    yield name, held, "end"
                name, held, ready = own, _Queries(), False
            pos, vectors = np.asarray(at["pos"][k].values), np.asarray(at["vectors"][k].values, float)
            if sides[k] == 0:
                held.tiles.append((tiles[k], pos, vectors, _array(at["top"][k]), _array(at["total"][k]), _array(at["weight"][k])))
                continue
            if not held.tiles:
                continue
            if not ready:
                held.gather(width)
                ready = True
            if not causal[k] or pos[0] <= held.pos.max():
                yield name, held, (pos, vectors.reshape(-1, width), causal[k], shown[k])
    if ready:
        yield name, held, "end"


def softmax_tiles(q: DataFrame, k: DataFrame, scale: float, width: int) -> DataFrame:
    """q with `top` and `total`: of each query the largest logit, and the sum of exponentials below it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, held, tile in _parts(batches, width):
            if tile != "end":
                pos, keys, causal, _ = tile
                x = held.logits(keys, pos, causal, scale)
                top = np.maximum(held.top, x.max(axis=1))
                safe = np.where(np.isneginf(top), 0.0, top)
                held.total = held.total * np.exp(held.top - safe) + np.exp(x - safe[:, None]).sum(axis=1)
                held.top = top
                continue
            a = 0
            for number, own, vectors, _, _, weight in held.tiles:
                b = a + len(own)
                values = [*name, number, own.tolist(), vectors.tolist(), weight.tolist(), held.top[a:b].tolist(), held.total[a:b].tolist()]
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, _SUMS, strict=True)], names=_SUM_NAMES)
                a = b

    return _sides(q, k).mapInArrow(run, "layer int, batch int, head int, part int, tile int, pos array<int>, vectors array<double>, weight array<double>, top array<double>, total array<double>")


_SUM_NAMES = [*HEAD, "part", "tile", "pos", "vectors", "weight", "top", "total"]
_SUMS = [*[pa.int32()] * 5, pa.list_(pa.int32()), *[pa.list_(pa.float64())] * 4]


def received(q: DataFrame, k: DataFrame, scale: float = WIDTH**-0.5, width: int = WIDTH) -> DataFrame:
    """Of query tiles (HEAD, part, tile, pos, vectors) and key tiles (the same, with causal and shown): for each shown key the attention that it receives, in all
    (`total`) and from one query at the most (`best`), over all query heads. causal: a query sees the keys of its position and before, else all of the tile."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, held, tile in _parts(batches, width):
            if tile == "end" or not tile[3]:
                continue
            pos, keys, causal, _ = tile
            w = np.exp(held.logits(keys, pos, causal, scale) - held.top[:, None]) * (held.weight / held.total)[:, None]
            numbers = [np.full(len(pos), v, np.int32) for v in name[:3]]
            yield pa.RecordBatch.from_arrays([*map(pa.array, numbers), pa.array(pos.astype(np.int32)), pa.array(w.sum(axis=0)), pa.array(w.max(axis=0))], names=[*KEYS, "total", "best"])

    parts = _sides(softmax_tiles(q, k, scale, width), k).mapInArrow(run, "layer int, batch int, head int, pos int, total double, best double")
    return parts.groupBy(*KEYS).agg(F.sum("total").alias("total"), F.max("best").alias("best"))


def causal_received(queries: DataFrame, kv: DataFrame, scale: float = WIDTH**-0.5, width: int = WIDTH, size: int = TILE, part: int = PART) -> DataFrame:
    """layer, batch, head, pos, total, best over all queries that see a key. Keys go to the parts whose queries come after them."""
    q = query_tiles(queries, size).withColumn("part", F.expr(f"cast(tile div {part} AS int)"))
    last = q.groupBy(*HEAD).agg(F.max("part").alias("last"))
    k = key_tiles(kv, size=size).join(last, HEAD)
    parts = F.sequence(F.expr(f"cast(tile div {part} AS int)"), F.greatest("last", F.expr(f"cast(tile div {part} AS int)")))
    k = k.withColumn("part", F.explode(parts)).withColumns({"causal": F.lit(True), "shown": F.lit(True)})
    return received(q, k, scale, width)


def repeated_received(queries: DataFrame, kv: DataFrame, chunk: int, n_sink: int, repeated: DataFrame | None = None, scale: float = WIDTH**-0.5, width: int = WIDTH, size: int = TILE) -> DataFrame:
    """Attention of a context's repetition to the context, chunk by chunk: the queries of a chunk (positions from n_sink on, `chunk` at a time) see the first n_sink keys, all keys of
    their chunk, and the keys of the repetition up to themselves. repeated: the keys of the repetition (as kv; without them the context's own).
    queries are those of the repetition, at the positions that they repeat. Gives layer, batch, head, pos, total, best for the keys of the context behind the sinks."""
    number = lambda pos: F.expr(f"cast(({pos} - {n_sink}) div {chunk} AS int)")
    inside = [*HEAD, "part"]
    q = query_tiles(queries.where(F.col("q_pos") >= n_sink).withColumn("part", number("q_pos")), size, inside)
    context = kv.where(F.col("pos") >= n_sink).withColumn("part", number("pos"))
    own = key_tiles(context, size=size, within=inside).withColumns({"causal": F.lit(False), "shown": F.lit(True)})
    again = context if repeated is None else repeated.where(F.col("pos") >= n_sink).withColumn("part", number("pos"))
    copies = key_tiles(again, size=size, within=inside).withColumns({"causal": F.lit(True), "shown": F.lit(False)})
    sinks = key_tiles(kv.where(F.col("pos") < n_sink), size=size).join(q.select(*inside).distinct(), HEAD).withColumns({"causal": F.lit(False), "shown": F.lit(False)})
    return received(q, own.unionByName(copies).unionByName(sinks.select(*own.columns)), scale, width)


def nearest(rows: DataFrame, among: DataFrame, width: int = WIDTH, size: int = TILE, part: int = PART) -> DataFrame:
    """For each of rows (layer, batch, head, pos, u) the one of its head's `among` with the largest product of their vectors u, compared after rounding to 9 places, the lower position
    among equals: layer, batch, head, pos, target, sim. A running best for each row while the other side's tiles pass by; heads without any of `among` have no rows."""
    asked = rows.select(*HEAD, F.lit(0).alias("qhead"), F.col("pos").alias("q_pos"), F.col("u").alias("q"))
    q = query_tiles(asked, size).withColumn("part", F.expr(f"cast(tile div {part} AS int)"))
    k = key_tiles(among, "u", size).join(q.select(*HEAD, "part").distinct(), HEAD).withColumns({"causal": F.lit(False), "shown": F.lit(True)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = sim = target = None
        for name, held, tile in _parts(batches, width):
            if tile != "end":
                if best is None:
                    best, sim, target = np.full(len(held.pos), -np.inf), np.zeros(len(held.pos)), np.zeros(len(held.pos), np.int32)
                pos, vectors, _, _ = tile
                x = held.x @ vectors.T
                order = np.round(x, 9)
                at = order.argmax(axis=1)  # the first of equals: positions grow within a tile, and from tile to tile
                rows_ = np.arange(len(at))
                better = order[rows_, at] > best
                best, sim, target = np.where(better, order[rows_, at], best), np.where(better, x[rows_, at], sim), np.where(better, pos[at], target)
                continue
            numbers = [np.full(len(best), v, np.int32) for v in name[:3]]
            yield pa.RecordBatch.from_arrays([*map(pa.array, numbers), pa.array(held.pos.astype(np.int32)), pa.array(target.astype(np.int32)), pa.array(sim)], names=[*KEYS, "target", "sim"])
            best = None

    return _sides(q, k).mapInArrow(run, "layer int, batch int, head int, pos int, target int, sim double")


def scored_by_head(rows: DataFrame, states: DataFrame, columns: list[str], score: Callable, size: int = TILE, many: bool = False) -> DataFrame:
    """Scores of rows by a state of their head: score((layer, batch, head), state, *matrices) gives a number a row, or (many) an array. Rows are packed into tiles
    first, so that a head's state goes along once for `size` rows. columns: the vectors that become matrices, a row of each for each position."""
    packed = rows.groupBy(*HEAD, F.expr(f"cast(pos div {size} AS int)").alias("tile")).agg(F.array_sort(F.collect_list(F.struct("pos", *columns))).alias("r"))
    flat = [F.flatten(F.col(f"r.{c}")).alias(c) for c in columns]
    tiles = packed.join(states, HEAD).select(*HEAD, "state", F.col("r.pos").alias("pos"), *flat)
    kind = pa.list_(pa.float64()) if many else pa.float64()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                name = tuple(batch.column(c)[k].as_py() for c in HEAD)
                pos = np.asarray(batch.column("pos")[k].values)
                parts = [np.asarray(batch.column(c)[k].values, float).reshape(len(pos), -1) for c in columns]
                found = score(name, np.asarray(batch.column("state")[k].values, float), *parts)
                numbers = [np.full(len(pos), v, np.int32) for v in name]
                yield pa.RecordBatch.from_arrays([*map(pa.array, numbers), pa.array(pos.astype(np.int32)), pa.array(found.tolist(), kind)], names=[*KEYS, "score"])

    return tiles.mapInArrow(run, f"layer int, batch int, head int, pos int, score {'array<double>' if many else 'double'}")
