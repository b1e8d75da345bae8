"""Caches that grow token by token, with their vectors as state.

A token is one row for each (layer, batch, pos): keys, values and queries of all its heads, laid end to end. A fold goes over the tokens of a
sequence in order and holds what a policy lets it hold: positions, keys, values and the attention that each slot has received so
far. It runs in two ways, over the same policies: `fold` takes a table, deals sequences out to tasks and sorts each by position;
`cache_stream` takes a stream and keeps the cache as keyed state between micro-batches, emitting changes.

Bounds. A policy holds its target and one interval (or block) of slots, and a prefill that it was told to keep whole; nothing else of a sequence
is in memory, however long it is. A sequence is worked on by one task, since each round depends on the one before; sequences
(layers times batch rows) are what runs in parallel. Ties go to the lower position; scores are compared after rounding to 9 places.

A token may lack heads, and a head may come late: its slots are marked as not there, score below all others, get and give no attention and are never shown. All
heads of a layer have the same number of queries and the same width. Positions grow within a sequence."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from heddle.sources.tables import HEAD, WIDTH

SLOTS = "layer int, batch int, head int, pos int, key array<double>, value array<double>, seen double"
CHANGES = "layer int, batch int, head int, pos int, version long, change int, key array<double>, value array<double>"


def tokens_of(kv: DataFrame, queries: DataFrame | None = None, n: int | None = None) -> DataFrame:
    """layer, batch, pos, heads and the flat arrays keys, values and queries of each token, heads (and their query heads) in order.
    queries: layer, batch, head, qhead, q_pos, q; without them a token asks nothing. n: each sequence has the tokens 0 to n - 1, those that kv does not know without heads."""
    if n is not None:
        known, grid = tokens_of(kv, queries), kv.select("layer", "batch").distinct().crossJoin(kv.sparkSession.range(n).select(F.col("id").cast("int").alias("pos")))
        own = ["heads", "keys", "values", "queries"]
        return grid.join(known, ["layer", "batch", "pos"], "left").select("layer", "batch", "pos", *(F.coalesce(c, F.array().cast(known.schema[c].dataType)).alias(c) for c in own))
    rows = kv.groupBy("layer", "batch", "pos").agg(F.array_sort(F.collect_list(F.struct("head", "key", "value"))).alias("h"))
    flat = lambda c: F.flatten(F.transform("h", lambda x: x[c])).alias(f"{c}s")
    out = rows.select("layer", "batch", "pos", F.transform("h", lambda x: x["head"]).alias("heads"), flat("key"), flat("value"))
    if queries is None:
        return out.withColumn("queries", F.array().cast("array<double>"))
    asked = queries.groupBy("layer", "batch", F.col("q_pos").alias("pos")).agg(F.array_sort(F.collect_list(F.struct("head", "qhead", "q"))).alias("a"))
    return out.join(asked.select("layer", "batch", "pos", F.flatten(F.transform("a", lambda x: x["q"])).alias("queries")), ["layer", "batch", "pos"])


class _Part:
    """An array (heads, n, ...) of a cache, with room behind it for slots to come."""

    def __set_name__(self, owner: type, name: str) -> None:
        self.name = name

    def __get__(self, c: Cache | None, owner: type | None = None) -> np.ndarray:
        return self if c is None else c.room[self.name][:, : c.n]

    def __set__(self, c: Cache, x: np.ndarray) -> None:
        c.room[self.name] = x


@dataclass
class Cache:
    """What is held of one sequence: positions (heads, n), keys and values (heads, n, width), attention received in all (heads, n), and whether the head has the slot (heads, n).
    asked: the last `recent` queries (heads, group, width), not a number where a head had none."""

    name: tuple[int, int]
    heads: np.ndarray
    width: int
    recent: int = 0
    asked: list[np.ndarray] = field(default_factory=list)
    tokens: int = 0
    since: int = 0
    n: int = 0

    pos, keys, values, seen, here = _Part(), _Part(), _Part(), _Part(), _Part()

    def __post_init__(self) -> None:
        h = len(self.heads)
        self.put(np.zeros((h, 0), np.int64), np.zeros((h, 0, self.width)), np.zeros((h, 0, self.width)), np.zeros((h, 0)), np.zeros((h, 0), bool))

    def put(self, pos: np.ndarray, keys: np.ndarray, values: np.ndarray, seen: np.ndarray, here: np.ndarray) -> None:
        self.room, self.n = {"pos": pos, "keys": keys, "values": values, "seen": seen, "here": here}, pos.shape[1]

    def admit(self, heads: np.ndarray) -> None:
        """Heads that have not come before get a row, without slots so far."""
        every = np.union1d(self.heads, heads).astype(np.int64)
        if len(every) == len(self.heads):
            return
        at = np.searchsorted(every, self.heads)

        def spread(x: np.ndarray, fill: float) -> np.ndarray:
            out = np.full((len(every), *x.shape[1:]), fill, x.dtype)
            out[at] = x
            return out

        pos = np.broadcast_to(self.pos[:1], (len(every), self.n)).copy() if len(at) else np.zeros((len(every), self.n), np.int64)
        pos[at] = self.pos
        self.put(pos, spread(self.keys, 0), spread(self.values, 0), spread(self.seen, 0), spread(self.here, False))
        self.asked, self.heads = [spread(x, np.nan) for x in self.asked], every

    def append(self, pos: int, heads: np.ndarray, key: np.ndarray, value: np.ndarray, query: np.ndarray) -> np.ndarray | None:
        """A token of these heads, one after the other; gives its queries as in `asked`. One without heads counts, but has no slot."""
        self.tokens += 1
        if not len(heads):
            return None
        self.admit(heads)
        h, n, at = len(self.heads), self.n, np.searchsorted(self.heads, heads)
        for name, x in self.room.items():
            if x.shape[1] == n:
                self.room[name] = np.concatenate([x[:, :n], np.zeros((h, max(64, n), *x.shape[2:]), x.dtype)], axis=1)
            self.room[name][:, n] = 0
        self.n = n + 1
        self.pos[:, n], self.here[at, n] = pos, True
        self.keys[at, n], self.values[at, n] = key.reshape(len(at), -1), value.reshape(len(at), -1)
        if not len(query):
            return None
        own = query.reshape(len(at), -1, self.width)
        full = np.full((h, *own.shape[1:]), np.nan)
        full[at] = own
        if self.recent:
            self.asked = [*self.asked, full][-self.recent :]
        return full

    def attention(self, query: np.ndarray) -> np.ndarray:
        """Of queries (heads, group, width): softmax over the slots, (heads, group, n); 0 for slots and queries that are not there."""
        asks = ~np.isnan(query).any(axis=2, keepdims=True)
        x = np.where(self.here[:, None], np.where(asks, query, 0.0) @ self.keys.transpose(0, 2, 1) * self.width**-0.5, -np.inf)
        top = x.max(axis=2, keepdims=True)
        e = np.exp(x - np.where(np.isneginf(top), 0.0, top))
        total = e.sum(axis=2, keepdims=True)
        return np.where(asks, e / np.where(total > 0, total, 1.0), 0.0)

    def take(self, slots: np.ndarray) -> None:
        """Only these slots (heads, m) stay, in the order given."""
        one = lambda x: np.take_along_axis(x, slots, 1)
        many = lambda x: np.take_along_axis(x, slots[:, :, None], 1)
        self.put(one(self.pos), many(self.keys), many(self.values), one(self.seen), one(self.here))


# --- scores of what is held: (cache, slots that will stay) -> (heads, n), higher stays ------------------------------------


def key_norm(c: Cache, keep: int) -> np.ndarray:
    return -np.linalg.norm(c.keys, axis=2)


def key_difference(c: Cache, keep: int) -> np.ndarray:
    here = c.here[:, :, None]
    unit = c.keys / np.where(here, np.linalg.norm(c.keys, axis=2, keepdims=True), 1.0)
    anchor = unit.sum(axis=1, keepdims=True) / np.maximum(here.sum(axis=1, keepdims=True), 1)
    return -(unit * anchor).sum(axis=2) / np.linalg.norm(anchor, axis=2)


def sink_and_recent(c: Cache, keep: int, n_sink: int = 4) -> np.ndarray:
    at = c.here.cumsum(axis=1) - 1
    return np.where((at >= n_sink) & (at < n_sink + c.here.sum(axis=1, keepdims=True) - keep), 0.0, 1.0)


def last_attention(c: Cache, keep: int) -> np.ndarray:
    """The last token's attention, averaged over all heads; its own slot scores the maximum plus 1."""
    asks = ~np.isnan(c.asked[-1]).any(axis=2)
    pairs = (asks[:, :, None] & c.here[:, None, :-1]).sum(axis=(0, 1))
    w = c.attention(c.asked[-1])[:, :, :-1].sum(axis=(0, 1)) / np.maximum(pairs, 1)
    top = w.max(initial=0.0) + 1
    return np.broadcast_to(np.append(np.where(pairs > 0, w, top), top), (len(c.heads), c.n))


@dataclass
class WindowAttention:
    """Mean attention of the last `window` tokens to the slots before them, pooled over `kernel` slots and averaged over the group; theirs score the maximum plus 1. Slots
    that a head lacks count as 0 where its neighbours are pooled; queries that it lacks do not count."""

    window: int = 16
    kernel: int = 5

    def __call__(self, c: Cache, keep: int) -> np.ndarray:
        w = min(self.window, len(c.asked))
        before, q = c.n - w, np.stack(c.asked[-w:], axis=2)
        asks = ~np.isnan(q).any(axis=3, keepdims=True)
        x = np.where(asks, q, 0.0) @ c.keys[:, None].transpose(0, 1, 3, 2) * c.width**-0.5
        x = np.where((np.arange(c.n) <= np.arange(c.n - w, c.n)[:, None]) & c.here[:, None, None], x, -np.inf)
        top = x.max(axis=3, keepdims=True)
        e = np.exp(x - np.where(np.isneginf(top), 0.0, top))
        total = e.sum(axis=3, keepdims=True)
        mean = np.where(asks, e / np.where(total > 0, total, 1.0), 0.0).sum(axis=2)[:, :, :before] / np.maximum(asks.sum(axis=2), 1)
        half = self.kernel // 2
        padded = np.pad(mean, ((0, 0), (0, 0), (half, half)))
        own = sum(padded[:, :, k : k + before] for k in range(self.kernel)) / self.kernel
        score = own.mean(axis=1)
        return np.hstack([score, np.full((len(c.heads), w), score.max(initial=0.0) + 1)])


@dataclass
class Filtered:
    """-<filter, key>, with one filter for each (layer, head)."""

    filters: dict[tuple[int, int], np.ndarray]

    def __call__(self, c: Cache, keep: int) -> np.ndarray:
        f = np.array([self.filters[c.name[0], int(h)] for h in c.heads])
        return -np.einsum("hnd,hd->hn", c.keys, f)


Score = Callable[[Cache, int], np.ndarray]


def ordered(scores: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """Slots from the highest score to the lowest, lower positions first among equals, along the last axis."""
    return np.lexsort((pos, -np.round(scores, 9)))


def scored(c: Cache, score: Score, keep: int) -> np.ndarray:
    """The score, below all others where a head lacks the slot."""
    return np.where(c.here, score(c, keep), -np.inf)


# --- policies --------------------------------------------------------------------------------------------------------------


@dataclass
class Decoding:
    """After `prefill` tokens, which stay whole, the cache shrinks to its best `target` slots whenever `interval` more have come and it holds more than that."""

    score: Score
    interval: int = 512
    target: int = 2048
    prefill: int = 0
    recent: int = 1

    def step(self, c: Cache, query: np.ndarray | None) -> None:
        if c.tokens <= self.prefill:
            return
        self.look(c, query)
        c.since += 1
        if c.since >= self.interval and c.n > self.target:
            self.shrink(c)
            c.since = 0

    def look(self, c: Cache, query: np.ndarray | None) -> None:
        pass

    def shrink(self, c: Cache) -> None:
        best = ordered(scored(c, self.score, self.target), c.pos)[:, : self.target]
        c.take(np.sort(best, axis=1))

    def end(self, c: Cache) -> None:
        pass


@dataclass
class Merging(Decoding):
    """As Decoding, but all heads of a layer lose the same positions, by the mean of their scores, and before they go the values of the best of them (as
    many as tokens have come since the last round, later positions first among equals) are added to the next `budget` slots that stay, in equal
    parts: with the probability of their attention so far over the mean of those slots', drawn for each head from a hash of the seed and the slot's key. A head that
    lacks a slot takes no part in its score, and neither gives nor gets there."""

    budget: int = 32
    seed: str = "11"

    def look(self, c: Cache, query: np.ndarray | None) -> None:
        if query is not None:
            seen = c.seen
            seen += c.attention(query).mean(axis=1)

    def draw(self, c: Cache, head: int, pos: int) -> float:
        text = ":".join(map(str, (self.seed, *c.name, int(c.heads[head]), pos)))
        return int(hashlib.md5(text.encode()).hexdigest()[:8], 16) / 2.0**32

    def shrink(self, c: Cache) -> None:
        mean, pos = np.round(np.mean(self.score(c, self.target), axis=0, where=c.here), 9), c.pos[0]
        order = np.lexsort((pos, -mean))
        kept, gone = np.sort(order[: self.target]), np.sort(order[self.target :])
        merged = gone[np.lexsort((-pos[gone], -mean[gone]))][: c.since]
        first = np.searchsorted(pos[kept], pos[merged], side="right")
        values = c.values.copy()
        for slot, start in zip(merged, first, strict=True):
            into = kept[start : start + self.budget]
            for h in np.flatnonzero(c.here[:, slot]):
                own = into[c.here[h, into]]
                if not len(own):
                    continue
                with np.errstate(divide="ignore", invalid="ignore"):
                    p = np.round(c.seen[h, slot] / c.seen[h, own].mean(), 9)
                if self.draw(c, h, int(pos[slot])) < np.clip(0.0 if np.isnan(p) else p, 0.0, 1.0):
                    values[h, own] += c.values[h, slot] / len(own)
        c.values = values
        c.take(np.broadcast_to(kept, (len(c.heads), len(kept))))


@dataclass
class Block:
    """The first `kept` tokens are held; whenever `size` more have come, each head keeps the best `kept` of all that it holds, scored among themselves. kept: one number, or
    one for each (layer, batch, head)."""

    score: Score
    kept: int | dict[tuple[int, int, int], int]
    size: int = 128
    recent: int = 1

    def limits(self, c: Cache) -> np.ndarray:
        return np.array([self.kept[*c.name, int(h)] if isinstance(self.kept, dict) else self.kept for h in c.heads])

    def step(self, c: Cache, query: np.ndarray | None) -> None:
        if c.n >= self.limits(c).max(initial=0) + self.size:
            self.end(c)

    def end(self, c: Cache) -> None:
        most = self.limits(c)
        if (c.here.sum(axis=1) > most).any():
            best = ordered(scored(c, self.score, int(most.max())), c.pos)
            here = np.zeros_like(c.here)
            np.put_along_axis(here, best, np.arange(c.n) < most[:, None], 1)
            c.here = c.here & here
            c.take(np.sort(best[:, : most.max()], axis=1))


Policy = Decoding | Block


# --- a table -----------------------------------------------------------------------------------------------------------------

_VECTOR = pa.list_(pa.float64())


def _slots(c: Cache) -> Iterator[pa.RecordBatch]:
    for h, head in enumerate(c.heads):
        held = np.flatnonzero(c.here[h])
        for a in range(0, len(held), 4096):
            cut = held[a : a + 4096]
            m = len(cut)
            vectors = lambda x, m=m, cut=cut, h=h: pa.ListArray.from_arrays(pa.array(np.arange(0, m + 1, dtype=np.int32) * c.width), pa.array(x[h, cut].ravel()))
            numbers = [np.full(m, v, np.int32) for v in (*c.name, head)]
            yield pa.RecordBatch.from_arrays(
                [*map(pa.array, numbers), pa.array(c.pos[h, cut].astype(np.int32)), vectors(c.keys), vectors(c.values), pa.array(c.seen[h, cut])], names=[x.split()[0] for x in SLOTS.split(", ")]
            )


def fold(tokens: DataFrame, policy: Policy, width: int = WIDTH) -> DataFrame:
    """What the policy holds at the end of each sequence: layer, batch, head, pos, key, value, seen."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = None
        for batch in batches:
            columns = {n: batch.column(n) for n in batch.schema.names}
            names = list(zip(columns["layer"].to_pylist(), columns["batch"].to_pylist(), strict=True))
            vectors = {n: [np.asarray(x.values, float) for x in columns[n]] for n in ("keys", "values", "queries")}
            heads = columns["heads"].to_pylist()
            for k, pos in enumerate(columns["pos"].to_pylist()):
                if cache is None or cache.name != names[k]:
                    if cache is not None:
                        policy.end(cache)
                        yield from _slots(cache)
                    cache = Cache(names[k], np.array(heads[k], np.int64), width, policy.recent)
                policy.step(cache, cache.append(pos, np.array(heads[k], np.int64), vectors["keys"][k], vectors["values"][k], vectors["queries"][k]))
        if cache is not None:
            policy.end(cache)
            yield from _slots(cache)

    rows = tokens.select("layer", "batch", "pos", "heads", "keys", "values", "queries")
    return rows.repartition("layer", "batch").sortWithinPartitions("layer", "batch", "pos").mapInArrow(run, SLOTS)


# --- a stream ----------------------------------------------------------------------------------------------------------------


class Holder(StatefulProcessor):
    """The cache of each (layer, batch), as arrays of bytes. Emits, for each micro-batch, slots that join (1), that get another value (0) and that leave (-1)."""

    def __init__(self, policy: Policy, width: int):
        self.policy, self.width = policy, width

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("cache", "heads binary, pos binary, keys binary, vals binary, seen binary, here binary, asked binary, tokens long, since long")

    def load(self, name: tuple[int, int], heads: list[int]) -> Cache:
        if not self.state.exists():
            return Cache(name, np.array(heads, np.int64), self.width, self.policy.recent)
        held, pos, keys, values, seen, here, asked, tokens, since = self.state.get()
        c = Cache(name, np.frombuffer(held, np.int64), self.width, self.policy.recent)
        h = len(c.heads)
        flat = [np.frombuffer(x, kind).reshape(h, -1).copy() for x, kind in ((pos, np.int64), (seen, float), (here, bool))]
        c.put(flat[0], *(np.frombuffer(x).reshape(h, -1, self.width).copy() for x in (keys, values)), *flat[1:])
        each = np.frombuffer(asked)
        c.asked = list(each[1:].reshape(int(each[0]), h, -1, self.width)) if len(each) else []
        c.tokens, c.since = tokens, since
        return c

    def store(self, c: Cache) -> None:
        asked = np.concatenate([[len(c.asked)], np.stack(c.asked).ravel()]).tobytes() if c.asked else b""
        self.state.update((c.heads.astype(np.int64).tobytes(), c.pos.tobytes(), c.keys.tobytes(), c.values.tobytes(), c.seen.tobytes(), c.here.tobytes(), asked, c.tokens, c.since))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows)).sort_values("pos")
        c = self.load((int(key[0]), int(key[1])), list(new["heads"].iloc[0]))
        before = {int(head): {int(p): v for p, v, x in zip(c.pos[h], c.values[h].copy(), c.here[h], strict=True) if x} for h, head in enumerate(c.heads)}
        for pos, heads, *vectors in zip(new["pos"], new["heads"], new["keys"], new["values"], new["queries"], strict=True):
            self.policy.step(c, c.append(int(pos), np.array(heads, np.int64), *(np.array(x, float) for x in vectors)))
        self.store(c)
        out = []
        for h, head in enumerate(c.heads):
            was, now = before.get(int(head), {}), {int(c.pos[h, k]): k for k in np.flatnonzero(c.here[h])}
            row = lambda pos, change, k=None, h=h, head=head: (*c.name, int(head), pos, c.tokens, change, None if k is None else c.keys[h, k].tolist(), None if k is None else c.values[h, k].tolist())
            out += [row(p, -1) for p in was if p not in now]
            for p, k in now.items():
                if p not in was:
                    out.append(row(p, 1, k))
                elif not np.array_equal(c.values[h, k], was[p]):
                    out.append(row(p, 0, k))
        if out:
            yield pd.DataFrame(out, columns=[x.split()[0] for x in CHANGES.split(", ")])

    def close(self) -> None:
        pass


def cache_stream(tokens: DataFrame, policy: Policy, width: int = WIDTH) -> DataFrame:
    """tokens: a streaming table whose micro-batches come in the order of positions within each sequence. Emits changes of what is held."""
    return tokens.groupBy("layer", "batch").transformWithStateInPandas(statefulProcessor=Holder(policy, width), outputStructType=CHANGES, outputMode="Append", timeMode="None")


def held_now(changes: DataFrame) -> DataFrame:
    """layer, batch, head, pos, key, value of what is held after all changes so far: the last version of each slot that has not left."""
    last = changes.groupBy(*HEAD, "pos").agg(F.max_by(F.struct("change", "key", "value"), "version").alias("x"))
    return last.where("x.change >= 0").select(*HEAD, "pos", "x.key", "x.value")
