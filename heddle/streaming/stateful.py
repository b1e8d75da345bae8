"""Pruning of growing sequences, as streams.

Rows (seq, step, score) arrive in any order inside a micro-batch; a processor sorts them by step and keeps what its policy keeps. It emits
changes: a row with change 1 when it joins the kept set and with -1 when it leaves, so a row is written twice at the most, whatever the
stream's length, and the set at any time is what has joined and not left. Rows that come and go inside one micro-batch are not written.
State is what a policy may still judge: bounded by its target plus its interval, or by its window."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROW = "step long, score double"
OUT = "seq long, step long, score double, change int"
Rows = list[tuple[int, float]]


class Policy(Protocol):
    def __call__(self, seen: int, held: Rows, new: Rows) -> tuple[Rows, Rows]:
        """After `seen` rows, of which `held` may still be judged, `new` rows come: what may be judged from now on, and what goes."""


class Pruner(StatefulProcessor):
    """The rows of each sequence that its policy may still judge, and how many have come."""

    def __init__(self, policy: Policy):
        self.policy = policy

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getListState("held", ROW)
        self.seen = handle.getValueState("seen", "seen long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = sorted((int(s), float(v)) for part in rows for s, v in zip(part["step"], part["score"], strict=True))
        held = [(int(s), float(v)) for s, v in self.held.get()] if self.held.exists() else []
        seen = int(self.seen.get()[0]) if self.seen.exists() else 0
        held, gone = self.policy(seen, held, new)
        self.held.put(held)
        self.seen.update((seen + len(new),))
        came, went = set(new), set(gone)
        out = [(int(key[0]), s, v, 1) for s, v in new if (s, v) not in went] + [(int(key[0]), s, v, -1) for s, v in gone if (s, v) not in came]
        if out:
            yield pd.DataFrame(out, columns=["seq", "step", "score", "change"])

    def close(self) -> None:
        pass


def best(rows: Rows, n: int) -> tuple[Rows, Rows]:
    """The n highest scores, earlier steps first among equals, and the others; both in the order of steps."""
    keep = set(heapq.nsmallest(n, rows, key=lambda r: (-r[1], r[0])))
    return [r for r in rows if r in keep], [r for r in rows if r not in keep]


class EveryInterval:
    """Shrinks to `target` each time `interval` rows have come. What is held is a heap: a row is pushed once and popped once, however many are held."""

    def __init__(self, interval: int, target: int):
        self.interval, self.target = interval, target

    def size(self, seen: int) -> int:
        return self.target

    def __call__(self, seen: int, held: Rows, new: Rows) -> tuple[Rows, Rows]:
        heap, gone, at = [(score, -step) for step, score in held], [], 0  # the lowest score, and the latest step among equals, goes first
        heapq.heapify(heap)
        while at < len(new):
            step = min(self.interval - seen % self.interval, len(new) - at)
            for s, score in new[at : at + step]:
                heapq.heappush(heap, (score, -s))
            seen, at = seen + step, at + step
            if seen % self.interval == 0:
                lost = [heapq.heappop(heap) for _ in range(len(heap) - self.size(seen))]
                gone += sorted((-s, score) for score, s in lost)
        return sorted((-s, score) for score, s in heap), gone


class RatioOfSeen(EveryInterval):
    """Shrinks to max(1, int(seen * (1 - ratio))) each interval: the target follows what has been seen, not what is left."""

    def __init__(self, interval: int, ratio: float):
        super().__init__(interval, 1)
        self.ratio = ratio

    def size(self, seen: int) -> int:
        return max(1, int(seen * (1 - self.ratio)))


class PrefillThenDecode:
    """The first `prefill` rows are pruned once by ratio, later ones every interval."""

    def __init__(self, prefill: int, ratio: float, interval: int, target: int):
        self.prefill, self.ratio, self.decode = prefill, ratio, EveryInterval(interval, target)

    def __call__(self, seen: int, held: Rows, new: Rows) -> tuple[Rows, Rows]:
        first, gone = max(0, min(self.prefill - seen, len(new))), []
        held = held + new[:first]
        if first and seen + first == self.prefill:
            held, gone = best(held, int(self.prefill * (1 - self.ratio)))
        held, later = self.decode(seen + first, held, new[first:])
        return held, gone + later


class DelayedThreshold:
    """A row is judged only once `window` newer rows have come; it goes if its score is below the threshold, else it stays for good, outside the state."""

    def __init__(self, window: int, threshold: float):
        self.window, self.threshold = window, threshold

    def __call__(self, seen: int, held: Rows, new: Rows) -> tuple[Rows, Rows]:
        every = held + new
        judged = max(0, len(every) - self.window)
        return every[judged:], [r for r in every[:judged] if r[1] < self.threshold]


class TopAlways:
    """The best n of all rows so far."""

    def __init__(self, n: int):
        self.n = n

    def __call__(self, seen: int, held: Rows, new: Rows) -> tuple[Rows, Rows]:
        return best(held + new, self.n)


class SinkAndRecent:
    """The first `sink` rows and the last `recent`."""

    def __init__(self, sink: int, recent: int):
        self.sink, self.recent = sink, recent

    def __call__(self, seen: int, held: Rows, new: Rows) -> tuple[Rows, Rows]:
        every = held + new
        cut = max(self.sink, len(every) - self.recent)
        return every[: self.sink] + every[cut:], every[self.sink : cut]


def pruned_stream(rows: DataFrame, policy: Policy) -> DataFrame:
    """rows: a streaming (seq, step, score). Emits what joins and leaves each kept set."""
    return rows.groupBy("seq").transformWithStateInPandas(statefulProcessor=Pruner(policy), outputStructType=OUT, outputMode="Append", timeMode="None")


def stateful_session(spark: SparkSession) -> SparkSession:
    """A session of the same application, with settings of its own, whose streams keep their state in RocksDB."""
    own = spark.newSession()
    for key, value in spark.sparkContext.getConf().getAll():
        if key.startswith("spark.sql.") and ".static" not in key and spark.conf.isModifiable(key):
            own.conf.set(key, value)
    own.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
    own.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return own


def kept_now(changes: DataFrame) -> DataFrame:
    """seq, step, score of what has joined and not left."""
    return changes.groupBy("seq", "step", "score").agg(F.sum("change").alias("held")).where("held > 0").drop("held")


def run_to_end(spark: SparkSession, stream: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """Runs a stream over all that is there now and reads what it wrote. A session for stateful pruning has RocksDB as its state store (stateful_session)."""
    stream.writeStream.format("parquet").outputMode(mode).option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out")
