"""Presses: ways to shrink a cache, as objects that can be nested and built by name.

A press takes kv (layer, batch, head, pos, key, value) and gives the rows that stay (`kept`: layer, batch, head, pos) and the cache that is left
(`compress`). A scorer also has `score`; wrappers take scorers or other presses. All of it is declared on DataFrames and runs when read;
only the length of the cache (one aggregate) and the rounds of block-wise presses are settled while a plan is built."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import partial
from typing import Protocol, runtime_checkable

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from heddle.functions.vectors import norm, norm1
from heddle.operators import attention as att
from heddle.operators import linear, merging, scoring, selection, surrogate, tiles
from heddle.sources.tables import HEAD, KEYS, cut_lineage
from heddle.streaming import cache


@runtime_checkable
class Compressor(Protocol):
    ratio: float

    def kept(self, kv: DataFrame) -> DataFrame: ...

    def compress(self, kv: DataFrame) -> DataFrame: ...


@runtime_checkable
class Scorer(Compressor, Protocol):
    def score(self, kv: DataFrame) -> DataFrame: ...


def length(kv: DataFrame) -> int:
    """Positions of the longest head."""
    found = kv.agg(F.max("pos")).first()[0]
    return 0 if found is None else found + 1


def layers_of(kv: DataFrame) -> int:
    found = kv.agg(F.max("layer")).first()[0]
    return 0 if found is None else found + 1


@dataclass
class Press:
    """Keeps everything; others say what they keep."""

    ratio: float = 0.5

    def __post_init__(self) -> None:
        if not 0 <= self.ratio < 1:
            raise ValueError("the compression ratio must be at least 0 and less than 1")

    def kept(self, kv: DataFrame) -> DataFrame:
        return kv.select(*KEYS)

    def compress(self, kv: DataFrame) -> DataFrame:
        return selection.prune(kv, self.kept(kv))


@dataclass
class ScorerPress(Press):
    """The best rows of each head by a score."""

    def score(self, kv: DataFrame) -> DataFrame:
        raise NotImplementedError

    def kept(self, kv: DataFrame) -> DataFrame:
        return selection.keep_top(self.score(kv), self.ratio).select(*KEYS)


@dataclass
class Knorm(ScorerPress):
    def score(self, kv: DataFrame) -> DataFrame:
        return scoring.key_norm(kv)

    def held(self, kv: DataFrame) -> cache.Score:
        return cache.key_norm


@dataclass
class KeyDiff(ScorerPress):
    def score(self, kv: DataFrame) -> DataFrame:
        return scoring.key_difference(kv)

    def held(self, kv: DataFrame) -> cache.Score:
        return cache.key_difference


@dataclass
class Random(ScorerPress):
    seed: str = "0"

    def score(self, kv: DataFrame) -> DataFrame:
        return scoring.seeded(kv, self.seed)


@dataclass
class StreamingLLM(ScorerPress):
    n_sink: int = 4

    def score(self, kv: DataFrame) -> DataFrame:
        return scoring.sink_and_recent(kv, self.ratio, self.n_sink)

    def held(self, kv: DataFrame) -> cache.Score:
        return partial(cache.sink_and_recent, n_sink=self.n_sink)


@dataclass
class SnapKV(ScorerPress):
    window: int = 16
    kernel: int = 5

    def score(self, kv: DataFrame) -> DataFrame:
        return att.window_scores(kv, length(kv), self.window, self.kernel)

    def held(self, kv: DataFrame) -> cache.Score:
        return cache.WindowAttention(self.window, self.kernel)


@dataclass
class TOVA(ScorerPress):
    def score(self, kv: DataFrame) -> DataFrame:
        return att.last_token_scores(kv, length(kv))

    def held(self, kv: DataFrame) -> cache.Score:
        return cache.last_attention


@dataclass
class ObservedAttention(ScorerPress):
    def score(self, kv: DataFrame) -> DataFrame:
        return att.observed_scores(kv)


@dataclass
class ExpectedAttention(ScorerPress):
    epsilon: float = 0.0
    use_vnorm: bool = True
    n_sink: int = 4
    future: int = 512
    stats: DataFrame | None = None

    def score(self, kv: DataFrame) -> DataFrame:
        return att.expected_scores(kv, self.n_sink, self.epsilon, stats=self.stats, future=self.future, use_vnorm=self.use_vnorm)


@dataclass
class QFilter(ScorerPress):
    """filters: layer, head, filter; without them each head's mean query stands for its filter."""

    filters: DataFrame | None = None

    def score(self, kv: DataFrame) -> DataFrame:
        return scoring.filtered(kv, scoring.mean_queries(kv) if self.filters is None else self.filters)

    def held(self, kv: DataFrame) -> cache.Score:
        rows = (scoring.mean_queries(kv) if self.filters is None else self.filters).collect()  # a row for each head
        return cache.Filtered({(r["layer"], r["head"]): np.array(r["filter"]) for r in rows})


@dataclass
class LagKV(ScorerPress):
    lag: int = 16
    cross_scoring: bool = False

    def score(self, kv: DataFrame) -> DataFrame:
        return scoring.lag_relative(kv, length(kv), self.lag, ranks=not self.cross_scoring)


@dataclass
class CUR(ScorerPress):
    kind: str = "kv_product"

    def score(self, kv: DataFrame) -> DataFrame:
        return scoring.leverage_product(kv, kind=self.kind)


@dataclass
class Leverage(ScorerPress):
    def score(self, kv: DataFrame) -> DataFrame:
        return linear.leverage(kv)


@dataclass
class NonCausal(ScorerPress):
    chunk: int = 16

    def score(self, kv: DataFrame) -> DataFrame:
        return att.block_scores(kv, self.chunk)


@dataclass
class Compactor_(ScorerPress):
    def score(self, kv: DataFrame) -> DataFrame:
        return linear.compactor(kv, self.ratio)


@dataclass
class Capacity(ScorerPress):
    def score(self, kv: DataFrame) -> DataFrame:
        return linear.capacity(kv)


@dataclass
class KVzip(ScorerPress):
    """Largest attention from any query; plus: attention times the value's norm. chunk: the queries are a repetition of the context, which is looked at in
    chunks of as many positions, each beside the first n_sink keys, which score 1. layerwise: each layer loses the same share, else the lowest of all layers go."""

    plus: bool = False
    layerwise: bool = False
    chunk: int | None = None
    n_sink: int = 4

    def score(self, kv: DataFrame) -> DataFrame:
        queries = att.queries_of(kv)
        got = tiles.repeated_received(queries, kv, self.chunk, self.n_sink) if self.chunk else tiles.causal_received(queries, kv)
        best = got.select(*KEYS, F.col("best").alias("score"))
        if self.plus:
            best = best.join(kv.select(*KEYS, norm(F.col("value")).alias("norm")), KEYS).select(*KEYS, (F.col("score") * F.col("norm")).alias("score"))
        if self.chunk:
            best = best.unionByName(kv.where(F.col("pos") < self.n_sink).select(*KEYS, F.lit(1.0).alias("score")))
        return best

    def kept(self, kv: DataFrame) -> DataFrame:
        scores = cut_lineage(self.score(kv))
        if self.layerwise:
            return selection.keep_top(scores, self.ratio, ["layer", "batch"]).select(*KEYS)
        return kv.select(*KEYS).join(selection.global_then_layer(scores, self.ratio), KEYS, "left_anti")


@dataclass
class FastKVzip(KVzip):
    """A linear surrogate in place of attention; sinks and the last `recent` share are protected."""

    n_sink: int = 4
    recent: float = 0.02

    def score(self, kv: DataFrame) -> DataFrame:
        n = length(kv)
        own = KVzap().score(kv)
        return own.withColumn("score", F.when((F.col("pos") < self.n_sink) | (F.col("pos") >= n - int(n * self.recent)), F.lit(1e9)).otherwise(F.col("score")))


@dataclass
class KVzap(ScorerPress):
    """A surrogate (linear, or with a hidden layer) of log attention; without a given one it is fitted to the cache's own KVzip scores."""

    model: str = "linear"
    fitted: surrogate.Surrogate | None = None

    def score(self, kv: DataFrame) -> DataFrame:
        model = self.fitted or surrogate.fit(kv, KVzip().score(kv), hidden=64 if self.model == "mlp" else 0)
        return model.apply(kv)


@dataclass
class Finch(ScorerPress):
    window: int = 16
    chunk: int | None = None
    rerotate: bool = True

    def score(self, kv: DataFrame) -> DataFrame:
        return att.window_scores(kv, length(kv), self.window, kernel=1, normalize=True)

    def kept(self, kv: DataFrame) -> DataFrame:
        if self.chunk is None:
            return super().kept(kv)
        return selection.keep_top(self.score(kv).withColumn("chunk", F.expr(f"pos div {self.chunk}")), self.ratio, [*HEAD, "chunk"], 1).select(*KEYS)

    def compress(self, kv: DataFrame) -> DataFrame:
        left = super().compress(kv)
        return scoring.rerotated(left).drop("new_pos") if self.rerotate else left


@dataclass
class KVCompose(Press):
    """Budgets from composite ranks, by layer (structured) or by head. least: ranks that every layer or head keeps first."""

    structured: bool = True
    window: int = 16
    value_norm: bool = False
    add_mean: bool = True
    least: int = 0

    def kept(self, kv: DataFrame) -> DataFrame:
        scores = cut_lineage(att.composed_scores(kv, length(kv), self.window, self.value_norm, self.add_mean))
        return (selection.composed_budget if self.structured else selection.composed_heads)(scores, self.ratio, self.least)


@dataclass
class PyramidKV(SnapKV):
    """Budgets that fall from layer to layer."""

    def kept(self, kv: DataFrame) -> DataFrame:
        budgets = list(enumerate(selection.pyramid_layers(layers_of(kv), self.ratio, length(kv), self.window)))
        table = kv.sparkSession.createDataFrame(budgets, "layer int, budget long")
        return selection.ranked(self.score(kv)).join(F.broadcast(table), "layer").where("rank <= budget").select(*KEYS)


@dataclass
class LUKV(Press):
    """Head budgets by a curve (layer, head, prune; without one the ratio for all), sinks and the last rows protected."""

    base: ScorerPress = field(default_factory=Knorm)
    curve: DataFrame | None = None
    sink: int = 4
    window: int = 1

    def kept(self, kv: DataFrame) -> DataFrame:
        n = length(kv)
        curve = kv.select("layer", "head").distinct().withColumn("prune", F.lit(self.ratio)) if self.curve is None else self.curve
        safe = (F.col("pos") < self.sink) | (F.col("pos") >= n - self.window)
        scores = self.base.score(kv).withColumn("score", F.when(safe, F.lit(1e9)).otherwise(F.col("score")))
        return selection.ranked(scores).join(F.broadcast(selection.head_budgets(curve, n)), ["layer", "head"]).where("rank <= budget").select(*KEYS)


@dataclass
class Duo(Press):
    """The heads with the lowest scores, a share `ratio` of all, keep sinks and recent rows only. scores: a table layer, head, score, read as numbers from 0 to 1;
    on_the_fly: from the heads' mean queries and keys instead."""

    scores: DataFrame | None = None
    n_sink: int = 4
    recent: int = 16
    on_the_fly: bool = False

    def head_scores(self, kv: DataFrame) -> DataFrame:
        if self.on_the_fly:
            return att.mean_head_scores(kv)
        if self.scores is None:
            raise ValueError("a table of head scores is needed, or on_the_fly")
        return self.scores.select("layer", "head", F.least(F.greatest("score", F.lit(0.0)), F.lit(1.0)).alias("score"))

    def kept(self, kv: DataFrame) -> DataFrame:
        n = length(kv)
        order = Window.orderBy(F.round("score", 9), "layer", "head")  # a row for each head
        low = self.head_scores(kv).withColumn("rank", F.row_number().over(order)).withColumn("n", F.count("*").over(Window.partitionBy())).where(F.col("rank") <= F.bround(F.col("n") * F.lit(self.ratio)))
        short = kv.select(*KEYS).join(F.broadcast(low.select("layer", "head", F.lit(True).alias("short"))), ["layer", "head"], "left")
        return short.where(F.col("short").isNull() | (F.col("pos") < self.n_sink) | (F.col("pos") >= n - self.recent)).select(*KEYS)


@dataclass
class ThinK(Press):
    """Sets the lowest-scored share of each head's key channels to 0; no row goes."""

    window: int = 16

    def compress(self, kv: DataFrame) -> DataFrame:
        return att.without_channels(kv, length(kv), self.window, self.ratio)


@dataclass
class SimLayer(Press):
    threshold: float = 0.2
    n_initial: int = 4
    n_recent: int = 16

    def kept(self, kv: DataFrame) -> DataFrame:
        n = length(kv)
        rows = kv.select(*KEYS).join(F.broadcast(att.lazy_layers(kv, n, self.threshold, self.n_initial, self.n_recent)), "layer")
        return rows.where(~F.col("lazy") | (F.col("pos") < self.n_initial) | (F.col("pos") >= n - self.n_recent + 1)).select(*KEYS)


# --- wrappers ----------------------------------------------------------------------------------------------------------


@dataclass
class Wrapper:
    """A press around another one; its ratio is that of the base."""

    base: ScorerPress

    def __post_init__(self) -> None:
        if not isinstance(self.base, Scorer if self.needs_scores else Compressor):
            raise TypeError(f"{type(self).__name__} cannot wrap {type(self.base).__name__}")

    needs_scores = True

    @property
    def ratio(self) -> float:
        return self.base.ratio

    def score(self, kv: DataFrame) -> DataFrame:
        return self.base.score(kv)

    def kept(self, kv: DataFrame) -> DataFrame:
        return self.base.kept(kv)

    def compress(self, kv: DataFrame) -> DataFrame:
        return selection.prune(kv, self.kept(kv))


@dataclass
class AdaKV(Wrapper):
    safeguard: float = 0.2

    def kept(self, kv: DataFrame) -> DataFrame:
        return selection.adaptive_heads(self.score(kv), self.ratio, self.safeguard).select(*KEYS)


@dataclass
class CriticalKV(Wrapper):
    first_stage: float = 0.5

    def kept(self, kv: DataFrame) -> DataFrame:
        weights = kv.select(*KEYS, norm1(F.col("value")).alias("norm"))
        return selection.keep_top_first(selection.two_stage(self.score(kv), weights, self.ratio, self.first_stage), self.ratio)


@dataclass
class CriticalAdaKV(CriticalKV):
    safeguard: float = 0.2

    def kept(self, kv: DataFrame) -> DataFrame:
        weights = kv.select(*KEYS, norm1(F.col("value")).alias("norm"))
        return selection.two_stage_adaptive(self.score(kv), weights, self.ratio, self.first_stage, self.safeguard)


@dataclass
class Chunk(Wrapper):
    size: int = 64

    def kept(self, kv: DataFrame) -> DataFrame:
        return selection.keep_top(self.score(kv).withColumn("chunk", F.expr(f"pos div {self.size}")), self.ratio, [*HEAD, "chunk"], 1).select(*KEYS)


@dataclass
class ChunkKV(Wrapper):
    size: int = 20

    def kept(self, kv: DataFrame) -> DataFrame:
        return selection.keep_chunks(self.score(kv), self.ratio, self.size)


@dataclass
class Block(Wrapper):
    """Positions come in blocks; after each block the best of what is held and the block stay, scored anew among themselves (streaming.cache)."""

    size: int = 128

    def kept(self, kv: DataFrame) -> DataFrame:
        n = length(kv)
        return cache.fold(cache.tokens_of(kv, att.queries_of(kv)), cache.Block(self.base.held(kv), int(n * (1 - self.ratio)), self.size, window_of(self.base))).select(*KEYS)


@dataclass
class PerLayer(Wrapper):
    ratios: tuple[float, ...] = (0.25, 0.75)

    def kept(self, kv: DataFrame) -> DataFrame:
        table = kv.sparkSession.createDataFrame([(k, 1.0 - r) for k, r in enumerate(self.ratios)], "layer int, keep double")
        rows = selection.counted(selection.ranked(self.score(kv))).join(F.broadcast(table), "layer")
        return rows.where(F.col("rank") <= F.floor(F.col("n") * F.col("keep"))).select(*KEYS)


@dataclass
class Threshold(Wrapper):
    """All rows under a score go, but for the last `window`."""

    threshold: float = -3.0
    window: int = 16

    def kept(self, kv: DataFrame) -> DataFrame:
        return self.score(kv).where((F.round("score", 9) >= self.threshold) | (F.col("pos") >= length(kv) - self.window)).select(*KEYS)


@dataclass
class KeyRerotation(Wrapper):
    needs_scores = False

    def compress(self, kv: DataFrame) -> DataFrame:
        return scoring.rerotated(super().compress(kv)).drop("new_pos")


@dataclass
class Merging(Wrapper):
    needs_scores = False
    threshold: float = 0.0
    fraction: float = 1.0

    def compress(self, kv: DataFrame) -> DataFrame:
        return merging.merge_evicted(kv, self.kept(kv), self.threshold, self.fraction)


@dataclass
class Decoding(Wrapper):
    """Rows come one by one; each `interval` of them the cache shrinks to `target` rows by the base's own choice. Bases that score what is held go over the
    tokens with a bounded state (streaming.cache); those whose heads keep different numbers of rows take a round for each interval."""

    needs_scores = False
    interval: int = 512
    target: int = 1024

    def kept(self, kv: DataFrame) -> DataFrame:
        return self.compress(kv).select(*KEYS)

    def folded(self, kv: DataFrame, policy: cache.Policy) -> DataFrame:
        return cache.fold(cache.tokens_of(kv, att.queries_of(kv)), policy).drop("seen")

    def compress(self, kv: DataFrame) -> DataFrame:
        if hasattr(self.base, "held"):
            return self.folded(kv, cache.Decoding(self.base.held(kv), self.interval, self.target, recent=window_of(self.base)))
        n, held, at = length(kv), kv.limit(0), 0
        while at < n:
            stop = min(at + self.interval, n)
            rows = held.unionByName(kv.where((F.col("pos") >= at) & (F.col("pos") < stop)).select(*held.columns))
            count = rows.groupBy(*HEAD).count().agg(F.max("count")).first()[0] or 0
            if stop - at == self.interval and count > self.target:
                rows = with_ratio(self.base, 1.0 - self.target / count).compress(rows)
            held, at = cut_lineage(rows), stop
        return held


def with_ratio(press, ratio: float):
    """A copy of a press with another ratio, given to the innermost of its wrapped presses."""
    return replace(press, base=with_ratio(press.base, ratio)) if isinstance(press, Wrapper) else replace(press, ratio=ratio)


def window_of(press) -> int:
    """The number of last queries that a scorer of held rows looks at."""
    return getattr(press, "window", 1)


@dataclass
class CAM(Decoding):
    """As Decoding, but all heads of a layer lose the same rows, by the mean of the base's scores, and values of the best of them are added to the next `budget`
    rows that stay, with a probability from the attention that each has received so far."""

    budget: int = 32
    seed: str = "11"

    def compress(self, kv: DataFrame) -> DataFrame:
        scorer = self.base.base if isinstance(self.base, AdaKV) else self.base
        return self.folded(kv, cache.Merging(scorer.held(kv), self.interval, self.target, recent=window_of(scorer), budget=self.budget, seed=self.seed))


@dataclass
class Composed:
    """Presses one after the other."""

    presses: list

    def __post_init__(self) -> None:
        for p in self.presses:
            if not isinstance(p, Compressor):
                raise TypeError(f"{type(p).__name__} is no press")
            if isinstance(p, (ObservedAttention, AdaKV, KVzip, Decoding)):
                raise TypeError(f"{type(p).__name__} cannot be composed: what it looks at is gone after another press")

    @property
    def ratio(self) -> float:
        left = 1.0
        for p in self.presses:
            left *= 1.0 - p.ratio
        return 1.0 - left

    def compress(self, kv: DataFrame) -> DataFrame:
        for p in self.presses:
            kv = p.compress(kv)
        return kv

    def kept(self, kv: DataFrame) -> DataFrame:
        return self.compress(kv).select(*KEYS)


#: Compositions by name (fixed values: the names and what each is made of). A builder takes the compression ratio.
REGISTRY: dict[str, Callable[[float], object]] = {
    "no_press": lambda r: Press(0.0),
    "knorm": lambda r: Knorm(r),
    "keydiff": lambda r: KeyDiff(r),
    "random": lambda r: Random(r),
    "streaming_llm": lambda r: StreamingLLM(r),
    "snapkv": lambda r: SnapKV(r),
    "tova": lambda r: TOVA(r),
    "observed_attention": lambda r: ObservedAttention(r),
    "qfilter": lambda r: QFilter(r),
    "lagkv": lambda r: LagKV(r),
    "cur": lambda r: CUR(r),
    "compactor": lambda r: Compactor_(r),
    "finch": lambda r: Finch(r),
    "kvzip": lambda r: KVzip(r),
    "kvzip_plus": lambda r: KVzip(r, plus=True),
    "fastkvzip": lambda r: FastKVzip(r),
    "kvcompose": lambda r: KVCompose(r),
    "kvcompose_unstructured": lambda r: KVCompose(r, structured=False),
    "pyramidkv": lambda r: PyramidKV(r),
    "think": lambda r: ThinK(r),
    "duo_attention": lambda r: Duo(r),
    "duo_attention_on_the_fly": lambda r: Duo(r, on_the_fly=True),
    "expected_attention": lambda r: AdaKV(ExpectedAttention(r, epsilon=1e-2)),
    "adakv_snapkv": lambda r: AdaKV(SnapKV(r)),
    "adakv_compactor": lambda r: AdaKV(Compactor_(r)),
    "block_keydiff": lambda r: Block(KeyDiff(r), size=128),
    "chunkkv": lambda r: ChunkKV(SnapKV(r), size=20),
    "critical_expected_attention": lambda r: CriticalKV(ExpectedAttention(r, use_vnorm=False)),
    "critical_snapkv": lambda r: CriticalKV(SnapKV(r)),
    "critical_adakv_expected_attention": lambda r: CriticalAdaKV(ExpectedAttention(r, use_vnorm=False)),
    "critical_adakv_snapkv": lambda r: CriticalAdaKV(SnapKV(r)),
    "lukv": lambda r: LUKV(r, ExpectedAttention(r, epsilon=2e-2), sink=4, window=1),
    "snap_think": lambda r: Composed([SnapKV(r), ThinK(r)]),
    "kvzap_linear": lambda r: Threshold(KVzap(r)),
    "kvzap_mlp": lambda r: Threshold(KVzap(r, model="mlp")),
    "kvzap_mlp_head": lambda r: KVzap(r, model="mlp"),
    "kvzap_mlp_layer": lambda r: AdaKV(KVzap(r, model="mlp")),
    "merging_knorm": lambda r: Merging(Knorm(r)),
    "merging_snapkv": lambda r: Merging(SnapKV(r)),
    "merging_expected_attention": lambda r: Merging(ExpectedAttention(r, epsilon=1e-2)),
    "merging_kvzap_mlp": lambda r: Merging(KVzap(r, model="mlp")),
    "cam_streaming_llm": lambda r: CAM(StreamingLLM(r)),
    "cam_knorm": lambda r: CAM(Knorm(r)),
    "cam_tova": lambda r: CAM(TOVA(r)),
    "cam_adakv_snapkv": lambda r: CAM(AdaKV(SnapKV(r))),
    "decoding_knorm": lambda r: Decoding(Knorm(r)),
    "decoding_streaming_llm": lambda r: Decoding(StreamingLLM(r)),
    "decoding_tova": lambda r: Decoding(TOVA(r)),
    "decoding_qfilter": lambda r: Decoding(QFilter(r)),
    "decoding_keydiff": lambda r: Decoding(KeyDiff(r)),
    "decoding_adakv_snapkv": lambda r: Decoding(AdaKV(SnapKV(r))),
    "decoding_adakv_expected_attention_e2": lambda r: Decoding(AdaKV(ExpectedAttention(r, epsilon=1e-2))),
}


def build(name: str, ratio: float = 0.5, **settings):
    """The press of this name; settings are put on the outermost press that has them."""
    if name not in REGISTRY:
        raise ValueError(f"no press {name}; there are {sorted(REGISTRY)}")
    press = REGISTRY[name](ratio)
    for key, value in settings.items():
        if not hasattr(press, key):
            raise ValueError(f"{name} has no setting {key}")
        setattr(press, key, value)
    return press


def configured(
    name: str, ratio: float, head_ratio: float | None = None, channel_ratio: float | None = None, threshold: float | None = None, interval: int | None = None, target: int | None = None, **settings
):
    """The press of a run's configuration. Which number is its share depends on its class: heads for Duo, channels for ThinK (alone or among composed presses), neither
    of which has a default; presses with a threshold need one and take no ratio; those that decode take interval and target, where given; all others the ratio."""
    press = build(name, ratio, **settings)

    def needed(value: float | None, what: str) -> float:
        if value is None:
            raise ValueError(f"{name} needs {what}")
        return value

    if isinstance(press, Duo):
        return replace(press, ratio=needed(head_ratio, "head_ratio"))
    if isinstance(press, Threshold):
        return replace(press, threshold=needed(threshold, "threshold"))
    if isinstance(press, Composed):
        return Composed([replace(p, ratio=needed(channel_ratio, "channel_ratio")) if isinstance(p, ThinK) else p for p in press.presses])
    if isinstance(press, ThinK):
        return replace(press, ratio=needed(channel_ratio, "channel_ratio"))
    if isinstance(press, Decoding):
        return replace(press, interval=interval or press.interval, target=target or press.target)
    return press
