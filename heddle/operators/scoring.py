"""Scores of cache positions: kv in, (layer, batch, head, pos, score) out; higher is kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heddle.functions.vectors import divide, dot, mean_vector, norm, rotate, total
from heddle.sources.tables import HEAD, KEYS, WIDTH

def every_head():
    return Window.partitionBy(*HEAD)



def lengths(kv: DataFrame) -> DataFrame:
    """batch, n: positions of each sequence, those of its longest head."""
    return kv.groupBy("batch").agg((F.max("pos") + 1).alias("n"))


def key_norm(kv: DataFrame) -> DataFrame:
    """Small keys first: -|k|."""
    return kv.select(*KEYS, (-norm(F.col("key"))).alias("score"))


def key_difference(kv: DataFrame, width: int = WIDTH) -> DataFrame:
    """-cos(k, anchor), the anchor being the mean of the head's unit keys. The anchors are a table of heads."""
    unit = kv.select(*KEYS, divide(F.col("key"), norm(F.col("key"))).alias("unit"))
    anchors = unit.groupBy(*HEAD).agg(mean_vector("unit", width).alias("anchor"))
    return unit.join(anchors, HEAD).select(*KEYS, (-dot(F.col("unit"), F.col("anchor")) / norm(F.col("anchor"))).alias("score"))


def sink_and_recent(kv: DataFrame, ratio: float, n_sink: int = 4) -> DataFrame:
    """0 for the positions after the first n_sink that a ratio prunes of the sequence's length, 1 for all others."""
    pruned = F.col("n") - F.floor(F.col("n") * F.lit(1.0 - ratio))
    return kv.select(*KEYS).join(F.broadcast(lengths(kv)), "batch").select(*KEYS, F.when((F.col("pos") >= n_sink) & (F.col("pos") < n_sink + pruned), 0.0).otherwise(1.0).alias("score"))


def filtered(kv: DataFrame, filters: DataFrame) -> DataFrame:
    """-<filter, k>, one filter for each (layer, head): a small dimension table."""
    return kv.join(F.broadcast(filters), ["layer", "head"]).select(*KEYS, (-dot(F.col("filter"), F.col("key"))).alias("score"))


def mean_queries(kv: DataFrame, width: int = WIDTH) -> DataFrame:
    """layer, head, filter: the mean of each head's queries, at length 1."""
    both = kv.select("layer", "head", F.explode(F.array("key", "value")).alias("q"))
    mean = both.groupBy("layer", "head").agg(mean_vector("q", width).alias("m"))
    return mean.select("layer", "head", divide(F.col("m"), F.greatest(norm(F.col("m")), F.lit(1e-12))).alias("filter"))


def seeded(kv: DataFrame, seed: str) -> DataFrame:
    """A number in [0, 1) that depends on the seed and the row's key alone."""
    text = F.concat_ws(":", F.lit(seed), *(F.col(c) for c in KEYS))
    return kv.select(*KEYS, hash_unit(text).alias("score"))


def hash_unit(text: Column) -> Column:
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / 2.0**32


def leverage_product(kv: DataFrame, sinks: int = 4, window: int = 16, kind: str = "kv_product") -> DataFrame:
    """Squared norms of key and value, each as a share of its window of positions, multiplied (kv_product), averaged (kv_avg) or alone (key, value);
    the first positions score 1."""
    local = Window.partitionBy(*HEAD, F.expr(f"pos div {window}"))
    sq = kv.select(*KEYS, dot(F.col("key"), F.col("key")).alias("k2"), dot(F.col("value"), F.col("value")).alias("v2"))
    k, v = F.col("k2") / F.sum("k2").over(local), F.col("v2") / F.sum("v2").over(local)
    shares = sq.select(*KEYS, {"kv_product": k * v, "kv_avg": (k + v) / 2, "key": k, "value": v}[kind].alias("s"))
    return shares.select(*KEYS, F.when(F.col("pos") < sinks, 1.0).otherwise(F.col("s") / F.sum("s").over(every_head())).alias("score"))


def lag_relative(kv: DataFrame, n: int, lag: int = 16, n_sink: int = 4, width: int = WIDTH, ranks: bool = True) -> DataFrame:
    """Partitions of `lag` positions, scaled by the next partition's range in each channel; the deviation over channels, as a
    softmax over the partition, averaged over key and value, gives the rank in the partition, or is the score itself (ranks=False: partitions
    then compete). A channel without a range counts as 0. Sinks and the tail score 1."""
    if n < n_sink + 2 * lag:
        ramp = (F.col("pos") - n_sink) / (n - n_sink)
        return kv.select(*KEYS, F.when(F.col("pos") < n_sink, 1.0).otherwise(ramp).alias("score"))
    parts = (n - n_sink) // lag
    rows = kv.where((F.col("pos") >= n_sink) & (F.col("pos") < n_sink + parts * lag)).withColumn("part", F.expr(f"(pos - {n_sink}) div {lag}"))
    element = lambda c, f: F.array(*(f(F.get(F.col(c), F.lit(i))) for i in range(width)))
    ranges = rows.groupBy(*HEAD, "part").agg(*(element(c, f).alias(f"{c}_{k}") for c in ("key", "value") for k, f in (("lo", F.min), ("hi", F.max))))
    ahead = ranges.withColumn("part", F.col("part") - 1)
    both = rows.join(ahead, [*HEAD, "part"])
    scaled = lambda c: F.zip_with(F.zip_with(F.col(c), F.col(f"{c}_lo"), lambda x, y: x - y), F.zip_with(F.col(f"{c}_hi"), F.col(f"{c}_lo"), lambda x, y: x - y), lambda x, y: F.when(y != 0, x / y).otherwise(0.0))
    local = Window.partitionBy(*HEAD, "part")
    out = both.select(*KEYS, "part", scaled("key").alias("k"), scaled("value").alias("v"))
    for c in ("k", "v"):
        mean = total(F.col(c)) / width
        out = out.withColumn(f"{c}_mean", mean).withColumn(c, F.sqrt(F.aggregate(F.col(c), F.struct(F.lit(0.0).alias("s"), F.col(f"{c}_mean").alias("m")), lambda a, x: F.struct((a["s"] + (x - a["m"]) * (x - a["m"])).alias("s"), a["m"].alias("m")))["s"] / (width - 1)))
    out = out.select(*KEYS, "part", F.exp("k").alias("k"), F.exp("v").alias("v"))
    out = out.withColumn("s", (F.col("k") / F.sum("k").over(local) + F.col("v") / F.sum("v").over(local)) / 2)
    rank = F.row_number().over(local.orderBy(F.round("s", 9), "pos")) - 1
    scored = out.select(*KEYS, (rank / F.lit(lag) if ranks else F.col("s")).alias("score"))
    return kv.select(*KEYS).join(scored, KEYS, "left").select(*KEYS, F.coalesce("score", F.lit(1.0)).alias("score"))


def rerotated(kept: DataFrame, base: float = 10000.0, width: int = WIDTH) -> DataFrame:
    """Kept keys closed up to positions 0, 1, ... and turned by the difference: new_pos, key."""
    half = width // 2
    new = kept.withColumn("new_pos", (F.row_number().over(Window.partitionBy(*HEAD).orderBy("pos")) - 1).cast("int"))
    angles = F.transform(F.sequence(F.lit(0), F.lit(half - 1)), lambda i: (F.col("new_pos") - F.col("pos")) * F.pow(F.lit(base), -i / F.lit(float(half))))
    return new.withColumn("angles", angles).withColumn("key", rotate(F.col("key"), F.col("angles"), half)).drop("angles")
