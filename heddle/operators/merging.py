"""Folding evicted rows into kept ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from heddle.functions.vectors import divide, norm
from heddle.operators import tiles
from heddle.sources.tables import HEAD, KEYS, WIDTH


def nearest_kept(kv: DataFrame, kept: DataFrame, width: int = WIDTH) -> DataFrame:
    """For each evicted row: target (position of the kept row of the same head whose key has the highest cosine) and sim; matrix products by tiles."""
    unit = kv.select(*KEYS, divide(F.col("key"), F.greatest(norm(F.col("key")), F.lit(1e-6))).alias("u"))
    return tiles.nearest(unit.join(kept.select(*KEYS), KEYS, "left_anti"), unit.join(kept.select(*KEYS), KEYS, "left_semi"), width)


def merge_evicted(kv: DataFrame, kept: DataFrame, threshold: float = 0.0, fraction: float = 1.0, width: int = WIDTH) -> DataFrame:
    """Kept rows whose values take in the evicted ones nearest to them: (v + sum w e) / (1 + sum w), with
    w = sim+ * |e| / (|e| + |v| + 1e-6) for matches at the threshold or above and among the best `fraction` of their head. Keys stay."""
    match = nearest_kept(kv, kept, width)
    if fraction < 1.0:
        cut = match.withColumn("able", F.when(F.col("sim") >= threshold, F.col("sim")).otherwise(float("-inf"))).groupBy(*HEAD).agg(F.percentile("able", F.lit(1.0 - fraction)).alias("cut"))
        match = match.join(F.broadcast(cut), HEAD).where(F.col("sim") >= F.col("cut"))
    match = match.where(F.col("sim") >= threshold)
    values = kv.select(*KEYS, "value", norm(F.col("value")).alias("norm"))
    gone = match.join(values, KEYS).select(*HEAD, "target", "sim", F.col("value").alias("e"), F.col("norm").alias("e_norm"))
    keep = kv.join(kept.select(*KEYS), KEYS, "left_semi").withColumn("norm", norm(F.col("value")))
    both = gone.join(keep.select(*HEAD, F.col("pos").alias("target"), F.col("norm").alias("v_norm")), [*HEAD, "target"])
    both = both.withColumn("w", F.greatest("sim", F.lit(0.0)) * F.col("e_norm") / (F.col("e_norm") + F.col("v_norm") + 1e-6))
    sums = both.groupBy(*HEAD, F.col("target").alias("pos")).agg(F.sum("w").alias("w"), F.array(*(F.sum(F.col("w") * F.get(F.col("e"), F.lit(i))) for i in range(width))).alias("add"))
    out = keep.join(sums, KEYS, "left")
    merged = F.zip_with("value", "add", lambda v, a: v + a)
    value = F.when(F.col("w") > 0, divide(merged, 1 + F.col("w"))).otherwise(F.col("value"))
    return out.select(*KEYS, "key", value.alias("value"))


def following_slots(kept: DataFrame, evicted: DataFrame, budget: int) -> DataFrame:
    """For each evicted position the next `budget` kept ones of its head: layer, batch, head, pos, target. The first slot is the count of kept positions not
    above the evicted one, found in one running window over both, and the slots follow from ranks, so the join is on equality."""
    every = kept.select(*KEYS, F.lit(1).alias("k")).unionByName(evicted.select(*KEYS, F.lit(0).alias("k")))
    run = Window.partitionBy(*HEAD).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    ranked = every.withColumn("before", F.sum("k").over(run))
    slots = ranked.where("k = 1").select(*HEAD, F.col("before").alias("slot"), F.col("pos").alias("target"))
    wanted = ranked.where("k = 0").select(*KEYS, F.explode(F.sequence(F.col("before") + 1, F.col("before") + budget)).alias("slot"))
    return wanted.join(slots, [*HEAD, "slot"]).select(*KEYS, "target")

