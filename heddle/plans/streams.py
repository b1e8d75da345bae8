"""Stream queries, run to the end of their input, and scores without a relational form."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from heddle.operators import attention as att
from heddle.operators import linear, selection
from heddle.plans.etl import scratch
from heddle.plans.press import channels, length, shown
from heddle.plans.registry import query
from heddle.sources.tables import Tables
from heddle.streaming import cache
from heddle.streaming import stateful as st

SEQ = "sq AS (SELECT user_id % 16 AS seq, row_number() OVER (PARTITION BY user_id % 16 ORDER BY ts, event_id) AS step, coalesce(value, 0) AS score FROM events)"

PARTS, FILES = 3, 4


def steps(t: Tables) -> DataFrame:
    """Events as numbered rows of 16 sequences, written as PARTS lots of files and read as a stream of as many micro-batches or more."""
    path = scratch(t, "steps")
    order = Window.partitionBy("seq").orderBy("ts", "event_id")
    rows = t.events.withColumn("seq", F.col("user_id") % 16).select("seq", F.row_number().over(order).cast("long").alias("step"), F.coalesce("value", F.lit(0.0)).alias("score"), F.ntile(PARTS).over(order).alias("part"))
    rows = rows.repartition(FILES, "seq").persist()  # a sequence's rows of one lot are in one file, so lots come in order
    for part in range(1, PARTS + 1):
        rows.where(F.col("part") == part).drop("part").write.mode("append").parquet(path)
    rows.unpersist()
    return st.stateful_session(t.spark).readStream.schema("seq long, step long, score double").option("maxFilesPerTrigger", FILES).parquet(path)


def last_set(t: Tables, policy: st.Policy) -> DataFrame:
    """The kept set of each sequence once all rows have come."""
    out = st.run_to_end(t.spark, st.pruned_stream(steps(t), policy), scratch(t, "stream"))
    return st.kept_now(out).select("seq", "step", F.round("score", 6).alias("score"))


query("stream_topk", f"WITH {SEQ} SELECT seq, step, round(score, 6) AS score FROM sq QUALIFY row_number() OVER (PARTITION BY seq ORDER BY score DESC, step) <= 8")(lambda t: last_set(t, st.TopAlways(8)))
query("stream_sink_recent", f"WITH {SEQ} SELECT seq, step, round(score, 6) AS score FROM sq QUALIFY step <= 4 OR step > max(step) OVER (PARTITION BY seq) - 16")(lambda t: last_set(t, st.SinkAndRecent(4, 16)))
query("stream_decoding_topk")(lambda t: last_set(t, st.EveryInterval(64, 32)))
query("stream_ratio_target")(lambda t: last_set(t, st.RatioOfSeen(64, 0.75)))
query("stream_prefill_decode")(lambda t: last_set(t, st.PrefillThenDecode(128, 0.5, 64, 32)))
query(
    "stream_dms_delay",
    f"WITH {SEQ} SELECT seq, step, round(score, 6) AS score FROM sq QUALIFY score >= 20 OR step > max(step) OVER (PARTITION BY seq) - 16",
)(lambda t: last_set(t, st.DelayedThreshold(16, 20.0)))


@query("stream_agg", "SELECT user_id % 16 AS seq, round(max(coalesce(value, 0)), 6) AS top, count(*) AS n FROM events GROUP BY ALL")
def stream_agg(t: Tables) -> DataFrame:
    """A running aggregate; the last row of each key is its final state."""
    agg = steps(t).groupBy("seq").agg(F.max("score").alias("top"), F.count("*").alias("n"))
    path, held = scratch(t, "agg"), scratch(t, "agg-out")

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("append").parquet(held)

    agg.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", path).trigger(availableNow=True).start().awaitTermination()
    rows = t.spark.read.parquet(held)
    return rows.groupBy("seq").agg(F.max(F.struct("batch", "top", "n")).alias("x")).select("seq", F.round("x.top", 6).alias("top"), F.col("x.n").alias("n"))


@query("stream_checkpoint", "SELECT DISTINCT user_id % 16 AS seq, event_type FROM events")
def stream_checkpoint(t: Tables) -> DataFrame:
    """An append-only sink that takes each id once, also over restarts."""
    path = scratch(t, "once")
    t.events.select((F.col("user_id") % 16).alias("seq"), "event_type").write.parquet(f"{path}/in")
    rows = t.spark.readStream.schema("seq long, event_type string").parquet(f"{path}/in").dropDuplicates(["seq", "event_type"])
    for _ in range(2):  # the second run finds nothing new
        out = st.run_to_end(t.spark, rows, path)
    return out




def token_stream(t: Tables) -> DataFrame:
    """The cache's tokens in PARTS lots of positions, read as a stream of as many micro-batches or more."""
    path = scratch(t, "tokens")
    rows = cache.tokens_of(t.kv, att.queries_of(t.kv))
    size = -(-length(t) // PARTS)
    rows = rows.withColumn("part", F.expr(f"pos div {size}")).repartition(FILES, "layer", "batch").persist()
    for part in range(PARTS):
        rows.where(F.col("part") == part).drop("part").write.mode("append").parquet(path)
    rows.unpersist()
    return st.stateful_session(t.spark).readStream.schema(rows.drop("part").schema).option("maxFilesPerTrigger", FILES).parquet(path)


@query("stream_cam")
def stream_cam(t: Tables) -> DataFrame:
    """Half of the cache is prefilled; then each 16 tokens it shrinks to a quarter, merging values, with the attention since the prefill as state."""
    n = length(t)
    policy = cache.Merging(cache.key_norm, interval=16, target=n // 4, prefill=n // 2, budget=4)
    return channels(cache.held_now(st.run_to_end(t.spark, cache.cache_stream(token_stream(t), policy), scratch(t, "cam"))))


query("leverage")(lambda t: shown(selection.keep_top(linear.leverage(t.kv), 0.5)))
query("compactor")(lambda t: shown(selection.keep_top(linear.compactor(t.kv, 0.5), 0.5)))
query("capkv")(lambda t: shown(selection.keep_top(linear.capacity(t.kv), 0.5)))
