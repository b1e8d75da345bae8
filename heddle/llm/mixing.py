"""Mixing sources to target weights with a low-discrepancy schedule (operator 5).

Each source's documents are shuffled (by digest of their id), laid end to end and cut into blocks of an equal
number of words. Slot i of the schedule takes the point frac((i + 1) * 0.618...) of the golden-ratio sequence; mapped
through the cumulative slot weights it names a source; the slot's rank r among that source's slots names a block
(r modulo the source's blocks), so a source with a target above its size starts over. Slots join blocks, blocks join
documents.

Targets: the total is shared by weight; a source whose share is above `most_epochs` times its size stops there and
the excess is shared again by weight among the others, until none is above. Sources are ordered by code point, null
last; weights repeat.

Scale. A block holds 1/2048 of its source's target, but MAX_BLOCK words at most, so rounding to whole blocks and the
sequence's discrepancy (a few slots) stay far below one percent of any target. Texts are never moved: only (id,
size, digest) rows are. Positions in a source and ranks of slots come from counts of chunks first and then from
windows in one chunk, so a hot source is spread over many tasks. The driver holds one row for each source.

Defined cases: a null or blank text has size 0 and is never taken; null ids are ordered as the text ''; repeated rows
are mixed one by one; a null source is a source; an empty table gives no rows. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from heddle.llm.common import materialize, read, words

GOLDEN, SLOTS_EACH, MAX_BLOCK, CHUNK_ROWS, SLOT_CHUNK = 0.6180339887498949, 2048, 65536, 4096, 65536
DIGITS = 15  # hex digits of the shuffling digest; they fit a long


def share_out(sizes: list[int], weights: list[float], most_epochs: int = 3) -> list[float]:
    """Targets of sources with these sizes and weights: 100 % of all sizes, none above most_epochs times its size."""
    total, full = float(sum(sizes)), set()
    while True:
        left = total - sum(most_epochs * sizes[k] for k in full)
        weight = sum(w for k, w in enumerate(weights) if k not in full)
        out = [float(most_epochs * s) if k in full else left * weights[k] / weight for k, s in enumerate(sizes)]
        over = {k for k, s in enumerate(sizes) if k not in full and out[k] > most_epochs * s}
        if not over:
            return out
        full |= over


def lay_out(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Narrow rows: doc_id, source, size, text_hash and the shuffling digest."""
    digest = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    return docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).cast("string").alias("source"),
        F.size(words(F.col(text_col))).cast("long").alias("size"),
        F.xxhash64(F.col(text_col)).alias("text_hash"),
        F.conv(F.substring(digest, 1, DIGITS), 16, 10).cast("long").alias("mix"),
    )


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), most_epochs: int = 3, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row for each row of docs: doc_id, text_hash, source, size, source_size, target, taken (words that the mix takes) and first_slot (null: never taken)."""
    spark = docs.sparkSession
    rows = materialize(lay_out(docs, id_col, text_col, source_col))
    found = rows.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("rows")).collect()
    found.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    sizes = [r["size"] for r in found]
    targets = share_out(sizes, [weights[k % len(weights)] for k in range(len(found))], most_epochs) if found else []
    blocks = [max(1, min(MAX_BLOCK, int(t // SLOTS_EACH))) for t in targets]
    counts = [-(-s // b) for s, b in zip(sizes, blocks, strict=True)]
    schema = "source string, source_size long, target double, block_size long, blocks long, number int"
    plan = spark.createDataFrame([(r["source"], s, t, b, c, k) for k, (r, s, t, b, c) in enumerate(zip(found, sizes, targets, blocks, counts, strict=True))], schema)
    chunks = max([1, *(-(-r["rows"] // CHUNK_ROWS) for r in found)])

    placed = position(rows.join(F.broadcast(plan), rows["source"].eqNullSafe(plan["source"])).drop(plan["source"]), chunks)
    last = F.expr("(start + size - 1) div block_size")
    parts = placed.where("size > 0").withColumn("block", F.explode(F.sequence(F.expr("start div block_size"), last)))
    overlap = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * F.col("block_size")) - F.greatest(F.col("start"), F.col("block") * F.col("block_size"))
    taken = parts.withColumn("words", overlap).join(schedule(spark, targets, blocks, counts, most_epochs), ["number", "block"], "left")
    own = ["doc_id", "text_hash", "source", "size", "source_size", "target"]
    some = taken.groupBy("number", "start", *own).agg(F.coalesce(F.sum(F.when(F.col("slot").isNotNull(), F.col("words"))), F.lit(0)).alias("taken"), F.min("slot").alias("first_slot")).drop("number", "start")
    none = placed.where("size = 0").select(*own, F.lit(0).cast("long").alias("taken"), F.lit(None).cast("long").alias("first_slot"))
    return some.unionByName(none)


def position(rows: DataFrame, chunks: int) -> DataFrame:
    """Adds start: words of the same source before each row, in the order of the digest."""
    rows = rows.withColumn("chunk", F.expr(f"mix div {16**DIGITS // chunks + 1}"))
    before = Window.partitionBy("number").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("number", "chunk").agg(F.sum("size").alias("held")).select("number", "chunk", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("chunk_start"))
    inside = Window.partitionBy("number", "chunk").orderBy("mix", "doc_id", "text_hash", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    return rows.join(starts, ["number", "chunk"]).withColumn("start", F.col("chunk_start") + F.col("inside")).drop("chunk", "chunk_start", "inside", "mix")


def schedule(spark: SparkSession, targets: list[float], blocks: list[int], counts: list[int], most_epochs: int = 3) -> DataFrame:
    """slot, number (of the source), block. blocks: words in a block; counts: blocks in a source."""
    want = np.array([t / b for t, b in zip(targets, blocks, strict=True)])
    n = int(round(want.sum())) if len(want) else 0
    edges, held = np.cumsum(want) / max(want.sum(), 1e-300), np.array(counts, dtype=np.int64)

    def name(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            point = np.modf((x["id"].to_numpy() + 1) * GOLDEN)[0]
            number = np.minimum(np.searchsorted(edges, point, side="right"), len(edges) - 1)
            yield pd.DataFrame({"slot": x["id"], "number": number.astype(np.int32), "held": held[number]})

    slots = spark.range(n).mapInPandas(name, "slot long, number int, held long").withColumn("chunk", F.expr(f"slot div {SLOT_CHUNK}"))
    before = Window.partitionBy("number").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = slots.groupBy("number", "chunk").agg(F.count("*").alias("in_chunk")).select("number", "chunk", F.coalesce(F.sum("in_chunk").over(before), F.lit(0)).alias("chunk_start"))
    rank = F.row_number().over(Window.partitionBy("number", "chunk").orderBy("slot")) - 1
    ranked = slots.withColumn("inside", rank).join(starts, ["number", "chunk"]).withColumn("rank", F.col("chunk_start") + F.col("inside"))
    return ranked.where(F.col("rank") < most_epochs * F.col("held")).select("slot", "number", F.pmod("rank", "held").alias("block"))


def op5_low_discrepancy_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "first_slot")
