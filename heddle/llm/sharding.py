"""Sharding by vector bin packing (operator 10).

Groups of equal texts are placed into shards so that bytes, tokens and rows are balanced together: each
group goes where the dot product of its size vector with the residual capacity is highest, among the shards
that still have room for it. Residual capacities count by their direction, at length 1, so that a shard with many rows
but few bytes left draws small texts, whatever it holds already. The law that holds is `bytes`.

Scale. The greedy pass is sequential, so it sees a bounded number of items whatever the input: a group of at
least 1/16384 of all bytes is an item (there can be 16384 at most), all others are bundled by hash of their
text into 4096 items. A group is cut only where no shard
has room left for its bytes and it is larger than 1/16 of a shard's share: into the fewest pieces of that size, by count of
rows (equal texts have equal sizes, so pieces differ by one row at most); all items are then placed anew. Only that item table
(some 20,000 rows) reaches the driver or is broadcast. Rows of equal id and text are one run with a count until the end, so however
often a row repeats, no window sees it twice. Places in a group and slots come from two levels of counting, so no task ranks a whole
group or shard; runs above RUN rows are dealt over tasks before they are unrolled.

Defined cases: a null text has 0 bytes plus 1, crc32 0, and forms a group of its own; an empty text is another
group. Rows that repeat are placed and numbered one by one. An empty table gives no rows. Further columns of
the input are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from heddle.llm.common import materialize, read, words

BUNDLES, ITEM_SHARE, PIECE_SHARE, SLOT_CHUNK, RUN = 4096, 16384, 16, 4096, 1 << 16


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One narrow row for each document: its id, size vector, checksum and the digest of its text."""
    text = F.col(text_col)
    return docs.select(
        F.col(id_col).alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.size(words(text)).cast("long").alias("tokens"),
        F.crc32(F.coalesce(text, F.lit(""))).alias("text_crc32"),
        F.coalesce(F.unhex(F.md5(text)), F.lit(b"null").cast("binary")).alias("text_key"),
    )


def place(vectors: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """Vector bin packing of rows (bytes, tokens, rows), largest first; returns each row's shard, and whether that had room for its bytes."""
    total = np.maximum(vectors.sum(axis=0), 1)
    sizes = vectors / total
    load = np.zeros((shards, vectors.shape[1]))
    out, held = np.zeros(len(vectors), dtype=np.int64), np.zeros(len(vectors), dtype=bool)
    for i in np.lexsort((np.arange(len(sizes)), -sizes.max(axis=1))):
        residual = 1.0 / shards - load
        room = residual >= sizes[i]
        fits = room.all(axis=1) if room.all(axis=1).any() else room[:, 0]
        held[i] = fits.any()
        drawn = residual @ sizes[i] / np.maximum(np.linalg.norm(residual, axis=1), 1e-300)
        score = np.where(fits, drawn, -np.inf) if held[i] else residual[:, 0]
        out[i] = best = int(np.argmax(score))
        load[best] += sizes[i]
    return out, held


def assign(items: list[tuple], shards: int) -> tuple[list[tuple], np.ndarray, np.ndarray]:
    """items (key, piece, bytes, tokens, rows) in an order of their own, with what place() says of them."""
    items = sorted(items, key=lambda x: (-x[2], x[0], x[1]))
    return items, *place(np.array([x[2:] for x in items], dtype=float).reshape(-1, 3), shards)


def cut(item: tuple, pieces: int) -> list[tuple]:
    """An item's pieces: position j of its rows belongs to piece j * pieces div rows."""
    key, _, size, tokens, rows = item
    firsts = [-(-k * rows // pieces) for k in range(pieces + 1)]
    return [(key, k, size // rows * (b - a), tokens // rows * (b - a), b - a) for k, (a, b) in enumerate(zip(firsts, firsts[1:], strict=False))]


def shard(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, tokens, text_crc32, law, shard, slot, grown_shard for each row of docs."""
    spark = docs.sparkSession
    runs = materialize(measure(docs, id_col, text_col).groupBy("doc_id", "size", "tokens", "text_crc32", "text_key").agg(F.count("*").alias("n")))
    n, total = runs.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.col("size") * F.col("n")), F.lit(0))).first()
    least, most = total / ITEM_SHARE, total / shards / PIECE_SHARE
    bundle = F.concat(F.lit("b").cast("binary"), F.pmod(F.xxhash64("text_key"), F.lit(BUNDLES)).cast("string").cast("binary"))

    groups = runs.groupBy("text_key").agg(*(F.sum(F.col(c) * F.col("n")).alias(c) for c in ("size", "tokens")), F.sum("n").alias("rows"))
    own = F.col("size") > least
    items = (
        groups.withColumn("item", F.when(own, F.col("text_key")).otherwise(bundle))
        .groupBy("item", own.alias("own"))
        .agg(*(F.sum(c).alias(c) for c in ("size", "tokens", "rows")))
        .collect()
    )
    placed, where, held = assign([(bytes(r["item"]), 0, r["size"], r["tokens"], r["rows"]) for r in items], shards)
    copied = {bytes(r["item"]): r["rows"] for r in items if r["own"] and r["rows"] > 1}
    pieces = {x[0]: min(x[4], int(np.ceil(x[2] / most))) for x, ok in zip(placed, held, strict=True) if not ok and x[0] in copied and x[2] > most}
    big = spark.createDataFrame([(bytes(r["item"]), pieces.get(bytes(r["item"]), 1), r["rows"]) for r in items if r["own"]], "text_key binary, pieces int, rows long")
    tagged = runs.join(F.broadcast(big), "text_key", "left").withColumn("item", F.when(F.col("pieces").isNotNull(), F.col("text_key")).otherwise(bundle))
    names = ["doc_id", "size", "tokens", "text_crc32", "text_key", "n", "item", "piece"]
    dealt = tagged.where("coalesce(pieces, 1) = 1").withColumn("piece", F.lit(0)).select(*names)
    if pieces:
        placed, where, _ = assign([y for x in placed for y in (cut(x, pieces[x[0]]) if x[0] in pieces else [x])], shards)
        ranked = running(tagged.where("pieces > 1"), "item", max(copied[k] for k in pieces))
        parts = ranked.withColumn("piece", F.explode(F.expr("sequence(int(start * pieces div rows), int((start + n - 1) * pieces div rows))")))
        first = lambda k: f"(({k}) * rows + pieces - 1) div pieces"
        held_here = F.expr(f"least(start + n, {first('piece + 1')}) - greatest(start, {first('piece')})")
        dealt = dealt.unionByName(parts.withColumn("n", held_here).select(*names))
    map_rows = spark.createDataFrame([(x[0], x[1], int(s)) for x, s in zip(placed, where, strict=True)], "item binary, piece int, shard int")
    return number(dealt.join(F.broadcast(map_rows), ["item", "piece"]), -(-n // shards)).select(
        "doc_id", "size", "tokens", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def running(runs: DataFrame, key: str, rows: int) -> DataFrame:
    """Adds start: the rows of a key's earlier runs. Chunks of a key (of about `rows` rows) are counted first, then runs in their chunk."""
    runs = runs.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(max(1, -(-rows // SLOT_CHUNK)))))
    before = Window.partitionBy(key).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = runs.groupBy(key, "chunk").agg(F.sum("n").alias("held")).select(key, "chunk", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("chunk_start"))
    inside = Window.partitionBy(key, "chunk").orderBy("doc_id", "text_crc32", "size", "text_key").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("inside", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    return runs.join(starts, [key, "chunk"]).withColumn("start", F.col("chunk_start") + F.col("inside")).drop("chunk", "chunk_start", "inside")


def number(dealt: DataFrame, rows: int) -> DataFrame:
    """Unrolls runs, with slot: 0, 1, ... in each shard of about `rows` rows."""
    runs = materialize(running(dealt, "shard", rows).drop("item", "piece", "text_key"))
    unroll = lambda df, n: df.withColumn("slot", F.explode(F.expr(f"sequence(start, start + {n} - 1)")))
    blocks = runs.where(F.col("n") > RUN).withColumn("block", F.explode(F.expr(f"sequence(0, (n - 1) div {RUN})")))
    blocks = blocks.withColumns({"start": F.expr(f"start + block * {RUN}"), "n": F.expr(f"least({RUN}, n - block * {RUN})")}).repartition("shard", "start")
    return unroll(runs.where(F.col("n") <= RUN), "n").unionByName(unroll(blocks.drop("block"), "n"))


def op10_vector_bin_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(read(spark, sf_dir, "documents"), shards=16)
