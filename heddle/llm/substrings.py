"""Substring deduplication by relative Lempel-Ziv parsing (operator 8).

A window is WINDOW consecutive words of one document; a word goes if a window that covers it has the same word sequence
as a window that starts anywhere else, in the same document too. Windows are judged on the input.

Reference blocks. Of each window the rarest-looking k-gram (the smallest hash among its K-grams) is its anchor. The windows
of one anchor occurrence are neighbours; the words that they cover are a block. Equal windows have equal anchors at equal
places, so a window can recur only in blocks of the same anchor. Every block whose anchor occurs twice is a reference
block: indexed under its anchor, once for all its copies, with the hashes of its words (62 at most).

Parsing. Each block is matched against every other reference block of its anchor: both are laid on the anchor, and the
match grows word by word to both sides until the words differ. What is at least WINDOW words long is a candidate factor.
A block with copies is a factor as a whole. A document is then parsed greedily: a factor begins at the first window that
some reference covers and takes the reference that reaches furthest; where the copy breaks off, the windows across that
boundary are looked up again, so that a passage pieced together from several references is followed across its seams.
The factors, at least WINDOW words long each, are the duplicate spans.

Scale. Anchors are 2 / (WINDOW - K + 2) of all positions, some 7 %: narrow rows of numbers are what is shuffled, and
counted with map-side aggregation; counts return to the occurrences by an ordinary join, which adaptive execution can
split. An anchor with more than PAIR_BLOCKS different blocks (a common phrase in ever new surroundings) is not matched block
against block: its blocks' windows are indexed by hash, and a window that several blocks hold is a factor of its own, which
the parse joins with its neighbours. Texts are joined with spans only for documents that have some, and shuffled only where
those are too many to broadcast.

Defined cases: a null, blank or short (under WINDOW words) text has no windows and keeps all its words. A row that
repeats loses every window, as each copy occurs elsewhere. Null ids are a key of their own. An empty table gives no
rows. Further columns pass through remove(), whatever their names, and are ignored by the query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.llm.common import NO_ID, Powers, Rolling, claim, hash_words, join_bounded, materialize, read, text_slices, tidy, words

WINDOW, K, PAIR_BLOCKS = 35, 8, 32
BROADCAST_ROWS, BROADCAST_ITEMS, PAIRS_AT_ONCE = 100_000, 500_000, 20_000
GRAMS, BLOCKS = Powers(0x9E3779B97F4A7C15), Powers(0xD1342543DE82EF95)


def slide_argmin(g: np.ndarray, width: int) -> np.ndarray:
    """Place of the smallest value in each run of `width` neighbours, the last of equal ones."""
    have, value, place = 1, g, np.arange(len(g))
    while have < width:
        step = min(have, width - have)
        a, b, pa_, pb = value[: len(value) - step], value[step:], place[: len(place) - step], place[step:]
        later = b <= a
        value, place = np.where(later, b, a), np.where(later, pb, pa_)
        have += step
    return place


def blocks_of(h: np.ndarray, counts: np.ndarray, window: int = WINDOW, k: int = K) -> dict[str, np.ndarray]:
    """Of the word hashes of texts laid end to end (counts: words of each): the blocks of all texts, in order. of: text, first: its first
    window (in words of the text), n: windows, lead: words from there to the anchor, anchor and block: hashes, at: place in h."""
    ends = np.cumsum(counts)
    begins = ends - counts
    of = np.repeat(np.arange(len(counts)), counts)
    starts = np.arange(max(len(h) - window + 1, 0))
    starts = starts[starts + window <= ends[of[: len(starts)]]]  # windows lie in one text
    if not len(starts):
        return {c: np.zeros(0, np.int64) for c in ("of", "first", "n", "lead", "anchor", "block", "at")}
    at = np.arange(len(h) - k + 1)
    g = Rolling(h, GRAMS)(at, at + k)
    tied = slide_argmin(g, window - k + 1)[starts]
    new = np.append(True, (np.diff(tied) != 0) | (np.diff(of[starts]) != 0))
    heads = np.flatnonzero(new)
    first, n, anchor = starts[heads], np.diff(np.append(heads, len(starts))), tied[heads]
    block = Rolling(h, BLOCKS)(first, first + n - 1 + window)
    owner = of[first]
    return {"of": owner, "first": first - begins[owner], "n": n, "lead": anchor - first, "anchor": g[anchor].view(np.int64), "block": block.view(np.int64), "at": first}


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The content key (k1, k2), text and the whole row: rows with equal keys have equal id and text, and so equal spans."""
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("k1"), F.coalesce(F.xxhash64(F.col(text_col)), F.lit(0)).alias("k2"), F.col(text_col).alias("text"), F.struct("*").alias("row"))


def anchors(docs: DataFrame, window: int, k: int) -> DataFrame:
    """A row for each block of each document: anchor, block (hashes), k1, k2, first (window), n (windows), lead."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("substrings")
        for batch in batches:
            for part in text_slices(batch, "text"):
                b = blocks_of(*hash_words(part.column("text")), window, k)
                owner = pa.array(b["of"])
                small = lambda c: pa.array(b[c].astype(np.int32))  # noqa: E731, B023
                yield pa.RecordBatch.from_arrays([pa.array(b["anchor"]), pa.array(b["block"]), part.column("k1").take(owner), part.column("k2").take(owner), small("first"), small("n"), small("lead")], ["anchor", "block", "k1", "k2", "first", "n", "lead"])

    return docs.select("k1", "k2", "text").mapInArrow(tidy(find), "anchor long, block long, k1 long, k2 long, first int, n int, lead int")


def reference_blocks(docs: DataFrame, window: int) -> DataFrame:
    """docs: text and wanted, an array of (anchor, block, copies, first, n, lead). A row for each: what is wanted without first, and body, the hashes of
    the words that the block covers."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("substrings")
        for batch in batches:
            for part in text_slices(batch, "text"):
                h, counts = hash_words(part.column("text"))
                begins = np.cumsum(counts) - counts
                lists = part.column("wanted")
                wanted, of = lists.flatten(), np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
                at, n = begins[of] + wanted.field("first").to_numpy(), wanted.field("n").to_numpy()
                body = [h[a : a + m + window - 1].tobytes() for a, m in zip(at.tolist(), n.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([wanted.field(c) for c in ("anchor", "block", "copies", "n", "lead")] + [pa.array(body, pa.binary())], ["anchor", "block", "copies", "n", "lead", "body"])

    return docs.select("text", "wanted").mapInArrow(tidy(find), "anchor long, block long, copies long, n int, lead int, body binary")


def matches(anchor: np.ndarray, n: np.ndarray, lead: np.ndarray, body: list[bytes], window: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Factors of blocks in the order of their anchors, each against every other of its anchor: block, first window and number of windows
    that reference holds too, and the reference. Of a block's factors those within another one are left out."""
    left, width = window - k, 2 * window - k
    # blocks as rows of word hashes, with their anchors in one column; low and high: the columns that a block covers
    low = left - lead
    high = low + n - 1 + window
    table = np.zeros((len(n), width), np.uint64)
    sizes = high - low
    row = np.repeat(np.arange(len(n)), sizes)
    table[row, np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + low[row]] = np.frombuffer(b"".join(body), np.uint64)
    edges = np.flatnonzero(np.append(True, np.diff(anchor) != 0))
    held = np.diff(np.append(edges, len(anchor)))
    each = np.repeat(held, held)
    a = np.repeat(np.arange(len(n)), each)
    b = np.arange(len(a)) - np.repeat(np.cumsum(each) - each, each) + np.repeat(np.repeat(edges, held), each)
    a, b = a[a != b], b[a != b]
    found = [np.zeros((4, 0), np.int64)]
    columns = np.arange(width)
    for i in range(0, len(a), PAIRS_AT_ONCE):
        x, y = a[i : i + PAIRS_AT_ONCE], b[i : i + PAIRS_AT_ONCE]
        same = (table[x] == table[y]) & (columns >= np.maximum(low[x], low[y])[:, None]) & (columns < np.minimum(high[x], high[y])[:, None])
        back = np.cumprod(same[:, :left][:, ::-1], axis=1, dtype=np.int8).sum(axis=1)
        ahead = np.cumprod(same[:, left:], axis=1, dtype=np.int8).sum(axis=1)
        start = np.maximum(left - back, np.maximum(low[x], low[y]))
        stop = np.minimum(left + ahead - window, np.minimum(low[x] + n[x], low[y] + n[y]) - 1)
        long = start <= stop
        found.append(np.stack([x[long], start[long] - low[x][long], (stop - start)[long] + 1, y[long]]))
    x, at, run, y = np.concatenate(found, axis=1)
    # the longest from each start, if it reaches further than those that start before it
    order = np.lexsort((-run, at, x))
    x, at, run, y = x[order], at[order], run[order], y[order]
    reach = x * (2 * window) + at + run
    further = np.append(True, reach[1:] > np.maximum.accumulate(reach)[:-1])[: len(x)]
    return x[further], at[further], run[further], y[further]


def block_factors(blocks: DataFrame, window: int, k: int) -> DataFrame:
    """anchor, block, at, n, reference (a block of the same anchor): factors of reference blocks, matched block against block."""

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("substrings")
        rest = None
        for batch in batches:
            for i in range(0, batch.num_rows, 4096):
                part = pa.Table.from_batches([batch.slice(i, 4096)])
                part = part if rest is None else pa.concat_tables([rest, part])
                anchor = part.column("anchor").to_numpy()
                cut = int(np.flatnonzero(anchor == anchor[-1])[0])  # the last anchor may go on; it has PAIR_BLOCKS blocks at most
                rest = part.slice(cut)
                if cut:
                    yield factors_of(part.slice(0, cut))
        if rest is not None:
            yield factors_of(rest)

    def factors_of(part: pa.Table) -> pa.RecordBatch:
        anchor, block, n, lead = (part.column(c).to_numpy() for c in ("anchor", "block", "n", "lead"))
        x, at, run, y = matches(anchor, n.astype(np.int64), lead.astype(np.int64), part.column("body").to_pylist(), window, k)
        return pa.RecordBatch.from_arrays([pa.array(anchor[x]), pa.array(block[x]), pa.array(at.astype(np.int32)), pa.array(run.astype(np.int32)), pa.array(block[y])], ["anchor", "block", "at", "n", "reference"])

    return blocks.repartition("anchor").sortWithinPartitions("anchor").select("anchor", "block", "n", "lead", "body").mapInArrow(tidy(match), "anchor long, block long, at int, n int, reference long")


def window_factors(blocks: DataFrame, window: int) -> DataFrame:
    """As block_factors, for anchors of any number of blocks: each window that several blocks hold is a factor."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("substrings")
        for batch in batches:
            for i in range(0, batch.num_rows, 4096):
                part = batch.slice(i, 4096)
                n = part.column("n").to_numpy().astype(np.int64)
                h = np.frombuffer(b"".join(part.column("body").to_pylist()), np.uint64)
                of = np.repeat(np.arange(len(n)), n)
                at = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
                start = np.repeat(np.cumsum(n + window - 1) - n - window + 1, n) + at
                hashes = Rolling(h, GRAMS)(start, start + window)
                yield pa.RecordBatch.from_arrays([part.column("anchor").take(pa.array(of)), part.column("block").take(pa.array(of)), pa.array(at.astype(np.int32)), pa.array(hashes.view(np.int64))], ["anchor", "block", "at", "hash"])

    windows = materialize(blocks.select("anchor", "block", "n", "body").mapInArrow(tidy(cut), "anchor long, block long, at int, hash long"))
    held = windows.groupBy("anchor", "hash").agg(F.min("block").alias("low"), F.max("block").alias("high")).where("low < high")
    return windows.join(held, ["anchor", "hash"]).select("anchor", "block", "at", F.lit(1).alias("n"), F.when(F.col("block") == F.col("low"), F.col("high")).otherwise(F.col("low")).alias("reference"))


def parse(at: np.ndarray, n: np.ndarray, reach_of: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Greedy parse of documents (reach_of: their numbers, ascending) whose windows at .. at + n - 1 some reference holds, ordered by (document, at, longest
    first). A factor is taken if it reaches further than all before it, and looked for from the first window that they leave
    open. Returns document, first word and end of each span: factors that meet or overlap are one."""
    step = np.int64(1) << np.int64(40)
    end = reach_of * step + at + n + window - 1
    reach = np.maximum.accumulate(end)
    taken = np.append(True, end[1:] > reach[:-1])[: len(at)]
    of, at, end = reach_of[taken], at[taken], end[taken] - reach_of[taken] * step
    new = np.append(True, (of[1:] != of[:-1]) | (at[1:] > end[:-1]))[: len(of)]
    heads = np.flatnonzero(new)
    return of[heads], at[heads], end[np.append(heads[1:], len(of)) - 1] if len(heads) else end[:0]


def held_rows(table: DataFrame, items: str) -> int:
    """Rows of a table with an array column, or more than can be broadcast if the arrays hold more than BROADCAST_ITEMS items in all."""
    rows, held = table.agg(F.count("*"), F.coalesce(F.sum(F.size(items)), F.lit(0))).first()
    return rows if held <= BROADCAST_ITEMS else max(rows, BROADCAST_ROWS + 1)


def duplicate_spans(docs: DataFrame, window: int = WINDOW, k: int = K) -> DataFrame:
    """docs: k1, k2, text. For each key that has some: k1, k2 and spans, an array of (start, stop) in words, disjoint and in order."""
    occurrences = materialize(anchors(docs, window, k))
    heads = occurrences.groupBy("anchor").agg(F.count("*").alias("copies"), F.min("block").alias("low"), F.max("block").alias("high")).where("copies > 1")
    # a table of its own, so that a hot anchor's occurrences can be split in the join; the joins are of one kind at any size
    heads = materialize(heads)
    again = materialize(occurrences.join(heads.hint("merge"), "anchor").select("anchor", "block", "k1", "k2", "first", "n", "lead", (F.col("low") < F.col("high")).alias("mixed")))
    # blocks of an anchor that are all alike are copies of each other
    alike = again.where("NOT mixed").select("k1", "k2", F.col("first").alias("at"), "n")

    kinds = again.where("mixed").groupBy("anchor", "block").agg(F.count("*").alias("copies"), F.min(F.struct("k1", "k2", "first", "n", "lead")).alias("one"))
    wanted = kinds.groupBy("one.k1", "one.k2").agg(F.collect_list(F.struct("anchor", "block", "copies", F.col("one.first").alias("first"), F.col("one.n").alias("n"), F.col("one.lead").alias("lead"))).alias("wanted"))
    wanted = materialize(wanted)
    # rows that repeat share a key: either of them gives the blocks
    sources = docs.select("k1", "k2", "text").join(wanted.hint("merge"), ["k1", "k2"])
    blocks = materialize(reference_blocks(sources, window).dropDuplicates(["anchor", "block"]))
    many = blocks.groupBy("anchor").agg(F.count("*").alias("kinds")).where(F.col("kinds") > PAIR_BLOCKS)
    many = materialize(many.select("anchor"))
    n_many = many.count()
    found = block_factors(join_bounded(blocks, many, ["anchor"], "left_anti", n_many, BROADCAST_ROWS), window, k)
    if n_many:
        found = found.unionByName(window_factors(join_bounded(blocks, many, ["anchor"], "left_semi", n_many, BROADCAST_ROWS), window))
    # a block with copies is a factor as a whole
    whole = blocks.where("copies > 1").select("anchor", "block", F.lit(0).alias("at"), "n", F.col("block").alias("reference"))
    factors = materialize(found.unionByName(whole))
    placed = again.where("mixed").select("anchor", "block", "k1", "k2", "first").join(factors, ["anchor", "block"]).select("k1", "k2", (F.col("first") + F.col("at")).alias("at"), "n")
    held = alike.unionByName(placed).groupBy("k1", "k2").agg(F.sort_array(F.collect_set(F.struct("at", (-F.col("n")).alias("n")))).alias("held"))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("substrings")
        kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
        for batch in batches:
            lists = batch.column("held")
            flat, of = lists.flatten(), np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
            at, n = flat.field("at").to_numpy().astype(np.int64), -flat.field("n").to_numpy().astype(np.int64)
            of, start, stop = parse(at, n, of.astype(np.int64), window)
            ends = np.searchsorted(of, np.arange(len(lists) + 1)).astype(np.int32)
            spans = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(start.astype(np.int32)), pa.array(stop.astype(np.int32))], ["start", "stop"])).cast(kind)
            yield pa.RecordBatch.from_arrays([batch.column("k1"), batch.column("k2"), spans], ["k1", "k2", "spans"])

    return held.mapInArrow(tidy(find), "k1 long, k2 long, spans array<struct<start:int,stop:int>>")


def remove(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, k: int = K) -> DataFrame:
    """docs with n_words, n_removed, kept (the words that stay, joined by one space) appended; columns of these names are replaced."""
    docs = docs.drop("n_words", "n_removed", "kept")
    rows = keyed(docs, id_col, text_col)
    spans = materialize(duplicate_spans(rows, window, k))
    out = join_bounded(rows, spans, ["k1", "k2"], "left", held_rows(spans, "spans"), BROADCAST_ROWS)
    # words between spans are cut out as slices, without a look at each word
    out = out.select("row", words(F.col("text")).alias("w"), F.coalesce("spans", F.array()).alias("spans"))
    starts = F.concat(F.array(F.lit(0)), F.transform("spans", lambda x: x["stop"]))
    stops = F.concat(F.transform("spans", lambda x: x["start"]), F.array(F.size("w")))
    out = out.select("row", F.size("w").alias("n"), F.flatten(F.zip_with(starts, stops, lambda a, b: F.slice("w", a + 1, b - a))).alias("stay"))
    return out.select("row.*", F.col("n").cast("long").alias("n_words"), (F.col("n") - F.size("stay")).cast("long").alias("n_removed"), F.array_join("stay", " ").alias("kept"))


def op8_relative_lempel_ziv(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept"), 256).alias("kept_sha256"))


OP8_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT r, i, array_to_string(w[i:i + 34], ' ') AS win FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM d)),
c AS (SELECT r, i FROM s WHERE win IN (SELECT win FROM s GROUP BY win HAVING count(*) > 1)),
p AS (SELECT DISTINCT r, i + j AS p FROM c, (SELECT unnest(range(0, 35)) AS j)),
g AS (SELECT r, list(p) AS gone FROM p GROUP BY r),
k AS (SELECT d.r, doc_id, w, coalesce(gone, []) AS gone FROM d LEFT JOIN g ON d.r = g.r),
o AS (SELECT r, doc_id, len(w) AS n, len(gone) AS m, w, gone FROM k),
u AS (SELECT r, i, w[i] AS x FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM d)),
t AS (SELECT u.r, string_agg(x, ' ' ORDER BY u.i) AS kept FROM u LEFT JOIN p ON u.r = p.r AND u.i = p.p WHERE p.p IS NULL GROUP BY u.r)
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(m AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM o LEFT JOIN t ON o.r = t.r
"""
