"""Prefix trie of conversations by partition refinement (operator 13).

All conversations start in one class, the root. In each round the classes that have more than one member are split by the next
turn of their members; a class is named by its depth and its smallest member, so a node of the trie is a class. A class of one
member is retired at once: the rest of that conversation is a chain of nodes with one child each, whose values are known
without looking further. When no class is left, leaves and saved words are folded back from the deepest round to the root.

Scale. Only digests of turns move, never texts. Turns are numbered by a range sort with offsets of partitions, so a conversation of any
length spreads over tasks. A round joins the members with one turn each and counts classes with map-side aggregation. New names
reach the members by a join; classes with more than 1 / HOT of all members, HOT at most, are broadcast for it, so no
key of the shuffled part is frequent. Turns are written anew whenever the active conversations need less than half of them. The
digest of the conversations that end in a node reads their ids in sorted parts of PART. Rounds: the longest prefix that two
conversations share.

Defined cases: a null role or text is empty. A null turn number comes first; turns of one number are ordered by the digest of role and
text. Turns without conv_id form one conversation, whose id is null, sorts first and is written as the empty text. An empty
table gives no rows, a table with one conversation a root and one chain. Further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.llm.common import NO_ID, group_offsets, materialize, read, tidy, words
from heddle.llm.merkle import CRC32_SQL, leaf

HOT, PART = 4096, 8192
EMPTY = hashlib.sha256(b"").hexdigest()


def number_rows(df: DataFrame, group: str, order: list[str]) -> DataFrame:
    """df, written as a table, with `i`: the row's number from 0 on in its group (a column of longs, no nulls), in the order given; rows that are alike
    in all of it follow the place at which they were read."""
    keys = [group, *order, "_read"]
    ordered = df.withColumn("_read", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_read")
    at = df.columns.index(group)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, last, seen = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            own = batch.column(at)
            begins = np.concatenate([[True], pc.not_equal(own[1:], own[:-1]).to_numpy(zero_copy_only=False).astype(bool)])
            here = np.arange(batch.num_rows)
            i = here - np.maximum.accumulate(np.where(begins, here, 0))
            if own[0].as_py() == last:
                going_on = np.cumsum(begins) == 1
                i = i + np.where(going_on, seen, 0)
            last, seen = own[-1].as_py(), int(i[-1]) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(batch.num_rows, pid, np.int32)), pa.array(i.astype(np.int64))], names=[*batch.schema.names, "pid", "i"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields), "pid int, i long"])
    counted = materialize(ordered.mapInArrow(tidy(count), schema))
    offsets = F.broadcast(group_offsets(counted.groupBy("pid", group).agg(F.count("*").alias("n")), group))  # one row a partition at most
    return counted.join(offsets, ["pid", group], "left").withColumn("i", F.col("i") + F.coalesce("offset", F.lit(0))).drop("pid", "offset")


def turns_of(table: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Numbered turns: c (NO_ID for a null), i, key (digest of role and text), words."""
    role, text = (F.coalesce(F.col(x).cast("string"), F.lit("")) for x in (role_col, text_col))
    narrow = table.select(F.coalesce(F.col(conv_col).cast("long"), F.lit(NO_ID)).alias("c"), F.col(turn_col).alias("turn"), F.unhex(leaf(role, text)).alias("key"), F.size(words(text)).cast("long").alias("words"))
    return number_rows(narrow, "c", ["turn", "key"]).select("c", "i", "key", "words")


def decimal(c: Column) -> Column:
    return F.when(c == NO_ID, F.lit("")).otherwise(c.cast("string"))


def share_heads(turns: DataFrame, family: int = 20, longest: int = 3) -> tuple[DataFrame, DataFrame]:
    """Conversations rebuilt on the head of their family: c keeps its turns from number h on, behind the first h turns of the conversation c - c % family,
    where h = crc32(c) % (longest + 1). Returns the turns (c, depth from 1 on, key, words) and the conversations (c, size)."""
    lengths = turns.groupBy("c").agg(F.count("*").alias("n"))
    h = (F.crc32(decimal(F.col("c"))) % (longest + 1)).alias("h")
    convs = lengths.select("c", "n", h, F.when(F.col("c") != NO_ID, F.col("c") - F.col("c") % family).alias("b"))
    held = lengths.select(F.col("c").alias("b"), F.least("n", F.lit(longest)).alias("held")).where(F.col("b") % family == 0)
    convs = convs.join(held, "b", "left").withColumn("m", F.least("h", F.coalesce("held", F.lit(0))))
    convs = materialize(convs.select("c", "h", "m", "b", (F.col("m") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("size")))
    own = turns.join(convs.select("c", "h", "m"), "c").where("i >= h").select("c", (F.col("m") + F.col("i") - F.col("h") + 1).alias("depth"), "key", "words")
    heads = turns.where(F.col("i") < longest).where(F.col("c") % family == 0).withColumnRenamed("c", "b")
    head = convs.where("m > 0").select("c", "h", "b").join(heads, "b").where("i < h").select("c", (F.col("i") + 1).alias("depth"), "key", "words")
    return materialize(head.unionByName(own)), convs.select("c", "size")


def renamed(movers: DataFrame, classes: DataFrame, active: int) -> DataFrame:
    """movers (c, size, rep, key) with the name `kid` of their new class, for those whose class is among `classes` (rep, key, kid, n)."""
    hot = classes.where(F.col("n") * HOT > active).select("rep", "key", "kid")  # fewer than HOT classes
    marked = movers.join(F.broadcast(hot), ["rep", "key"], "left")
    rest = classes.where(F.col("n") * HOT <= active).select("rep", "key", "kid")
    found = marked.where("kid IS NOT NULL").select("c", "size", "kid")
    return found.unionByName(marked.where("kid IS NULL").drop("kid").join(rest, ["rep", "key"]).select("c", "size", "kid"))


def ends_digest(ends: DataFrame) -> DataFrame:
    """ends (depth, rep, c): SHA-256 of each node's ids in decimal, ascending and comma-joined, as depth, rep, ends_sha256. Ids are joined in sorted parts
    first, wherever they lie, and a node's parts are then fed to the hash one after the other."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, held = None, []

        def part() -> pa.RecordBatch:
            text = ",".join("" if c == NO_ID else str(c) for c in held)
            return pa.RecordBatch.from_pydict({"depth": pa.array([node[0]], pa.int64()), "rep": pa.array([node[1]], pa.int64()), "first": pa.array([held[0]], pa.int64()), "ids": [text]})

        for batch in batches:
            for depth, rep, c in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if held and ((depth, rep) != node or len(held) == PART):
                    yield part()
                    held.clear()
                node = depth, rep
                held.append(c)
        if held:
            yield part()

    def feed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"depth": pa.array([node[0]], pa.int64()), "rep": pa.array([node[1]], pa.int64()), "ends_sha256": [state.hexdigest()]})

        for batch in batches:
            for depth, rep, ids in zip(*(batch.column(k).to_pylist() for k in (0, 1, 3)), strict=True):
                if (depth, rep) == node:
                    state.update(b"," + ids.encode())
                    continue
                if state:
                    yield row()
                node, state = (depth, rep), hashlib.sha256(ids.encode())
        if state:
            yield row()

    parts = ends.select("depth", "rep", "c").repartitionByRange("depth", "rep", "c").sortWithinPartitions("depth", "rep", "c").mapInArrow(tidy(join), "depth long, rep long, first long, ids string")
    return parts.repartition("depth", "rep").sortWithinPartitions("depth", "rep", "first").mapInArrow(tidy(feed), "depth long, rep long, ends_sha256 string")


def union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def prefix_trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """Nodes of the trie over conversations (c, size) and their turns (c, depth 1 to size, key, words): conv_id (the smallest member), depth, parent_conv_id,
    n_convs, n_children, n_leaves, saved_tokens, ends_sha256 and key, the digest of the node's last turn."""
    members = convs
    n, first, left = convs.agg(F.count("*"), F.min("c"), F.coalesce(F.sum("size"), F.lit(0))).first()
    root = convs.agg(F.lit(None).cast("long").alias("rep"), F.lit(None).cast("binary").alias("key"), F.min("c").alias("kid"), F.count("*").alias("n"), F.lit(0).cast("long").alias("words")).where("n > 0")
    shared, children, single, ends = [root], [], [], []
    members = members.withColumn("kid", F.lit(first).cast("long"))
    depth, active, written, turns_left = 0, n, left, turns
    while active:
        ends.append(members.where(F.col("size") == depth).select(F.lit(depth).cast("long").alias("depth"), F.col("kid").alias("rep"), "c"))
        if 2 * left < written:  # what retired conversations hold is not read again
            turns_left = materialize(turns_left.join(members.select("c"), "c", "left_semi").where(F.col("depth") > depth))
            written = left
        depth += 1
        step = turns_left.where(F.col("depth") == depth).select("c", "key", "words")
        movers = materialize(members.where(F.col("size") >= depth).withColumnRenamed("kid", "rep").join(step, "c"))
        classes = materialize(movers.groupBy("rep", "key").agg(F.min("c").alias("kid"), F.count("*").alias("n"), F.any_value("words").alias("words"), F.max("size").alias("size")))
        many = classes.where("n > 1")
        children.append(classes.groupBy("rep").agg(F.count("*").alias("n_children"), F.count_if(F.col("n") == 1).alias("singles")))
        single.append(classes.where("n = 1").select("rep", F.col("kid").alias("c"), "size", F.lit(depth).cast("long").alias("begin")))
        active = many.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        if active:
            shared.append(many.drop("size"))
            members = materialize(renamed(movers.select("c", "size", "rep", "key"), many, active))
            left = members.agg(F.coalesce(F.sum(F.col("size") - depth), F.lit(0))).first()[0]

    nodes, below = [], None
    for level in reversed(range(len(shared))):
        out = shared[level].withColumn("depth", F.lit(level).cast("long"))
        if level < len(children):
            out = out.join(children[level].withColumnRenamed("rep", "kid"), "kid", "left")
        else:
            out = out.withColumns({"n_children": F.lit(None).cast("long"), "singles": F.lit(None).cast("long")})
        if below is not None:
            sums = below.groupBy("rep").agg(F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
            out = out.join(sums.withColumnRenamed("rep", "kid"), "kid", "left")
        else:
            out = out.withColumns({"leaves": F.lit(None).cast("long"), "saved": F.lit(None).cast("long")})
        zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
        leaves = F.when(zero(F.col("n_children")) == 0, F.lit(1).cast("long")).otherwise(zero(F.col("singles")) + zero(F.col("leaves")))
        below = materialize(
            out.select("rep", "key", "kid", "depth", F.col("n").alias("n_convs"), zero(F.col("n_children")).alias("n_children"), leaves.alias("n_leaves"), (zero(F.col("saved")) + (F.col("n") - 1) * F.col("words")).alias("saved_tokens"))
        )
        nodes.append(below)

    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256", "key"]
    out = union(nodes).withColumnsRenamed({"rep": "parent_conv_id", "kid": "conv_id"})
    if ends:
        out = out.join(ends_digest(union(ends)).withColumnRenamed("rep", "conv_id"), ["depth", "conv_id"], "left")
    else:
        out = out.withColumn("ends_sha256", F.lit(None).cast("string"))
    out = out.withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(EMPTY))).select(*columns)
    if single:
        tails = turns.select("c", "depth", "key").join(union(single), "c").where("depth >= begin")
        one, last = F.lit(1).cast("long"), F.col("depth") == F.col("size")
        chain = tails.select(
            F.col("c").alias("conv_id"),
            "depth",
            F.when(F.col("depth") == F.col("begin"), F.col("rep")).otherwise(F.col("c")).alias("parent_conv_id"),
            one.alias("n_convs"),
            F.when(last, F.lit(0)).otherwise(1).cast("long").alias("n_children"),
            one.alias("n_leaves"),
            F.lit(0).cast("long").alias("saved_tokens"),
            F.when(last, F.sha2(decimal(F.col("c")), 256)).otherwise(F.lit(EMPTY)).alias("ends_sha256"),
            "key",
        )
        out = out.unionByName(chain)
    return out.withColumns({c: F.nullif(F.col(c), F.lit(NO_ID)) for c in ("conv_id", "parent_conv_id")})


OP13_SQL = f"""
WITH turns AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) - 1 AS i FROM conversations),
convs AS (SELECT c, {CRC32_SQL.format("c::VARCHAR")} % 4 AS h, c - c % 20 AS b FROM (SELECT DISTINCT c FROM turns)),
parts AS (
  SELECT v.c, 0 AS part, i, role, text FROM convs v JOIN turns t ON t.c = v.b WHERE i < h
  UNION ALL SELECT v.c, 1, i, role, text FROM convs v JOIN turns t ON t.c = v.c WHERE i >= h),
steps AS (SELECT c, part, i, md5(strlen(role)::VARCHAR || ':' || role || text) AS k, len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS n FROM parts),
seqs AS (SELECT c, coalesce(list(k ORDER BY part, i) FILTER (k IS NOT NULL), []) AS s, coalesce(list(n ORDER BY part, i) FILTER (k IS NOT NULL), []) AS ns FROM convs LEFT JOIN steps USING (c) GROUP BY c),
prefixes AS (SELECT *, s[1:d] AS p, CASE WHEN d = 0 THEN 0 ELSE ns[d] END AS words FROM (SELECT c, s, ns, len(s) AS size, unnest(range(0, len(s) + 1)) AS d FROM seqs)),
nodes AS MATERIALIZED (
  SELECT d, p, min(c) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(words) AS own,
    sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (size = d), '')) AS ends_sha256
  FROM prefixes GROUP BY d, p),
kids AS (SELECT q AS p, count(*) AS n_children FROM (SELECT p[1:d - 1] AS q FROM nodes WHERE d > 0) GROUP BY q),
full_nodes AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM nodes n LEFT JOIN kids USING (p)),
up AS (SELECT q AS p, sum(own) AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves FROM (SELECT own, n_children, p[1:a] AS q FROM (SELECT *, unnest(range(0, d + 1)) AS a FROM full_nodes)) GROUP BY q)
SELECT f.conv_id, f.d AS depth, o.conv_id AS parent_conv_id, f.n_convs, f.n_children, n_leaves, saved_tokens::BIGINT AS saved_tokens, f.ends_sha256
FROM full_nodes f JOIN up USING (p) LEFT JOIN nodes o ON f.d > 0 AND o.p = f.p[1:f.d - 1]"""


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns, convs = share_heads(turns_of(read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")))
    return prefix_trie(turns, convs).drop("key")
