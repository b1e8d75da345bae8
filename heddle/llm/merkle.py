"""Merkle manifest of a table: a tree for each group of rows, a tree over the groups, and a proof for each row (operator 12).

Leaves are SHA-256 digests of a row's fields. They are range-sorted by group and key; each partition counts its rows of each
group, and the counts of earlier partitions are the offset at which a partition's first group goes on. With its offset a block
of up to BLOCK neighbouring leaves builds all complete subtrees that lie in it alone. What sticks out on either side, at most
two nodes a level, is the block's ragged boundary: those nodes are shuffled by their coordinate (group, level, index) to the
ancestor STEP levels higher, where at most 2 ** STEP of them meet, and so on up to the group's root. Going down again, each
boundary node learns the siblings on its way to the root, and each block proves its leaves. The roots of the groups, sorted
by group, are the leaves of one more tree of the same kind.

A node with one child is the digest of that child alone. Digests are written, and hashed again, as lower-case hexadecimal text.

Scale. Texts are hashed where they are read and never shuffled. What is sorted is id, group and digest; it is packed into blocks,
so the joins that follow see one row for some thousand leaves. The offsets, one number a partition, are all that is
broadcast. A group of any size spreads over many partitions; equal rows too, by the place at which they were read. Rounds
grow with the logarithm of the largest group, divided by STEP.

Defined cases: null fields are `-` in a leaf. Null ids come first and are not tampered with; a null group is a group of its own and
the first one. The largest n_chars that a long holds stays as it is. Rows that repeat are leaves of their own, side by side; among rows of one id the smaller leaf comes first.
An empty table gives no rows. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from hashlib import sha256

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.llm.common import group_offsets, materialize, read, tidy

BLOCK, STEP = 1 << 14, 12
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
BLOCK_SCHEMA = "pid int, block long, group string, at long, n long, ids array<long>, leaves string, others array<string>"
NODE_SCHEMA = "group string, level int, index long, digest string"
#: Characters of a digest.
HEX = 64


def digest(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def leaf(*fields: Column) -> Column:
    """Digest of fields: `-` for a null, else the value's bytes in UTF-8, a colon and the value."""
    texts = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def group_key(group: Column) -> Column:
    """A text for each group that is never null and sorts as the groups do, bytewise, null first."""
    return F.coalesce(F.concat(F.lit("+"), group.cast("string")), F.lit(""))


def group_of(key: Column) -> Column:
    return F.when(key != "", F.expr("substring(group, 2)"))


def pack(leaves: DataFrame) -> DataFrame:
    """leaves (group, id, leaf, other) sorted and packed, written as a table: a block has `n` neighbouring leaves of one group and partition,
    of which the first is number `at` of that group in that partition."""
    ordered = leaves.withColumn("_read", F.monotonically_increasing_id())
    ordered = ordered.repartitionByRange("group", "id", "leaf", "_read").sortWithinPartitions("group", "id", "leaf", "_read").drop("_read")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, group, at, number, held, size = TaskContext.get().partitionId(), None, 0, 0, [], 0

        def flush() -> pa.RecordBatch:
            nonlocal at, number, size
            rows = pa.Table.from_batches(held).combine_chunks()
            ids, digests, others = (rows.column(k).to_pylist() for k in (1, 2, 3))
            row = [pid, number, group, at, size, ids, "".join(digests), others if any(others) else []]
            kinds = [pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.string(), pa.list_(pa.string())]
            at, number, size = at + size, number + 1, 0
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds, strict=True)], names=[f.split()[0] for f in BLOCK_SCHEMA.split(", ")])

        for batch in batches:
            groups = batch.column(0)
            cuts = [0, *(k + 1 for k in pc.indices_nonzero(pc.not_equal(groups[1:], groups[:-1])).to_pylist()), batch.num_rows]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                own = groups[a].as_py()
                if own != group:
                    if held:
                        yield flush()
                    group, at = own, 0
                while a < b:
                    part = batch.slice(a, min(b - a, BLOCK - size))
                    held.append(part)
                    size += part.num_rows
                    a += part.num_rows
                    if size == BLOCK:
                        yield flush()
        if held:
            yield flush()

    packed = materialize(ordered.select("group", F.col("id").cast("long"), "leaf", "other").mapInArrow(tidy(blocks), BLOCK_SCHEMA))
    offsets = F.broadcast(group_offsets(packed.select("pid", "group", "n")))  # one row a partition at most
    return packed.join(offsets, ["pid", "group"], "left").withColumn("first", F.col("at") + F.coalesce("offset", F.lit(0))).drop("at", "offset")


def subtrees(leaves: str, first: int) -> tuple[list[tuple[int, list[str]]], list[tuple[int, int, str]]]:
    """Levels of the complete subtrees over neighbouring leaves, each as its first index and its digests, and the boundary: nodes without a sibling
    among them, as (level, index, digest). Each leaf is below one of those."""
    at, nodes = first, [leaves[k : k + HEX] for k in range(0, len(leaves), HEX)]
    levels, boundary = [], []
    while nodes:
        levels.append((at, nodes))
        k = len(levels) - 1
        a, b = at % 2, len(nodes) - (at + len(nodes)) % 2
        if a:
            boundary.append((k, at, nodes[0]))
        if b < len(nodes) and b >= a:
            boundary.append((k, at + b, nodes[b]))
        nodes = [digest(nodes[j] + nodes[j + 1]) for j in range(a, b, 2)]
        at = (at + a) // 2
    return levels, boundary


def boundaries(blocks: DataFrame) -> DataFrame:
    """Boundary nodes of all blocks: pid, block, first, and coordinates and digest of the node."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                pid, block, first, group, leaves = (c[k].as_py() for c in batch.columns)
                found = subtrees(leaves, first)[1]
                own = {"pid": [pid] * len(found), "block": [block] * len(found), "group": [group] * len(found)}
                yield pa.RecordBatch.from_pydict(own | {n: list(v) for n, v in zip(("level", "index", "digest"), zip(*found, strict=True), strict=True)}, pa.schema(_BOUNDARY))

    return blocks.select("pid", "block", "first", "group", "leaves").mapInArrow(tidy(build), f"pid int, block long, {NODE_SCHEMA}")


_NODE = [("group", pa.string()), ("level", pa.int32()), ("index", pa.int64()), ("digest", pa.string())]
_BOUNDARY = [("pid", pa.int32()), ("block", pa.int64()), *_NODE]


def climb(nodes: dict[tuple[int, int], str], n: int, top: int, up: int) -> tuple[str, dict[tuple[int, int], str]]:
    """The digest of node (top, up) of a tree over n leaves, from nodes (level, index) that tile it, and for each of them the siblings on its way there."""
    known, paths = dict(nodes), {}
    rising: dict[int, set[int]] = {}
    for level, index in nodes:
        rising.setdefault(level, set()).add(index >> 1)
    for level in range(min(rising), top):
        width = -(-n >> level)
        for up_index in rising.get(level, ()):
            left = 2 * up_index
            known[level + 1, up_index] = digest(known[level, left] + (known[level, left + 1] if left + 1 < width else ""))
            rising.setdefault(level + 1, set()).add(up_index >> 1)
    for level, index in nodes:
        i, siblings = index, []
        for k in range(level, top):
            if (i ^ 1) < -(-n >> k):
                siblings.append(known[k, i ^ 1])
            i >>= 1
        paths[level, index] = "".join(siblings)
    return known[top, up], paths


def finish(nodes: DataFrame, sizes: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """nodes (group, level, index, digest) that tile each group's tree; sizes (group, n); most: the largest n.
    Returns the siblings of each node on its way up (group, level, index, path) and the roots (group, n, subroot)."""
    height = F.expr("CASE WHEN n > 1 THEN length(bin(n - 1)) ELSE 0 END")
    state, rounds, top = nodes.join(sizes, "group").withColumn("height", height), [], 0
    while top < max(1, (most - 1).bit_length()):
        top += STEP
        goal = F.least(F.lit(top), F.col("height"))
        moving = state.where(F.col("level") < goal).withColumn("goal", goal)
        moving = moving.withColumn("up", F.expr("shiftright(index, goal - level)"))

        def raise_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Rows come sorted by group and ancestor: each ancestor's are gathered, 2 ** STEP at most."""
            key, held = None, {}

            def done() -> pa.RecordBatch:
                group, goal, up, n = key
                found, paths = climb(held, n, goal, up)
                rows = [(group, k, i, path, goal, up, None) for (k, i), path in paths.items()] + [(group, goal, up, None, None, None, found)]
                return pa.RecordBatch.from_arrays([pa.array(v, t) for v, (_, t) in zip(zip(*rows, strict=True), _RAISED, strict=True)], names=[x for x, _ in _RAISED])

            for batch in batches:
                for group, goal, up, n, level, index, value in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if (group, goal, up, n) != key:
                        if held:
                            yield done()
                        key, held = (group, goal, up, n), {}
                    held[level, index] = value
            if held:
                yield done()

        sent = moving.select("group", "goal", "up", "n", "level", "index", "digest").repartition("group", "up").sortWithinPartitions("group", "up")
        raised = materialize(sent.mapInArrow(tidy(raise_nodes), "group string, level int, index long, path string, goal int, up long, digest string"))
        rounds.append(raised.where("path IS NOT NULL").drop("digest"))
        parents = raised.where("path IS NULL").select("group", "level", "index", "digest").join(sizes, "group").withColumn("height", height)
        state = state.where(F.col("level") >= goal).unionByName(parents)
    roots = state.select("group", "n", F.col("digest").alias("subroot"))
    later = None
    for own in reversed(rounds):
        if later is not None:
            above = later.select("group", F.col("level").alias("goal"), F.col("index").alias("up"), F.col("path").alias("_above"))
            own = own.join(above, ["group", "goal", "up"], "left").withColumn("path", F.concat("path", F.coalesce("_above", F.lit(""))))
        own = own.select("group", "level", "index", "path")
        later = own if later is None else later.unionByName(own)
    return later, roots


_RAISED = [("group", pa.string()), ("level", pa.int32()), ("index", pa.int64()), ("path", pa.string()), ("goal", pa.int32()), ("up", pa.int64()), ("digest", pa.string())]


def siblings(levels: list[tuple[int, list[str]]], index: int, level: int) -> list[str]:
    """Digests beside a leaf's way up to the given level of the block's subtrees."""
    return [levels[k][1][(index >> k ^ 1) - levels[k][0]] for k in range(level)]


def fold(leaf: str, index: int, n: int, path: str) -> tuple[str, int]:
    """The root that a leaf and its siblings lead to, and the place in `path` behind the siblings used."""
    at, level = 0, 0
    while n > 1 << level:
        i = index >> level
        if (i ^ 1) < -(-n >> level):
            beside, at = path[at : at + HEX], at + HEX
            leaf = digest(beside + leaf if i & 1 else leaf + beside)
        else:
            leaf = digest(leaf)
        level += 1
    return leaf, at


def tree(leaves: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of leaves (group, id, leaf, other): the packed blocks, their boundary nodes with their siblings up to the root of their group
    (pid, block, level, index, path, group), and the roots (group, n, subroot)."""
    blocks = pack(leaves)
    nodes = materialize(boundaries(blocks))
    sizes = materialize(blocks.groupBy("group").agg(F.sum("n").alias("n")))
    most = sizes.agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    paths, roots = finish(nodes.drop("pid", "block"), sizes, most)
    # a node that is its group's root has no way to go
    known = nodes.drop("digest").join(paths, ["group", "level", "index"], "left").withColumn("path", F.coalesce("path", F.lit("")))
    return blocks, known, roots


PROOF_SCHEMA = "group string, id long, leaf string, other string, idx long, n long, path string, subroot string, folded string"


def prove(blocks: DataFrame, known: DataFrame, roots: DataFrame) -> DataFrame:
    """One row for each leaf: its number in its group, the group's size and root, the siblings up to it, and the root that `other` (or, where that
    is null, the leaf) and the siblings lead to. Further columns of roots come along, one value a block."""
    more = [c for c in roots.columns if c not in ("group", "n", "subroot")]
    tops = known.join(roots, "group").groupBy("pid", "block").agg(
        F.collect_list(F.struct("level", "index", "path")).alias("tops"), *[F.any_value(c).alias(c) for c in ("n", "subroot", *more)]
    )  # at most two nodes a level of a block
    full = blocks.drop("n").withColumnRenamed("first", "_first").join(tops, ["pid", "block"])
    extra = [(f.name, f.dataType.simpleString()) for f in roots.schema.fields if f.name in more]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = {n: k for k, n in enumerate(batch.schema.names)}
            for k in range(batch.num_rows):
                get = lambda name, k=k, batch=batch, at=at: batch.column(at[name])[k].as_py()
                first, leaves, ids, others, n, group, subroot = (get(x) for x in ("_first", "leaves", "ids", "others", "n", "group", "subroot"))
                levels, _ = subtrees(leaves, first)
                above = {(t["level"], t["index"]): t["path"] for t in get("tops")}
                shared = [get(x) for x in more]
                for a in range(0, len(ids), 2048):
                    rows = []
                    for j in range(a, min(a + 2048, len(ids))):
                        index, own = first + j, leaves[j * HEX : (j + 1) * HEX]
                        top = next(t for t in range(len(levels)) if (t, index >> t) in above)
                        path = "".join(siblings(levels, index, top)) + above[top, index >> top]
                        other = others[j] if others else None
                        rows.append((group, ids[j], own, other, index, n, path, subroot, fold(other or own, index, n, path)[0], *shared))
                    yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    s, i = pa.string(), pa.int64()
    kinds = [s, i, s, s, i, i, s, s, s] + [i if kind == "bigint" else s for _, kind in extra]
    names = [f.split()[0] for f in PROOF_SCHEMA.split(", ")] + more
    columns = ["_first", "leaves", "ids", "others", "n", "group", "subroot", "tops", *more]
    return full.select(*columns).mapInArrow(tidy(each), ", ".join([PROOF_SCHEMA, *(f"{n} {kind}" for n, kind in extra)]))


def manifest(docs: DataFrame, id_col: str, group_col: str, fields: list[str], tampered: dict[str, Column] | None = None, where: Column | None = None) -> DataFrame:
    """The table's manifest: group, id, leaf, idx, n, path (siblings up to the group's root), subroot, rank (the group's number), groups, upper (siblings from
    there to the root), root, and folded: the root that the proof leads to from the leaf - from that of the changed row, where `where` holds and `tampered` changes fields."""
    now = [F.col(f) for f in fields]
    changed = leaf(*[(tampered or {}).get(f, F.col(f)) for f in fields])
    other = F.when(where, changed) if where is not None and tampered else F.lit(None).cast("string")
    rows = docs.select(group_key(F.col(group_col)).alias("group"), F.col(id_col).cast("long").alias("id"), leaf(*now).alias("leaf"), other.alias("other"))
    blocks, known, roots = tree(rows)
    roots = materialize(roots)
    # the groups' roots are the leaves of one more tree, in the order of their keys
    ranked = number_groups(roots)
    above = prove(*tree(ranked.select(F.lit("").alias("group"), F.col("rank").alias("id"), F.col("subroot").alias("leaf"), F.lit(None).cast("string").alias("other"))))
    upper = above.select(F.col("id").alias("rank"), F.col("n").alias("groups"), F.col("path").alias("upper"), F.col("subroot").alias("root"))
    roots = materialize(ranked.join(upper, "rank"))

    def to_root(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = {n: batch.column(n).to_pylist() for n in ("folded", "rank", "groups", "upper")}
            values = [fold(*x)[0] for x in zip(*at.values(), strict=True)]
            yield batch.set_column(batch.schema.get_field_index("folded"), "folded", pa.array(values, pa.string()))

    proofs = prove(blocks, known, roots)
    return proofs.mapInArrow(tidy(to_root), proofs.schema)


def number_groups(roots: DataFrame) -> DataFrame:
    """roots with `rank`, from 0 on in the order of the group keys: positions in range-sorted partitions, shifted by the rows of earlier ones."""
    place = F.monotonically_increasing_id()
    ordered = materialize(roots.repartitionByRange("group").sortWithinPartitions("group").withColumn("_place", place))
    ordered = ordered.withColumns({"pid": F.expr("cast(shiftright(_place, 33) AS int)"), "_place": F.expr("_place & 8589934591"), "_all": F.lit("")})
    offsets = group_offsets(ordered.groupBy("pid", "_all").agg(F.count("*").alias("n")), "_all")  # one row a partition
    return ordered.join(F.broadcast(offsets), ["pid", "_all"], "left").withColumn("rank", F.col("_place") + F.coalesce("offset", F.lit(0))).drop("pid", "_place", "_all", "offset")


#: crc32 (unsigned) of a text of ASCII characters, bit by bit, as a macro-free expression: 3988292384 is the reversed polynomial.
CRC32_SQL = """xor(list_reduce([4294967295::BIGINT] || list_transform(string_split({0}, ''), lambda ch: ascii(ch)::BIGINT),
  lambda c, b: list_reduce([xor(c, b), 1, 2, 3, 4, 5, 6, 7, 8], lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295)"""
_FIELD_SQL = "coalesce(strlen({0}::VARCHAR)::VARCHAR || ':' || {0}::VARCHAR, '-')"
_LEAF_SQL = "sha256(" + " || ".join(_FIELD_SQL.format(f) for f in FIELDS) + ")"
_LEVELS_SQL = """
  SELECT {0}, 0 AS k, list(leaf ORDER BY i) AS nodes FROM {1} GROUP BY ALL
  UNION ALL
  SELECT {0}, k + 1, list_transform(range(0, len(nodes), 2), lambda j: sha256(nodes[j + 1] || coalesce(nodes[j + 2], ''))) FROM {2} WHERE len(nodes) > 1"""
OP12_SQL = f"""
WITH RECURSIVE leaves AS MATERIALIZED (
  SELECT doc_id, coalesce('+' || lang, '') AS g, {_LEAF_SQL} AS leaf, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS i,
    CASE WHEN {CRC32_SQL.format("doc_id::VARCHAR")} % 7 = 0 THEN {_LEAF_SQL.replace("n_chars::VARCHAR", "(n_chars + 1)::VARCHAR")} END AS other
  FROM documents),
levels AS ({_LEVELS_SQL.format("g", "leaves", "levels")}),
subroots AS MATERIALIZED (SELECT g, nodes[1] AS leaf, row_number() OVER (ORDER BY g) - 1 AS i FROM levels WHERE len(nodes) = 1),
upper AS ({_LEVELS_SQL.format("0 AS one", "subroots", "upper").replace("SELECT 0 AS one, k + 1", "SELECT one, k + 1")}),
heights AS (SELECT g, max(k) AS height FROM levels GROUP BY g),
steps AS MATERIALIZED (
  SELECT doc_id, k, nodes[xor(i >> k, 1) + 1] AS beside, (i >> k) & 1 AS odd FROM leaves JOIN levels USING (g) WHERE len(nodes) > 1
  UNION ALL
  SELECT doc_id, height + k, nodes[xor(s.i >> k, 1) + 1], (s.i >> k) & 1 FROM leaves l JOIN heights USING (g) JOIN subroots s USING (g), upper WHERE len(nodes) > 1),
folds AS (
  SELECT doc_id, 0 AS k, coalesce(other, leaf) AS folded FROM leaves
  UNION ALL
  SELECT doc_id, f.k + 1, sha256(CASE WHEN odd = 1 THEN beside || folded ELSE folded || coalesce(beside, '') END) FROM folds f JOIN steps s USING (doc_id) WHERE s.k = f.k),
roots AS (SELECT nodes[1] AS root FROM upper WHERE len(nodes) = 1),
proofs AS (SELECT doc_id, sha256(coalesce(string_agg(beside, '' ORDER BY k), '')) AS proof_sha256 FROM leaves LEFT JOIN steps USING (doc_id) GROUP BY doc_id),
ends AS (SELECT doc_id, arg_max(folded, k) AS folded_root FROM folds GROUP BY doc_id)
SELECT doc_id, l.leaf, s.leaf AS subroot, root, proof_sha256, folded_root, folded_root = root AS verified
FROM leaves l JOIN subroots s USING (g) JOIN proofs USING (doc_id) JOIN ends USING (doc_id), roots"""


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select(*FIELDS)
    one_more = F.coalesce(F.try_add(F.col("n_chars"), F.lit(1)), F.col("n_chars"))
    out = manifest(docs, "doc_id", "lang", FIELDS, {"n_chars": one_more}, F.crc32(F.col("doc_id").cast("string")) % 7 == 0)
    proof = F.sha2(F.concat("path", "upper"), 256)
    return out.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", proof.alias("proof_sha256"), F.col("folded").alias("folded_root"), (F.col("folded") == F.col("root")).alias("verified"))
