"""Merkle manifest against a plain tree, over blocks of many sizes and odd rows."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from heddle.llm import merkle

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def H(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf_of(r, more=0):
    values = (r["doc_id"], r["source"], r["lang"], None if r["n_chars"] is None else min(r["n_chars"] + more, 2**63 - 1), r["text"])
    return H("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def build(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([H("".join(levels[-1][i : i + 2])) for i in range(0, len(levels[-1]), 2)])
    return levels


def way(levels, i):
    out = []
    for nodes in levels[:-1]:
        out.append((nodes[i ^ 1], i & 1) if (i ^ 1) < len(nodes) else None)
        i >>= 1
    return out


def fold(x, steps):
    for s in steps:
        x = H(x) if s is None else H(s[0] + x) if s[1] else H(x + s[0])
    return x


def plain(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r["lang"], []).append(r)
    keys = sorted(groups, key=lambda k: (k is not None, (k or "").encode()))
    ordered = {k: sorted(groups[k], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf_of(r))) for k in keys}
    trees = {k: build([leaf_of(r) for r in ordered[k]]) for k in keys}
    top = build([trees[k][-1][0] for k in keys]) if keys else [[""]]
    out = []
    for g, k in enumerate(keys):
        for i, r in enumerate(ordered[k]):
            steps = way(trees[k], i) + way(top, g)
            bad = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0
            end = fold(leaf_of(r, 1 if bad else 0), steps)
            out.append((r["doc_id"], trees[k][0][i], trees[k][-1][0], top[-1][0], H("".join(s[0] for s in steps if s)), end, end == top[-1][0]))
    return sorted(out, key=str)


def got(spark, docs, tmp_path, name):
    docs.write.parquet(f"{tmp_path}/{name}/documents.parquet")
    return sorted(map(tuple, merkle.op12_merkle_manifest(spark, f"{tmp_path}/{name}").collect()), key=str)


@pytest.mark.parametrize(("block", "step"), [(1 << 14, 12), (7, 2), (1, 1), (8, 3)])
def test_manifest_is_a_plain_tree(spark, tmp_path, monkeypatch, block, step):
    monkeypatch.setattr(merkle, "BLOCK", block)
    monkeypatch.setattr(merkle, "STEP", step)
    rows = [(k * 7 % 101, f"text {k}", "hot" if k % 3 else f"l{k % 11}", None if k % 5 else "s", k) for k in range(101)]
    docs = spark.createDataFrame(rows, DOCS).repartition(5)
    assert got(spark, docs, tmp_path, "even") == plain(docs.collect())


def test_odd_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(merkle, "BLOCK", 4)
    rows = [(None, None, None, None, None), (None, "a", None, "s", 1), (5, "", "", "", 0), (5, "é" * 40_000, "", None, None), (-3, "x", "日", "s", 2**63 - 1)]
    rows += [(9, "same", "en", "s", 4)] * 11 + [(9, "other", "en", "s", 4), (12, "z", "en", "s", 4), (None, "n", "en", "s", 4)]
    docs = spark.createDataFrame([(*r, "shadow", 1) for r in rows], DOCS + ", leaf string, n int")
    assert got(spark, docs, tmp_path, "odd") == plain(docs.collect())
    assert got(spark, docs.limit(0), tmp_path, "none") == []
    assert got(spark, docs.limit(1), tmp_path, "one") == plain(docs.limit(1).collect())


def test_a_hot_group_spreads_over_partitions(spark):
    rows = spark.range(40_000).select(F.lit("+en").alias("group"), (F.col("id") % 2).alias("id"), F.sha2(F.lit("same"), 256).alias("leaf"), F.lit(None).cast("string").alias("other"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        blocks = merkle.pack(rows.repartition(6)).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len({b["pid"] for b in blocks}) > 2 and all(b["n"] <= merkle.BLOCK for b in blocks)
    assert sorted(x for b in blocks for x in range(b["first"], b["first"] + b["n"])) == list(range(40_000))


def test_each_node_of_a_boundary_stands_alone():
    for first in range(9):
        for n in range(1, 40):
            levels, boundary = merkle.subtrees("".join(H(str(k)) for k in range(n)), first)
            spans = sorted((i << k, (i + 1) << k) for k, i, _ in boundary)
            assert spans[0][0] == first and spans[-1][1] == first + n and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
            assert len(boundary) <= 2 * len(levels)
