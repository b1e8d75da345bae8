"""Prefix trie against a dictionary of prefixes, on plain and odd conversations."""

import hashlib
import random
import re
import zlib

import pytest

from heddle.llm import prefix_trie as trie

TURNS = "conv_id long, turn long, role string, text string"


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def turn_key(role, text):
    return hashlib.sha256(f"{len(role.encode())}:{role}{len(text.encode())}:{text}".encode()).digest()


def shown(c):
    return "" if c is None else str(c)


def plain(rows):
    """Nodes as the contract has them; a null id is a conversation, before all others."""
    own = {}
    for c, turn, role, text in rows:
        own.setdefault(c, []).append((turn is not None, turn or 0, turn_key(role or "", text or ""), role or "", text or ""))
    own = {c: [t[3:] for t in sorted(ts)] for c, ts in own.items()}
    built = {}
    for c, ts in own.items():
        h = zlib.crc32(shown(c).encode()) % 4
        rest = abs(c) % 20 * (1 if c > 0 else -1) if c is not None else 0
        built[c] = (own.get(c - rest, [])[:h] if c is not None else []) + ts[h:]
    nodes = {}
    for c, ts in built.items():
        for d in range(len(ts) + 1):
            nodes.setdefault(tuple(ts[:d]), []).append(c)
    low = lambda c: (c is not None, c or 0)
    small = {p: min(cs, key=low) for p, cs in nodes.items()}
    kids = {p: sum(len(q) == len(p) + 1 and q[: len(p)] == p for q in nodes) for p in nodes}
    words = lambda p: len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
    out = []
    for p, cs in nodes.items():
        below = [q for q in nodes if q[: len(p)] == p]
        ends = sorted((c for c in cs if len(built[c]) == len(p)), key=low)
        saved = sum((len(nodes[q]) - 1) * words(q) for q in below)
        out.append((small[p], len(p), small[p[:-1]] if p else None, len(cs), kids[p], sum(not kids[q] for q in below), saved, sha(",".join(map(shown, ends)))))
    return sorted(out, key=str)


def got(spark, rows, tmp_path, name, schema=TURNS):
    spark.createDataFrame(rows, schema).repartition(5).write.parquet(f"{tmp_path}/{name}/conversations.parquet")
    return sorted(map(tuple, trie.op13_prefix_trie(spark, f"{tmp_path}/{name}").collect()), key=str)


@pytest.mark.parametrize(("hot", "part"), [(4096, 8192), (3, 2)])
def test_trie_is_a_dictionary_of_prefixes(spark, tmp_path, monkeypatch, hot, part):
    monkeypatch.setattr(trie, "HOT", hot)
    monkeypatch.setattr(trie, "PART", part)
    rng = random.Random(hot)
    rows = [(c, t, rng.choice(["user", "system"]), f"w{rng.randrange(2)} x" * rng.randrange(3)) for c in range(-30, 60, 2) for t in range(rng.randrange(1, 6))]
    rows += [(c, t, "user", f"same {t}") for c in (100, 101, 102, 103, 104, 105, 107, 109, 111, 113) for t in range(5)]
    assert got(spark, rows, tmp_path, "t") == plain(rows)


def test_odd_rows(spark, tmp_path):
    rows = [(None, 0, "a", "b"), (None, None, None, None), (1, None, None, "x  y"), (1, None, None, "x  y"), (1, 0, "u", ""), (1, 0, "u", None), (2, 5, "", "")]
    rows += [(200, k, "u", "tick") for k in range(300)] + [(201, 0, "u", "é " * 100_000), (202, 0, "u", "é " * 100_000), (-7, 1, "ü", "z"), (-7, 1, "ü", "a"), (2**62, 3, "r", "t")]
    assert got(spark, [(*r, 1, "k") for r in rows], tmp_path, "odd", TURNS + ", depth int, key string") == plain(rows)


def test_few_conversations(spark, tmp_path):
    assert got(spark, [], tmp_path, "none") == []
    for name, rows in {"one": [(9, k, "u", f"t {k}") for k in range(5)], "short": [(6, 0, "u", "a")], "pair": [(40, 0, "u", "a b"), (41, 0, "u", "a b")]}.items():
        assert got(spark, rows, tmp_path, name) == plain(rows)


def test_rows_are_numbered_over_partitions(spark):
    from pyspark.sql import functions as F

    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.range(20_000).select((F.col("id") % 3 * F.when(F.col("id") < 9000, 1).otherwise(0)).alias("c"), (F.col("id") * 7919 % 20_000).alias("turn")).repartition(6)
        rows = trie.number_rows(df, "c", ["turn"]).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for c in (0, 1, 2):
        own = sorted((r["turn"], r["i"]) for r in rows if r["c"] == c)
        assert [i for _, i in own] == list(range(len(own)))
