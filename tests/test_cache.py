"""Caches held token by token: the fold and the stream against plain loops over lists."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from heddle.operators import attention as att
from heddle.operators import scoring, selection
from heddle.sources.tables import KEYS, Tables
from heddle.streaming import cache
from heddle.streaming import stateful as st

N = 48


@pytest.fixture(scope="module")
def kv(spark, sf_dir):
    rows = Tables(spark, sf_dir).kv.where(F.col("pos") < N).persist()
    assert rows.count() == 4 * N
    return rows


@pytest.fixture(scope="module")
def tokens(kv):
    return cache.tokens_of(kv, att.queries_of(kv)).persist()


@pytest.fixture(scope="module")
def vectors(kv):
    return {(r["layer"], r["head"], r["pos"]): (np.array(r["key"]), np.array(r["value"])) for r in kv.collect()}


def as_rows(df):
    return {(r["layer"], r["head"], r["pos"]): np.array(r["value"]) for r in df.collect()}


def same(got, want):
    assert set(got) == set(want)
    assert all(np.allclose(got[k], want[k], atol=1e-9) for k in want)


def plain_merging(vectors, interval, target, prefill, budget, score):
    """Slot by slot: running sums, rounds, candidates, windows and draws."""
    out = {}
    for layer in (0, 1):
        held, value, seen, since = [], {}, {}, 0
        for pos in range(N):
            held.append(pos)
            for h in (0, 1):
                value[h, pos], seen[h, pos] = vectors[layer, h, pos][1].copy(), 0.0
            if pos < prefill:
                continue
            for h in (0, 1):
                for q in vectors[layer, h, pos]:
                    e = [math.exp(q @ vectors[layer, h, p][0] / math.sqrt(32)) for p in held]
                    for p, x in zip(held, e, strict=True):
                        seen[h, p] += x / sum(e) / 2
            since += 1
            if since < interval or len(held) <= target:
                continue
            mean = {p: round(sum(score(vectors[layer, h, p][0]) for h in (0, 1)) / 2, 9) for p in held}
            kept = sorted(sorted(held, key=lambda p: (-mean[p], p))[:target])
            gone = sorted(set(held) - set(kept), key=lambda p: (-mean[p], -p))[:since]
            adds = []
            for p in gone:
                window = [k for k in kept if k > p][:budget]
                for h in (0, 1) if window else ():
                    chance = round(seen[h, p] / (sum(seen[h, k] for k in window) / len(window)), 9)
                    if int(hashlib.md5(f"11:{layer}:0:{h}:{p}".encode()).hexdigest()[:8], 16) / 2**32 < min(max(chance, 0), 1):
                        adds += [(h, k, value[h, p] / len(window)) for k in window]
            for h, k, x in adds:
                value[h, k] = value[h, k] + x
            held, since = kept, 0
        out |= {(layer, h, p): value[h, p] for h in (0, 1) for p in held}
    return out


@pytest.mark.parametrize(("interval", "target", "prefill", "budget"), [(8, 12, 16, 4), (1, 20, 30, 2), (5, 7, 0, 32), (64, 8, 0, 4)])
def test_merging_is_a_plain_loop(tokens, vectors, interval, target, prefill, budget):
    policy = cache.Merging(cache.key_norm, interval=interval, target=target, prefill=prefill, budget=budget)
    want = plain_merging(vectors, interval, target, prefill, budget, lambda k: -np.linalg.norm(k))
    same(as_rows(cache.fold(tokens, policy)), want)
    assert len({p for _, h, p in want if h == 0} ^ {p for _, h, p in want if h == 1}) == 0


def test_merging_changes_values(tokens, vectors):
    got = as_rows(cache.fold(tokens, cache.Merging(cache.key_norm, interval=8, target=12, budget=4)))
    assert sum(not np.allclose(v, vectors[k][1]) for k, v in got.items()) > 4


def key_diff(keys):
    unit = keys / np.linalg.norm(keys, axis=1, keepdims=True)
    anchor = unit.mean(axis=0)
    return -(unit @ anchor) / np.linalg.norm(anchor)


def plain_blocks(vectors, kept, size):
    out = set()
    for layer in (0, 1):
        for h in (0, 1):
            held = list(range(kept))
            for start in range(kept, N, size):
                held = held + list(range(start, min(start + size, N)))
                s = key_diff(np.array([vectors[layer, h, p][0] for p in held]))
                held = sorted(p for _, p in sorted(zip(-np.round(s, 9), held, strict=True))[:kept])
            out |= {(layer, h, p) for p in held}
    return out


@pytest.mark.parametrize("size", [1, 7, 16, 100])
def test_blocks(kv, tokens, vectors, size):
    best = {(r["layer"], r["head"], r["pos"]) for r in selection.keep_count(scoring.key_norm(kv), 20).collect()}
    assert set(as_rows(cache.fold(tokens, cache.Block(cache.key_norm, 20, size)))) == best  # a score of the row alone: blocks change nothing
    assert set(as_rows(cache.fold(tokens, cache.Block(cache.key_difference, 20, size)))) == plain_blocks(vectors, 20, size)


def test_blocks_matter_where_scores_depend_on_others(kv, tokens):
    whole = {(r["layer"], r["head"], r["pos"]) for r in selection.keep_count(scoring.key_difference(kv), 20).collect()}
    assert set(as_rows(cache.fold(tokens, cache.Block(cache.key_difference, 20, 4)))) != whole
    assert set(as_rows(cache.fold(tokens, cache.Block(cache.key_difference, 20, 28)))) == whole


@pytest.mark.parametrize(
    ("score", "table"),
    [
        (cache.key_norm, scoring.key_norm),
        (cache.key_difference, scoring.key_difference),
        (cache.last_attention, lambda kv: att.last_token_scores(kv, N)),
        (cache.WindowAttention(8, 5), lambda kv: att.window_scores(kv, N, 8, 5)),
        (lambda c, keep: cache.sink_and_recent(c, keep), lambda kv: scoring.sink_and_recent(kv, 0.5)),
    ],
    ids=["norm", "difference", "last", "window", "sinks"],
)
def test_one_round_is_the_relational_score(kv, tokens, score, table):
    """Scores of arrays pick what the scores of tables pick."""
    got = cache.fold(tokens, cache.Decoding(score, interval=N, target=N // 2, recent=8))
    want = selection.keep_count(table(kv), N // 2)
    assert set(as_rows(got)) == {(r["layer"], r["head"], r["pos"]) for r in want.collect()}


def test_odd_caches(spark, tokens):
    policy = cache.Merging(cache.key_norm, interval=4, target=2)
    assert cache.fold(tokens.limit(0), policy).collect() == []
    one = cache.fold(tokens.where("pos = 0"), policy)
    assert one.count() == 4 and {r["seen"] for r in one.collect()} == {1.0}
    zero = spark.createDataFrame([(0, 0, p, [0], [0.0] * 32, [1.0] * 32, [0.0] * 32) for p in range(9)], tokens.schema)  # ties: lower positions stay
    assert sorted(r["pos"] for r in cache.fold(zero, policy).collect()) == [0, 1, 8]


def test_stream_holds_what_the_fold_holds(spark, tokens, tmp_path):
    rows = tokens.repartition(2, "layer", "batch").persist()
    for k in range(4):
        rows.where(f"pos div 12 = {k}").write.mode("append").parquet(f"{tmp_path}/in")
    for policy in (cache.Merging(cache.key_norm, interval=5, target=9, prefill=10, budget=3), cache.Decoding(cache.last_attention, 6, 10), cache.Decoding(cache.WindowAttention(4, 3), 10, 12, recent=4)):
        name = f"{tmp_path}/{type(policy).__name__}{policy.interval}"
        source = st.stateful_session(spark).readStream.schema(tokens.schema).option("maxFilesPerTrigger", 2).parquet(f"{tmp_path}/in")
        changes = st.run_to_end(spark, cache.cache_stream(source, policy), name)
        assert changes.select("version").distinct().count() > 1  # several micro-batches
        same(as_rows(cache.held_now(changes)), as_rows(cache.fold(tokens, policy)))
    rows.unpersist()
    assert changes.where("change = -1").count() > 0 and set(KEYS) <= set(changes.columns)
