"""Tiled attention, mergeable aggregates and what is built on them, against whole matrices."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from heddle.operators import attention as att
from heddle.operators import linear, presses, surrogate, tiles
from heddle.operators.aggregate import Moments, WeightedGram, aggregate
from heddle.sources.tables import HEAD, KEYS, Tables

N, D = 60, 32


@pytest.fixture(scope="module")
def kv(spark, sf_dir):
    """Ragged: the heads have 60, 60, 45 and 45 positions."""
    rows = Tables(spark, sf_dir).kv.where(F.col("pos") < F.when(F.col("layer") == 0, N).otherwise(45)).persist()
    assert rows.count() == 210
    return rows


@pytest.fixture(scope="module")
def heads(kv):
    out = {}
    for r in sorted(kv.collect(), key=lambda r: r["pos"]):
        out.setdefault((r["layer"], r["batch"], r["head"]), []).append((r["key"], r["value"]))
    return {h: (np.array([k for k, _ in rows]), np.array([v for _, v in rows])) for h, rows in out.items()}


def scores(df, column="score"):
    return {tuple(r[c] for c in KEYS): r[column] for r in df.collect()}


def close(got, want):
    assert set(got) == set(want)
    assert all(np.isclose(got[k], want[k], rtol=1e-8, atol=1e-10) for k in want)


def weights(k, v):
    """(2, n, n): causal softmax of both queries of each position."""
    x = np.stack([k @ k.T, v @ k.T]) / np.sqrt(D)
    x = np.where(np.tri(len(k), dtype=bool), x, -np.inf)
    e = np.exp(x - x.max(axis=2, keepdims=True))
    return e / e.sum(axis=2, keepdims=True)


@pytest.mark.parametrize(("size", "part"), [(256, 16), (7, 1), (8, 2), (1, 3)])
def test_received_is_the_whole_matrix(kv, heads, size, part):
    got = tiles.causal_received(att.queries_of(kv), kv, size=size, part=part).persist()
    want = {h: weights(*x) for h, x in heads.items()}
    close(scores(got, "total"), {(*h, p): w[:, :, p].sum() for h, w in want.items() for p in range(w.shape[1])})
    close(scores(got, "best"), {(*h, p): w[:, :, p].max() for h, w in want.items() for p in range(w.shape[1])})


def test_large_logits_do_not_run_over(kv, heads):
    big = kv.withColumn("key", F.transform("key", lambda x: x * 1e4))
    got = scores(tiles.causal_received(att.queries_of(kv), big, size=16, part=1), "total")
    assert all(np.isfinite(v) for v in got.values()) and np.isclose(sum(got.values()), 2 * 210)


def test_observed_and_kvzip(kv, heads):
    want = {h: weights(*x) for h, x in heads.items()}
    close(scores(att.observed_scores(kv)), {(*h, p): w[:, :, p].sum() / 2 / (w.shape[1] - p) for h, w in want.items() for p in range(w.shape[1])})
    plus = {(*h, p): w[:, :, p].max() * np.linalg.norm(heads[h][1][p]) for h, w in want.items() for p in range(w.shape[1])}
    close(scores(presses.KVzip(plus=True).score(kv)), plus)
    layerwise = {tuple(r) for r in presses.KVzip(0.5, layerwise=True).kept(kv).collect()}
    best = {h: w.max(axis=(0, 1)) for h, w in want.items()}
    for layer, n in ((0, N), (1, 45)):
        rows = sorted(((-round(best[h][p], 9), *h[1:], p) for h in best if h[0] == layer for p in range(n)))[:n]
        assert {(layer, b, h, p) for _, b, h, p in rows} == {r for r in layerwise if r[0] == layer}


@pytest.mark.parametrize(("chunk", "size"), [(10, 4), (25, 256), (1000, 16)])
def test_chunks_of_a_repetition(kv, heads, chunk, size):
    """The repetition has keys of its own."""
    again = kv.withColumn("key", F.transform("key", lambda x: x * 0.5 + 0.1))
    got = tiles.repeated_received(att.queries_of(kv), kv, chunk, 4, again, size=size).persist()
    total, best = {}, {}
    for h, (k, v) in heads.items():
        for start in range(4, len(k), chunk):
            own = slice(start, min(start + chunk, len(k)))
            n = own.stop - start
            both = [q[own] @ np.vstack([k[:4], k[own], k[own] * 0.5 + 0.1]).T / np.sqrt(D) for q in (k, v)]
            seen = np.hstack([np.ones((n, 4 + n), bool), np.tri(n, dtype=bool)])
            w = []
            for x in both:
                e = np.where(seen, np.exp(x - x.max()), 0)
                w.append(e / e.sum(axis=1, keepdims=True))
            w = np.stack(w)[:, :, 4 : 4 + n]
            for j in range(n):
                total[(*h, start + j)], best[(*h, start + j)] = w[:, :, j].sum(), w[:, :, j].max()
    close(scores(got, "total"), total)
    close(scores(got, "best"), best)
    assert scores(presses.KVzip(chunk=chunk).score(kv))[(0, 0, 0, 2)] == 1.0


def test_targets_of_a_repetition_teach_a_surrogate(spark, kv, heads):
    spans = spark.createDataFrame([(0, 3, 20, 22, 39)], "batch int, start int, end int, again_start int, again_end int")
    weight = kv.select(*HEAD, F.col("pos").alias("q_pos"), (1 / (F.col("pos") + 1.0)).alias("weight"))
    got = att.repeated_targets(kv, att.queries_of(kv).join(weight, [*HEAD, "q_pos"]), spans)
    want = {}
    for h, (k, v) in heads.items():
        w = weights(k, v)[:, 22:39] / (np.arange(22, 39) + 1.0)[None, :, None]
        want |= {(*h, p): np.log(w[:, :, p].max() * np.linalg.norm(v[p])) for p in range(3, 20)}
    close(scores(got), want)
    model = surrogate.fit(kv, got, penalty=0.1, logged=True)
    for layer in (0, 1):
        x = np.array([[*heads[h[:3]][0][h[3]], *heads[h[:3]][1][h[3]], 1.0] for h in want if h[0] == layer])
        y = np.array([s for h, s in want.items() if h[0] == layer])
        assert np.allclose(model.weights[layer], np.linalg.solve(x.T @ x + 0.1 * np.eye(65), x.T @ y))


def test_statistics(kv, heads):
    for sample in (False, True):
        for r in att.query_statistics(kv, sample=sample).collect():
            q = heads[r["layer"], r["batch"], r["head"]][r["qhead"] % 2][4:]
            assert np.allclose(r["mu"], q.mean(axis=0)) and np.allclose(r["sigma"], np.cov(q.T, bias=not sample))


def z(by_head):
    out = {}
    for layer in (0, 1):
        own = np.concatenate([s for h, s in by_head.items() if h[0] == layer])
        out |= {(*h, p): (x - own.mean()) / own.std(ddof=1) for h, s in by_head.items() if h[0] == layer for p, x in enumerate(s)}
    return out


def test_leverage_and_capacity(kv, heads):
    found = {}
    for h, (k, _) in heads.items():
        project = np.random.default_rng(zlib.crc32(f"0:{':'.join(map(str, h))}".encode())).normal(size=(D, 16)) / 4
        x = (k - k.mean(axis=0)) @ project
        found[h] = np.einsum("ij,jk,ik->i", x, np.linalg.inv(x.T @ x + 1e-3 * np.eye(16)), x)
    close(scores(linear.leverage(kv)), z(found))
    want = {}
    for h, (k, v) in heads.items():
        unit = k / np.linalg.norm(k, axis=1, keepdims=True)
        s = -(unit @ unit.mean(axis=0)) / np.linalg.norm(unit.mean(axis=0))
        w = np.exp(5 * (s - s.max()))
        score = w * np.einsum("ij,jk,ik->i", v, np.linalg.inv(np.eye(D) + (v * w[:, None]).T @ v), v)
        want |= {(*h, p): score.max() + 1 if p < 4 else x for p, x in enumerate(score)}
    close(scores(linear.capacity(kv)), want)


def test_compactor_joins_both_scores(kv):
    lever, block = scores(linear.leverage(kv)), scores(att.block_scores(kv, 16))
    got = scores(linear.compactor(kv, 0.3))
    for layer, n in ((0, N), (1, 45)):
        sums = {k: 0.3 * lever[k] + block[k] for k in lever if k[0] == layer}
        assert all(np.isclose(got[k], max(sums.values()) if k[3] < 8 or k[3] >= n - 4 else s) for k, s in sums.items())


def test_sketch_is_gaussian_and_keeps_norms():
    s = np.stack([linear.sketch_of((0, 0, h), D, 16, 0) for h in range(400)])
    assert abs(s.mean()) < 0.002 and abs(s.var() * 16 - 1) < 0.01 and not np.allclose(s[0], s[1])
    assert abs((np.ones(D) @ s).var(axis=0).mean() * 16 / D - 1) < 0.1


def test_states_do_not_depend_on_partitions(spark, kv):
    for by, columns in ((Moments(D), ["key"]), (WeightedGram(D), ["s", "value"])):
        rows = kv.withColumn("s", (F.col("pos") * 20.0))  # exp(1,180) would run over
        got = [{tuple(r[c] for c in HEAD): np.array(r["state"]) for r in aggregate(rows.repartition(n), HEAD, columns, by).collect()} for n in (1, 9)]
        assert set(got[0]) == set(got[1]) and len(got[0]) == 4
        assert all(np.allclose(got[0][h], got[1][h]) and np.isfinite(got[0][h]).all() for h in got[0])
    assert aggregate(kv.limit(0), HEAD, ["key"], Moments(D)).collect() == []
    assert np.array_equal(WeightedGram(2).merge(WeightedGram(2).zero(), WeightedGram(2).zero()), WeightedGram(2).zero())
