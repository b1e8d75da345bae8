"""What presses keep, against plain selections over lists, and settings by the class of a press."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from heddle.operators import attention as att
from heddle.operators import presses, scoring, selection
from heddle.sources.tables import HEAD, KEYS, Tables

N, D = 64, 32


@pytest.fixture(scope="module")
def kv(spark, sf_dir):
    rows = Tables(spark, sf_dir).kv.where(F.col("pos") < N).persist()
    assert rows.count() == 4 * N
    return rows


@pytest.fixture(scope="module")
def arrays(kv):
    out = {}
    for r in sorted(kv.collect(), key=lambda r: r["pos"]):
        out.setdefault((r["layer"], r["head"]), []).append((r["key"], r["value"]))
    return {h: (np.array([k for k, _ in x]), np.array([v for _, v in x])) for h, x in out.items()}


def ids(df):
    return {(r["layer"], r["head"], r["pos"]) for r in df.select(*KEYS).collect()}


def table(df):
    return {(r["layer"], r["head"], r["pos"]): r["score"] for r in df.collect()}


def heads(scores):
    out = {}
    for (layer, head, pos), s in scores.items():
        out.setdefault((layer, head), {})[pos] = round(s, 9)
    return out


def best(own, n):
    return sorted(own, key=lambda p: (-own[p], p))[:n]


def top(scores, n):
    return {(*h, p) for h, own in heads(scores).items() for p in best(own, n)}


def ada(scores, n_kept, safeguard=0.2):
    out = set()
    for layer in (0, 1):
        own = {h: s for h, s in heads(scores).items() if h[0] == layer}
        value = {(*h, p): (float("inf") if p in best(s, int(n_kept * safeguard)) else s[p]) for h, s in own.items() for p in s}
        out |= set(sorted(value, key=lambda k: (-value[k], k[1], k[2]))[: n_kept * len(own)])
    return out


def l1(arrays):
    return {(*h, p): abs(x).sum() for h, (_, v) in arrays.items() for p, x in enumerate(v)}


SCORERS = ["knorm", "keydiff", "random", "streaming_llm", "snapkv", "tova", "observed_attention", "qfilter", "lagkv", "cur", "compactor", "finch", "kvzap_mlp_head"]


@pytest.mark.parametrize("name", SCORERS)
def test_scorers_keep_each_heads_best(kv, name):
    press = presses.build(name, 0.3)
    assert ids(press.compress(kv)) == top(table(press.score(kv)), int(N * 0.7))


@pytest.mark.parametrize("name", ["adakv_snapkv", "adakv_compactor", "expected_attention", "kvzap_mlp_layer"])
def test_heads_share_a_budget(kv, name):
    press = presses.build(name, 0.3)
    assert ids(press.compress(kv)) == ada(table(press.score(kv)), int(N * 0.7))


@pytest.mark.parametrize("name", ["critical_snapkv", "critical_expected_attention"])
def test_two_stages(kv, arrays, name):
    press, norms, n = presses.build(name, 0.3), l1(arrays), int(N * 0.7)
    scores = table(press.score(kv))
    first = top(scores, int(0.7 * N * 0.5))
    second = {k: round((s + 1e-4) * norms[k], 9) + (1e9 if k in first else 0) for k, s in scores.items()}
    assert ids(press.compress(kv)) == top(second, n)


@pytest.mark.parametrize("name", ["critical_adakv_snapkv", "critical_adakv_expected_attention"])
def test_two_stages_with_shared_budgets(kv, arrays, name):
    press, norms, n = presses.build(name, 0.3), l1(arrays), int(N * 0.7)
    scores = table(press.score(kv))
    budget = {}
    for layer, head, _ in ada(scores, n):
        budget[layer, head] = budget.get((layer, head), 0) + 1
    want = set()
    for h, own in heads(scores).items():
        early = set(best(own, max(int(n * 0.2), int(budget[h] * 0.5))))
        second = {p: round((scores[(*h, p)] + 1e-4) * norms[(*h, p)], 9) + (1e9 if p in early else 0) for p in own}
        want |= {(*h, p) for p in best(second, budget[h])}
    assert ids(press.compress(kv)) == want


def test_chunks_layers_and_thresholds(kv):
    press = presses.build("chunkkv", 0.3)
    scores, want = table(press.score(kv)), set()
    for layer in (0, 1):
        means = {c: round(np.mean([s for (la, _, p), s in scores.items() if la == layer and p // 20 == c]), 9) for c in range(4)}
        chosen = best(means, int(4 * 0.7))
        want |= {k for k in scores if k[0] == layer and k[2] // 20 in chosen}
    assert ids(press.compress(kv)) == want
    knorm = table(scoring.key_norm(kv))
    local = presses.Chunk(presses.Knorm(0.3), size=10)
    assert ids(local.kept(kv)) == {(*h, p) for h, own in heads(knorm).items() for c in range(7) for p in best({q: s for q, s in own.items() if q // 10 == c}, max(1, int(len([q for q in own if q // 10 == c]) * 0.7)))}
    layered = presses.PerLayer(presses.Knorm(0.5), ratios=(0.25, 0.75))
    assert ids(layered.kept(kv)) == {(*h, p) for h, own in heads(knorm).items() for p in best(own, int(N * (0.75, 0.25)[h[0]]))}
    cut = presses.Threshold(presses.Knorm(0.5), threshold=-1.0, window=8)
    assert ids(cut.kept(kv)) == {k for k, s in knorm.items() if s >= -1.0 or k[2] >= N - 8}


def test_pyramid_budgets_select(kv):
    press = presses.PyramidKV(0.5, window=4)
    budgets = selection.pyramid_layers(2, 0.5, N, 4)
    assert budgets[0] > budgets[1] and sum(budgets) == N
    assert ids(press.kept(kv)) == {(*h, p) for h, own in heads(table(press.score(kv))).items() for p in best(own, budgets[h[0]])}


def weights(k, v, window):
    x = np.stack([k @ k.T, v @ k.T])[:, -window:] / np.sqrt(D)
    x = np.where(np.tri(N, dtype=bool)[-window:], x, -np.inf)
    e = np.exp(x - x.max(axis=2, keepdims=True))
    return e / e.sum(axis=2, keepdims=True)


@pytest.mark.parametrize(("value_norm", "add_mean", "least"), [(False, True, 0), (True, True, 5), (True, False, 12)])
def test_composite_ranks(kv, arrays, value_norm, add_mean, least):
    scores = {h: weights(k, v, 16).max(axis=1).mean(axis=0) * (np.linalg.norm(v, axis=1) if value_norm else 1) for h, (k, v) in arrays.items()}
    if add_mean:
        scores = {h: s + np.mean([scores[h[0], j] for j in (0, 1)], axis=0) for h, s in scores.items()}
    order = {h: sorted(range(N), key=lambda p, s=s: (-round(s[p], 9), p)) for h, s in scores.items()}
    ranks = {h: s[order[h]] for h, s in scores.items()}
    bonus = np.where(np.arange(N) < least, 1e9, 0)
    layer = np.stack([np.mean([ranks[la, j] for j in (0, 1)], axis=0) + bonus for la in (0, 1)])
    layer[0] = layer.max(axis=0)
    flat = sorted(((-round(layer[la, r], 9), la, r) for la in (0, 1) for r in range(N)))[: int(2 * N * 0.5)]
    budget = [sum(la == k for _, la, _ in flat) for k in (0, 1)]
    press = presses.KVCompose(0.5, True, 16, value_norm, add_mean, least)
    assert ids(press.kept(kv)) == {(*h, p) for h in order for p in order[h][: budget[h[0]]]}
    every = sorted((-round(ranks[h][r] + bonus[r], 9), *h, r) for h in ranks for r in range(N))[: int(4 * N * 0.5)]
    count = {h: sum((la, j) == h for _, la, j, _ in every) for h in ranks}
    press = presses.KVCompose(0.5, False, 16, value_norm, add_mean, least)
    assert ids(press.kept(kv)) == {(*h, p) for h in order for p in order[h][: count[h]]} and min(count.values()) >= least


def test_lag_cross_scoring(kv, arrays):
    lag, sinks = 16, 4
    got = table(scoring.lag_relative(kv, N, lag, ranks=False))
    parts = (N - sinks) // lag
    for h, (k, v) in arrays.items():
        for part in range(parts - 1):
            own, ahead = (slice(sinks + j * lag, sinks + (j + 1) * lag) for j in (part, part + 1))
            s = []
            for x in (k, v):
                low, high = x[ahead].min(axis=0), x[ahead].max(axis=0)
                e = np.exp(((x[own] - low) / (high - low)).std(axis=1, ddof=1))
                s.append(e / e.sum())
            assert np.allclose([got[(*h, p)] for p in range(own.start, own.stop)], np.mean(s, axis=0))
        assert all(got[(*h, p)] == 1.0 for p in [*range(sinks), *range(sinks + (parts - 1) * lag, N)])


@pytest.mark.parametrize("kind", ["kv_product", "kv_avg", "key", "value"])
def test_cur_kinds(kv, arrays, kind):
    got = table(scoring.leverage_product(kv, kind=kind))
    for h, (k, v) in arrays.items():
        share = lambda x: np.concatenate([(s := (x[a : a + 16] ** 2).sum(axis=1)) / s.sum() for a in range(0, N, 16)])
        a, b = share(k), share(v)
        s = {"kv_product": a * b, "kv_avg": (a + b) / 2, "key": a, "value": b}[kind]
        want = np.where(np.arange(N) < 4, 1.0, s / s.sum())
        assert np.allclose([got[(*h, p)] for p in range(N)], want)


def test_finch_by_chunks_and_rotation(kv, arrays):
    press = presses.Finch(0.5, window=8, chunk=24, rerotate=True)
    scores = table(press.score(kv))
    want = {(*h, p) for h, own in heads(scores).items() for c in range(3) for p in best({q: s for q, s in own.items() if q // 24 == c}, max(1, int(len([q for q in own if q // 24 == c]) * 0.5)))}
    rows = press.compress(kv).collect()
    assert {(r["layer"], r["head"], r["pos"]) for r in rows} == want
    for h in arrays:
        for new, p in enumerate(sorted(k[2] for k in want if k[:2] == h)):
            key, turn = arrays[h][0][p], (new - p) * 10000.0 ** (-np.arange(16) / 16)
            turned = np.concatenate([key[:16] * np.cos(turn) - key[16:] * np.sin(turn), key[16:] * np.cos(turn) + key[:16] * np.sin(turn)])
            assert np.allclose(next(r["key"] for r in rows if (r["layer"], r["head"], r["pos"]) == (*h, p)), turned)


def test_duo_from_a_table_and_on_the_fly(spark, kv, arrays):
    given = spark.createDataFrame([(0, 0, 0.3), (0, 1, 7.0), (1, 0, -2.0), (1, 1, 1.0)], "layer int, head int, score double")
    ends = lambda low: {(*h, p) for h in arrays for p in range(N) if h not in low or p < 4 or p >= N - 16}
    assert ids(presses.Duo(0.5, scores=given).kept(kv)) == ends({(1, 0), (0, 0)})
    assert ids(presses.Duo(0.75, scores=given).kept(kv)) == ends({(1, 0), (0, 0), (0, 1)})  # 7 is read as 1, and the first head of equals goes
    with pytest.raises(ValueError):
        presses.Duo(0.5).kept(kv)
    want = {}
    for h, (k, v) in arrays.items():
        angle = np.arange(100)[:, None] * 10000.0 ** (-np.arange(16) / 16)
        turn = lambda x: np.hstack([x[:16] * np.cos(angle) - x[16:] * np.sin(angle), x[16:] * np.cos(angle) + x[:16] * np.sin(angle)])  # noqa: B023, E731
        areas = []
        for q in (k.mean(axis=0), v.mean(axis=0)):
            e = np.exp(turn(q)[-1] @ turn(k.mean(axis=0)).T / math.sqrt(D))
            areas.append(np.cumsum(e / e.sum()).mean())
        want[h] = np.mean(areas)
    got = {(r["layer"], r["head"]): r["score"] for r in att.mean_head_scores(kv, 100).collect()}
    assert set(got) == set(want) and all(np.isclose(got[h], want[h]) for h in want)


def test_merging_shows_in_the_values(kv, arrays):
    rows = presses.build("merging_knorm", 0.5).compress(kv).collect()
    keep = {h: sorted(best(own, 32)) for h, own in heads(table(scoring.key_norm(kv))).items()}
    for h, (k, v) in arrays.items():
        unit, value, weight = k / np.linalg.norm(k, axis=1, keepdims=True), {p: v[p].copy() for p in keep[h]}, dict.fromkeys(keep[h], 0.0)
        for p in set(range(N)) - set(keep[h]):
            sims = {t: round(unit[p] @ unit[t], 9) for t in keep[h]}
            t = best(sims, 1)[0]
            sim = unit[p] @ unit[t]
            if sim >= 0:
                e, own = np.linalg.norm(v[p]), np.linalg.norm(v[t])
                w = sim * e / (e + own + 1e-6)
                value[t] += w * v[p]
                weight[t] += w
        got = {r["pos"]: np.array(r["value"]) for r in rows if (r["layer"], r["head"]) == h}
        assert set(got) == set(keep[h]) and all(np.allclose(got[p], value[p] / (1 + weight[p])) for p in got)
        assert sum(not np.allclose(got[p], v[p]) for p in got) > 3


def test_settings_by_class(spark, kv):
    for name in ("duo_attention", "think", "snap_think", "kvzap_linear"):
        with pytest.raises(ValueError, match="needs"):
            presses.configured(name, 0.5)
    both = presses.configured("snap_think", 0.25, channel_ratio=0.5)
    assert [p.ratio for p in both.presses] == [0.25, 0.5]
    zeros = both.compress(kv).select(F.size(F.filter("key", lambda x: x == 0)).alias("z"), *HEAD).collect()
    assert len(zeros) == 4 * 48 and {r["z"] for r in zeros} == {16}
    assert presses.configured("kvzap_linear", 0.5, threshold=-4.0).threshold == -4.0
    assert presses.configured("duo_attention_on_the_fly", 0.9, head_ratio=0.25).ratio == 0.25
    press = presses.configured("decoding_knorm", 0.5, interval=8)
    assert (press.interval, press.target) == (8, 1024) and presses.configured("knorm", 0.1).ratio == 0.1
