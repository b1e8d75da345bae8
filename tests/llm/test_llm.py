"""The training-data operators against brute force, and on nulls, empty and long texts, repeated rows, empty tables and odd columns."""

import glob
import hashlib
import math
import re
import zlib
from collections import Counter
from itertools import combinations

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from heddle.llm import mixing, near_documents, near_vectors, pieces, ppm, quality_rules, sharding, substrings, token_planes, toxicity
from heddle.llm.components import components
from heddle.llm.queries import ORACLES, QUERIES

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORDS = public_tokenizers.path("word_bpe_49k.json")


def docs_of(spark, texts, ids=None):
    ids = list(range(len(texts))) if ids is None else ids
    rows = [(i, t, "en", f"s{k % 3}" if k % 4 else None, len(t or "")) for k, (i, t) in enumerate(zip(ids, texts, strict=True))]
    return spark.createDataFrame(rows, DOCS)


def base_text(seed, n=60):
    rng = np.random.default_rng(seed)
    return " ".join(f"w{rng.integers(400)}" for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty, blank, very long and repeated texts, a repeated row, and a null id."""
    a, long = base_text(1), base_text(2, 30_000)
    texts = [None, "", " \t\n", a, a, a + " x", long, "one", "two words\x0b here\x0c now", "日本語 ▁ ünïcode\n\n", a]
    return docs_of(spark, texts, [0, 1, 2, 3, 4, 5, 6, 7, 8, None, 3])


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(name, spark, sf_dir):
    duck = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        duck.execute(f"create view {p.split('/')[-1][:-8]} as select * from '{p}'")
    want = duck.execute(ORACLES[name]).fetchdf()
    got = QUERIES[name](spark, sf_dir).toPandas()[list(want.columns)]
    order = list(want.columns)[:2]
    pd.testing.assert_frame_equal(got.sort_values(order).reset_index(drop=True), want.sort_values(order).reset_index(drop=True), check_dtype=False)


# --- 1 ------------------------------------------------------------------------------------------------------------------


def brute_ppm(train, text, order):
    """Method D with exclusion, symbol by symbol."""
    counts = {}
    for t in train:
        s = [ppm.START] * order + list(t.encode().lower()) + [ppm.END]
        for i in range(order, len(s)):
            for k in range(order + 1):
                counts.setdefault(tuple(s[i - k : i]), Counter())[s[i]] += 1
    out, s = 0.0, [ppm.START] * order + list(text.encode().lower()) + [ppm.END]
    for i in range(order, len(s)):
        gone = set()
        for k in range(order, -1, -1):
            held = {x: n for x, n in counts.get(tuple(s[i - k : i]), {}).items() if x not in gone}
            if not held:
                continue
            total = sum(held.values())
            if s[i] in held:
                out += math.log10((held[s[i]] - 0.5) / total)
                break
            out += math.log10(len(held) / (2 * total))
            gone |= set(held)
        else:
            out -= math.log10(ppm.SYMBOLS - len(gone))
    return out


def test_ppm_is_brute_force(spark):
    train = ["abracadabra", "abra cad", "the end", ""]
    tests = ["abra", "cadabra zebra", "", "QUITE", "ünï"]
    counts = ppm.count(docs_of(spark, train), order=3)
    got = {r["doc_id"]: r for r in ppm.score_texts(docs_of(spark, tests).select("doc_id", "text"), counts, order=3).collect()}
    c = Counter(w for t in train for w in [*t.lower().split(), None])
    n, v = sum(c.values()), len(c)
    for i, t in enumerate(tests):
        assert got[i]["score"] == pytest.approx(brute_ppm(train, t, 3))
        own = [*t.lower().split(), None]
        assert got[i]["base_score"] == pytest.approx(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in own))
        assert (got[i]["n_tokens"], got[i]["n_known"], got[i]["train_tokens"]) == (len(own), sum(c[w] > 0 for w in own), n)


def test_ppm_bounds_keep_words_and_rows(spark, odd):
    docs = odd.select("doc_id", "text")
    counts = ppm.count(docs)
    tight = ppm.score_texts(docs, counts, max_grams=50, most_hot=3).toPandas()
    wide = ppm.score_texts(docs, counts).toPandas()
    assert len(tight) == len(wide) == 11
    key = ["doc_id", "n_tokens", "n_known", "train_tokens"]
    assert tight[key].fillna(-1).sort_values(key).values.tolist() == wide[key].fillna(-1).sort_values(key).values.tolist()
    assert np.allclose(sorted(tight.base_score), sorted(wide.base_score)) and np.isfinite(tight.score).all()


def test_ppm_broadcasts_no_more_than_its_bound(spark):
    """Whatever the counts are: many rows of one large count, and ranges that one step cannot tell apart."""
    same = spark.range(1000).select(F.lit(1 << 21).cast("long").alias("n"), F.encode(F.col("id").cast("string"), "utf-8").alias("word"))
    table, floor = ppm.hot_words(same, 10)
    assert table == {} and floor == (1 << 21) + 1
    rng = np.random.default_rng(3)
    counts = sorted((int(x) for x in [*rng.integers(1, 9, 300), *rng.integers(1, 10**12, 200), *[10**12] * 20]), reverse=True)
    level = spark.createDataFrame([(c,) for c in counts], "n long").repartition(3)
    for most, steps in ((0, 4), (19, 1 << 16), (20, 4), (150, 1 << 16), (230, 4), (400, 1 << 16), (520, 4)):
        reached = sum(x >= ppm.least_count(level, most, steps) for x in counts)
        assert reached == max(sum(x >= c for x in counts) for c in {1, *counts, counts[0] + 1} if sum(x >= c for x in counts) <= most)
    assert ppm.least_count(level.limit(0), 5) == 1


def test_ppm_keeps_every_gram(spark):
    train = ["abracadabra", "abra cad", "the end", "", base_text(3, 30)]
    tests = ["abra", "cadabra zebra", "", None, "QUITE", "ünï", base_text(3, 20) + " abra", "abra"]
    docs = docs_of(spark, tests, [0, 1, 2, 3, 4, 5, None, 0]).select("doc_id", "text")
    for most in (0, 5, 60):
        got = ppm.score_texts(docs, ppm.count(docs_of(spark, train), order=3), order=3, max_grams=most).toPandas()
        assert np.allclose(sorted(got.score), sorted(brute_ppm(train, t or "", 3) for t in tests))


def test_ppm_empty(spark, none, odd):
    assert ppm.score_texts(none.select("doc_id", "text"), ppm.count(none)).count() == 0
    assert ppm.score_texts(odd.select("doc_id", "text"), ppm.count(none)).count() == 11


# --- 2 ------------------------------------------------------------------------------------------------------------------


def test_pieces_are_lossless_and_reproducible(spark, odd):
    first = pieces.encode_pieces(odd, PIECES).select("doc_id", "text", "piece_ids", "lossless").collect()
    again = pieces.encode_pieces(odd.repartition(5), PIECES).select("doc_id", "text", "piece_ids", "lossless").collect()
    assert sorted(map(str, first)) == sorted(map(str, again))
    assert all(r["lossless"] for r in first if r["text"] is not None)
    assert [r["piece_ids"] for r in first if r["text"] is None] == [None]
    back = pieces.decode_pieces(pieces.encode_pieces(odd.withColumn("lossless", F.lit(1)), PIECES), PIECES)
    assert back.where("NOT (decoded <=> text)").count() == 0


def test_pieces_follow_the_lattice():
    e = pieces.encoder(PIECES)
    unit, found = " other", []

    def walk(i, held, w):
        if i == len(unit):
            found.append((tuple(held), w))
        for j in range(i + 1, len(unit) + 1):
            if (p := e.v.surface.get(unit[i:j])) is not None:
                walk(j, [*held, p], w + e.v.log_weight[p])

    walk(0, [], 0.0)
    total = sum(math.exp(w) for _, w in found)
    got = Counter(tuple(x) for x in e(["other"] * 4000, list(range(4000))))
    assert set(got) <= {p for p, _ in found}
    assert all(abs(got[p] / 4000 - math.exp(w) / total) < 0.03 for p, w in found)
    flat = pieces.Encoder(PIECES, alpha=0.0)
    assert len({tuple(x) for x in flat(["other"] * 500, list(range(500)))}) > 10


# --- 3 ------------------------------------------------------------------------------------------------------------------


def test_toxicity_finds_words_that_mark_the_label(spark, none, odd):
    rng = np.random.default_rng(5)
    y = [int(rng.random() < 0.3) for _ in range(800)]
    docs = docs_of(spark, [base_text(i, 30) + (" vilewort" if v else "") for i, v in enumerate(y)])
    labels = spark.createDataFrame([(i, v) for i, v in enumerate(y)] + [(None, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    out = toxicity.score(docs.select("doc_id", "text", F.lit("x").alias("score")), model).toPandas().sort_values("doc_id")
    held = np.array([zlib.crc32(str(i).encode()) % 4 == 2 for i in range(800)])
    assert ((out.score.values >= 0.3) == np.array(y))[held].mean() > 0.98
    assert toxicity.score(odd, model).where("score BETWEEN 0 AND 1").count() == 11
    assert toxicity.score(odd, toxicity.fit(odd, labels.limit(0))).where("score <> 0").count() == 0
    assert toxicity.score(none, model).count() == 0
    assert len(model[0]) < 5000  # sparse


def test_toxicity_is_plain_ftrl(spark):
    """Weights by name of feature in dictionaries, one row after the other."""
    rng = np.random.default_rng(11)
    texts = [" ".join(f"v{rng.integers(10)}" for _ in range(3 + i % 9)) + (" bad, BAD" if i % 3 == 0 else "") for i in range(240)]
    docs = docs_of(spark, texts)
    labels = spark.createDataFrame([(i, int(i % 3 == 0 or i % 41 == 0)) for i in range(240)], "doc_id long, toxic int")

    def features(text):
        w = re.findall(r"[a-z0-9_]+", text.lower())
        return {*w, *((1, *x) for x in zip(w, w[1:], strict=False)), *((2, *x) for x in zip(w, w[2:], strict=False)), "(bias)"}

    z, n = Counter(), Counter()

    def weight(f):
        l1 = 0.0 if f == "(bias)" else toxicity.L1
        return 0.0 if abs(z[f]) <= l1 else (math.copysign(l1, z[f]) - z[f]) / ((toxicity.BETA + math.sqrt(n[f])) / toxicity.ALPHA + toxicity.L2)

    def chance(text):
        return 1 / (1 + math.exp(-sum(weight(f) for f in features(text))))

    order = [r.id for r in spark.range(240).orderBy(F.xxhash64("id")).collect() if zlib.crc32(str(r.id).encode()) % 4 != 2]
    for _ in range(toxicity.PASSES):
        for i in order:
            g = chance(texts[i]) - int(i % 3 == 0 or i % 41 == 0)
            for f, w in [(f, weight(f)) for f in features(texts[i])]:
                z[f] += g - (math.sqrt(n[f] + g * g) - math.sqrt(n[f])) / toxicity.ALPHA * w
                n[f] += g * g
    got = toxicity.score(docs.select("doc_id", "text"), toxicity.fit(docs, labels)).toPandas().sort_values("doc_id")
    assert got.score.tolist() == pytest.approx([chance(t) for t in texts], rel=1e-9)
    assert got.score.max() > 0.5 > got.score.min()


# --- 4 ------------------------------------------------------------------------------------------------------------------


def test_vectors_against_brute_force(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 16))
    near = np.repeat(x[:40], 3, axis=0) + rng.normal(size=(120, 16)) * 0.04
    every = np.concatenate([x, near, x[:10], 2 * x[:5]]).tolist()
    labels = [i % 3 for i in range(len(every))]
    bad = [(1000, None, 1), (1001, [0.0] * 16, 1), (1002, [float("nan")] * 16, 1), (1003, [None] + [1.0] * 15, 1), (1004, every[0], None), (1005, [1.0, 2.0], 1), (None, [5.0] * 16, 2)]
    frame = spark.createDataFrame([*((i, v, k) for i, (v, k) in enumerate(zip(every, labels, strict=True))), *bad], "vec_id long, embedding array<double>, label int")
    got = near_vectors.near_vectors(frame, block=16).toPandas()
    assert len(got) == len(every) + len(bad)
    u = np.array(every) / np.linalg.norm(every, axis=1, keepdims=True)
    link = (u @ u.T >= 0.98) & (np.array(labels)[:, None] == np.array(labels)[None, :])
    np.fill_diagonal(link, False)
    mine = got[got.vec_id < 1000].sort_values("vec_id")
    assert mine.n_links.sum() >= 0.9 * link.sum() and (mine.n_links.values <= link.sum(axis=1)).all()
    low = np.arange(len(every))
    for _ in range(20):
        low = np.minimum(low, np.where(link, low[None, :], 10**9).min(axis=1))
    assert (mine.component_id.values == low).mean() > 0.97
    assert got[got.vec_id >= 1000].n_links.sum() == 0 and (got[got.vec_id >= 1000].kept).all()
    assert near_vectors.near_vectors(frame.limit(0)).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(50, 90)] + [(1, 100), (100, 7), (7, 3), (5, 5)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {**{i: 50 for i in range(50, 91)}, **{i: 1 for i in (1, 3, 7, 100)}}


# --- 5 ------------------------------------------------------------------------------------------------------------------


def test_targets():
    assert mixing.share_out([100, 100, 100], [5, 2, 1]) == pytest.approx([187.5, 75, 37.5])
    assert mixing.share_out([10, 1000, 100], [5, 2, 1]) == pytest.approx([30, 780, 300])  # the first stops, then the third
    assert mixing.share_out([0, 0], [5, 2]) == [0, 0]
    for sizes in ([1, 5, 900, 3], [7, 7, 7, 7000]):
        out = mixing.share_out(sizes, [5, 2, 1, 5])
        assert sum(out) == pytest.approx(sum(sizes)) and all(t <= 3 * s + 1e-9 for t, s in zip(out, sizes, strict=True))


def test_mix_meets_targets(spark, odd, none):
    docs = docs_of(spark, [base_text(i, 20 + i % 50) for i in range(900)])
    got = mixing.mix(docs).toPandas()
    assert len(got) == 900 and (got.taken <= 3 * got["size"]).all()
    for _, g in got.groupby("source", dropna=False):
        assert g.taken.sum() == pytest.approx(g.target.iloc[0], rel=0.02)
    again = mixing.mix(docs.repartition(7)).toPandas()
    assert got.sort_values("doc_id").taken.tolist() == again.sort_values("doc_id").taken.tolist()
    assert mixing.mix(odd).count() == 11 and mixing.mix(none).count() == 0


def test_mix_is_the_schedule_slot_by_slot(spark):
    rng = np.random.default_rng(4)
    texts = [base_text(i, int(rng.integers(0, 60))) for i in range(400)]
    docs = docs_of(spark, texts)
    source = {r.doc_id: r.source for r in docs.collect()}
    names = sorted(set(source.values()), key=lambda s: (s is None, s or ""))
    size = [len(words(t)) for t in texts]
    sums = [sum(size[i] for i in source if source[i] == s) for s in names]
    targets = mixing.share_out(sums, [(5, 2, 1)[k % 3] for k in range(len(names))])
    blocks = [max(1, min(mixing.MAX_BLOCK, int(t // mixing.SLOTS_EACH))) for t in targets]
    laid = [[i for i in sorted(source, key=lambda i: hashlib.md5(str(i).encode()).hexdigest()) if source[i] == s for _ in range(size[i])] for s in names]
    want = [t / b for t, b in zip(targets, blocks, strict=True)]
    taken, first, used = Counter(), {}, Counter()
    for slot in range(round(sum(want))):
        point, k = math.modf((slot + 1) * mixing.GOLDEN)[0], 0
        while k < len(want) - 1 and point >= sum(want[: k + 1]) / sum(want):
            k += 1
        held = -(-sums[k] // blocks[k])
        rank, used[k] = used[k], used[k] + 1
        if rank < 3 * held:
            at = rank % held * blocks[k]
            for i in laid[k][at : at + blocks[k]]:
                taken[i] += 1
                first.setdefault(i, slot)
    got = mixing.mix(docs).toPandas().set_index("doc_id")
    assert {i: (int(r.taken), None if pd.isna(r.first_slot) else int(r.first_slot)) for i, r in got.iterrows()} == {i: (taken[i], first.get(i)) for i in source}


# --- 6 ------------------------------------------------------------------------------------------------------------------


def brute_components(texts, size, percent):
    sets = [{tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if (w := words((t or "").lower())) else set() for t in texts]
    low = list(range(len(texts)))
    for _ in range(len(texts)):
        for a, b in combinations(range(len(texts)), 2):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                low[a] = low[b] = min(low[a], low[b])
    return low, [len(s) for s in sets]


def test_near_documents_against_brute_force(spark, odd, none):
    rng = np.random.default_rng(9)
    texts = []
    for g in range(12):
        own = base_text(g, 120).split()
        for k in range(6):
            w = list(own)
            for _ in range(k):
                w[rng.integers(len(w))] = f"z{rng.integers(1000)}"
            texts.append(" ".join(w))
    texts += ["a b", "A  b", "a", None, "", texts[0]]
    got = near_documents.near_duplicates(docs_of(spark, texts)).toPandas().sort_values("doc_id")
    low, sizes = brute_components(texts, 4, 80)
    assert got.n_shingles.tolist() == sizes and got.component_id.tolist() == low
    assert near_documents.near_duplicates(odd).count() == 11 and near_documents.near_duplicates(none).count() == 0


def test_one_stray_deals_a_bucket_once(spark):
    """What is dealt to tiles grows with the members of a bucket, not with their square."""
    for members in (4096, 16384):
        rows = spark.range(members).select(F.lit(7).cast("long").alias("bucket"), F.col("id").alias("node"), F.when(F.col("id") == 5, 5).otherwise(0).cast("long").alias("part"))
        sizes = spark.createDataFrame([(7, members)], "bucket long, held long")
        dealt = near_documents.dealt_tiles(rows, sizes)
        assert members <= dealt.count() <= members + members / near_documents.TILE + 1


def test_near_documents_in_tiles(spark, monkeypatch):
    """A large group just around the similarity: buckets beyond PAIR_BUCKET go through tiles of several blocks."""
    rng = np.random.default_rng(5)
    base, texts = base_text(9, 120).split(), []
    for _ in range(60):
        own = list(base)
        for at in rng.integers(0, 120, int(rng.integers(1, 6))):
            own[at] = f"x{rng.integers(10**6)}"
        texts.append(" ".join(own))
    want, _ = brute_components(texts, 4, 80)
    for most, tile in ((4, 8), (1, 512), (64, 512)):
        monkeypatch.setattr(near_documents, "PAIR_BUCKET", most)
        monkeypatch.setattr(near_documents, "TILE", tile)
        got = near_documents.near_duplicates(docs_of(spark, texts)).toPandas().sort_values("doc_id")
        assert got.component_id.tolist() == want
    assert 1 < len(set(want)) < 60


def test_near_documents_with_shared_ids(spark):
    a, b, c = (base_text(s, 120) for s in (1, 2, 3))
    rows = [(None, a), (None, b), (5, c), (5, a + " x"), (6, b + " x"), (7, c + " x"), (8, c + " y")]
    got = near_documents.near_duplicates(docs_of(spark, [t for _, t in rows], [i for i, _ in rows])).toPandas()
    found = {(None if pd.isna(i) else int(i), None if pd.isna(c) else int(c)) for i, c in zip(got.doc_id, got.component_id, strict=True)}
    assert len(got) == 7 and found == {(None, None), (5, 5), (5, None), (6, None), (7, 5), (8, 5)}


# --- 7 ------------------------------------------------------------------------------------------------------------------


def test_quality_rules(spark, odd, none):
    loud, plain = "BUY!! NOW!! $$$ ### ", "the cat sat on a mat and went home. "
    docs = docs_of(spark, [plain * 3 + base_text(i, 60) for i in range(60)] + [loud * 5 + " ".join(w + "!!" for w in base_text(i, 60).split()) for i in range(20)])
    labels = spark.createDataFrame([(i, int(i < 60)) for i in range(80)], "doc_id long, quality int")
    held = docs.select("doc_id", "text")
    got = quality_rules.judge(held, quality_rules.fit(held, quality_rules.trusted_sample(labels))).toPandas().set_index("doc_id")
    assert got.loc[:59].kept.all() and not got.loc[60:].kept.any()
    plainest = quality_rules.judge(odd.select("doc_id", "text"), quality_rules.fit(odd.select("doc_id", "text"), quality_rules.trusted_sample(labels.limit(0)))).toPandas()
    assert len(plainest) == 11 and (plainest.ratio == 0).all() and (plainest.kept == ~plainest.base_failed).all()
    assert quality_rules.judge(none.select("doc_id", "text"), quality_rules.fit(none.select("doc_id", "text"), quality_rules.trusted_sample(labels))).count() == 0


def test_ratio_is_that_of_counted_ngrams(spark):
    """Counts by n-gram in place of buckets, and the decisions that follow."""
    rng = np.random.default_rng(9)
    pools = [[f"g{k}" for k in range(8)], [f"g{k}" for k in range(4, 8)] + ["zap", "!"]]
    texts = [" ".join(rng.choice(pools[i % 3 == 2], 40 + i % 90)) for i in range(150)] * 8
    docs = docs_of(spark, texts).select("doc_id", "text")
    trusted = [i for i in range(len(texts)) if i % 3 != 2]

    def ngrams(text):
        w = re.findall(r"\w+|[^\w\s]", text)
        return w + list(zip(w, w[1:], strict=False))

    raw, good = Counter(g for t in texts for g in ngrams(t)), Counter(g for i in trusted for g in ngrams(texts[i]))
    share = lambda c, g: math.log((c[g] + quality_rules.PRIOR) / (c.total() + quality_rules.PRIOR * quality_rules.BUCKETS))
    ratio = {t: sum(share(good, g) - share(raw, g) for g in ngrams(t)) / len(ngrams(t)) for t in set(texts)}
    got = quality_rules.judge(docs, quality_rules.fit(docs, spark.createDataFrame([(i,) for i in trusted], "doc_id long"))).toPandas().sort_values("doc_id")
    assert got.ratio.tolist() == pytest.approx([ratio[t] for t in texts], abs=1e-9)
    assert got.kept.tolist() == [not f and ratio[t] >= quality_rules.LEAST_RATIO for f, t in zip(got.base_failed, texts, strict=True)]
    assert got.kept.any() and (~got.kept & ~got.base_failed).any()


@pytest.mark.parametrize("text", ["a b c a b c", "x x x x x", "a b", "", None, "l one\nl one\n\n \nl two #$", base_text(4, 300) + " " + base_text(4, 30)])
def test_base_rules(spark, text):
    r = quality_rules.base_rules(docs_of(spark, [text]).select("doc_id", "text")).first()
    w = words(text)
    windows = Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {i + j for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for j in range(3)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    assert (r.n_words, r.word_chars, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(lines) - len(set(lines)), len(covered))
    assert r.n_symbols == len(re.findall(r"[#*$%&|<>]", text or ""))


# --- 8 ------------------------------------------------------------------------------------------------------------------


def brute_removed(texts, window):
    held = [words(t) for t in texts]
    count = Counter(tuple(w[i : i + window]) for w in held for i in range(len(w) - window + 1))
    return [{i + j for i in range(len(w) - window + 1) if count[tuple(w[i : i + window])] > 1 for j in range(window)} for w in held], held


def test_substrings_against_brute_force(spark, odd, none):
    shared = [base_text(100 + i, 50) for i in range(3)]
    rng = np.random.default_rng(1)
    texts = [base_text(i, 40) + " " + shared[i % 3] + " " + base_text(50 + i, 40) for i in range(12)]
    texts += [" ".join(shared), shared[0][: len(shared[0]) // 2], " ".join(["ha"] * 90), base_text(7, 35), base_text(7, 35), base_text(8, 34), base_text(8, 34), None, ""]
    texts += [" ".join(np.array(shared[1].split())[5:45]) + " " + base_text(int(rng.integers(1000)), 5)]
    gone, held = brute_removed(texts, 35)
    got = substrings.remove(docs_of(spark, texts).withColumn("kept", F.lit(0))).toPandas().sort_values("doc_id")
    assert got.n_removed.tolist() == [len(g) for g in gone]
    assert got.kept.tolist() == [" ".join(x for i, x in enumerate(w) if i not in g) for w, g in zip(held, gone, strict=True)]
    odd_got = substrings.remove(odd.withColumns({"k1": F.lit("a"), "k2": F.lit(2), "spans": F.lit(3), "row": F.lit(4), "text x": F.lit(5)})).toPandas()
    gone, held = brute_removed(odd_got.text.tolist(), 35)
    assert odd_got.n_removed.tolist() == [len(g) for g in gone] and set(odd_got.k1) == {"a"} and set(odd_got.row) == {4} and len(odd_got) == 11
    assert substrings.remove(none).count() == 0


def test_factors_decide_spans(spark, monkeypatch):
    """Passages in ever new surroundings: found by matching block against block, and by windows where an anchor has many blocks; not without them."""
    shared = [base_text(700 + i, 36 + 5 * i) for i in range(4)]
    texts = [f"{base_text(i, 50)} {shared[i % 4]} {base_text(80 + i, 50)} {shared[(i + 1) % 4]} {shared[(i + 2) % 4]}" for i in range(24)]
    gone, _ = brute_removed(texts, 35)
    removed = lambda: substrings.remove(docs_of(spark, texts)).toPandas().sort_values("doc_id").n_removed.tolist()
    assert removed() == [len(g) for g in gone]
    monkeypatch.setattr(substrings, "PAIR_BLOCKS", 3)
    assert removed() == [len(g) for g in gone]
    nothing = lambda blocks, *a: spark.createDataFrame([], "anchor long, block long, at int, n int, reference long")
    monkeypatch.setattr(substrings, "block_factors", nothing)
    monkeypatch.setattr(substrings, "window_factors", nothing)
    assert sum(removed()) < sum(len(g) for g in gone)


def test_parse():
    doc, start, stop = substrings.parse(np.array([0, 0, 3, 60, 1, 40]), np.array([9, 2, 20, 1, 4, 1]), np.array([0, 0, 0, 0, 2, 2]), 35)
    assert list(zip(doc.tolist(), start.tolist(), stop.tolist(), strict=True)) == [(0, 0, 57), (0, 60, 95), (2, 1, 39), (2, 40, 75)]
    assert all(len(x) == 0 for x in substrings.parse(*(np.zeros(0, np.int64),) * 3, 35))


# --- 9 ------------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("kind", ["byte", "bit"])
def test_planes_round_trip(kind):
    for ids in (np.zeros(0, np.uint32), np.arange(40_000, dtype=np.uint32), np.array([0, 2**32 - 1, 7], np.uint32)):
        payload, ends, widths = token_planes.pack(ids, kind)
        assert token_planes.unpack(payload, ends, widths, len(ids), kind).tolist() == ids.tolist()


def test_ids_are_the_tokenizers(spark, odd, none):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(WORDS)
    docs = odd.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    written = token_planes.write_ids(docs, lambda: token_planes.word_encoder(WORDS), end_id=1)
    got = {r["doc_id"]: r for r in token_planes.read_ids(written, token_planes.digest, token_planes.DOC_SCHEMA).collect()}
    start = 0
    for r in docs.orderBy("doc_id").collect():
        ids = [*plain.encode(r["text"] or "", add_special_tokens=False).ids, 1]
        assert (got[r["doc_id"]]["start"], got[r["doc_id"]]["n_tokens"]) == (start, len(ids))
        assert got[r["doc_id"]]["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    empty = token_planes.write_ids(none, lambda: token_planes.word_encoder(WORDS), end_id=1)
    assert token_planes.read_ids(empty, token_planes.digest, token_planes.DOC_SCHEMA).count() == 0
    assert token_planes.read_ids(token_planes.write_ids(odd, lambda: token_planes.word_encoder(WORDS)), token_planes.digest, token_planes.DOC_SCHEMA).count() == 11


@pytest.mark.parametrize("text", ["<|endoftext|> A<|startoftext|>b", "don't I'LL it's ÀÉ İ ſ ﬁ é ́x", "½ ¼1 23 ªº ß ΣΑΣ 你好 한글 😀 ​'S", "x" * 300, "a\u0085b c d \x1c"])
def test_words_are_cut_as_the_library_cuts(text):
    from tokenizers import Tokenizer

    got = token_planes.word_encoder(WORDS)([text])[0]
    assert np.frombuffer(got, "<u4").tolist() == Tokenizer.from_file(WORDS).encode(text, add_special_tokens=False).ids


# --- 10 -----------------------------------------------------------------------------------------------------------------


def test_shards(spark, odd, none):
    docs = docs_of(spark, [base_text(i, 5 + (i * 37) % 90) for i in range(700)] + ["same text here"] * 400)
    got = sharding.shard(docs).toPandas()
    load = got.groupby("shard")["size"].sum()
    assert len(load) == 16 and load.max() / load.min() < 1.05
    for _, g in got.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    own = got[got["size"] < 1000].groupby("text_crc32").shard.nunique()
    assert (own > 1).sum() <= 1  # the large group alone is cut
    assert sharding.shard(odd).count() == 11 and sharding.shard(none).count() == 0


def test_a_group_is_cut_only_where_it_fits_no_shard(spark):
    others = [base_text(i, 5 + (i * 37) % 90) for i in range(700)]
    for copies, cut in ((60, False), (4000, True)):
        got = sharding.shard(docs_of(spark, others + ["same text here now"] * copies)).toPandas()
        share = got["size"].sum() / 16
        group = got[got["size"] == 19]
        assert len(group) == copies and (copies * 19 > share) == cut
        assert (group.shard.nunique() > 1) == cut


def test_cut_groups_are_cut_by_rows(spark):
    """Five large copies, each as large as most of a share, come into shards of their own, rows come near their mean, and none is lost."""
    texts = ["y" * 2000] * 5 + [f"{k:04d}"[: 2 + k % 16] * (1 + k % 4) for k in range(3000)] + [None] * 300
    got = sharding.shard(docs_of(spark, texts)).toPandas()
    assert sorted(got.doc_id) == list(range(len(texts)))
    load = got.groupby("shard")["size"].sum()
    assert got[got["size"] == 2001].groupby("shard").size().max() == 1 and load.max() / load.mean() < 1.02


def test_rows_balance_beside_bytes(spark, sf_dir):
    from heddle.llm.common import read

    got = sharding.shard(read(spark, sf_dir.replace("0.001", "0.01"), "documents")).toPandas()
    sums = got.groupby("shard").agg({"size": "sum", "tokens": "sum", "slot": "size"})
    assert (sums["size"] / sums["size"].mean()).between(0.99, 1.01).all()
    assert (sums["tokens"] / sums["tokens"].mean()).between(0.98, 1.02).all() and (sums["slot"] / sums["slot"].mean()).between(0.92, 1.08).all()


def test_one_row_repeated_is_one_run(spark, monkeypatch):
    """A null id whose text makes up most of the table: cut inside its run, numbered without gaps, unrolled in blocks."""
    monkeypatch.setattr(sharding, "RUN", 50)
    texts = [base_text(i, 10) for i in range(200)] + ["again and again"] * 3000
    got = sharding.shard(docs_of(spark, texts, [*range(200), *[None] * 3000])).toPandas()
    assert len(got) == 3200 and got.doc_id.isna().sum() == 3000
    for _, g in got.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    load = got.groupby("shard")["size"].sum()
    assert len(load) == 16 and load.max() / load.min() < 1.05


def test_placing_follows_the_greedy_rule():
    rng = np.random.default_rng(7)
    items, shards = rng.integers(1, 200, (300, 3)).astype(float), 7
    total, load, want = items.sum(axis=0), [[0.0] * 3 for _ in range(shards)], {}
    for i in sorted(range(len(items)), key=lambda i: (-max(items[i] / total), i)):
        v = items[i] / total
        left = [[1 / shards - x for x in row] for row in load]
        room = [s for s in range(shards) if all(left[s][d] >= v[d] for d in range(3))] or [s for s in range(shards) if left[s][0] >= v[0]]
        drawn = lambda s: sum(left[s][d] * v[d] for d in range(3)) / max(math.sqrt(sum(x * x for x in left[s])), 1e-300)  # noqa: B023, E731
        want[i] = max(room, key=drawn) if room else max(range(shards), key=lambda s: left[s][0])
        load[want[i]] = [a + b for a, b in zip(load[want[i]], v, strict=True)]
    got, _ = sharding.place(items, shards)
    assert got.tolist() == [want[i] for i in range(len(items))]


# --- the pipeline -------------------------------------------------------------------------------------------------------


def test_pipeline(spark, sf_dir):
    import corpus_pipeline as cp
    from heddle.llm.common import materialize, read

    docs = read(spark, sf_dir, "documents")
    clash = docs.withColumns({"score": F.lit("x"), "kept": F.lit(True), "_row": F.lit(1), "k1": F.lit(2)})
    steps = [clash]
    for _, stage in cp.STAGES:
        steps.append(materialize(stage(spark, steps[-1], sf_dir)))
        if len(steps) <= len(cp.STAGES):
            assert steps[-1].columns == clash.columns
    plain, copies, cut, mixed, coded = (s.toPandas() for s in steps[1:])
    low, _ = brute_components(plain.text.tolist(), 5, 80)
    assert len(copies) == len(set(low))
    gone, held = brute_removed(copies.text.tolist(), 35)
    want = Counter(t if not g else " ".join(x for i, x in enumerate(w) if i not in g) for t, w, g in zip(copies.text, held, gone, strict=True) if not w or len(g) < len(w))
    assert Counter(cut.text) == want
    want = mixing.mix(materialize(spark.createDataFrame(cut[["doc_id", "text", "source"]]))).toPandas()
    taken = Counter()
    for r in want.itertuples():
        taken[r.doc_id] += r.taken
    got = Counter()
    for r in mixed.itertuples():
        got[r.doc_id] += len(words(r.text))
    assert got == Counter({k: v for k, v in taken.items() if v})
    assert abs(sum(got.values()) / sum(len(words(t)) for t in cut.text) - 1) < 0.02
    assert coded.lossless.all() and len(coded) == len(mixed)
    assert len(cp.run(spark, sf_dir).toPandas()) == len(coded)


def test_pipeline_on_odd_rows(spark, odd, none, sf_dir):
    import corpus_pipeline as cp
    from heddle.llm.common import materialize

    for start in (odd, none):
        steps = [start]
        for _, stage in cp.STAGES:
            steps.append(materialize(stage(spark, steps[-1], sf_dir)))
        if start is none:
            assert all(s.count() == 0 for s in steps)
            continue
        texts = lambda s: Counter(r.text for r in s.collect())
        a = base_text(1)
        assert texts(steps[1]) == texts(odd)  # none is toxic
        low = texts(steps[2])
        assert low == texts(odd) - Counter({a: 2, a + " x": 1})  # the copies of a, and a + " x", go but for one
        assert texts(steps[3]) == low  # nothing that repeats is left
        assert set(texts(steps[4])) >= {base_text(2, 30_000)} and all(r.lossless for r in steps[5].collect())


def test_pipeline_leaves_other_results(spark, odd, sf_dir):
    """Tables of results made before a run, or within another owner, outlive it; its own go."""
    import corpus_pipeline as cp
    from heddle.llm import common

    before = near_documents.near_duplicates(odd.select("doc_id", "text"))
    held = common.materialize(odd)
    known = set(common._tables)
    cp.run(spark, sf_dir).count()
    assert before.count() == 11 and held.count() == 11 and known <= set(common._tables)
    with common.Owner() as own:
        with common.Owner() as inner:
            kept = common.materialize(odd)
            common.materialize(odd)
            inner.release(keep=kept)
        assert kept.count() == 11 and len(own.paths) == 1
        own.release()
    assert not own.paths and held.count() == 11


def test_mix_of_repeated_rows(spark, sf_dir):
    """Rows of equal id and text: together they give all that the mix takes of them, no word less."""
    import corpus_pipeline as cp

    docs = docs_of(spark, [base_text(k % 5, 7 + k % 5) for k in range(60)], [k % 5 if k % 2 else None for k in range(60)])
    taken = mixing.mix(docs).toPandas().taken.sum()
    assert sum(len(words(r.text)) for r in cp.mix_sources(spark, docs, sf_dir).collect()) == taken


def test_pipeline_keeps_texts_that_share_an_id(spark, sf_dir):
    import corpus_pipeline as cp

    a, b, c = base_text(1, 200), base_text(2, 200), base_text(3, 200)
    rows = [(None, a), (None, b), (None, b + " x"), (7, c), (7, a + " y"), (7, base_text(4, 200)), (8, c), (8, c), (9, ""), (9, ""), (None, None)]
    got = cp.keep_one_of_near_copies(spark, docs_of(spark, [t for _, t in rows], [i for i, _ in rows]), sf_dir).toPandas()
    kept = Counter((None if pd.isna(i) else int(i), t or "") for i, t in zip(got.doc_id, got.text, strict=True))
    low = kept.pop((None, b), 0) + kept.pop((None, b + " x"), 0)
    assert low == 1 and kept == Counter({(None, a): 1, (7, c): 1, (7, base_text(4, 200)): 1, (9, ""): 2, (None, ""): 1})
