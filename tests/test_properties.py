"""Properties and fixed values that hold whatever the data."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from heddle.functions import text as tx
from heddle.operators import answers as an
from heddle.operators import budgets, etl, merging, scoring, selection
from heddle.sources.tables import HEAD, KEYS, Tables
from heddle.streaming import stateful as st


@pytest.fixture(scope="module")
def kv(spark, sf_dir):
    return Tables(spark, sf_dir).kv


def test_budget_values():
    per_token = budgets.bytes_per_token(32, 8, 128, 2)
    assert per_token == 131072
    assert budgets.token_budget(200, "MB", per_token) == 1525
    assert budgets.token_budget(1, "GB", per_token) == 7629
    assert budgets.ratio_for(10000, 1525) == (1525, 0.8475)
    assert budgets.ratio_for(1000, 1525) == (1000, 0.0)
    for bad in ((0, "MB"), (-1, "GB"), (1, "MiB"), (0.00001, "MB")):
        with pytest.raises(ValueError):
            budgets.token_budget(*bad, per_token)
    assert budgets.decode_target(54, 58, 0.0)[0] == 54


@pytest.mark.parametrize("ratio", [0.0, 0.1, 0.5, 0.9, 0.99])
def test_kept_are_the_highest(kv, ratio):
    scores = scoring.key_norm(kv)
    kept = selection.keep_top(scores, ratio)
    n = kv.where("layer = 0 AND head = 0").count()
    assert {r["n"] for r in kept.groupBy(*HEAD).agg(F.count("*").alias("n")).collect()} <= {int(n * (1 - ratio)) if ratio else n}
    worst = kept.groupBy(*HEAD).agg(F.min("score").alias("lo"))
    lost = scores.join(kept.select(*KEYS), KEYS, "left_anti").groupBy(*HEAD).agg(F.max("score").alias("hi"))
    assert worst.join(lost, HEAD).where("hi > lo + 1e-9").count() == 0


def test_truncation_is_of_doubles():
    assert int(10 * (1 - 0.9)) == 0 and int(50 * (1 - 0.8)) == 9


def test_pyramid_mean():
    for layers in (32, 64):
        for ratio in (0.1, 0.25, 0.5):
            kept = selection.pyramid_layers(layers, ratio, 2048)
            assert abs(np.mean(kept) / 2048 - (1 - ratio)) < 1e-3


def test_masks_and_prunes_are_complements(kv):
    kept = selection.keep_top(scoring.key_norm(kv), 0.5)
    assert selection.prune(kv, kept).count() + selection.mask(kv, kept).count() == kv.count()


def test_merging_keeps_keys_and_rows(kv):
    kept = selection.keep_top(scoring.key_norm(kv), 0.5)
    out = merging.merge_evicted(kv, kept)
    assert out.count() == kept.count()
    assert out.join(kv.select(*KEYS, F.col("key").alias("own")), KEYS).where("key <> own").count() == 0


def test_rerotation_keeps_norms(kv):
    kept = selection.prune(kv, selection.keep_top(scoring.key_norm(kv), 0.5))
    norm = lambda df, c: df.select(*KEYS, F.round(F.aggregate("key", F.lit(0.0), lambda a, x: a + x * x), 6).alias(c))
    assert norm(kept, "a").join(norm(scoring.rerotated(kept), "b"), KEYS).where("abs(a - b) > 1e-5").count() == 0


def test_policies():
    rows = [(i, float((i * 7) % 10)) for i in range(20)]
    assert st.EveryInterval(4, 2)(0, [], rows[:4]) == st.best(rows[:4], 2)
    assert st.EveryInterval(4, 2)(4, rows[:2], rows[4:5]) == (rows[:2] + rows[4:5], [])
    assert len(st.RatioOfSeen(10, 0.75)(0, [], rows)[0]) == 5
    assert st.SinkAndRecent(2, 3)(0, [], rows) == (rows[:2] + rows[-3:], rows[2:-3])
    assert st.DelayedThreshold(2, 5.0)(0, [], [(0, 9.0), (1, 1.0), (2, 0.0), (3, 0.0)]) == ([(2, 0.0), (3, 0.0)], [(1, 1.0)])
    for policy in (st.EveryInterval(4, 2), st.RatioOfSeen(5, 0.5), st.PrefillThenDecode(7, 0.5, 4, 3), st.TopAlways(3), st.SinkAndRecent(2, 3), st.DelayedThreshold(3, 8.0)):
        whole, lost = policy(0, [], rows)
        held, gone = [], []
        for k in range(0, len(rows), 3):  # in micro-batches of three
            held, more = policy(k, held, rows[k : k + 3])
            gone += more
        assert (held, sorted(gone)) == (whole, sorted(lost))


def one(spark, expr, **columns):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in columns.items())).select(expr.alias("x")).first()["x"]


def test_text_values(spark):
    assert one(spark, tx.normalize_answer(F.col("s")), s=" The  Cat, an\tapple! ") == "cat apple"
    assert one(spark, tx.normalize_answer(F.col("s").cast("string")), s=None) == ""
    assert one(spark, tx.last_choice(F.col("s")), s="A then B or\nC?") == "B"
    assert one(spark, tx.boxed(F.col("s"), True), s="x boxed{1} y boxed{2}") == "2"
    assert one(spark, tx.boxed(F.col("s"), False), s="none") is None
    assert one(spark, tx.hex_ids(F.col("s")), s="V_0123456789ab, x0123456789ab 0123456789abc") == ["0123456789ab"]
    assert one(spark, an.f1_of(F.split("p", " "), F.split("g", " ")), p="a b b", g="b b c") == pytest.approx(2 / 3)
    assert one(spark, an.classification(F.col("p"), F.col("g"), F.array(F.lit("man"), F.lit("woman"))), p="a woman", g="woman") == 1.0
    assert one(spark, an.number_share(F.col("p"), F.lit("3")), p="3 or 4") == 0.5
    assert one(spark, an.rouge_l("p", "g"), p="a b c", g="a c") == pytest.approx(0.8)
    assert one(spark, an.listed(F.col("p")), p="Final: ['a', \"it's\"]") == ["a", "it's"]


def test_errors(spark):
    with pytest.raises(ValueError):
        etl.require(spark.range(1), ["answers"])
    with pytest.raises(ValueError):
        etl.layered({"a": {"extends": "b"}, "b": {"extends": "a"}}, "a")
    with pytest.raises(Exception):
        etl.expand_pairs(spark.createDataFrame([(1, ["a"], ["x", "y"])], "id int, questions array<string>, answers array<string>")).collect()


def test_queries_without_sql_read_whole_texts(spark, sf_dir, tmp_path):
    import difflib
    import unicodedata

    from heddle.plans import QUERIES

    lead = " ".join(f"w{i}" for i in range(200))  # over 400 characters
    texts = {3: lead + " Ünique tail", 4: "`skip` " + lead + "\nreturn 1", 6: "short one"}
    rows = [(i, x, "en", "s", len(x)) for i, x in texts.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    first = {i: x[4:16] if i % 3 == 0 else f"no{i}" for i, x in texts.items()}
    got = {name: {r["doc_id"]: r[1] for r in QUERIES[name](spark, str(tmp_path)).collect()} for name in ("norm_answer_nfd", "rouge_l", "code_sim")}
    assert got["norm_answer_nfd"][3].endswith(unicodedata.normalize("NFD", "ünique tail"))
    for i, x in texts.items():
        p, g = x.split(), first[i].split()
        common = [[0] * (len(g) + 1) for _ in range(len(p) + 1)]
        for a, w in enumerate(p, 1):
            for b, v in enumerate(g, 1):
                common[a][b] = common[a - 1][b - 1] + 1 if w == v else max(common[a - 1][b], common[a][b - 1])
        assert got["rouge_l"][i] == pytest.approx(2 * common[-1][-1] / (len(p) + len(g)), abs=1e-6)
        line = next(y for y in x.split("\n") if "`" not in y)
        assert got["code_sim"][i] == pytest.approx(difflib.SequenceMatcher(None, line, first[i], autojunk=False).ratio(), abs=1e-6)
