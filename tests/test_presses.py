"""Every composition of the registry can be built by name and run; wrappers refuse what they cannot wrap."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from heddle.operators import presses, surrogate
from heddle.sources.tables import HEAD, KEYS, Tables


@pytest.fixture(scope="module")
def kv(spark, sf_dir):
    """The first 64 positions of each head, in memory."""
    rows = Tables(spark, sf_dir).kv.where("pos < 64").persist()
    assert rows.count() == 256
    return rows


def test_registry_is_whole():
    assert len(presses.REGISTRY) == 52


@pytest.mark.parametrize("name", sorted(presses.REGISTRY))
def test_composition(name, kv):
    settings = {"interval": 40, "target": 24} if name.startswith(("decoding", "cam")) else {"size": 24} if name == "block_keydiff" else {}
    if name == "duo_attention":
        settings = {"scores": kv.sparkSession.createDataFrame([(k // 2, k % 2, s) for k, s in enumerate((0.3, 2.0, 0.1, 0.9))], "layer int, head int, score double")}
    press = presses.build(name, 0.5, **settings)
    assert isinstance(press, presses.Compressor)
    left = press.compress(kv)
    assert set(left.columns) == {*KEYS, "key", "value"}
    held = {tuple(r[c] for c in HEAD): r["n"] for r in left.groupBy(*HEAD).agg(F.count("*").alias("n")).collect()}
    assert 0 < sum(held.values()) <= 256
    if name in ("knorm", "keydiff", "snapkv", "tova", "lagkv", "merging_snapkv", "kvzap_mlp_head", "block_keydiff"):
        assert set(held.values()) == {32}
    if name.startswith(("decoding", "cam")):  # one shrink to 24 after 40 rows, then 24 more
        assert sum(held.values()) == 4 * 48
    if name in ("no_press", "think"):
        assert set(held.values()) == {64}


def test_what_cannot_be_built():
    with pytest.raises(ValueError):
        presses.build("nothing")
    with pytest.raises(ValueError):
        presses.Knorm(1.0)
    with pytest.raises(ValueError):
        presses.build("knorm", 0.5, window=3)
    with pytest.raises(TypeError):
        presses.AdaKV(presses.ThinK())
    with pytest.raises(TypeError):
        presses.Composed([presses.Knorm(), presses.AdaKV(presses.Knorm())])


def test_ridge_is_the_normal_equation(kv):
    scores = kv.select(*KEYS, F.exp(F.get("key", F.lit(0)) * 2 - F.get("value", F.lit(3)) + F.col("layer")).alias("score"))
    model = surrogate.fit(kv, scores, penalty=1e-9)
    for layer in (0, 1):
        want = np.zeros(65)
        want[0], want[35], want[64] = 2.0, -1.0, layer
        assert np.allclose(model.weights[layer], want, atol=1e-5)
