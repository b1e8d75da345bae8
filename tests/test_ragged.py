"""Caches whose heads have different lengths, late heads and gaps: the rows that the SQL gives."""

from decimal import Decimal

import duckdb
import pytest
from pyspark.sql import functions as F

from heddle.plans import ORACLES, QUERIES

#: Each query is wrong or an error on the first set of rows if heads are taken to be alike.
NAMED = ("block_topk", "cam_merge", "adakv", "critical_adakv", "streaming_llm", "press_adakv_snapkv", "press_expected_attention", "press_streaming_llm")
SETS = {"tail": "vec_id < 465", "gaps": "vec_id < 462 AND vec_id NOT IN (2, 3, 101, 204, 205, 206, 207)"}


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    out = {}
    for name, rows in SETS.items():
        out[name] = str(tmp_path_factory.mktemp(name))
        spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").where(rows).coalesce(1).write.parquet(f"{out[name]}/embeddings.parquet")
    return out


def rows(columns, found):
    clean = lambda v: (0.0 if v == 0 else float(v)) if isinstance(v, (float, Decimal)) else str(v)
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(tuple(clean(r[k]) for k in order) for r in found)


@pytest.mark.parametrize("name", NAMED)
@pytest.mark.parametrize("kind", SETS)
def test_heads_of_different_lengths(name, kind, spark, folders):
    got, duck = QUERIES[name](spark, folders[kind]), duckdb.connect()
    duck.execute(f"create view embeddings as select * from '{folders[kind]}/embeddings.parquet/*.parquet'")
    want = duck.execute(ORACLES[name])
    assert rows(got.columns, got.collect()) == rows([c[0] for c in want.description], want.fetchall())


@pytest.mark.parametrize(("name", "share"), [("block_keydiff", 2), ("stream_cam", 0)])
def test_ragged_caches_without_sql(name, share, spark, folders):
    heads = {tuple(r)[:3]: r["n"] for r in QUERIES[name](spark, folders["tail"]).groupBy("layer", "batch", "head").agg(F.count_distinct("pos").alias("n")).collect()}
    assert set(heads) == {(layer, 0, head) for layer in (0, 1) for head in (0, 1)}
    if share:
        assert heads == dict.fromkeys(heads, 58)  # half of 117 positions, and of 116
