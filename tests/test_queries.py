"""Every query with SQL gives the rows that DuckDB gives."""

import glob

import duckdb
import pytest

from heddle.plans import ORACLES, QUERIES


def rows(frame):
    cols = sorted(frame.columns)
    clean = lambda v: (0.0 if v == 0 else float(v)) if isinstance(v, float) else str(v)
    return cols, sorted((tuple(clean(v) for v in r) for r in frame[cols].itertuples(index=False, name=None)), key=str)


@pytest.fixture(scope="session")
def duck(sf_dir):
    c = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        c.execute(f"create view {p.split('/')[-1][:-8]} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(name, spark, sf_dir, duck):
    assert rows(QUERIES[name](spark, sf_dir).toPandas()) == rows(duck.execute(ORACLES[name]).fetchdf())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(name, spark, sf_dir):
    assert QUERIES[name](spark, sf_dir).count() > 0
