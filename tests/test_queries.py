"""Every query of the library against its twin, on the smallest tables."""

import glob
import os

import pytest

from spanrank.plans import registry

SF = "/root/testdata/sf0.001"


def shown(v):
    return f"{v:.6g}" if isinstance(v, float) else str(v)


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(SF):
        pytest.skip("no tables")
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return c


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    got = registry.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    rows = sorted(tuple(map(shown, r)) for r in got.select(*columns).collect())
    if name not in registry.ORACLES:
        assert rows
        return
    want = duck.sql(registry.ORACLES[name])
    assert sorted(want.columns) == columns
    other = duck.sql(f"SELECT {', '.join(columns)} FROM ({registry.ORACLES[name]})").fetchall()
    assert rows == sorted(tuple(map(shown, r)) for r in other)


def test_window_agg_in_stream_and_batch(spark):
    from spanrank.streaming.ingest import windowed

    e = spark.read.parquet(f"{SF}/events.parquet")
    assert windowed(e, "ts", "event_type").agg({"n": "sum"}).first()[0] == e.count()
