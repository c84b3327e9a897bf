"""Every registered query with an oracle against DuckDB at the smallest scale, and hand-computed cases."""

import os

import duckdb
import pytest

from clipsift.operators import calibration, intervals, selection, vectors
from clipsift.plans import oracles, queries

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return con


def rows(table):
    return sorted(tuple("%.9g" % v if isinstance(v, float) else str(v) for v in r) for r in table)


@pytest.mark.parametrize("name", sorted(oracles.ORACLES))
def test_oracle(spark, duck, name):
    df = queries.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    want = duck.sql(oracles.ORACLES[name])
    assert sorted(want.columns) == columns
    assert rows(df.select(*[df[c] for c in columns]).collect()) == rows(want.select(*[f'"{c}"' for c in columns]).fetchall())


def test_interval_of_a_bump(spark):
    df = spark.createDataFrame([("a", i, 100 + 4 * i, s) for i, s in enumerate([0.1, 0.2, 0.5, 0.6, 0.2, 0.1])], "run_uuid string, row long, chunk_start_unix long, score double")
    (r,) = intervals.intervals(df, 0.45).collect()
    assert (r.start_s, round(r.end_s, 4), r.peak_row) == (112.0, 116.6667, 3)


def test_bounds():
    assert vectors.bound_cauchy([3, 4]) == 5 / 254
    assert vectors.bound_cauchy([1, 2, 2]) == 3 / 254


def test_classes(spark):
    df = spark.createDataFrame([(x,) for x in (9.4, 9.5, 9.9, 10.0, 10.5, 10.6)], "s double")
    got = [r.c for r in df.select("s", selection.classify(df.s, 10, 0.5).alias("c")).orderBy("s").collect()]
    assert got == ["below", "band", "band", "band", "above", "above"]


def test_empty_set_matches_nothing(spark):
    df = spark.createDataFrame([(1, "v1"), (2, None)], "row long, vehicle string")
    assert selection.filtered(df, vehicles=[]).count() == 0
    assert selection.filtered(df, vehicles=["v1"]).count() == 1
    assert selection.filtered(df).count() == 2


def test_precision_floor_not_met(spark):
    df = spark.createDataFrame([(0.40, 1), (0.55, 1), (0.60, 0), (0.62, 0)], "score double, label int")
    assert not calibration.pick_tau(calibration.sweep(df), "precision", floor=1.0).first()["met"]
