"""The table function and the Arrow groups against intervals by windows."""

import random

import pytest
from pyspark.sql import functions as F

from clipsift.operators import intervals, islands

WAYS = {"function": islands.intervals_by_function, "arrow": islands.intervals_by_arrow}


def plain(df):
    return sorted(((r.run_uuid, *[round(r[c], 6) for c in ("start_s", "end_s", "peak", "mean")], r.num_cells, r.peak_row) for r in df.collect()), key=str)


def drives(spark):
    rng = random.Random(8)
    rows = []
    for run in ("a", "b", None, ""):
        t = 0
        for _ in range(200):
            t += rng.choice([4, 4, 4, 8, 60])
            score = None if rng.random() < 0.05 else round(rng.random() + (0.6 if 200 < t < 900 else 0), 2)  # many ties
            rows += [(run, len(rows), t, score)] * rng.choice([1, 1, 1, 2])
    rows += [("one", 9000, 77, 0.9), ("none", 9001, None, 0.9), ("low", 9002, 5, 0.1), ("unscored", 9003, 5, None)]
    return spark.createDataFrame(rows, "run_uuid string, row long, chunk_start_unix long, score double").repartition(3)


@pytest.mark.parametrize("way", sorted(WAYS))
@pytest.mark.parametrize("block", [1, 2, 7, 1 << 14])
def test_equal_to_windows(spark, way, block):
    df = drives(spark)
    want = plain(intervals.intervals(df, 0.5))
    assert len(want) > 50
    assert plain(WAYS[way](df, 0.5, block=block)) == want


@pytest.mark.parametrize("way", sorted(WAYS))
def test_nothing(spark, way):
    df = drives(spark)
    assert WAYS[way](df.limit(0), 0.5).count() == 0
    assert WAYS[way](df, 9.0).count() == 0
    more = df.select("*", F.lit(1).alias("home"), F.lit(2).alias("block"))  # clashing names
    assert plain(WAYS[way](more, 0.5)) == plain(intervals.intervals(df, 0.5))


def test_called_in_sql(spark):
    df = drives(spark)
    islands.table_function(spark)
    cells = islands.blocks(intervals.cells(df), 16)
    parts = spark.sql("SELECT * FROM islands(TABLE({c}) PARTITION BY (run_uuid, block) ORDER BY (m), 0.5D)", c=cells)
    assert plain(intervals.merged(parts, 16)) == plain(intervals.intervals(df, 0.5))
