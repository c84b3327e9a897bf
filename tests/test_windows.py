"""Many windows at once against comparing each with each."""

import random

import pytest

from clipsift.operators import selection, windows


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(1)
    clips = []
    for i in range(400):
        start = rng.randrange(1000, 9000)
        clips.append((rng.choice(["a", "b", None]), i, None if i % 97 == 5 else start, rng.choice([None, start + 8, start + 3000, start, start - 5])))
    wins = [(i, rng.choice(["a", "b", "gone", None]), rng.choice([0, None, rng.randrange(500, 9500)]), rng.choice([0, None, rng.randrange(500, 9500)])) for i in range(150)]
    wins += [(3, *wins[3][1:]), (900, "a", 5000, 5000), (901, "a", 10**12, 0), (902, "a", 0, 10)]
    c = spark.createDataFrame(clips, "run_uuid string, row long, chunk_start_unix long, chunk_end_unix long")
    return clips, wins, c, spark.createDataFrame(wins, "window_id long, run_uuid string, start long, end long")


@pytest.mark.parametrize("width", [1, 7, 600, 10**6])
def test_overlaps_equal_comparing_all(tables, width):
    clips, wins, c, w = tables
    want = []
    for i, run, start, end in wins:
        for r, row, s, e in clips:
            if run is None or r != run or s is None:
                continue
            e = s + 8 if e is None else e
            if (not end or s < end) and (not start or e > start) and (not start or not end or start < end):
                want.append((i, row))
    got = windows.overlaps(c, w, width=width) if width > 1 else windows.overlaps(c, w.where("start > 0 and end > 0"), width=width)
    if width == 1:
        shut = {i for i, _, s, e in wins if s and e}
        want = [p for p in want if p[0] in shut]
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


def test_one_window_is_window_rows(tables):
    _, _, c, w = tables
    one = w.where("window_id = 902 or window_id = 900").limit(1)
    r = one.first()
    alone = selection.window_rows(c.where("chunk_start_unix is not null"), run=r["run_uuid"], start=r["start"], end=r["end"])
    if r["start"] < r["end"] or not r["start"]:
        assert sorted(x["row"] for x in windows.overlaps(c, one).collect()) == sorted(x["row"] for x in alone.collect())


def test_no_nested_loop(tables):
    _, _, c, w = tables
    plan = windows.overlaps(c, w)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_empty_tables(tables):
    _, _, c, w = tables
    assert windows.overlaps(c.limit(0), w).count() == 0 == windows.overlaps(c, w.limit(0)).count()
