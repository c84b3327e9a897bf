"""Selections, quantiles and intervals cut small, as tables of any size are cut: against plain sorting and brute force."""

import random
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from clipsift.operators import calibration, cascade, exporting, intervals, order, screening, selection, vectors
from clipsift.session import shared_folder


@pytest.fixture(scope="module")
def numbers(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice([0.5, 0.5, 0.25, rng.random(), None])) for i in range(4000)]
    return [r for r in rows if r[1] is not None], spark.createDataFrame(rows, "row long, score double").repartition(5).cache()


@pytest.mark.parametrize("k", [1, 7, 60, 500, 1600, 3000, 3199, 5000])
def test_kth_and_top_equal_sorting(numbers, k):
    rows, df = numbers
    best = sorted(rows, key=lambda r: (-r[1], r[0]))
    assert order.kth(df, "score", k, few=50, accuracy=100) == best[min(k, len(best)) - 1][1]
    got = order.top(df, k, few=50, accuracy=100)
    assert sorted((r["row"], r["score"]) for r in got.collect()) == sorted(best[:k])


def test_top_has_no_sort_of_all_rows(numbers):
    plan = order.top(numbers[1], 500, few=50, accuracy=100)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrdered" not in plan and "Exchange SinglePartition" not in plan


def test_order_of_few_equal_and_no_values(spark):
    same = spark.createDataFrame([(i, 1.0) for i in range(300)], "row long, score double")
    assert order.kth(same, "score", 100, few=10) == 1.0
    assert sorted(r["row"] for r in order.top(same, 100, few=10).collect()) == list(range(100))
    none = same.where("row < 0")
    assert order.kth(none, "score", 5) is None and order.kth(none, "score", 500, few=10) is None
    assert order.top(none, 50, few=10).count() == 0 and order.quantiles(none, "score", [0.5]) == [None]
    longs = spark.createDataFrame([(i, 2**60 + i % 7) for i in range(500)], "row long, score long")
    assert order.kth(longs, "score", 100, few=10) == sorted((2**60 + i % 7 for i in range(500)), reverse=True)[99]


def test_quantiles_equal_numpy(numbers):
    rows, df = numbers
    shares = [0.0, 0.1, 0.25, 0.5, 0.9, 0.999, 1.0]
    for few in (100, 10**6):
        assert np.allclose(order.quantiles(df, "score", shares, few=few, accuracy=200), np.quantile([s for _, s in rows], shares), atol=1e-12)


def test_groups_are_dealt_as_ntile(spark, numbers):
    from pyspark.sql import Window

    df = numbers[1].where("row < 500")
    for groups in (1, 3, 7, 600):
        want = {r["row"]: r["g"] for r in df.withColumn("g", F.ntile(groups).over(Window.orderBy(F.col("score").desc_nulls_last(), "row"))).collect()}
        got = {r["row"]: r["_g"] for r in exporting.in_groups(df, groups, "score", rows_per_range=60).collect()}
        assert got == want


def test_sweep_in_ranges_equals_one_range(spark):
    rng = random.Random(3)
    df = spark.createDataFrame([(round(rng.random(), 2), rng.choice([0, 1, None])) for _ in range(600)] + [(None, 1)], "score double, label int")
    key = lambda r: (r["tau"] is not None, r["tau"] or 0)
    one, many = sorted(calibration.sweep(df).collect(), key=key), sorted(calibration.sweep(df, rows_per_range=50).collect(), key=key)
    assert [(r["tau"], r["tp"], r["fp"]) for r in one] == [(r["tau"], r["tp"], r["fp"]) for r in many]
    assert np.allclose([r["gain"] for r in one], [r["gain"] for r in many])


def test_confidence_has_no_window(numbers):
    plan = exporting.confidence(numbers[1], None)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan


# --- cascade


@pytest.fixture(scope="module")
def corpus(spark):
    rng = np.random.default_rng(5)
    vecs = rng.normal(size=(600, 16))
    vecs /= np.linalg.norm(vecs, axis=1, keepdims=True)
    vecs[100:140] = vecs[100]
    rows = [(i, f"run-{i % 3}", None if i % 50 == 7 else v.tolist()) for i, v in enumerate(vecs)]
    df = spark.createDataFrame(rows, "row long, run_uuid string, vec array<double>").repartition(4).cache()
    scale = vectors.scales(df)
    return df, selection.Screen(vectors.directions([vecs[100].tolist(), vecs[3].tolist()]), scale), cascade.write(df, scale, f"{shared_folder(spark, 'tests')}/{uuid.uuid4().hex}")


def found(df):
    return [(r["row"], r["run_uuid"], r["class"], None if r["score"] is None else round(r["score"], 8), None if r["exact"] is None else round(r["exact"], 8)) for r in df.collect()]


@pytest.mark.parametrize("options", [{}, {"most_sent": 0}, {"few": 10}])
@pytest.mark.parametrize("what", [{"k": 1}, {"k": 20}, {"k": 45}, {"k": 599}, {"k": 5000}, {"k": 30, "refine": False}, {"tau": 0.3}, {"tau": 0.3, "refine": False}, {"tau": 9.0}])
def test_written_selection_equals_that_of_vectors(corpus, what, options):
    df, screen, written = corpus
    want = selection.select(df, screen, **what)
    assert found(cascade.select(written, screen, **what, **options)) == found(want)


def test_vectors_are_read_below_the_join_only(corpus):
    _, screen, written = corpus
    plan = cascade.select(written, screen, k=5)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("vec#") > 0 and "Join Inner" in plan
    scans = [line for line in cascade.scores(written.codes, screen)._jdf.queryExecution().executedPlan().toString().split("\n") if "ReadSchema" in line]
    assert scans and all("vec" not in line and "run_uuid" not in line for line in scans)


def test_batches_give_back_what_can_matter(spark, corpus):
    df, screen, written = corpus
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        some = cascade.scores(written.codes, screen, best=5)
        assert 5 <= some.count() < 600
        assert cascade.kth_score(written.codes, screen, 5) == selection.kth_score(screen.apply(df), 5)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_an_empty_corpus(spark, corpus):
    df, screen, _ = corpus
    none = cascade.write(df.where("row < 0"), screen.scale, f"{shared_folder(spark, 'tests')}/{uuid.uuid4().hex}")
    assert cascade.select(none, screen, k=5).collect() == [] == cascade.select(none, screen, tau=0.1).collect()
    with pytest.raises(ValueError, match="exactly one"):
        cascade.select(none, screen)


def test_codes_without_a_copy_or_with_nulls():
    import pyarrow as pa

    column = pa.array([b"\x01\xff", None, b"\x00\x7f"], pa.binary())
    assert screening.codes(column, 2).tolist() == [[1, -1], [0, 0], [0, 127]]
    assert screening.codes(column.slice(2), 2).tolist() == [[0, 127]] and screening.codes(column[:0], 2).shape == (0, 2)


# --- intervals


def brute_intervals(rows, tau):
    """rows: (run, row, start, score)."""
    out = []
    for run in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == run), key=lambda r: (r[2], -r[3], r[1]))
        starts = sorted({r[2] for r in own})
        stride = min((b - a for a, b in zip(starts, starts[1:])), default=4)
        grid = {}
        for _, row, start, s in own:
            grid[round((start - starts[0]) / stride)] = (s, row)
        cell, peak = {}, {}
        for m in {p + d for p in grid for d in (0, 1)}:
            sides = [(*grid[p][:1], left, grid[p][1]) for p, left in ((m - 1, 1), (m, 0)) if p in grid]
            cell[m], peak[m] = sum(s for s, _, _ in sides) / len(sides), max(sides)[2]
        centre = lambda m, b=starts[0], w=stride: b + (m + 0.5) * w
        hits = sorted(m for m in cell if cell[m] >= tau)
        while hits:
            n = 1
            while n < len(hits) and hits[n] == hits[0] + n:
                n += 1
            isle, hits = hits[:n], hits[n:]
            edge = lambda m, o, cell=cell: (cell[m] - tau) / (cell[m] - cell[o]) if o in cell else 0.5
            best = max(isle, key=lambda m, cell=cell: (cell[m], -m))
            out.append((run, round(centre(isle[0]) - stride * edge(isle[0], isle[0] - 1), 6), round(centre(isle[-1]) + stride * edge(isle[-1], isle[-1] + 1), 6), round(cell[best], 6), round(sum(cell[m] for m in isle) / n, 6), n, peak[best]))
    return sorted(out, key=str)


@pytest.mark.parametrize(("span", "block"), [(1 << 17, 1 << 14), (10, 4), (3, 1), (1000, 2), (40, 7)])
def test_intervals_in_ranges_and_blocks_equal_brute_force(spark, span, block):
    rng = random.Random(6)
    rows = []
    for run in ("a", "b", None):
        t = 0
        for _ in range(150):
            t += rng.choice([4, 4, 4, 8, 60])
            rows.append((run, len(rows), t, round(rng.random() + (0.6 if 100 < t < 500 else 0), 3)))
            if rng.random() < 0.1:
                rows.append((run, len(rows), t, round(rng.random(), 3)))
    rows.append(("one", len(rows), 77, 0.9))
    df = spark.createDataFrame(rows, "run_uuid string, row long, chunk_start_unix long, score double").repartition(3)
    got = [(r["run_uuid"], *[round(r[c], 6) for c in ("start_s", "end_s", "peak", "mean")], r["num_cells"], r["peak_row"]) for r in intervals.intervals(df, 0.5, span=span, block=block).collect()]
    assert sorted(got, key=str) == brute_intervals(rows, 0.5)


def test_a_long_drive_is_many_tasks(spark):
    """One run of 200,000 clips, all over the threshold: one interval, of blocks that are summed up apart."""
    df = spark.range(200_000).select(F.lit("r").alias("run_uuid"), F.col("id").alias("row"), (F.col("id") * 4).alias("chunk_start_unix"), F.lit(0.9).alias("score"))
    parts = intervals.summaries(intervals.cells(df), 0.5, 1 << 10)
    assert parts.count() == parts.select("_block").distinct().count() == 196
    (one,) = intervals.intervals(df, 0.5, block=1 << 10).collect()
    assert (one["start_s"], one["end_s"], one["num_cells"]) == (0.0, 800_004.0, 200_001)
