"""Exports built in one call, and their odd cases."""

import math

import pytest

from clipsift.operators import building, cascade, exporting, selection

SCHEMA = "row long, run_uuid string, chunk_start_unix long, chunk_end_unix long, segment_id string, vehicle string, created_at_unix_s double, vec array<double>"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Ten clips whose product with the first axis is row / 10; of the rest one has no vector, one no number in it."""
    rows = [(i, "r", 4 * i, None if i == 3 else 4 * i + 8, [None, "", "a", "b", "b"][i % 5], "v", float(i), [i / 10, 1 - i / 10]) for i in range(10)]
    rows += [(10, "r", 40, None, "c", "v", 10.0, None), (11, "r", 44, None, "c", "v", 11.0, [math.nan, 0.0])]
    df = spark.createDataFrame(rows, SCHEMA)
    return cascade.write(df, [1.0, 1.0], f"{tmp_path_factory.mktemp('corpus')}/c")


SCREEN = selection.Screen([[1.0, 0.0]], [1.0, 1.0])


def build(corpus, tmp_path, **asked):
    more = {k: asked.pop(k) for k in ("output", "source", "most_sent") if k in asked}
    made = building.build(corpus, SCREEN, building.Request("t", 1, "p", "9", "m/", **asked), str(tmp_path), **more)
    return made, corpus.codes.sparkSession.read.parquet(made.path).orderBy("rank").collect() if made.output == "parquet" else None


@pytest.mark.parametrize("sent", [0, 100])
def test_best_and_over_a_threshold(corpus, tmp_path, sent):
    made, rows = build(corpus, tmp_path, k=3, most_sent=sent)
    assert [r["corpus_row"] for r in rows] == [9, 8, 7] and (made.num_rows, made.cutoff, made.rows_above) == (3, 0.7, None)
    made, rows = build(corpus, tmp_path, tau=0.65, since=8.0, most_sent=sent)
    assert [(r["rank"], r["corpus_row"], r["score"]) for r in rows] == [(1, 9, 0.9), (2, 8, 0.8)]
    assert rows[0]["corpus_version"] == "9" and rows[0]["project"] == "p" and rows[0]["tag_version"] == 1


def test_all_rows_mark_those_above_and_keep_unscorable_ones_last(corpus, tmp_path):
    made, rows = build(corpus, tmp_path, tau=0.55, below=True, confidence=True)
    assert made.num_rows == 12 and made.rows_above == 4 and made.rows_unscorable == 1
    assert [r["corpus_row"] for r in rows][:4] == [9, 8, 7, 6] and rows[-1]["corpus_row"] == 11
    assert rows[-1]["score"] is None and rows[-1]["confidence"] is None and not rows[-1]["above_threshold"]
    assert rows[0]["confidence"] == 1.0 and rows[4]["confidence"] == 0.0 and not rows[4]["above_threshold"]
    made, rows = build(corpus, tmp_path, below=True)
    assert made.cutoff is None and made.rows_above == 0 and len(rows) == 12
    assert build(corpus, tmp_path, below=True, k=99)[0].cutoff is None
    assert build(corpus, tmp_path, below=True, most=2)[0].num_rows == 2


def test_segments_sources_and_sets(corpus, tmp_path, spark):
    source = spark.createDataFrame([("a", "x", 5), ("z", "y", 6)], "segment_id string, vehicle string, more long")
    made, rows = build(corpus, tmp_path, tau=0.15, by_segment=True, source=source, segment_set=f"{tmp_path}/set", filters={"vehicles": ["v"], "runs": None})
    assert [r["corpus_row"] for r in rows] == [9, 7, 6, 5] and [r["more"] for r in rows] == [None, 5, None, None] and {r["vehicle"] for r in rows} == {"v"}
    assert made.set_segments == 2 and [r["segment_id"] for r in spark.read.parquet(f"{tmp_path}/set/segments").collect()] == ["a", "b"]
    assert building.provenance(spark, f"{tmp_path}/set") == {"source": "export", "tag": "t", "version": 1, "project": "p", "corpus_version": "9", "vehicles": ["v"], "num_segments": 2}
    made, rows = build(corpus, tmp_path, k=2, filters={"exclude": [9, 8, 7, 4, 3, 2]}, segment_set=f"{tmp_path}/none")
    assert [r["corpus_row"] for r in rows] == [6, 5] and made.set_segments is None and "0 ids" in made.set_error
    none = spark.createDataFrame([(1,)], "n long")
    assert exporting.passthrough(none, none) is none


def test_intervals_and_csv(corpus, tmp_path):
    made, rows = build(corpus, tmp_path, tau=0.62, below=True, by_interval=True)
    assert made.num_rows == 1 and rows[0]["run_uuid"] == "r" and rows[0]["tag_version"] == 1 and made.rows_above is None
    made, _ = build(corpus, tmp_path, k=2, output="csv")
    lines = [x for x in open(next((tmp_path / made.path.rsplit("/", 1)[1]).glob("*.csv"))).read().splitlines()]
    assert len(lines) == 3 and lines[0].startswith("rank,score,segment_id") and lines[1].startswith("1,0.9,")


def test_refused(corpus, tmp_path):
    for asked in ({}, {"k": 1, "tau": 0.5}, {"k": 1, "output": "xls"}, {"tau": 5.0}, {"k": 2, "filters": {"vehicles": []}}, {"below": True, "tau": 5.0, "by_interval": True}):
        with pytest.raises(ValueError):
            build(corpus, tmp_path, **asked)
