"""Marks and the lives of tags, refusals, probes, windows as queries, and what columns tell."""

import math

import pytest
from pyspark.sql import functions as F

from clipsift.operators import cascade, feedback, ledger, selection
from clipsift.sources import clips, files


def marked(marks, tags):
    return sorted((r["tag"], r["version"], r["chunk_id"], r["mark"]) for r in marks.current(tags).collect())


def test_marks_go_with_the_life_of_their_tag(spark, tmp_path):
    tags, marks = ledger.Tags(spark, f"{tmp_path}/tags"), ledger.Marks(spark, f"{tmp_path}/marks")
    tags.create("t", "p", 0.5, "w", 0, "first")
    tags.create("u", "p", 0.5, "w", 0)
    assert marks.add(tags, "t", 1, "p", {"a": "up", "b": "down"}) == 2
    assert marks.add(tags, "t", 1, "p", {"a": "down"}, "me") == 1
    marks.add(tags, "u", 1, "p", {"a": "up"})
    assert marked(marks, tags) == [("t", 1, "a", "down"), ("t", 1, "b", "down"), ("u", 1, "a", "up")]
    for tag, version, given in (("t", 2, {"a": "up"}), ("x", 1, {"a": "up"}), ("t", 1, {"a": "left"})):
        with pytest.raises((KeyError, ValueError)):
            marks.add(tags, tag, version, "p", given)
    tags.delete("t")
    assert marked(marks, tags) == [("u", 1, "a", "up")]
    tags.create("t", "p", 0.7, "w", 5)
    assert marked(marks, tags) == [("u", 1, "a", "up")] and tags.resolve("t")["description"] == ""
    marks.add(tags, "t", 1, "p", {"b": "up"})
    assert marked(marks, tags) == [("t", 1, "b", "up"), ("u", 1, "a", "up")]


def test_fields_of_a_tag_are_those_of_all_versions(spark, tmp_path):
    tags = ledger.Tags(spark, f"{tmp_path}/tags")
    tags.create("t", "p", 0.5, "w", 0, "first")
    tags.new_version("t", "p", 0.6, "w", 1)
    tags.pin("t", 1)
    tags.create("t", "q", 0.1, "w", 2, "second")
    rows = {r["version"]: r for r in tags.versions().collect()}
    assert {v: (r["pinned"], r["description"]) for v, r in rows.items()} == {1: (1, "second"), 2: (1, "second")}
    assert rows[2]["thresholds"] == {"p": 0.6, "q": 0.1} and rows[1]["thresholds"] == {"p": 0.5}, "on the latest version, whatever is pinned"
    tags.update("t", pinned=None, description="third")
    assert tags.resolve("t")["version"] == 2 and tags.resolve("t", 1)["description"] == "third"
    for wrong in ({}, {"pinned": 3}, {"pinned": 0}, {"name": "x"}):
        with pytest.raises(ValueError):
            tags.update("t", **wrong)


def test_several_directions_are_not_refined(spark):
    c = spark.createDataFrame([(i, [math.cos(i), math.sin(i)]) for i in range(6)], "row long, vec array<double>")
    marks = spark.createDataFrame([(0, 1), (3, 0)], "row long, label int")
    with pytest.raises(ValueError, match="2 directions"):
        feedback.refine(c, marks, [[1.0, 0.0], [0.0, 1.0]])
    one, same = (feedback.refine(c, marks, q) for q in ([[1.0, 0.0]], [1.0, 0.0]))
    assert one[1].collect() == same[1].collect()
    best = feedback.sample(one[0], F.concat(F.lit("c"), "row"), 2).collect()
    assert [r["chunk_id"] for r in best] == ["c0", "c1"] and best[0]["score"] >= best[1]["score"]
    assert feedback.sample(one[0].limit(0), F.col("row")).count() == 0
    assert feedback.one_direction(None) is None and feedback.one_direction([]) == []


def test_vectors_that_are_only_codes_decide_nothing(spark, tmp_path):
    scale = [1.0, 0.5]
    real = spark.createDataFrame([(i, [math.cos(i) * 0.9, math.sin(i) * 0.4]) for i in range(1, 30)] + [(40, None), (41, [0.0, 0.0])], "row long, vec array<double>")
    written = cascade.write(real, scale, f"{tmp_path}/real")
    screen = selection.Screen([[1.0, 0.0]], scale)
    back = lambda v: F.transform(F.arrays_zip(v, F.array(*[F.lit(s) for s in scale]).alias("s")), lambda x: F.rint(x["vec"] * 127 / x["s"]) * x["s"] / 127)
    flat = cascade.write(real.withColumn("vec", back(F.col("vec"))), scale, f"{tmp_path}/flat")
    assert cascade.probe(written, screen) is True and cascade.probe(flat, screen) is False
    none = cascade.Written(written.codes.where("row >= 40"), written.vectors)
    assert cascade.probe(none, screen) is None
    odd = cascade.Written(written.codes, written.vectors.withColumn("vec", F.transform("vec", lambda x: x * float("nan"))))
    assert cascade.probe(odd, screen) is None
    for corpus, refine, want in ((written, "auto", True), (written, "never", False), (flat, "auto", False), (written, "always", True)):
        rows, exact = cascade.selection(corpus, screen, k=4, refine=refine)
        assert exact is want and rows.count() == 4 and rows.where("exact is null").count() == (0 if want else 4)
    for corpus, refine in ((flat, "always"), (written, "maybe")):
        with pytest.raises(ValueError):
            cascade.selection(corpus, screen, k=4, refine=refine)


def test_a_window_as_a_query(spark):
    w = spark.createDataFrame([(2, 20, [0.0, 2.0]), (1, 10, [3.0, 0.0]), (3, 5, None), (4, 30, [0.0, -9.0])], "row long, chunk_start_unix long, vec array<double>")
    assert selection.window_directions(w, most=1) == [[1.0, 0.0]], "the first start counts"
    assert selection.window_directions(w, pooling="individual") == [[1.0, 0.0], [0.0, 1.0], [0.0, -1.0]]
    many = spark.range(65).select(F.col("id").alias("row"), F.col("id").alias("chunk_start_unix"), F.array(F.lit(1.0)).alias("vec"))
    assert selection.window_directions(many) == [[1.0]]
    opposite = spark.createDataFrame([(1, 1, [1.0]), (2, 2, [-1.0])], w.schema)
    for df, pooling in ((many, "individual"), (opposite, "mean"), (w.limit(0), "mean"), (w.limit(0), "individual"), (w, "max")):
        with pytest.raises(ValueError):
            selection.window_directions(df, pooling=pooling)


def test_days_at_the_ends_of_a_corpus_are_open():
    held = (1704067200 + 100, 1704067200 + 3 * 86400 + 5)  # 1 to 4 January
    assert selection.day_bounds("2024-01-01", "2024-01-04", held) == (None, None)
    assert selection.day_bounds("2023-12-30", "2024-02-04", held) == (None, None)
    assert selection.day_bounds("2024-01-02", "2024-01-03", held) == (1704153600, 1704326400)
    assert selection.day_bounds(None, None, held) == (None, None) and selection.day_bounds("2024-01-01", None) == (1704067200, None)


def test_downsample_tables(spark):
    df = spark.createDataFrame([(1, "r1", "s1", "b"), (2, "r1", "", "a"), (3, "r2", None, ""), (4, None, "s2", None)], "row long, run_uuid string, segment_id string, vehicle string")
    table = lambda column, *values: spark.createDataFrame([(v,) for v in values], f"{column} string")
    rows = lambda t: sorted(r["row"] for r in selection.downsampled(df, t).collect())
    assert rows(table("segment_id", "s1", "s1", "", None)) == [1] and rows(table("scenario_id", "s2", "zz")) == [4]
    assert rows(table("run_uuid", "r1")) == [1, 2] and rows(table("run_uuid")) == []
    for column in ("dx_internal_id", "name"):
        with pytest.raises(ValueError):
            rows(table(column, "1"))
    assert selection.vehicles(df) == ["a", "b"]
    assert clips.key_column(["run_uuid", "scenario_id"]) == "scenario_id"


def test_columns_tell_ends_and_encoders(spark, tmp_path):
    df = spark.createDataFrame([(1_500_000_000, -1, [1.0]), (0, 2_999_999_999, [2.0])], "start_timestamp_ns long, end_timestamp_ns long, vec array<double>")
    ends = df.select(files.chunk_start(df.columns).alias("a"), files.chunk_end(df.columns).alias("b")).collect()
    assert [tuple(r) for r in ends] == [(1, None), (0, 2)] and files.chunk_end(["vec"]) is None
    assert files.chunk_end(["chunk_end_unix", "end_timestamp_ns"]) is not None
    files.with_model(df, "vec", "Encoder-Base").write.parquet(f"{tmp_path}/c")
    back = spark.read.parquet(f"{tmp_path}/c")
    assert files.validate_model(back, "vec", " encoder_base ") == "Encoder-Base"
    for table, column, model in ((back, "vec", "other"), (df, "vec", "Encoder-Base"), (back, "v", "Encoder-Base")):
        with pytest.raises(ValueError):
            files.validate_model(table, column, model)
