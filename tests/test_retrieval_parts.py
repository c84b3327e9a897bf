"""Axes against numpy, ledgers by their transitions, files by round trips, and scalar functions by hand."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from clipsift.functions import encode, text
from clipsift.operators import atlas, calibration, encoding, exporting, feedback, ledger, pca, projects, screening, selection, vectors
from clipsift.plans import queries
from clipsift.sinks import files as sinks
from clipsift.session import shared_folder
from clipsift.sources import files, remote
from clipsift.sources.clips import clips

DATA = "/root/testdata/sf0.001"


def corpus(spark):
    rows = sorted(clips(spark, DATA).select("row", "vec").collect())
    return np.array([r.vec for r in rows], np.float64)


@pytest.mark.parametrize("centred", [True, False])
def test_axes_against_numpy(spark, centred):
    m = corpus(spark)
    x = m - m.mean(0) if centred else m
    _, sv, axes = np.linalg.svd(x, full_matrices=False)
    b = pca.fit(clips(spark, DATA).repartition(5), 8, centred=centred)
    assert b.rows == len(m)
    assert np.allclose(b.ratio, sv[:8] ** 2 / (sv**2).sum())
    assert np.allclose(np.abs((b.axes * axes[:8]).sum(1)), 1, atol=1e-6)
    got = {r.row: r.projected for r in pca.project(clips(spark, DATA), b).collect()}
    assert np.allclose([got[i] for i in sorted(got)], x @ b.axes.T)


def test_axes_of_nothing_and_of_nulls(spark):
    df = spark.createDataFrame([(1, None), (2, [1.0, 0.0]), (3, [-1.0, 0.0])], "row long, vec array<float>")
    b = pca.fit(df, 2)
    assert (b.rows, b.effective_rank()) == (2, 1)
    assert {r.row for r in pca.project(df, b).collect()} == {2, 3}
    assert pca.fit(df.where("row = 1"), 2).rows == 0


def test_explained_variance_query(spark):
    rows = queries.pca_explained_variance(spark, DATA).collect()
    assert len(rows) == 16
    assert all(a.ratio >= b.ratio for a, b in zip(rows[:-1], rows[1:], strict=True))
    assert queries.pca_projection(spark, DATA).count() == clips(spark, DATA).count()


def test_real_projection(spark):
    c = clips(spark, DATA)
    scale = vectors.scales(c)
    q = c.limit(20).withColumn("i8", vectors.quantise(F.col("vec"), scale))
    back = q.withColumn("vec", F.zip_with("i8", vectors.literal([s / 127 for s in scale]), lambda a, s: a.cast("double") * s))
    assert pca.real_projection(q, scale) is True
    assert pca.real_projection(back, scale) is False
    assert pca.real_projection(q.where("false"), scale) is None


def test_export_jobs(spark, tmp_path):
    jobs = ledger.Exports(spark, f"{tmp_path}/exports")
    key = ledger.export_id({"b": 1, "a": 2})
    assert key == ledger.export_id({"a": 2, "b": 1}) != ledger.export_id({"a": 2, "b": 2})
    assert jobs.claim(key, 0)
    assert not jobs.claim(key, 10_799)
    assert jobs.claim(key, 10_800)
    jobs.move(key, "ready", 10_900, "where")
    assert not jobs.claim(key, 10**9)
    jobs.move("other", "error", 5, "x" * 5000)
    assert len(jobs.current().where("export_id = 'other'").first()["detail"]) == 2000
    jobs.forget_error("other", 6)
    assert jobs.state("other") is None
    assert jobs.claim("other", 7)
    with pytest.raises(ValueError, match="status"):
        jobs.move(key, "lost", 1)


def test_tags(spark, tmp_path):
    tags = ledger.Tags(spark, f"{tmp_path}/tags")
    tags.create("a", "p", 0.1, "me", 1)
    tags.create("a", "q", 0.2, "me", 2)
    with pytest.raises(ValueError, match="threshold"):
        tags.create("a", "p", 0.3, "me", 3)
    assert tags.new_version("a", "p", 0.5, "you", 4) == 2
    r = tags.resolve("a")
    assert (r.version, r.thresholds, r.stale) == (2, {"p": 0.5, "q": 0.2}, ["q"])
    tags.set_threshold("a", 2, "q", 0.3)
    assert tags.resolve("a").stale == []
    tags.pin("a", 1)
    assert tags.resolve("a").version == 1
    assert tags.resolve("a", 2).version == 2
    with pytest.raises(ValueError, match="pinned"):
        tags.delete("a")
    tags.pin("a", None)
    tags.delete("a")
    assert tags.resolve("a") is None
    tags.create("a", "p", 0.7, "me", 9)
    assert [(r.version, r.thresholds) for r in tags.versions().collect()] == [(1, {"p": 0.7})]


def test_sets(spark):
    df = spark.createDataFrame([("b",), ("a",), ("",), (None,), ("b",)], "segment_id string")
    assert [r.segment_id for r in ledger.register_set(df).collect()] == ["a", "b"]
    with pytest.raises(ValueError, match="0 ids"):
        ledger.register_set(df.where("segment_id = ''"))
    with pytest.raises(ValueError, match="2 ids"):
        ledger.register_set(df, most=1)
    with pytest.raises(ValueError, match="numbers"):
        ledger.zipped_ids(df, spark.createDataFrame([(1,)], "internal_id long"))
    assert ledger.internal_ids(spark.range(3).withColumnRenamed("id", "row"), spark.createDataFrame([(1, 9), (1, 8)], "row long, internal_id long"), drop=True).collect() == [(1, 8)]


def test_files(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "b", c', None), (2, "plain", 0.5)], "row long, name string, x double")
    sinks.write_csv(df.coalesce(1), f"{tmp_path}/csv")
    written = next((tmp_path / "csv").glob("*.csv")).read_text()
    assert written == 'row,name,x\n1,"a ""b"", c",\n2,plain,0.5\n'
    sinks.write_parquet(df, f"{tmp_path}/t/version=3")
    sinks.write_corpus(df.coalesce(1), f"{tmp_path}/t/version=12", rows=1)
    assert len(list((tmp_path / "t" / "version=12").glob("*.parquet"))) == 2
    assert files.latest_version(spark, f"{tmp_path}/t") == 12
    assert files.latest_version(spark, f"{tmp_path}/none") is None
    assert files.read_tables(spark, f"{tmp_path}/t").count() == 4
    sinks.write_visit(df, f"{tmp_path}/visits")
    assert [r.row for r in files.read_records(spark, f"{tmp_path}/visits", "row", "row long, name string").collect()] == [2, 1]
    (tmp_path / "ids.txt").write_text("s1\n\ns2\n")
    assert files.read_lines(spark, f"{tmp_path}/ids.txt").count() == 2
    assert files.null_rate(df, "x") == 0.5
    assert files.null_rate(df, "y") is None
    assert sinks.stem("a b/c").startswith("a_b_c_")
    with pytest.raises(ValueError, match="absent"):
        files.validate(df, {"row": "bigint", "z": "string"})


def test_matrices(spark, tmp_path):
    m = np.arange(12, dtype=np.float32).reshape(6, 2)
    np.save(tmp_path / "a.npy", m[:4])
    np.save(tmp_path / "b.npy", m[4:])
    meta = spark.range(6).withColumnRenamed("id", "row")
    got = files.read_matrices(spark, str(tmp_path), meta).orderBy("row").collect()
    assert [r.vec for r in got] == m.tolist()
    with pytest.raises(ValueError, match="6 vectors"):
        files.read_matrices(spark, str(tmp_path), spark.range(5))


def test_columns():
    assert files.vector_column(["x", "vec", "embedding"]) == "embedding"
    assert files.model_column(["vector_a", "vector_fp_a"]) == "vector_a"
    with pytest.raises(ValueError, match="2"):
        files.model_column(["vector_a", "vector_b"])


def test_chunk_start(spark):
    df = spark.createDataFrame([("r#t12",), ("r#tx",), (None,)], "chunk_id string")
    assert [r[0] for r in df.select(files.chunk_start(df.columns)).collect()] == [12, 0, 0]


def test_scalars(spark):
    df = spark.createDataFrame([(1_700_000_000,), (1_700_000_000_000_000_000,)], "t long")
    assert {r[0] for r in df.select(text.seconds_of(F.col("t"))).collect()} == {1.7e9}
    r = spark.range(1).select(text.routed(F.lit("ab_x"), [("a", "one"), ("ab", "two")], "none"), text.routed(F.lit("z"), [("a", "one")], "none"), text.bucket_of(F.lit("http://x/y"))).first()
    assert tuple(r) == ("one", "none", "")
    assert text.seconds_until("01:00", 3600) == 86400
    assert text.seconds_until("01:00", 3599) == 1
    with pytest.raises(ValueError, match="time of day"):
        text.seconds_until("24:00", 0)
    assert selection.day_bounds("1970-01-02", "1970-01-02") == (86400, 172800)
    assert selection.merged({"v": {"a", "b"}}, {"v": {"b"}, "r": None}, {"v": {"c"}}) == {"v": set(), "r": None}
    assert 0 <= calibration.guessed_tau(10, 1000) <= 0.42


def test_cut_to(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(5)], "row long, score double")
    assert [r.row for r in selection.cut_to(df, k=2, max_rows=1)[0].collect()] == [4, 3]
    rows, truncated = selection.cut_to(df, max_rows=3)
    assert (rows.count(), truncated) == (3, True)
    assert selection.cut_to(df, max_rows=5)[1] is False


def test_rescore_stops_at_another_name(spark):
    df = spark.createDataFrame([(1, "a")], "row long, name string")
    names = spark.createDataFrame([(1, "b")], "row long, chunk_id string")
    with pytest.raises(Exception, match="another name"):
        selection.rescore(df, names, F.lit(1.0), F.col("name")).collect()


def test_fit_needs_both_classes(spark):
    with pytest.raises(ValueError, match="both classes"):
        calibration.fit_threshold(spark.createDataFrame([(0.5, 1)], "score double, label int"))


def test_refine_without_bad_marks(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "row long, vec array<float>")
    (r,) = feedback.refine(df, spark.createDataFrame([(1, 1), (9, 0)], "row long, label int"))[1].collect()
    assert (r.fitted, r.marked, r.unresolved) == (False, 1, 1)
    with pytest.raises(ValueError, match="good marks"):
        feedback.refine(df, spark.createDataFrame([(1, 0)], "row long, label int"))


def test_encoding(spark):
    df = spark.createDataFrame([(1, "The cat"), (2, "cat the"), (3, None), (4, "dog")], "row long, text string")
    v = {r.row: np.array(r.vec) for r in encoding.encoded(df, encoding.hashed_words(32)).collect()}
    assert np.allclose(v[1], v[2])
    assert np.isclose(v[4] @ v[4], 1)
    assert not v[3].any()
    p = spark.createDataFrame([(1, [1.0, 2.0, 3.0]), (2, None)], "row long, projected array<double>")
    assert [tuple(r) for r in encoding.placed(p).collect()] == [(1, [1.0, 2.0])]
    assert encoding.placed(p, lambda m: m[:, 1:] * 2).first().position == [4.0, 6.0]
    assert encoding.frames(1) == [0] * 8
    assert encoding.frames(8) == list(range(8))


def test_null_fraction_takes_all_rows(spark, monkeypatch):
    df = spark.range(300_000).selectExpr("if(id >= 200000, null, 'a') as segment_id")
    monkeypatch.setattr(queries, "clips", lambda s, d: df)
    assert queries.QUERIES["null_fraction"](spark, "").first()["fraction"] == 0.333333


def test_stored_screen_reads_nulls_as_zeros_and_equals_the_screen(spark):
    rng = np.random.default_rng(5)
    rows = [(i, None if i % 9 == 0 else [float(x) for x in rng.normal(0, 1, 8)]) for i in range(60)]
    c = spark.createDataFrame(rows, "row long, vec array<double>")
    screen = selection.Screen([[1.0] + [0.0] * 7, [0.0, 1.0] + [0.0] * 6], vectors.scales(c))
    stored = screening.same_rows(screening.store(c, screen.scale), 60)
    got = {r.row: r.score for r in screening.screened(stored, screen).collect()}
    want = {r.row: r.score for r in screen.apply(c).collect()}
    assert got.keys() == want.keys()
    assert all(abs(got[i] - want[i]) < 1e-9 for i in got)
    assert got[0] == want[0] == 0.0
    with pytest.raises(ValueError):
        screening.same_rows(stored, 61)


def test_choice_of_refinement(spark):
    c = spark.createDataFrame([(i, [float(i % 7), float(i % 5) / 3]) for i in range(50)], "row long, vec array<double>")
    screen = selection.Screen([[1.0, 0.0]], vectors.scales(c))
    with pytest.raises(ValueError):
        screening.selection(c, screen, k=3, refine="always", usable=False)
    with pytest.raises(ValueError):
        screening.selection(c, screen, k=3, refine="sometimes")
    auto = screening.selection(c, screen, k=3, usable=False)
    assert not auto.refined
    assert auto.candidates == 50
    assert [r.row for r in auto.rows.collect()] == [6, 13, 20]
    kept = screening.selection(c, screen, tau=2.5, max_rows=4)
    assert kept.truncated
    assert [r.row for r in kept.rows.collect()] == [6, 13, 20, 27]
    assert not screening.selection(c, screen, k=3, max_rows=1).truncated


def test_spot_check_finds_moved_rows(spark):
    c = spark.createDataFrame([(i, f"r#t{i}") for i in range(500)], "row long, chunk_id string")
    assert tuple(screening.spot_check(c, c).first()) == (32, 0)
    moved = c.withColumn("row", c["row"] + 1)
    assert tuple(screening.spot_check(c, moved).first()) == (32, 32)
    assert tuple(screening.spot_check(c, c.limit(0)).first()) == (0, 0)


def test_arrays_points_and_json(spark):
    m = np.random.default_rng(6).normal(0, 1, (3, 4)).astype(np.float32)
    assert (encode.text_array(encode.array_text(m)) == m).all()
    d = spark.createDataFrame([(2, 0.5, -0.25, 7), (1, 1.0, 2.0, 9)], "row long, x double, y double, code int")
    blobs = sorted(encode.packed_points(d, "code").collect())
    xy = np.frombuffer(b"".join(r.xy for r in blobs), "<f4")
    assert xy.tolist() == [1.0, 2.0, 0.5, -0.25]
    assert b"".join(r.code for r in blobs) == bytes([9, 7])
    v = spark.createDataFrame([([0.12345, -0.0],)], "v array<double>")
    assert v.select(encode.vector_json(F.col("v"), 2)).first()[0] == "[0.12,0.0]"
    nested = spark.createDataFrame([([[1.0], [2.0]],)], "v array<array<double>>")
    assert nested.select(encode.vector_json(F.col("v"))).first()[0] == "[[1.0],[2.0]]"
    several = spark.createDataFrame([([[0.126, -0.0], None, []],), (None,)], "v array<array<float>>")
    assert [r[0] for r in several.select(encode.vector_json(F.col("v"), 2, several=True)).collect()] == ["[[0.13,0.0],null,[]]", None]


def test_remote_sets_and_versions(spark, tmp_path):
    held = [["a", "", "b"], ["b", "c"], []]

    def fetch(uuid, cursor, size):
        k = int(cursor or 0)
        return held[k], str(k + 1) if k + 1 < len(held) else None

    ids = remote.remote_set(spark, fetch, "u", f"{tmp_path}/set")
    assert sorted(r.segment_id for r in ids.collect()) == ["a", "b", "c"]
    d = spark.createDataFrame([(1, "a"), (2, "z"), (3, None)], "row long, segment_id string")
    assert [r.row for r in remote.set_filter(d, ids).collect()] == [1]
    with pytest.raises(remote.NotReady):
        remote.set_filter(d, None, "loading")
    for bad in (ids.limit(0), None):
        with pytest.raises(ValueError):
            remote.set_filter(d, bad)
    versions = spark.createDataFrame([(1, 5.0)], "version int, committed_at double")
    with pytest.raises(ValueError):
        remote.since_version(d.withColumn("created_at_unix_s", F.lit(6.0)), versions, 2)


def test_projects():
    known = {n: projects.Project(n, n.upper(), f"x/{n}") for n in ("a", "b")}
    r = projects.Registry(known, "a")
    assert r.enabled(" B ,nope,b,a") == ["b", "a"]
    assert r.enabled("") == ["a"]
    assert r.get(None, "b").name == "b"
    assert r.get("A", overrides={"a_corpus": "y", "a_label": " "}).corpus == "y"
    with pytest.raises(KeyError):
        r.get("c")


def test_reduced_points_are_the_two_strongest_axes(spark):
    m = np.random.default_rng(7).normal(0, 1, (40, 5)) * [5, 3, 1, 1, 1]
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "row long, vec array<double>")
    got = np.array([r.position for r in sorted(atlas.reduced(d).collect())])
    u, s, _ = np.linalg.svd(m - m.mean(axis=0))
    assert np.allclose(np.abs(got), np.abs(u[:, :2] * s[:2]))
    halves = atlas.reduced(d, lambda x: x[:, 3:5])
    assert np.allclose([r.position for r in sorted(halves.collect())], m[:, 3:5])


def test_utc_text_ignores_the_session(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
        assert spark.range(1).select(text.utc(F.lit(1704153599))).first()[0] == "2024-01-01T23:59:59Z"
        assert spark.range(1).select(text.utc(F.lit(-1))).first()[0] == "1969-12-31T23:59:59Z"
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_lists_and_tags(spark):
    d = spark.createDataFrame([("a, b;c ,,d",)], "x string")
    assert d.select(text.items_of(F.col("x"))).first()[0] == ["a", "b;c", "d"]
    names = spark.createDataFrame([("ok_1",), ("No",), (" x ",), ("",)], "x string")
    assert [r[0] for r in names.select(text.valid_tag(F.col("x"))).collect()] == [True, False, True, False]


@pytest.mark.parametrize("per_range", [7, 1000])
def test_ranks_by_ranges_equal_one_order(spark, per_range):
    rng = np.random.default_rng(8)
    scores = [None, *rng.integers(0, 30, 200).tolist(), *rng.normal(0, 9, 100).tolist(), *[5] * 100]
    d = spark.createDataFrame([(i, None if x is None else float(x)) for i, x in enumerate(scores)], "row long, score double")
    got = {r.row: r["rank"] for r in exporting.ranked(d, rows_per_range=per_range).collect()}
    order = sorted(range(len(scores)), key=lambda i: (scores[i] is None, -(scores[i] or 0), i))
    assert got == {i: k + 1 for k, i in enumerate(order)}
    assert exporting.ranked(d.limit(0)).count() == 0
    page = exporting.page_of(d, 3, 20).collect()
    assert [(r["rank"], r.row) for r in page] == [(k + 1, order[k]) for k in range(40, 60)]


@pytest.mark.parametrize("per_range", [7, 1_000_000])
def test_sweep_by_ranges(spark, per_range):
    rng = np.random.default_rng(5)
    rows = [(float(x) if x else None, int(y) if y < 2 else None) for x, y in zip(rng.integers(0, 40, 300), rng.integers(0, 3, 300), strict=True)]
    d = spark.createDataFrame(rows, "score double, label int")
    curve = calibration.sweep(d, rows_per_range=per_range)
    pos, neg = (sum(y == k for _, y in rows) for k in (1, 0))
    want, ap, last = {}, 0.0, 0.0
    for tau in [*sorted({x for x, _ in rows if x}, reverse=True), None]:
        tp, fp = (sum(y == k for x, y in rows if tau is None or (x or -1) >= tau) for k in (1, 0))
        want[tau] = (tp, fp, tp / (tp + fp) if tp + fp else 1.0, tp / pos, fp / neg)
        ap, last = ap + (tp / pos - last) * want[tau][2], tp / pos
    got = {r.tau: (r.tp, r.fp, r.precision, r.recall, r.fpr) for r in curve.collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[t], want[t]) for t in want)
    assert abs(calibration.average_precision(curve).first().ap - ap) < 2e-6
    assert calibration.sweep(d.limit(0)).count() == 0 and calibration.average_precision(calibration.sweep(d.limit(0))).first().ap is None
    assert calibration.average_precision(calibration.sweep(d.where("label = 0"))).first().ap == 0.0


def test_a_cluster_needs_a_shared_folder():
    class Fake:
        class conf:  # noqa: N801
            get = staticmethod(lambda name, default=None: default)

        class sparkContext:  # noqa: N801
            master = "spark://host:7077"

    with pytest.raises(ValueError):
        shared_folder(Fake, "streams")


def test_seeded_samples(spark):
    rows = [(i, "a" if i % 3 else None, None if i % 5 == 0 else [1.0]) for i in range(200)]
    d = spark.createDataFrame(rows, "row long, run_uuid string, vec array<float>")
    one = [r.row for r in atlas.seeded_sample(d, 40, seed=1).collect()]
    assert len(one) == 40 and one == sorted(one) and not [i for i in one if i % 5 == 0]
    assert one == [r.row for r in atlas.seeded_sample(d.repartition(7), 40, seed=1).collect()]
    assert one != [r.row for r in atlas.seeded_sample(d, 40, seed=2).collect()]
    capped = [r.run_uuid for r in atlas.seeded_sample(d, 40, seed=1, cap=6).collect()]
    assert capped.count("a") == 6 and capped.count(None) == 6
    assert atlas.seeded_sample(d.limit(0), 40, seed=1, cap=6).count() == 0


def test_exact_scores_keep_their_deadline(spark):
    d = spark.createDataFrame([(1, [1.0, 2.0]), (2, None)], "row long, vec array<float>")
    got = {r.row: r.score for r in vectors.arrow_scores(d, [[1.0, 1.0]], until=time.time() + 600).collect()}
    assert got == {1: 3.0, 2: 0.0}
    with pytest.raises(Exception, match="deadline"):
        vectors.arrow_scores(d, [[1.0, 1.0]], until=time.time() - 1).collect()
