"""Several writers of one log, compaction, and streams against the same on tables."""

import threading

import pytest
from pyspark.sql import functions as F

from clipsift.operators import commits, ledger
from clipsift.streaming import ingest

SCHEMA = "k string, n long"


def rows_of(spark, *rows):
    return spark.createDataFrame(list(rows), SCHEMA).coalesce(1)


def test_versions_are_whole_and_one_writer_wins(spark, tmp_path):
    a, b = (commits.Commits(spark, f"{tmp_path}/log", SCHEMA) for _ in range(2))
    assert a.version() == 0 and a.rows().count() == 0
    assert a.put(1, rows_of(spark, ("a", 1)))
    assert not b.put(1, rows_of(spark, ("b", 1)))
    assert [tuple(r) for r in b.rows().collect()] == [("a", 1)]
    assert b.put(2, rows_of(spark, ("b", 2)), seen=7) and a.state(2)["seen"] == 7
    assert a.rows(1).count() == 1 and a.rows().count() == 2
    assert len(list((tmp_path / "log" / "data").iterdir())) == 2, "the loser's rows are gone"


def test_a_change_is_decided_anew_after_a_conflict(spark, tmp_path):
    a, b = (commits.Commits(spark, f"{tmp_path}/log", SCHEMA) for _ in range(2))
    tries = []

    def make(rows, state):
        tries.append(rows.count())
        if len(tries) == 1:
            b.put(b.version() + 1, rows_of(spark, ("other", 0)))
        return rows_of(spark, ("mine", rows.count()))

    assert a.change(make) and tries == [0, 1]
    assert sorted(tuple(r) for r in a.rows().collect()) == [("mine", 1), ("other", 0)]
    assert not a.change(lambda rows, state: None) and a.version() == 2
    with pytest.raises(commits.Conflict):
        a.change(lambda rows, state: b.put(b.version() + 1, None) and rows_of(spark, ("x", 1)), tries=2)


def test_compaction_keeps_rows_and_cleaning_the_rest(spark, tmp_path):
    log = commits.Commits(spark, f"{tmp_path}/log", SCHEMA)
    for i in range(6):
        log.put(i + 1, rows_of(spark, ("k", i)))
    assert log.compact()
    assert len(log.state(7)["folders"]) == 1 and sorted(r["n"] for r in log.rows().collect()) == list(range(6))
    assert log.clean(versions=1) == 6 and log.rows().count() == 6
    assert not commits.Commits.put(log, 7, rows_of(spark, ("late", 0)))


def test_of_many_claims_at_once_one_wins(spark, tmp_path):
    """Five writers with sessions of their own claim the same exports at the same time."""
    won = []

    def work(i):
        jobs = ledger.Exports(spark.newSession(), f"{tmp_path}/exports")
        for key in ("a", "b"):
            if jobs.claim(key, 100 + i):
                won.append(key)

    threads = [threading.Thread(target=work, args=(i,)) for i in range(5)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(won) == ["a", "b"]
    rows = ledger.Exports(spark, f"{tmp_path}/exports").rows().collect()
    assert sorted(r["export_id"] for r in rows) == ["a", "b"] and sorted(r["seq"] for r in rows) == [1, 2]


def test_changes_of_a_tag_by_two_writers_are_all_kept(spark, tmp_path):
    made = []

    def work(i):
        tags = ledger.Tags(spark.newSession(), f"{tmp_path}/tags")
        made.append(tags.new_version("t", f"p{i}", i / 10, "w", i))

    ledger.Tags(spark, f"{tmp_path}/tags").create("t", "p", 0.5, "w", 0)
    threads = [threading.Thread(target=work, args=(i,)) for i in range(3)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(made) == [2, 3, 4]
    last = ledger.Tags(spark, f"{tmp_path}/tags").resolve("t", 4)
    assert set(last["thresholds"]) == {"p", "p0", "p1", "p2"}


def test_a_log_of_many_folders_is_rewritten(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(commits, "MOST_FOLDERS", 4)
    jobs = ledger.Exports(spark, f"{tmp_path}/exports")
    for i in range(5):
        assert jobs.claim(f"e{i}", 0)
    assert len(jobs.log.state(jobs.log.version())["folders"]) < 4 and jobs.rows().count() == 5


def test_pins_of_all_versions_are_one_change(spark, tmp_path):
    tags = ledger.Tags(spark, f"{tmp_path}/tags")
    tags.create("t", "p", 0.5, "w", 0)
    tags.new_version("t", "p", 0.6, "w", 1)
    at = tags.log.version()
    tags.pin("t", 1)
    assert tags.log.version() == at + 1 and tags.resolve("t")["version"] == 1
    seqs = [r["seq"] for r in tags.rows().collect()]
    assert len(seqs) == len(set(seqs))


KIND = "chunk_id string, row long, event_time timestamp"


def clips(spark, *rows):
    return spark.createDataFrame([(c, r, t) for c, r, t in rows], "chunk_id string, row long, t long").select("chunk_id", "row", F.timestamp_seconds("t").alias("event_time"))


def test_upserts_replay_and_compact(spark, tmp_path):
    for i in range(5):
        clips(spark, ("a", i, 10**9 + i), (f"b{i}", i, 10**9 + i)).write.mode("append").parquet(f"{tmp_path}/in")
        ingest.upsert(ingest.read_clips(spark, f"{tmp_path}/in", KIND), f"{tmp_path}/log", f"{tmp_path}/state", compact_every=2).awaitTermination()
    got = {r["chunk_id"]: r["row"] for r in ingest.current(spark, f"{tmp_path}/log", KIND).collect()}
    assert got == {"a": 4, **{f"b{i}": i for i in range(5)}}
    log = ingest.log_of(spark, f"{tmp_path}/log", KIND)
    folders = len(log.state(log.version())["folders"])
    assert folders < 5
    fresh = lambda _, state: log.rows() if state["batch"] < 3 else None  # noqa: E731  a batch that is replayed
    assert not log.change(fresh)


def test_streamed_runs_equal_those_of_a_table(spark, tmp_path):
    rows = [("r", 4 * i, 0.9 if i % 7 else 0.1) for i in range(60)] + [("q", 1000, 0.8), ("q", 1004, 0.8), ("q", 1010, 0.8)]
    df = spark.createDataFrame(rows, "run_uuid string, t long, score double").select("run_uuid", F.timestamp_seconds("t").alias("event_time"), "score")
    want = sorted(tuple(r) for r in ingest.hit_runs(df, 0.5).collect())
    assert len(want) == 9 + 2
    for part in (df.where("pmod(hash(event_time), 3) = 0"), df.where("pmod(hash(event_time), 3) = 1"), df.where("pmod(hash(event_time), 3) = 2")):
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    for t in (None, 10**8, 2 * 10**8):
        if t:
            spark.createDataFrame([("later", t, 1.0)], "run_uuid string, t long, score double").select("run_uuid", F.timestamp_seconds("t").alias("event_time"), "score").write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in").withWatermark("event_time", "10 days")
        ingest.write_runs(ingest.hit_runs(stream, 0.5), f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out").where("run_uuid != 'later'").collect()
    assert sorted(tuple(r) for r in got) == want


def test_activity_counts_sliding_windows(spark):
    df = spark.createDataFrame([("r", t) for t in (0, 3, 4, 9)], "run_uuid string, t long").select("run_uuid", F.timestamp_seconds("t").alias("event_time"))
    got = {r["window"]["start"].second: r["n"] for r in ingest.activity(df).collect() if r["window"]["start"].minute == 0}
    assert got[0] == 3 and got[4] == 2
