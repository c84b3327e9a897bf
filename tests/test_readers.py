"""Matrices in ranges of rows and pages of ids, read by Spark tasks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from clipsift.sinks.files import write_matrices
from clipsift.sources import files, remote
from clipsift.sources.readers import MatrixSource, register_pages, splits


def stored(folder, sizes, width=16, kind=np.float32):
    rng = np.random.default_rng(0)
    parts = [(rng.normal(size=(n, width)) * 50).astype(kind) for n in sizes]
    for i, m in enumerate(parts):
        np.save(folder / f"m{i}.npy", m)
    return np.concatenate(parts)


@pytest.mark.parametrize("kind", [np.float16, np.float32, np.float64, np.int8, ">f4"])
def test_matrices_by_ranges(spark, tmp_path, kind):
    m = stored(tmp_path, [700, 0, 1, 1300], kind=kind)
    most = 100 * m[:1].nbytes
    assert len(splits(str(tmp_path), most)) == 7 + 1 + 13
    spark.dataSource.register(MatrixSource)
    df = spark.read.format("npy").option("splitBytes", most).load(str(tmp_path))
    assert df.rdd.getNumPartitions() == 21
    got = sorted((r.row, r.vec) for r in df.collect())
    assert [r for r, _ in got] == list(range(2001))
    assert np.array_equal([v for _, v in got], m.astype(np.float32))


def test_ten_matrices_in_more_than_ten_tasks_beside_metadata(spark, tmp_path):
    m = stored(tmp_path, [5000] * 10, width=4)
    meta = spark.range(len(m)).select(F.col("id").alias("row"), (F.col("id") % 7).alias("k"))
    df = files.read_matrices(spark, f"file://{tmp_path}", meta, split=16 * 1000)
    assert len(splits(str(tmp_path), 16 * 1000)) == 50
    total = df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("vec")[2].cast("double") * F.col("k")).alias("t")).first()
    assert total.n == len(m) and np.isclose(total.t, (m[:, 2].astype(float) * (np.arange(len(m)) % 7)).sum())


def test_matrices_that_are_none(spark, tmp_path):
    spark.dataSource.register(MatrixSource)
    assert spark.read.format("npy").load(str(tmp_path)).count() == 0
    np.save(tmp_path / "a.npy", np.asfortranarray(np.ones((3, 2))))
    with pytest.raises(ValueError, match="in order of rows"):
        splits(str(tmp_path))
    np.save(tmp_path / "a.npy", np.ones(3))
    with pytest.raises(ValueError):
        splits(str(tmp_path))
    np.save(tmp_path / "a.npy", np.ones((30, 2), np.float32))
    whole = (tmp_path / "a.npy").read_bytes()
    (tmp_path / "a.npy").write_bytes(whole[:-8])
    with pytest.raises(Exception, match="ends before"):
        spark.read.format("npy").load(str(tmp_path)).collect()


def test_written_matrices_keep_the_order(spark, tmp_path):
    m = np.random.default_rng(1).normal(size=(500, 3)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "row long, vec array<float>").repartition(7)
    done = write_matrices(df, f"{tmp_path}/m", parts=3, batch=70).collect()
    assert sum(r.rows for r in done) == 500 and max(r.rows for r in done) == 70
    back = files.read_matrices(spark, f"{tmp_path}/m", spark.range(500).withColumnRenamed("id", "row"), split=120)
    assert np.array_equal([r.vec for r in back.orderBy("row").collect()], m)
    assert write_matrices(df.limit(0), f"{tmp_path}/none").count() == 0
    with pytest.raises(Exception, match="null vectors"):
        write_matrices(df.select("row", F.lit(None).cast("array<float>").alias("vec")), f"{tmp_path}/nulls")


def service(n, broken=None):
    """A set of n ids, some of them empty, by offsets as cursors; the page at `broken` cannot be fetched."""

    def fetch(uuid, cursor, size):
        at = int(cursor or 0)
        if broken is not None and at >= broken:
            raise OSError("the service is gone")
        ids = ["" if i % 10 == 3 else f"{uuid}-{i // 2}" for i in range(at, min(at + size, n))]
        return ids, str(at + size) if at + size < n else None

    def cursors(uuid, size):
        return [str(at) for at in range(4 * size, n, 4 * size)]

    return fetch, cursors


@pytest.mark.parametrize("known", [True, False])
def test_pages_by_cursors(spark, tmp_path, known):
    fetch, cursors = service(95)
    register_pages(spark, fetch, cursors if known else None, name="some_pages")
    df = spark.read.format("some_pages").option("set", "s").option("pageSize", 5).load()
    assert df.rdd.getNumPartitions() == (5 if known else 1)
    want = sorted(f"s-{i // 2}" for i in range(95) if i % 10 != 3)
    assert sorted(r.segment_id for r in df.collect()) == want
    ids = remote.remote_set(spark, fetch, "s", f"{tmp_path}/set", 5, cursors if known else None)
    assert sorted(r.segment_id for r in ids.collect()) == sorted(set(want))


def test_a_fetch_that_fails_midway_publishes_nothing(spark, tmp_path):
    fetch, cursors = service(95, broken=60)
    with pytest.raises(Exception, match="service is gone"):
        remote.remote_set(spark, fetch, "s", f"{tmp_path}/set", 5, cursors)
    assert not any(tmp_path.iterdir())
    good, _ = service(20)
    remote.remote_set(spark, good, "s", f"{tmp_path}/set", 5)
    with pytest.raises(Exception, match="service is gone"):
        remote.remote_set(spark, fetch, "s", f"{tmp_path}/set", 5)
    assert spark.read.parquet(f"{tmp_path}/set").count() == 18
