"""Randomised axes against numpy, and the map by neighbourhood."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from clipsift.operators import atlas, layout, pca
from clipsift.plans import queries
from clipsift.sources.clips import clips

DATA = "/root/testdata/sf0.001"


def falling(spark, n=400, d=120, parts=5):
    """Rows whose variance falls by direction, in a turned basis."""
    rng = np.random.default_rng(3)
    turn = np.linalg.qr(rng.normal(size=(d, d)))[0]
    m = rng.normal(size=(n, d)) * 0.85 ** np.arange(d) @ turn + 0.3
    return m, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "row long, vec array<double>").repartition(parts)


@pytest.mark.parametrize("centred", [True, False])
@pytest.mark.parametrize("unit", [True, False])
def test_sketched_axes_against_numpy(spark, centred, unit):
    m, df = falling(spark)
    m = m / np.linalg.norm(m, axis=1, keepdims=True) if unit else m
    x = m - m.mean(0) if centred else m
    _, sv, axes = np.linalg.svd(x, full_matrices=False)
    b = pca.fit_sketched(df, 10, centred=centred, unit=unit)
    assert b.rows == len(m) and b.axes.shape == (10, 120)
    assert np.allclose(b.ratio, sv[:10] ** 2 / (sv**2).sum(), atol=1e-4)
    assert np.allclose(np.abs((b.axes * axes[:10]).sum(1)), 1, atol=1e-4)
    got = {r.row: r.projected for r in pca.project(df, b, unit=unit).collect()}
    assert np.allclose(np.abs([got[i] for i in range(len(m))]), np.abs(x @ axes[:10].T), atol=1e-3)


def test_sketched_axes_of_nothing_nulls_and_few_dimensions(spark):
    df = spark.createDataFrame([(1, None), (2, [1.0, 0.0]), (3, [-1.0, 0.0])], "row long, vec array<float>")
    b = pca.fit_sketched(df, 2)
    assert (b.rows, b.effective_rank(), b.axes.shape) == (2, 1, (2, 2))
    assert pca.fit_sketched(df.where("row = 1"), 2).rows == 0
    same = df.select("row", F.array(F.lit(1.0), F.lit(2.0)).alias("vec"))
    assert pca.fit_sketched(same, 1).ratio.tolist() == [0.0]


def test_sketched_query_equals_exact_axes(spark):
    exact = pca.fit(clips(spark, DATA), 16, unit=True)
    got = [r.ratio for r in sorted(queries.pca_sketched_variance(spark, DATA).collect())]
    assert np.allclose(got, exact.ratio, atol=1e-4)


# --- the map


def clusters(spark, n=900, d=24, groups=12, parts=6):
    """Unit-like vectors in groups, every seventh a null."""
    rng = np.random.default_rng(5)
    centre = rng.normal(size=(groups, d))
    group = rng.integers(groups, size=n)
    m = centre[group] + rng.normal(size=(n, d)) * 0.35
    rows = [(i, v.tolist() if i % 7 else None) for i, v in enumerate(m)]
    return group, m, spark.createDataFrame(rows, "row long, vec array<double>").repartition(parts)


def similarities(m):
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -np.inf)
    return s


def trust(m, places, k=15):
    """1 less the share of neighbours on the map that are far by cosine, by how far they are."""
    n = len(m)
    rank = np.argsort(np.argsort(-similarities(m), axis=1), axis=1)
    gap = ((places[:, None] - places[None]) ** 2).sum(2)
    np.fill_diagonal(gap, np.inf)
    near = np.argsort(gap, axis=1)[:, :k]
    over = np.maximum(np.take_along_axis(rank, near, 1) + 1 - k, 0)
    return 1 - 2 * over.sum() / (n * k * (2 * n - 3 * k - 1))


def test_neighbours_are_the_exact_ones(spark):
    _, m, df = clusters(spark)
    kept = [i for i in range(len(m)) if i % 7]
    rows, units = layout.sample_matrix(df)
    assert rows.tolist() == kept
    got = {r.row: r for r in layout.nearest(df, rows, units, 25, batch=100).collect()}
    s = similarities(m[kept])
    want = np.argsort(-s, axis=1)[:, :25]
    assert sorted(got) == kept
    recall = np.mean([len(set(got[i].at) & set(w)) / 25 for i, w in zip(kept, want.tolist(), strict=True)])
    assert recall > 0.999
    assert np.allclose([got[i].similarity for i in kept], -np.sort(-s, axis=1)[:, :25], atol=1e-5)


def test_sample_is_bounded(spark):
    _, _, df = clusters(spark)
    with pytest.raises(ValueError, match="over 1000"):
        layout.sample_matrix(df, most_bytes=1000)


@pytest.mark.parametrize("share", [1.0, 0.5])
def test_map_is_more_faithful_than_two_axes(spark, share):
    group, m, df = clusters(spark)
    kept = [i for i in range(len(m)) if i % 7]
    sample = atlas.seeded_sample(df, int(len(kept) * share), 1)
    assert sample.count() == int(len(kept) * share)
    at = {r.row: r.position for r in layout.laid_out(df, sample, 15).collect()}
    assert sorted(at) == kept
    axes = {r.row: r.position for r in atlas.reduced(df).collect()}
    placed, plain = np.array([at[i] for i in kept]), np.array([axes[i] for i in kept])
    assert np.isfinite(placed).all()
    ours, stand_in = trust(m[kept], placed), trust(m[kept], plain)
    print(ours, stand_in)
    assert ours > 0.9 and ours > stand_in + 0.05
    gap = ((placed[:, None] - placed[None]) ** 2).sum(2)
    np.fill_diagonal(gap, np.inf)
    assert (group[kept][gap.argmin(1)] == group[kept]).mean() > 0.95


def test_maps_of_little(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.0, 1.0]), (4, [0.0, 0.0]), (5, [0.0, 1.0]), (5, [0.0, 1.0])], "row long, vec array<double>")
    for n, want in ((0, []), (1, [1, 3, 4, 5, 5]), (2, [1, 3, 4, 5, 5]), (6, [1, 3, 4, 5, 5])):
        got = sorted(layout.laid_out(df, df.orderBy("row").where("vec is not null").limit(n)).collect())
        assert [r.row for r in got] == want
        assert all(np.isfinite(r.position).all() and len(r.position) == 2 for r in got)


def test_curve_and_weights():
    a, b = layout.curve(0.1)
    assert abs(a - 1.577) < 0.02 and abs(b - 0.895) < 0.01  # the published values for 0.1
    w = layout.memberships(np.sort(np.random.default_rng(0).random((50, 15)), axis=1))
    assert np.allclose(w[:, 0], 1) and np.allclose(w.sum(1), np.log2(15), atol=1e-3)
    i, j, v = layout.edges(np.array([[1], [0], [0]]), np.array([[0.5], [0.5], [0.25]]))
    assert list(zip(i.tolist(), j.tolist(), v.tolist(), strict=True)) == [(0, 1, 0.75), (0, 2, 0.25)]
