"""A map by neighbourhood: a graph of nearest neighbours, fuzzy weights, and positions at which near ones stay near.

A bounded sample is laid out; its neighbours are found exactly, by tasks that each hold the sample's matrix. Every other row
is placed among its neighbours in the sample, in one pass over the table. Only the sample, its graph and its positions
reach the driver, all bounded by `most` rows; the descent of their edges is the one step that is not distributed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clipsift.operators.pca import matrix

#: Rows of the sample at most, bytes of its matrix at most, and neighbours of a row.
MOST, MOST_BYTES, NEAREST = 20_000, 64 << 20, 25


def sample_matrix(sample: DataFrame, *, vec: str = "vec", row: str = "row", most_bytes: int = MOST_BYTES) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a bounded sample, ascending, and their unit vectors; more than `most_bytes` of them are refused before any
    is fetched."""
    kept = sample.where(F.col(vec).isNotNull()).select(F.col(row).cast("long").alias("row"), F.col(vec).cast("array<double>").alias("vec"))
    size = kept.agg(F.sum(F.size("vec") * 8)).first()[0] or 0
    if size > most_bytes:
        raise ValueError(f"the sample's vectors have {size} bytes, over {most_bytes}")
    table = kept.toArrow().sort_by("row")
    return table["row"].to_numpy(), matrix(table["vec"].combine_chunks(), True)


def nearest(df: DataFrame, rows: np.ndarray, units: np.ndarray, k: int = NEAREST, *, vec: str = "vec", row: str = "row", batch: int = 256) -> DataFrame:
    """(row, at, similarity): for each row with a vector the places in `rows` of its k nearest by cosine, nearest first, itself left
    out. Of equally near ones at the end any may be kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            whole = whole.filter(whole.column(1).is_valid())
            for b in (whole.slice(lo, batch) for lo in range(0, len(whole), batch)):
                own, m = b.column(0).to_numpy(zero_copy_only=False), matrix(b.column(1), True)
                sim = np.nan_to_num(m @ units.T, nan=-1) if len(rows) else np.zeros((len(own), 0))
                here = np.searchsorted(rows, own)
                known = np.flatnonzero((here < len(rows)) & (rows[np.minimum(here, len(rows) - 1)] == own)) if len(rows) else here[:0]
                sim[known, here[known]] = -np.inf
                n = min(k, len(rows))
                best = np.argpartition(-sim, n - 1, axis=1)[:, :n] if n else np.zeros((len(own), 0), np.int64)
                best = np.take_along_axis(best, np.lexsort((best, -np.take_along_axis(sim, best, 1)), axis=1), 1)
                value = np.take_along_axis(sim, best, 1)
                real = np.isfinite(value)  # a row alone in the sample has none
                ends = pa.array(np.r_[0, np.cumsum(real.sum(1))].astype(np.int32))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(ends, pa.array(best[real])), pa.ListArray.from_arrays(ends, pa.array(value[real]))], names=["row", "at", "similarity"])

    return df.select(F.col(row).cast("long").alias("row"), vec).mapInArrow(run, "row long, at array<long>, similarity array<double>")


def memberships(distance: np.ndarray) -> np.ndarray:
    """Fuzzy weights of each row's neighbours, nearest first: 1 for the nearest, falling with a width by which they sum up to log2
    of their number."""
    beyond = np.maximum(distance - distance[:, :1], 0)
    goal = np.log2(max(2, distance.shape[1]))
    lo, hi = np.full(len(distance), 1e-6), np.full(len(distance), 64.0)
    for _ in range(48):
        width = (lo + hi) / 2
        over = np.exp(-beyond / width[:, None]).sum(1) > goal
        lo, hi = np.where(over, lo, width), np.where(over, width, hi)
    return np.exp(-beyond / ((lo + hi) / 2)[:, None])


def edges(at: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, weight), i < j: the fuzzy union v + w - v w of the weights of both directions."""
    n, k = at.shape
    i, j, w = np.repeat(np.arange(n), k), at.ravel(), weight.ravel()
    key = np.minimum(i, j) * n + np.maximum(i, j)
    pair, place = np.unique(key, return_inverse=True)
    neither = np.ones(len(pair))
    np.multiply.at(neither, place, 1 - w)
    return pair // n, pair % n, 1 - neither


def curve(least: float) -> tuple[float, float]:
    """a, b of 1 / (1 + a d^(2 b)), nearest to 1 up to the distance `least` and exp(least - d) beyond, by a grid made finer."""
    d = np.linspace(0, 3, 300)[1:]
    goal = np.exp(-np.maximum(d - least, 0))
    a, b, wide = 1.5, 1.0, 1.4
    for _ in range(40):
        tried = [(x, y) for x in a * wide ** np.linspace(-1, 1, 9) for y in b * wide ** np.linspace(-0.5, 0.5, 9)]
        a, b = min(tried, key=lambda t: ((1 / (1 + t[0] * d ** (2 * t[1])) - goal) ** 2).sum())
        wide = 1 + (wide - 1) * 0.8
    return float(a), float(b)


def descend(start: np.ndarray, i: np.ndarray, j: np.ndarray, weight: np.ndarray, *, least: float = 0.1, epochs: int = 200, away: int = 5, seed: int = 0) -> np.ndarray:
    """Positions after `epochs` over the edges, each taken as often as its weight says: its ends draw together, and each is pushed
    off `away` others drawn at random. Edges are taken in batches in which a point is about once."""
    rng, pos, n = np.random.default_rng(seed), start.copy(), len(start)
    if not len(i):
        return pos
    a, b = curve(least)
    often = weight / weight.max()

    def move(at: np.ndarray, step: np.ndarray) -> None:
        for c in (0, 1):
            pos[:, c] += np.bincount(at, step[:, c], n)

    for epoch in range(epochs):
        rate = 1 - epoch / epochs
        live = rng.permutation(np.flatnonzero(rng.random(len(often)) < often))
        for part in np.array_split(live, max(1, 2 * len(live) // n)):
            h, t = i[part], j[part]
            gap = pos[h] - pos[t]
            d2 = np.maximum((gap * gap).sum(1, keepdims=True), 1e-12)
            pull = np.clip(-2 * a * b * d2 ** (b - 1) / (1 + a * d2**b) * gap, -4, 4) * rate
            ends = np.repeat(np.concatenate([h, t]), away)
            others = rng.integers(n, size=len(ends))
            gap = pos[ends] - pos[others]
            d2 = (gap * gap).sum(1, keepdims=True)
            push = np.clip(2 * b / ((0.001 + d2) * (1 + a * d2**b)) * gap, -4, 4) * rate
            move(np.concatenate([h, t, ends]), np.concatenate([pull, -pull, push]))
    return pos


def laid_out(df: DataFrame, sample: DataFrame, k: int = NEAREST, *, vec: str = "vec", row: str = "row", least: float = 0.1, epochs: int = 200, seed: int = 0) -> DataFrame:
    """(row, position) of all rows with a vector: sampled rows where the descent left them, others at the mean of their k nearest
    in the sample, by fuzzy weight. Repeated row numbers in the sample share the position of one, null ones are not sampled. An
    empty sample places nothing, a sample of one puts all rows in one place.
    """
    sample = sample.where(F.col(row).isNotNull() & F.col(vec).isNotNull()).dropDuplicates([row])
    rows, units = sample_matrix(sample, vec=vec, row=row)
    if len(rows) < 2:
        one = df.where(F.col(vec).isNotNull()).select(F.col(row).cast("long").alias("row"), F.array(F.lit(0.0), F.lit(0.0)).alias("position"))
        return one if len(rows) else one.limit(0)
    k = min(k, len(rows) - 1)
    found = nearest(sample, rows, units, k, vec=vec, row=row).toArrow().sort_by("row")  # a sample's graph
    at = found["at"].combine_chunks().flatten().to_numpy().reshape(-1, k)
    far = 1 - found["similarity"].combine_chunks().flatten().to_numpy().reshape(-1, k)
    pairs = edges(at, memberships(far))
    centred = units - units.mean(0)
    axes = np.linalg.svd(centred.T @ centred)[0][:, : min(2, centred.shape[1])]
    start = np.zeros((len(rows), 2))
    start[:, : axes.shape[1]] = centred @ axes
    start = start * 10 / max(np.abs(start).max(), 1e-12) + np.random.default_rng(seed).normal(0, 1e-3, start.shape)
    places = descend(start, *pairs, least=least, epochs=epochs, seed=seed)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = b.column(0).to_numpy(zero_copy_only=False)
            at = b.column(1).flatten().to_numpy().reshape(-1, k)
            weight = memberships(1 - b.column(2).flatten().to_numpy().reshape(-1, k))
            out = (places[at] * weight[:, :, None]).sum(1) / np.maximum(weight.sum(1), 1e-12)[:, None]
            here = np.minimum(np.searchsorted(rows, own), len(rows) - 1)
            out = np.where((rows[here] == own)[:, None], places[here], out)
            ends = pa.array(np.arange(len(out) + 1, dtype=np.int32) * 2)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(ends, pa.array(out.ravel()))], names=["row", "position"])

    return nearest(df, rows, units, k, vec=vec, row=row).mapInArrow(place, "row long, position array<double>")
