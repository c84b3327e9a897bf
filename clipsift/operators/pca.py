"""Principal axes of a vector column: sums over all rows on the executors, a small eigenproblem on the driver.

Each task adds up its rows' products into one matrix; the matrices are added line by line on the executors, so that only
one matrix of the vectors' dimensions, whatever the number of rows, reaches the driver. `fit` takes all products of two
dimensions and is exact; `fit_sketched` takes the products with a few random directions, for vectors of many dimensions.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def matrix(column: pa.Array, unit: bool = False) -> np.ndarray:
    """Non-null vectors of equal length as rows in double precision, scaled to unit length if asked (zeros stay)."""
    kept = column.drop_null()
    if not len(kept):
        return np.zeros((0, 0))
    m = kept.flatten().to_numpy(zero_copy_only=False).reshape(len(kept), -1).astype(np.float64)
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12) if unit else m


def _products(batches: Iterator[pa.RecordBatch], unit: bool) -> Iterator[pa.RecordBatch]:
    """Line -1: (rows, sum of the vectors); line i: line i of the sum of products."""
    n, total, gram = 0, None, None
    for batch in batches:
        m = matrix(batch.column(0), unit)
        if len(m):
            n += len(m)
            total = m.sum(0) if total is None else total + m.sum(0)
            gram = m.T @ m if gram is None else gram + m.T @ m
    if n:
        lines = [np.concatenate([[n], total]), *gram]
        yield pa.RecordBatch.from_arrays([pa.array(range(-1, len(gram)), pa.int32()), pa.array([x.tobytes() for x in lines], pa.binary())], names=["line", "sums"])


def _add(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x) for x in table["sums"].to_pylist())
    return pa.table({"line": table["line"].slice(0, 1), "sums": pa.array([total.tobytes()], pa.binary())})


@dataclass(frozen=True)
class Basis:
    """mean (zeros if not centred), axes (one a row, the strongest first), variance of each, total variance, rows."""

    mean: np.ndarray
    axes: np.ndarray
    variance: np.ndarray
    total: float
    rows: int

    @property
    def ratio(self) -> np.ndarray:
        """Share of the total variance of each axis."""
        return self.variance / self.total if self.total > 0 else self.variance * 0

    def effective_rank(self, share: float = 0.95) -> int:
        """Number of axes that together reach the share."""
        return int(np.searchsorted(np.cumsum(self.ratio), share)) + 1


def fit(df: DataFrame, k: int, *, vec: str = "vec", centred: bool = True, unit: bool = False) -> Basis:
    """The k strongest axes. Null vectors are not used; each axis points to where its largest part is positive."""
    sums = df.select(vec).mapInArrow(lambda b: _products(b, unit), "line int, sums binary").groupBy("line").applyInArrow(_add, "line int, sums binary")
    lines = [np.frombuffer(r["sums"]) for r in sorted(sums.collect(), key=lambda r: r["line"])]
    if not lines:
        return Basis(np.zeros(0), np.zeros((0, 0)), np.zeros(0), 0.0, 0)
    n, total, gram = int(lines[0][0]), lines[0][1:], np.stack(lines[1:])
    mean = total / n if centred else np.zeros(len(total))
    spread = gram / n - np.outer(mean, mean)
    value, axes = np.linalg.eigh(spread)
    value, axes = np.maximum(value[::-1][:k], 0), axes.T[::-1][:k]
    return Basis(mean, _oriented(axes), value, float(np.trace(spread)), n)


def _oriented(axes: np.ndarray) -> np.ndarray:
    """Axes, one a row, each pointing to where its largest part is positive."""
    return axes * np.sign(axes[np.arange(len(axes)), np.abs(axes).argmax(axis=1)])[:, None]


def _lines(batches: Iterator[pa.RecordBatch], unit: bool, mean: np.ndarray | None, directions: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """Without directions line 0: (rows, sum of squares, sum of the vectors); with them line i: line i of x' (x directions)."""
    out = None
    for batch in batches:
        m = matrix(batch.column(0), unit)
        if len(m):
            if directions is None:
                part = np.concatenate([[len(m), (m * m).sum()], m.sum(0)])[None]
            else:
                m = m - mean
                part = m.T @ (m @ directions)
            out = part if out is None else out + part
    if out is not None:
        yield pa.RecordBatch.from_arrays([pa.array(range(len(out)), pa.int32()), pa.array([x.tobytes() for x in out], pa.binary())], names=["line", "sums"])


def _summed(df: DataFrame, unit: bool, mean: np.ndarray | None = None, directions: np.ndarray | None = None) -> np.ndarray:
    parts = df.mapInArrow(lambda b: _lines(b, unit, mean, directions), "line int, sums binary")
    rows = parts.groupBy("line").applyInArrow(_add, "line int, sums binary").collect()  # one a dimension
    return np.array([np.frombuffer(r["sums"]) for r in sorted(rows, key=lambda r: r["line"])])


def fit_sketched(df: DataFrame, k: int, *, vec: str = "vec", centred: bool = True, unit: bool = False, rounds: int = 4, seed: int = 0) -> Basis:
    """The k strongest axes by a randomised range finder: max(2 k, k + 32) random directions, `rounds` products with the spread
    of the rows, made orthogonal after each, and the eigenproblem of the spread within what they reach.

    A task holds d x max(2 k, k + 32) sums, never d x d; the driver gets as many. `rounds` + 2 passes over the rows. The total
    variance is that of all dimensions. Null vectors are not used; no rows give an empty basis.
    """
    rows = df.select(vec)
    first = _summed(rows, unit)
    if not len(first):
        return Basis(np.zeros(0), np.zeros((0, 0)), np.zeros(0), 0.0, 0)
    n, squares, total = int(first[0, 0]), first[0, 1], first[0, 2:]
    mean = total / n if centred else np.zeros(len(total))
    d = len(total)
    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(d, min(d, max(2 * k, k + 32)))))[0]
    for _ in range(rounds):
        q = np.linalg.qr(_summed(rows, unit, mean, q))[0]
    value, inner = np.linalg.eigh(q.T @ _summed(rows, unit, mean, q) / n)
    axes = (q @ inner).T[::-1][:k]
    return Basis(mean, _oriented(axes), np.maximum(value[::-1][:k], 0), max(0.0, squares / n - float(mean @ mean)), n)


def project(df: DataFrame, basis: Basis, *, vec: str = "vec", row: str = "row", unit: bool = False) -> DataFrame:
    """(row, projected) of the non-null vectors: places along the axes, a matrix product per Arrow batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = batch.filter(batch.column(vec).is_valid())
            m = matrix(keep.column(vec), unit)
            out = (m - basis.mean) @ basis.axes.T if len(m) else np.zeros((0, len(basis.axes)))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1, dtype=np.int32) * out.shape[1]), pa.array(out.ravel()))
            yield pa.RecordBatch.from_arrays([keep.column(row), lists], names=["row", "projected"])

    return df.select(row, vec).mapInArrow(run, "row long, projected array<double>")


def real_projection(sample: DataFrame, scale: Sequence[float], *, exact: str = "vec", quantised: str = "i8") -> bool | None:
    """Whether a bounded sample's exact vectors differ from the dequantised ones by more than rounding in storage; None if
    that cannot be told (no rows, or a value that is no number)."""
    step = F.array(*[F.lit(s / 127) for s in scale])
    back = F.zip_with(quantised, step, lambda q, s: q.cast("double") * s)
    off = F.array_max(F.zip_with(exact, back, lambda x, y: F.abs(x.cast("double") - y)))
    worst = sample.where(F.exists(exact, lambda x: x != 0)).agg(F.max(off)).first()[0]
    if worst is None or worst != worst:
        return None
    return worst >= 1e-3 * max(s / 127 for s in scale)
