"""Dot products, quantisation, error bounds and feedback over vector columns.

Query-side arithmetic (weights, bounds) is done once on the driver; rows are scored by built-in higher-order functions, or by
`arrow_scores`, which multiplies whole Arrow batches in numpy.
"""

from __future__ import annotations

import math
import time
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def literal(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def dot(a: Column, b: Column) -> Column:
    """Dot product in double precision, summed from the left."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def directions(vectors: Sequence[Sequence[float]], most: int = 64) -> list[list[float]]:
    """Unit query directions; rejects none, too many, and zero vectors."""
    out = []
    if not 0 < len(vectors) <= most:
        raise ValueError(f"1 to {most} directions are needed")
    for v in vectors:
        n = math.sqrt(sum(x * x for x in v))
        if not n > 0 or not math.isfinite(n):
            raise ValueError("a direction is zero or not finite")
        out.append([x / n for x in v])
    return out


def scales(df: DataFrame, vec: str = "vec") -> list[float]:
    """Largest absolute value of each dimension: a row of maxima per Arrow batch, and only these are exploded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = b.column(0).drop_null()
            if len(col):
                m = np.abs(col.flatten().to_numpy(zero_copy_only=False).reshape(len(col), -1).astype(np.float64))
                yield pa.RecordBatch.from_arrays([pa.array([m.max(axis=0).tolist()], pa.list_(pa.float64()))], names=["m"])

    found = df.select(vec).mapInArrow(run, "m array<double>").select(F.posexplode("m").alias("d", "x")).groupBy("d").agg(F.max("x").alias("m")).orderBy("d").collect()
    return [r["m"] for r in found]


def quantise(vec: Column, scale: Sequence[float]) -> Column:
    """clip(rint(v * 127 / scale), -127, 127) as tinyint."""
    q = lambda x, s: F.greatest(F.lit(-127.0), F.least(F.lit(127.0), F.rint(x.cast("double") * F.lit(127.0) / s)))
    return F.zip_with(vec, literal(scale), lambda x, s: q(x, s).cast("tinyint"))


def weights(query: Sequence[float], scale: Sequence[float]) -> list[float]:
    """Dequantisation folded into the query, so that rows stay int8."""
    return [q * s / 127 for q, s in zip(query, scale, strict=True)]


def bound_cauchy(scale: Sequence[float]) -> float:
    """Largest error of a screened score for a unit query."""
    return math.sqrt(sum(s * s for s in scale)) / 254


def bound_hoelder(query: Sequence[float], scale: Sequence[float]) -> float:
    return sum(abs(q) * s for q, s in zip(query, scale, strict=True)) / 254


def maxsim(vec: Column, queries: Sequence[Sequence[float]]) -> Column:
    """Largest dot product over several directions."""
    return F.array_max(F.array(*[dot(vec, literal(q)) for q in queries]))


def arrow_scores(df: DataFrame, queries: Sequence[Sequence[float]], *, row: str = "row", vec: str = "vec", until: float | None = None) -> DataFrame:
    """(row, score): largest dot product with the directions, a matrix product per Arrow batch. Null vectors score 0. After the
    Unix time `until` no batch is begun and the job fails with a TimeoutError."""
    q = np.asarray(queries, np.float64).T

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if until is not None and time.time() > until:
                raise TimeoutError("exact scores were not done by their deadline")
            col = b.column(vec)
            score = np.zeros(b.num_rows)
            if len(col) > col.null_count:
                at = np.flatnonzero(col.is_valid().to_numpy(zero_copy_only=False))
                m = col.drop_null().flatten().to_numpy(zero_copy_only=False).reshape(-1, len(q)).astype(np.float64)
                score[at] = (m @ q).max(axis=1)
            yield pa.RecordBatch.from_arrays([b.column(row), pa.array(score)], names=["row", "score"])

    return df.select(row, vec).mapInArrow(run, "row long, score double")


def rocchio(pos: list[list[float]], neg: list[list[float]], text: list[float] | None, negative_weight: float = 0.5, text_weight: float = 0.3) -> list[float]:
    """Feedback vector from few labelled vectors: mean of the good, less the mean of the bad, leaning on the text."""

    def unit(v: np.ndarray) -> np.ndarray:
        n = np.linalg.norm(v)
        return v / n if n > 0 else v * 0

    w = unit(np.mean(pos, axis=0))
    if neg:
        w = unit(w - negative_weight * unit(np.mean(neg, axis=0)))
    if text is not None and text_weight > 0:
        w = unit((1 - text_weight) * w + text_weight * unit(np.asarray(text)))
    return w.tolist()


def mean_vector(df: DataFrame, vec: str = "vec") -> list[float]:
    """Element-wise mean, aggregated by dimension."""
    rows = df.select(F.posexplode(vec).alias("d", "x")).groupBy("d").agg(F.avg(F.col("x").cast("double")).alias("m")).orderBy("d").collect()
    return [r["m"] for r in rows]
