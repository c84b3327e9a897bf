"""Plug-in points for models that turn texts into vectors and vectors into map positions, with stand-ins without weights."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Texts to a matrix, one unit vector a row.
Encoder = Callable[[Sequence[str]], np.ndarray]
#: A matrix of vectors to one of two columns.
Reducer = Callable[[np.ndarray], np.ndarray]


def hashed_words(dim: int = 64) -> Encoder:
    """Stand-in encoder: signed counts of hashed words, of unit length (zeros for a text without words)."""

    def encode(texts: Sequence[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim))
        for i, t in enumerate(texts):
            for w in t.lower().split():
                h = zlib.crc32(w.encode())
                out[i, h % dim] += 1 if h >> 31 else -1
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)

    return encode


def frames(n: int, wanted: int = 8) -> list[int]:
    """Numbers of `wanted` frames evenly through n; a single one is repeated."""
    if n < 1:
        raise ValueError("no frames")
    return [round(i * (n - 1) / (wanted - 1)) for i in range(wanted)]


def encoded(df: DataFrame, encoder: Encoder, *, row: str = "row", text: str = "text") -> DataFrame:
    """(row, vec) by an encoder, an Arrow batch at a time; null texts are empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield _rows(b.column(row), encoder([t or "" for t in b.column(text).to_pylist()]), "vec")

    return df.select(row, text).mapInArrow(run, "row long, vec array<double>")


def placed(df: DataFrame, reducer: Reducer | None = None, *, row: str = "row", vec: str = "projected") -> DataFrame:
    """(row, position) of vectors by a fitted reducer, an Arrow batch at a time; without one the first two numbers."""
    place = reducer or (lambda m: m[:, :2])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = b.filter(b.column(vec).is_valid())
            if keep.num_rows:
                m = keep.column(vec).flatten().to_numpy(zero_copy_only=False).reshape(keep.num_rows, -1).astype(np.float64)
                yield _rows(keep.column(row), place(m), "position")

    return df.select(row, vec).mapInArrow(run, "row long, position array<double>")


def _rows(ids: pa.Array, m: np.ndarray, name: str) -> pa.RecordBatch:
    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1, dtype=np.int32) * m.shape[1]), pa.array(np.ascontiguousarray(m, np.float64).ravel()))
    return pa.RecordBatch.from_arrays([ids, lists], names=["row", name])
