"""Vectors, points and lists in writing: JSON, base64 arrays, packed binary, comma lists."""

from __future__ import annotations

import base64
import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def vector_json(vec: Column, digits: int | None = None, *, several: bool = False) -> Column:
    """A direction, or an array of `several`, as JSON numbers, rounded if asked for. Null vectors and numbers stay null."""
    if digits is None:
        return F.to_json(vec)
    rounded = lambda v: F.transform(v, lambda x: F.round(x.cast("double"), digits) + F.lit(0.0))
    return F.to_json(F.transform(vec, rounded) if several else rounded(vec))


def array_text(m: np.ndarray) -> str:
    """An array in .npy form, as base64."""
    out = io.BytesIO()
    np.save(out, np.asarray(m), allow_pickle=False)
    return base64.b64encode(out.getvalue()).decode()


def text_array(text: str) -> np.ndarray:
    """Reverse of array_text; objects are refused."""
    return np.load(io.BytesIO(base64.b64decode(text, validate=True)), allow_pickle=False)


def comma_items(c: Column) -> Column:
    """Items of a list parted by commas alone, trimmed, empty ones dropped."""
    return F.filter(F.transform(F.split(c, ","), lambda x: F.trim(x)), lambda x: x != "")


def in_commas(joined: Column, item: Column) -> Column:
    """Whether a list written as ,a,b, holds an item as a whole."""
    return F.contains(joined, F.concat(F.lit(","), item, F.lit(",")))


def checkpoint_name(uri: Column) -> Column:
    """Last part of a model's address, whatever slashes end it."""
    return F.substring_index(F.rtrim(uri, F.lit("/")), "/", -1)


def packed_points(points: DataFrame, codes: str | None = None) -> DataFrame:
    """(first_row, n, xy, code): points (row, x, y) in order of row within each Arrow batch, as interleaved little-endian
    32-bit floats, and their category numbers as bytes."""
    rows = points.select("row", "x", "y", (F.col(codes) if codes else F.lit(0)).cast("int").alias("code")).orderBy("row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                xy = np.column_stack([b.column(c).to_numpy(zero_copy_only=False) for c in ("x", "y")]).astype("<f4").tobytes()
                code = b.column("code").to_numpy(zero_copy_only=False).astype(np.uint8).tobytes()
                yield pa.RecordBatch.from_arrays([b.column("row")[:1], pa.array([b.num_rows], pa.int64()), pa.array([xy], pa.binary()), pa.array([code], pa.binary())], names=["first_row", "n", "xy", "code"])

    return rows.mapInArrow(run, "first_row long, n long, xy binary, code binary")


def dictionary(df: DataFrame, column: str) -> DataFrame:
    """(value, code): the distinct non-null values numbered from 0 in order. Values are distinct before they are ordered."""
    values = df.where(F.col(column).isNotNull()).select(F.col(column).alias("value")).distinct().orderBy("value")
    kind = values.schema["value"].dataType.simpleString()
    return values.rdd.zipWithIndex().map(lambda x: (x[0]["value"], x[1])).toDF(f"value {kind}, code long")


def first_occurrences(df: DataFrame, key: str, order: str) -> DataFrame:
    """Distinct keys, each where it is first by `order`: (key, order). A partial aggregation, no window."""
    return df.groupBy(key).agg(F.min(order).alias(order)).orderBy(order, key)
