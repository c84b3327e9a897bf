"""A stored int8 screen of the corpus, selections over it, and checks that it still belongs to its clips."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from clipsift.operators.exporting import ranked
from clipsift.operators.selection import Screen, classify, cut_to, ordered, select
from clipsift.operators.vectors import weights

REFINE = ("auto", "never", "always")


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Vectors as rows; null vectors and null numbers are zeros."""
    out = np.zeros((len(column), width))
    valid = column.is_valid().to_numpy(zero_copy_only=False)
    if valid.any():
        flat = column.drop_null().flatten()
        flat = flat.fill_null(0) if flat.null_count else flat
        out[valid] = np.nan_to_num(flat.to_numpy(zero_copy_only=False).reshape(-1, width).astype(np.float64))
    return out


def store(df: DataFrame, scale: Sequence[float], *, vec: str = "vec") -> DataFrame:
    """The corpus with its vectors as one byte a dimension (`i8`), to be written once and screened often; vectors themselves go."""
    kept = [f for f in df.schema.fields if f.name != vec]
    schema = StructType([*kept, StructField("i8", BinaryType())])
    s = np.where(np.asarray(scale) > 0, scale, 1.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = _matrix(b.column(len(kept)), len(s))
            q = np.clip(np.rint(m * 127.0 / s), -127, 127).astype(np.int8)
            yield pa.RecordBatch.from_arrays([*b.columns[: len(kept)], pa.array([r.tobytes() for r in q], pa.binary())], names=[f.name for f in schema])

    return df.select(*[f.name for f in kept], vec).mapInArrow(run, schema)


def codes(column: pa.Array, width: int) -> np.ndarray:
    """Stored codes as rows of int8, without a copy unless some are null, which count as zeros."""
    if column.null_count:
        column = column.fill_null(bytes(width))
    if not len(column):
        return np.zeros((0, width), np.int8)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if pa.types.is_large_binary(column.type) else np.int32)
    return np.frombuffer(data, np.int8)[at[column.offset] : at[column.offset + len(column)]].reshape(len(column), width)


def products(column: pa.Array, w: np.ndarray, rows: int = 4096) -> np.ndarray:
    """Largest product of each row's codes with the columns of w, rounded to 9; so many rows are widened at a time."""
    m, out = codes(column, len(w)), np.empty(len(column))
    for a in range(0, len(m), rows):
        out[a : a + rows] = (m[a : a + rows].astype(np.float64) @ w).max(axis=1)
    return np.round(out, 9)


def screened(stored: DataFrame, screen: Screen) -> DataFrame:
    """A stored corpus with score: the largest product with the screen's directions, a matrix product per Arrow batch. Only
    the bytes are read, never exact vectors."""
    w = np.array([weights(q, screen.scale) for q in screen.queries]).T
    kept = [f for f in stored.schema.fields if f.name != "i8"]
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in kept) + "score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[: len(kept)], pa.array(products(b.column(len(kept)), w))], names=[*[f.name for f in kept], "score"])

    return stored.select(*[f.name for f in kept], "i8").mapInArrow(run, schema)


def candidates(scored: DataFrame, screen: Screen, *, tau: float | None = None) -> int:
    """How many rows a selection could still hold: all filtered ones by top k, those not surely below by threshold."""
    if tau is None:
        return scored.count()
    return scored.where(classify(F.col("score"), tau, screen.eps) != "below").count()


@dataclass
class Selection:
    """rows by score; candidates; truncated: max_rows cut them; refined: exact scores decided."""

    rows: DataFrame
    candidates: int
    truncated: bool
    refined: bool


def selection(corpus: DataFrame, screen: Screen, *, k: int | None = None, tau: float | None = None, max_rows: int = 0, refine: str = "auto", usable: bool = True) -> Selection:
    """select() with the choice of refinement: never; always, an error if exact vectors are not usable; auto, which then falls
    back to screened scores. By top k at most k rows and max_rows has no effect; by threshold at most max_rows, if not 0."""
    if refine not in REFINE:
        raise ValueError(f"refine is one of {', '.join(REFINE)}")
    if refine == "always" and not usable:
        raise ValueError("exact vectors are not usable")
    exact = refine != "never" and usable
    rows = select(corpus, screen, k=k, tau=tau, refine=exact)
    n = candidates(screen.apply(corpus), screen, tau=tau)
    kept, truncated = cut_to(rows, max_rows=max_rows) if tau is not None else (rows, False)
    return Selection(ordered(kept) if tau is not None else kept, n, truncated, exact)


def spot_check(df: DataFrame, names: DataFrame, *, most: int = 32) -> DataFrame:
    """(checked, mismatches) of (row, chunk_id) names against the corpus, on at most `most` rows spread over the names; a row
    that the corpus lacks is a mismatch. `df` has row and chunk_id too."""
    n = names.count()
    take = sorted({round(i * (n - 1) / max(1, min(most, n) - 1)) for i in range(min(most, n))})
    at = names.sparkSession.createDataFrame([(i,) for i in take], "at long")
    placed = ranked(names.withColumn("_down", -F.col("row")), "_down").select((F.col("rank") - 1).alias("at"), "row", "chunk_id")
    probe = placed.join(F.broadcast(at), "at")  # `most` rows
    found = probe.join(df.select("row", F.col("chunk_id").alias("now")), "row", "left")
    return found.agg(F.count(F.lit(1)).alias("checked"), F.count_if(~F.col("now").eqNullSafe(F.col("chunk_id"))).alias("mismatches"))


def same_rows(stored: DataFrame, expected: int) -> DataFrame:
    """The stored corpus; refuses one that has not as many rows as the table it was made from."""
    n = stored.count()
    if n != expected:
        raise ValueError(f"the stored screen has {n} rows, its table {expected}")
    return stored
