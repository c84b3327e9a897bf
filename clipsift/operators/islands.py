"""Interval emission as a table function and as a function of Arrow groups: both sum up the islands of each block of cells, as
`intervals.summaries` does with windows, and `intervals.merged` puts the blocks together. A task holds a block, not a drive.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.udtf import UserDefinedTableFunction

from clipsift.operators import intervals as iv

#: A summary: an island's first and last cell, edges, best cell, sum and number of cells.
SUMMARY = "run_uuid string, lo long, hi long, up struct<m: long, s: double>, down struct<m: long, s: double>, best struct<cell: double, _m: long, peak_row: long>, sum double, n long"


def blocks(cells: DataFrame, block: int = iv.BLOCK) -> DataFrame:
    """Cells with the block they are of (home) and a copy for a block that they are the next cell to."""
    home = F.floor(F.col("m") / block)
    near = F.array_compact(F.array(home, F.when(F.col("m") % block == 0, home - 1), F.when(F.col("m") % block == block - 1, home + 1)))
    kinds = [F.col("run_uuid"), F.col("m").cast("long"), F.col("cell").cast("double"), F.col("peak_row").cast("long"), F.col("centre").cast("double"), F.col("stride").cast("double")]
    return cells.select(*kinds, F.explode(near).alias("block")).withColumn("home", F.col("block") == home)


def edge(cell: float, beside: float | None, adjacent: bool, tau: float) -> float:
    """Strides from a centre to where the line to the cell beside it meets tau; half a stride if that one is not below it."""
    return (cell - tau) / (cell - beside) if adjacent and beside is not None and beside < tau else 0.5


class Islands:
    """Cells of one run and block in order of m, and tau: a summary of each island of cells >= tau. State is one island.

    Null cells are in no island. Each m comes once, as `intervals.cells` gives it.
    """

    def __init__(self) -> None:
        self.last: tuple[int, float | None] | None = None  # the cell before
        self.held: list[Any] | None = None  # run, lo, hi, up, best, sum, n, and cell, centre, stride of the last one

    def _closed(self, m: int | None, cell: float | None, tau: float) -> tuple[Any, ...]:
        run, lo, hi, up, best, total, n, at, centre, stride = self.held  # type: ignore[misc]
        self.held = None
        down = centre + stride * edge(at, cell, m == hi + 1, tau)
        return run, lo, hi, (lo, up), (hi, down), (best[0], -best[1], best[2]), total, n

    def eval(self, row: Any, tau: float) -> Iterator[tuple[Any, ...]]:
        self.tau = tau
        m, cell, centre, stride = row["m"], row["cell"], row["centre"], row["stride"]
        inside = row["home"] and cell is not None and cell >= tau
        if self.held and not (inside and m == self.held[2] + 1):
            yield self._closed(m, cell, tau)
        if inside and self.held:
            best = self.held[4] if self.held[4][0] >= cell else (cell, m, row["peak_row"])
            self.held[2], self.held[4:] = m, [best, self.held[5] + cell, self.held[6] + 1, cell, centre, stride]
        elif inside:
            adjacent = self.last is not None and self.last[0] == m - 1
            up = centre - stride * edge(cell, self.last[1] if self.last else None, adjacent, tau)
            self.held = [row["run_uuid"], m, m, up, (cell, m, row["peak_row"]), cell, 1, cell, centre, stride]
        self.last = (m, cell)

    def terminate(self) -> Iterator[tuple[Any, ...]]:
        if self.held:
            yield self._closed(None, None, self.tau)


def table_function(spark: SparkSession | None = None) -> UserDefinedTableFunction:
    """The table function; with a session also known to its SQL: `islands(TABLE(blocks) PARTITION BY (run_uuid, block) ORDER BY (m),
    tau)`."""
    f = F.udtf(Islands, returnType=SUMMARY)
    if spark is not None:
        spark.udtf.register("islands", f)
    return f


def arrow_summaries(tau: float):  # noqa: ANN201
    """The same of an Arrow group: edges, best and sums of all its islands at once."""

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("m")
        column = {c: group[c].to_numpy() for c in ("m", "cell", "peak_row", "centre", "stride", "home")}
        m, cell = column["m"], pc.fill_null(group["cell"], float("nan")).to_numpy()
        inside = (cell >= tau) & column["home"].astype(bool)
        before, after = np.r_[np.nan, cell[:-1]], np.r_[cell[1:], np.nan]
        with np.errstate(divide="ignore", invalid="ignore"):
            left = np.where((np.r_[False, np.diff(m) == 1]) & (before < tau), (cell - tau) / (cell - before), 0.5)
            right = np.where((np.r_[np.diff(m) == 1, False]) & (after < tau), (cell - tau) / (cell - after), 0.5)
        at = np.flatnonzero(inside)
        first = np.flatnonzero(np.r_[True, np.diff(m[at]) != 1])[: len(at)]
        last = np.r_[first[1:], len(at)][: len(first)] - 1
        lo, hi, centre, stride = at[first], at[last], column["centre"], column["stride"]
        island = np.repeat(np.arange(len(first)), last - first + 1)
        order = np.lexsort((m[at], -cell[at], island))
        best = at[order[first]]
        n = len(first)
        pair = lambda ms, s: pa.StructArray.from_arrays([pa.array(ms), pa.array(s)], names=["m", "s"])
        return pa.table({
            "run_uuid": group["run_uuid"].combine_chunks().slice(0, 1).take(pa.array(np.zeros(n, np.int64))),
            "lo": m[lo], "hi": m[hi], "up": pair(m[lo], centre[lo] - stride[lo] * left[lo]), "down": pair(m[hi], centre[hi] + stride[hi] * right[hi]),
            "best": pa.StructArray.from_arrays([pa.array(cell[best]), pa.array(-m[best]), pa.array(column["peak_row"][best])], names=["cell", "_m", "peak_row"]),
            "sum": np.add.reduceat(cell[at], first) if n else np.zeros(0), "n": (last - first + 1).astype(np.int64),
        })

    return run


def intervals_by_function(df: DataFrame, tau: float, score: str = "score", *, span: int = iv.SPAN, block: int = iv.BLOCK) -> DataFrame:
    """`intervals.intervals` with the table function."""
    cells = blocks(iv.cells(df, score, span=span), block)
    parts = table_function()(cells.asTable().partitionBy("run_uuid", "block").orderBy("m"), F.lit(float(tau)))
    return iv.merged(parts, block)


def intervals_by_arrow(df: DataFrame, tau: float, score: str = "score", *, span: int = iv.SPAN, block: int = iv.BLOCK) -> DataFrame:
    """`intervals.intervals` with groups of Arrow tables."""
    cells = blocks(iv.cells(df, score, span=span), block)
    return iv.merged(cells.groupBy("run_uuid", "block").applyInArrow(arrow_summaries(float(tau)), SUMMARY), block)
