"""Intervals of adjacent hits within a drive: cells on its stride grid, islands over a threshold, interpolated edges.

A drive may be long: nothing here orders a whole one in a task. Starts are compared within ranges of time, cells within blocks of
the grid that also see the next cell on either side, and each block sums up its islands. Only the summaries of islands that
touch a block's edge meet their neighbours, to be merged where an island goes on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clipsift.operators import order

#: Seconds of a range of time, and cells of a block.
SPAN, BLOCK = 1 << 17, 1 << 14


def strides(df: DataFrame, span: int = SPAN) -> DataFrame:
    """(run_uuid, stride, base): a run's least positive gap of starts, else 4, and its first start."""
    at = F.floor(F.col("chunk_start_unix") / span)
    starts = df.select("run_uuid", "chunk_start_unix").where("chunk_start_unix is not null").distinct().withColumn("_at", at)
    gap = F.col("chunk_start_unix") - F.lag("chunk_start_unix").over(Window.partitionBy("run_uuid", "_at").orderBy("chunk_start_unix"))
    ranges = starts.withColumn("_gap", gap).groupBy("run_uuid", "_at").agg(F.min("_gap").alias("_gap"), F.min("chunk_start_unix").alias("_first"), F.max("chunk_start_unix").alias("_last"))
    over = F.col("_first") - F.lag("_last").over(Window.partitionBy("run_uuid").orderBy("_at"))
    return ranges.withColumn("_over", over).groupBy("run_uuid").agg(F.coalesce(F.least(F.min("_gap"), F.min("_over")), F.lit(4)).alias("stride"), F.min("_first").alias("base"))


def cells(df: DataFrame, score: str = "score", *, span: int = SPAN) -> DataFrame:
    """(run_uuid, m, cell, peak_row, base, stride, centre): cell m is the mean of the clips at grid positions m - 1 and m.

    Of clips at one position the last start, then the lowest score, then the largest row counts. Clips without a start are in
    no cell.
    """
    grid = strides(df, span).withColumnRenamed("run_uuid", "_run")
    rows = df.select("run_uuid", "row", "chunk_start_unix", F.col(score).alias("s")).join(grid, F.col("run_uuid").eqNullSafe(F.col("_run"))).drop("_run")
    rows = rows.withColumn("p", F.rint((F.col("chunk_start_unix") - F.col("base")) / F.col("stride")).cast("long"))
    last = F.max(F.struct("chunk_start_unix", F.col("s").isNull().alias("_none"), (-F.col("s")).alias("_low"), "row", "s"))
    one = rows.groupBy("run_uuid", "p").agg(last.alias("_c"), F.first("base").alias("base"), F.first("stride").alias("stride")).select("run_uuid", "p", "base", "stride", "_c.row", "_c.s")
    sides = one.withColumn("m", F.explode(F.array(F.col("p"), F.col("p") + 1)))
    left = (F.col("p") == F.col("m") - 1).cast("int")
    return sides.groupBy("run_uuid", "m").agg(
        F.avg("s").alias("cell"), F.max(F.struct("s", left.alias("left"), "row")).getField("row").alias("peak_row"),
        F.first("base").alias("base"), F.first("stride").alias("stride"),
    ).withColumn("centre", F.col("base") + (F.col("m") + 0.5) * F.col("stride"))


def summaries(c: DataFrame, tau: float, block: int = BLOCK) -> DataFrame:
    """Of each block of cells: its islands of cells >= tau, by first and last cell (lo, hi), with edges, peak, sum and number."""
    home = F.floor(F.col("m") / block)
    near = F.array_compact(F.array(home, F.when(F.col("m") % block == 0, home - 1), F.when(F.col("m") % block == block - 1, home + 1)))
    here = Window.partitionBy("run_uuid", "_block").orderBy("m")
    c = c.select("run_uuid", "m", "cell", "peak_row", "centre", "stride", F.explode(near).alias("_block"))
    c = c.withColumns({"_pm": F.lag("m").over(here), "_pc": F.lag("cell").over(here), "_nm": F.lead("m").over(here), "_nc": F.lead("cell").over(here)})
    c = c.where((F.col("cell") >= tau) & (F.col("_block") == home)).withColumn("_island", F.col("m") - F.row_number().over(here))
    before = (F.col("_pm") == F.col("m") - 1) & (F.col("_pc") < tau)
    after = (F.col("_nm") == F.col("m") + 1) & (F.col("_nc") < tau)
    up = F.col("centre") - F.col("stride") * F.when(before, (F.col("cell") - tau) / (F.col("cell") - F.col("_pc"))).otherwise(0.5)
    down = F.col("centre") + F.col("stride") * F.when(after, (F.col("cell") - tau) / (F.col("cell") - F.col("_nc"))).otherwise(0.5)
    return c.groupBy("run_uuid", "_block", "_island").agg(
        F.min("m").alias("lo"), F.max("m").alias("hi"), F.min(F.struct("m", up.alias("s"))).alias("up"), F.max(F.struct("m", down.alias("s"))).alias("down"),
        F.max(F.struct("cell", (-F.col("m")).alias("_m"), "peak_row")).alias("best"), F.sum("cell").alias("sum"), F.count(F.lit(1)).alias("n"),
    )


def merged(parts: DataFrame, block: int = BLOCK) -> DataFrame:
    """Islands from their summaries by block: one that ends a block and one that begins the next are one. Summaries that touch no
    edge are windows of their own, so a drive's window holds two a block at most."""
    touches = (F.col("lo") % block == 0) | (F.col("hi") % block == block - 1)
    chain = Window.partitionBy("run_uuid", F.when(touches, F.lit(-1)).otherwise(F.col("lo"))).orderBy("lo")
    begins = F.when(~F.coalesce(F.lag("hi").over(chain) == F.col("lo") - 1, F.lit(False)), F.col("lo"))
    rows = parts.withColumn("_begin", begins).withColumn("_chain", F.last("_begin", ignorenulls=True).over(chain))
    return rows.groupBy("run_uuid", "_chain").agg(
        F.min("up").getField("s").alias("start_s"), F.max("down").getField("s").alias("end_s"), F.max("best").getField("cell").alias("peak"),
        (F.sum("sum") / F.sum("n")).alias("mean"), F.sum("n").alias("num_cells"), F.max("best").getField("peak_row").alias("peak_row"),
    ).drop("_chain")


def intervals(df: DataFrame, tau: float, score: str = "score", *, span: int = SPAN, block: int = BLOCK) -> DataFrame:
    """Islands of cells >= tau: run_uuid, start_s, end_s, peak, mean, num_cells, peak_row. Null runs are one run."""
    return merged(summaries(cells(df, score, span=span), tau, block), block)


def pooled_threshold(df: DataFrame, k: int, score: str = "score") -> DataFrame:
    """The k-th largest cell over all drives, as tau; null without cells."""
    return df.sparkSession.createDataFrame([(order.kth(cells(df, score), "cell", k),)], "tau double")
