"""Many windows of time against all clips: an overlap join by bins of time, checked exactly.

A window and a clip that overlap have a bin of time in common, so both are put into the bins they touch, joined by run and bin, and
compared. Of the bins that a pair shares only the first gives it, so no pair comes twice. There is no comparison of every
window with every clip.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Seconds of a bin, and of a clip whose end is not known.
BIN, CLIP = 600, 8
#: A start or end that leaves its side open.
OPEN = 0


def _bins(start: Column, end: Column, width: int) -> Column:
    """Bins that [start, end) touches."""
    return F.sequence(F.floor(start / width), F.floor((end - 1) / width))


def overlaps(clips: DataFrame, windows: DataFrame, *, width: int = BIN) -> DataFrame:
    """(window_id, row) for each window (window_id, run_uuid, start, end) and clip of its run that overlap: the clip begins before
    the end and ends after the start. A start or end of 0, or null, leaves that side open; a clip's null end is its start + CLIP.

    Open sides are closed by the first start and last end of the run. Windows that end before they start, of null or unknown
    runs, and clips without a start or run match nothing. Repeated windows and rows give repeated pairs.
    """
    c = clips.select("run_uuid", "row", F.col("chunk_start_unix").alias("_s"), F.greatest(F.coalesce("chunk_end_unix", F.col("chunk_start_unix") + CLIP), F.col("chunk_start_unix") + 1).alias("_e"), F.coalesce("chunk_end_unix", F.col("chunk_start_unix") + CLIP).alias("_end")).where("_s is not null")
    ends = c.groupBy("run_uuid").agg(F.min("_s").alias("_first"), F.max("_e").alias("_last"))
    w = windows.select("window_id", "run_uuid", F.coalesce("start", F.lit(OPEN)).alias("_from"), F.coalesce("end", F.lit(OPEN)).alias("_to")).join(ends, "run_uuid")
    # What is compared, and the stretch of the run that the window can touch.
    w = w.withColumns({"_lo": F.greatest("_first", "_from"), "_hi": F.when(F.col("_to") == OPEN, F.col("_last")).otherwise(F.least("_last", "_to"))}).where("_lo < _hi")
    w = w.withColumn("_w0", F.floor(F.col("_lo") / width)).withColumn("_bin", F.explode(_bins(F.col("_lo"), F.col("_hi"), width)))
    c = c.withColumn("_c0", F.floor(F.col("_s") / width)).withColumn("_bin", F.explode(_bins(F.col("_s"), F.col("_e"), width)))
    both = w.join(c, ["run_uuid", "_bin"]).where(F.col("_bin") == F.greatest("_w0", "_c0"))
    begins = (F.col("_to") == OPEN) | (F.col("_s") < F.col("_to"))
    lasts = (F.col("_from") == OPEN) | (F.col("_end") > F.col("_from"))
    return both.where(begins & lasts).select("window_id", "row")
