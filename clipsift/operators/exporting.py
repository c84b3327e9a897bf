"""Dedupe, confidence, export columns and pages of ranked rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clipsift.functions.text import utc_day
from clipsift.operators import order


def chunk_id() -> Column:
    return F.concat("run_uuid", F.lit("#t"), F.col("chunk_start_unix").cast("string"))


def first_per_segment(df: DataFrame, *, empty_is_none: bool = False, score: str = "score") -> DataFrame:
    """The best row of each segment; rows without a segment (null, or also empty) all stay."""
    none = F.col("segment_id").isNull() | ((F.col("segment_id") == "") if empty_is_none else F.lit(False))
    key = F.when(none, F.concat(F.lit("#"), F.col("row").cast("string"))).otherwise(F.concat(F.lit("="), F.col("segment_id")))
    w = Window.partitionBy(key).orderBy(F.col(score).desc(), "row")
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def ranked(df: DataFrame, score: str = "score", *, ties: Sequence[str] = ("row",), rows_per_range: int = 1_000_000) -> DataFrame:
    """Rank from 1 by score, then `ties`; null scores last. Rows are cut by score into ranges of about rows_per_range at
    percentiles, ranked within each, and moved on by the rows of the ranges before, so that no task orders all of them. Where
    Spark knows the rows to be few, or they are counted to be, one range does."""
    down = [F.col(score).desc_nulls_last(), *[F.col(t).asc() for t in ties]]
    one = lambda: df.withColumn("rank", F.row_number().over(Window.orderBy(*down)).cast("long"))
    if rows_per_range >= order.FEW and order.surely_small(df):
        return one()
    parts = -(-df.count() // rows_per_range)
    if parts <= 1:
        return one()
    found = df.agg(F.percentile_approx(score, [i / parts for i in range(1, parts)], 100_000)).first()[0] or []
    bounds = F.array(*[F.lit(float(b)) for b in sorted(set(found), reverse=True)])
    # The range of a score: how many bounds it does not reach; equal scores share one, and ties order them there.
    at = F.when(F.col(score).isNull(), F.lit(len(found) + 1)).otherwise(F.size(F.filter(bounds, lambda b: F.col(score) < b)))
    cut = df.withColumn("_range", at)
    sizes = sorted((r["_range"], r["n"]) for r in cut.groupBy("_range").agg(F.count(F.lit(1)).alias("n")).collect())  # one row a range
    before, total = [], 0
    for k, m in sizes:
        before.append((k, total))
        total += m
    offsets = F.broadcast(df.sparkSession.createDataFrame(before, "_range int, _before long"))
    within = F.row_number().over(Window.partitionBy("_range").orderBy(*down))
    return cut.withColumn("rank", within).join(offsets, "_range").withColumn("rank", (F.col("rank") + F.col("_before")).cast("long")).drop("_range", "_before").select(*df.columns, "rank")


def in_groups(df: DataFrame, groups: int, score: str, *, ties: Sequence[str] = ("row",), rows_per_range: int = 1_000_000) -> DataFrame:
    """The group (`_g`, from 1) of each row among `groups` of nearly equal size, the first ones by score from the highest, as ntile
    deals them: by rank, so that no task orders all rows."""
    n = df.count()
    size, more = divmod(n, groups)
    at = F.col("_rank0")
    small = F.lit(more) if size == 0 else F.lit(more) + F.floor((at - more * (size + 1)) / max(size, 1))
    rows = ranked(df, score, ties=ties, rows_per_range=rows_per_range).withColumn("_rank0", F.col("rank") - 1).drop("rank")
    return rows.withColumn("_g", (F.when(at < more * (size + 1), F.floor(at / (size + 1))).otherwise(small) + 1).cast("long")).drop("_rank0")


def page_of(df: DataFrame, number: int, size: int, depth: int = 5000, score: str = "score") -> DataFrame:
    """Page `number` of rows by score: only the rows up to its end, at most `depth`, are ordered as a whole."""
    if number * size > depth:
        raise ValueError("page out of range")
    best = df.orderBy(F.col(score).desc_nulls_last(), "row").limit(max(0, number * size))
    return page(best.withColumn("rank", F.row_number().over(Window.orderBy(F.col(score).desc_nulls_last(), "row"))), number, size, depth)


def page(df: DataFrame, number: int, size: int, depth: int = 5000) -> DataFrame:
    """Page `number` (from 1) of ranked rows, not beyond `depth`."""
    if not 1 <= size <= 500 or number < 1 or number * size > depth:
        raise ValueError("page out of range")
    return df.where(F.col("rank").between((number - 1) * size + 1, number * size))


def export_columns(df: DataFrame, tag: str, prefix: str, *more: str) -> DataFrame:
    """The clip export table, and more of its columns; an unknown end is -1, times are in nanoseconds."""
    day = utc_day(F.col("chunk_start_unix"))
    uri = F.concat(F.lit(prefix), F.lit("dt="), day, F.lit("/"), F.col("run_uuid"), F.lit("_t"), F.col("chunk_start_unix").cast("string"), F.lit(".mp4"))
    ns = F.lit(1_000_000_000)
    return df.select(
        "rank", F.round("score", 6).alias("score"), "segment_id", chunk_id().alias("chunk_id"), "run_uuid", (F.col("chunk_start_unix") * ns).alias("start_timestamp_ns"),
        F.coalesce(F.col("chunk_end_unix") * ns, F.lit(-1)).alias("end_timestamp_ns"), uri.alias("source_media_uri"), "vehicle", F.lit(tag).alias("tag"), F.col("row").alias("corpus_row"), *more,
    )


def confidence(df: DataFrame, tau: float | None, score: str = "score") -> DataFrame:
    """0 at tau (or the least score), 1 at the best, null without a score. Both ends are aggregated, and come to the rows as one."""
    ends = df.agg(F.min(score).alias("_lo"), F.max(score).alias("_hi"))
    lo = F.lit(tau) if tau is not None else F.col("_lo")
    hi = F.greatest(F.col("_hi"), lo + 1e-6)
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col(score) - lo) / (hi - lo)))
    return df.crossJoin(F.broadcast(ends)).withColumn("confidence", F.when(F.col(score).isNotNull(), share)).drop("_lo", "_hi")  # one row


def passthrough(df: DataFrame, source: DataFrame, key: str = "segment_id") -> DataFrame:
    """Carry the source's other columns over by key; skipped without the key."""
    if key not in source.columns:
        return df
    return df.join(source.select(key, *[c for c in source.columns if c not in df.columns]), key, "left")


#: Rows of an export at most; the best ones stay.
MOST_EXPORTED = 2_000_000


def export(df: DataFrame, tau: float, *, since: float | None = None, include_below: bool = False, dedupe: bool = False, most: int = MOST_EXPORTED) -> DataFrame:
    """Ranked rows of an export: `above` says whether a score reaches tau; rows below go unless asked for. Rows older than
    `since` go before segments are reduced to their best row. Scores that are no number are left out; of more than `most`
    rows the best are exported."""
    df = df.where(F.col("score").isNotNull() & ~F.isnan("score"))
    if since is not None:
        df = df.where(F.col("created_at_unix_s") >= F.lit(since))
    df = df.withColumn("above", F.col("score").cast("float") >= F.lit(tau).cast("float"))
    if not include_below:
        df = df.where("above")
    if dedupe:
        df = first_per_segment(df, empty_is_none=True)
    best = order.top(df, most)
    return confidence(ranked(best), None if include_below else tau)


def interval_rows(intervals: DataFrame, corpus: DataFrame) -> DataFrame:
    """Ranked intervals with the names of their peak clips; bounds also in nanoseconds, an unknown name is empty."""
    names = corpus.select(F.col("row").alias("peak_row"), chunk_id().alias("peak_chunk_id"), "segment_id")
    r = ranked(intervals, "peak", ties=("run_uuid", "start_s")).join(names, "peak_row", "left")
    ns = lambda c: F.round(F.col(c) * 1_000_000_000).cast("long")
    return r.select(
        "rank", "run_uuid", F.round("peak", 6).alias("peak"), F.round("mean", 6).alias("mean"), F.round(F.col("end_s") - F.col("start_s"), 3).alias("seconds"),
        ns("start_s").alias("start_ns"), ns("end_s").alias("end_ns"), "num_cells", F.coalesce("peak_chunk_id", F.lit("")).alias("peak_chunk_id"), F.coalesce("segment_id", F.lit("")).alias("segment_id"),
    )


def page_of_score(df: DataFrame, score: float, size: int) -> DataFrame:
    """(page): that of the first ranked row whose score is at most the given one; null if there is none."""
    return df.where(F.col("score") <= F.lit(score)).agg((F.floor((F.min("rank") - 1) / size) + 1).alias("page"))


def interval_export(intervals: DataFrame, corpus: DataFrame, tag: str, prefix: str) -> DataFrame:
    """The interval export table: ranked intervals with the names, day and media of their peak clips."""
    r = interval_rows(intervals, corpus).withColumnRenamed("peak", "peak_score").withColumnRenamed("mean", "mean_score")
    start = F.regexp_extract("peak_chunk_id", r"#t([0-9]+)$", 1).try_cast("long")
    uri = F.concat(F.lit(prefix), F.lit("dt="), utc_day(start), F.lit("/"), F.col("run_uuid"), F.lit("_t"), start.cast("string"), F.lit(".mp4"))
    return r.select(
        "rank", "peak_score", "mean_score", "run_uuid", F.col("start_ns").alias("start_timestamp_ns"), F.col("end_ns").alias("end_timestamp_ns"),
        F.col("seconds").alias("duration_s"), F.col("num_cells").alias("num_chunks"), "segment_id", F.col("peak_chunk_id").alias("chunk_id"),
        F.coalesce(uri, F.lit("")).alias("source_media_uri"), F.lit(tag).alias("tag"),
    )
