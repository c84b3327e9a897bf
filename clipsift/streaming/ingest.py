"""Incremental upsert of clips by chunk id, and runs of hits as sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from clipsift.operators.catalog import latest
from clipsift.operators.commits import Commits


def read_clips(spark: SparkSession, path: str, schema: str, watermark: str = "1 hour") -> DataFrame:
    """A stream of Parquet files of clips, one event per chunk id within the watermark."""
    return spark.readStream.schema(schema).parquet(path).withWatermark("event_time", watermark).dropDuplicatesWithinWatermark(["chunk_id", "event_time"])


def log_of(spark: SparkSession, folder: str, schema: str) -> Commits:
    """The log of a stream's rows of a schema; batch: the number of the batch they came in."""
    return Commits(spark, folder, f"{schema}, batch long")


def upsert(stream: DataFrame, log: str, checkpoint: str, *, compact_every: int = 20) -> StreamingQuery:
    """Append batches to a log; `current` reads its latest rows. A batch is one commit that notes its number, so replays change
    nothing. Every so many batches the log is rewritten with the latest row of each chunk id only."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stream.schema.fields)

    def put(batch: DataFrame, number: int) -> None:
        commits = log_of(batch.sparkSession, log, schema)
        fresh = lambda _, state: batch.withColumn("batch", F.lit(number).cast("long")) if state.get("batch", -1) < number else None
        if commits.change(fresh, batch=number) and number % compact_every == compact_every - 1:
            commits.compact(newest)

    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(put).start()


def newest(rows: DataFrame) -> DataFrame:
    """The latest row of each chunk id."""
    return latest(rows, ["chunk_id"], ["event_time", "batch"])


def current(spark: SparkSession, log: str, schema: str) -> DataFrame:
    """The latest row of each chunk id of a log."""
    return newest(log_of(spark, log, schema).rows()).drop("batch")


def activity(events: DataFrame, size: str = "8 seconds", slide: str = "4 seconds") -> DataFrame:
    """Sliding windows of event counts by run; works on streams with a watermark and on tables."""
    return events.groupBy(F.window("event_time", size, slide), "run_uuid").agg(F.count(F.lit(1)).alias("n"))


def hit_runs(clips: DataFrame, tau: float, *, gap: str = "5 seconds") -> DataFrame:
    """(run_uuid, start, last, n, peak): hits (score >= tau) of a run that follow each other within `gap` or less. The same on
    tables and on streams with a watermark, which hold open sessions as state, take late hits into them (two sessions become
    one where a late hit closes the gap), and give a session when the watermark has passed it."""
    hits = clips.where(F.col("score") >= tau)
    runs = hits.groupBy("run_uuid", F.session_window("event_time", gap).alias("s")).agg(F.min("event_time").alias("start"), F.max("event_time").alias("last"), F.count(F.lit(1)).alias("n"), F.max("score").alias("peak"))
    return runs.select("run_uuid", "start", "last", "n", "peak")


def write_runs(runs: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Append closed sessions to a folder of Parquet, each once, from all that is there now."""
    return runs.writeStream.format("parquet").outputMode("append").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
