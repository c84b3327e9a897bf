"""The corpus of clips: one row per clip with its run, time, segment, vehicle and vector."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corpus view over `embeddings`: runs by label, a stride of 4 s with gaps, some null ends, segments and vehicles."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    k = F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1
    e = e.withColumn("k", k.cast("long"))
    start = F.lit(1704067200) + 86400 * F.col("label") + 4 * F.col("k") + 40 * F.floor(F.col("k") / 17)
    run = F.concat(F.lit("run-"), F.col("label").cast("string"))
    return e.select(
        F.col("vec_id").alias("row"),
        run.alias("run_uuid"),
        start.cast("long").alias("chunk_start_unix"),
        F.when(F.col("vec_id") % 13 != 0, (start + 8).cast("long")).alias("chunk_end_unix"),
        F.when(F.col("vec_id") % 11 == 0, None).when(F.col("vec_id") % 29 == 0, "").otherwise(F.concat(run, F.lit("-s"), F.floor(F.col("k") / 4).cast("string"))).alias("segment_id"),
        F.when(F.col("label") != 9, F.concat(F.lit("v"), (F.col("label") % 3).cast("string"))).alias("vehicle"),
        (start + 3600).cast("double").alias("created_at_unix_s"),
        F.col("embedding").alias("vec"),
    )


def required_columns(df: DataFrame, needed: tuple[str, ...] = ("run_uuid", "segment_id", "chunk_start_unix", "vec")) -> None:
    """Contract check at plan time."""
    missing = [c for c in needed if c not in df.columns]
    if missing:
        raise ValueError(f"the corpus lacks {', '.join(missing)}")


def key_column(columns: list[str]) -> str:
    """Column that a downsample table is keyed by, by priority."""
    for c in ("dx_internal_id", "segment_id", "scenario_id", "run_uuid"):
        if c in columns:
            return c
    raise ValueError("no key column")


def key_values(table: DataFrame) -> DataFrame:
    """Distinct keys of a downsample table, without null and empty ones."""
    c = key_column(table.columns)
    return table.select(F.col(c).cast("string").alias("key")).where("key is not null and key != ''").distinct()


def coverage(df: DataFrame, column: str) -> DataFrame:
    """n (non-null), total and pct of a column in one pass."""
    pct = F.round(100 * F.count(column) / F.count(F.lit(1)), 4)
    return df.agg(F.count(column).alias("n"), F.count(F.lit(1)).alias("total"), pct.alias("pct"))
