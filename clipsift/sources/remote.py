"""Sets of segment ids that a service hands out in pages, and corpus versions."""

from __future__ import annotations

import uuid as ids
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clipsift.session import remove_folder
from clipsift.sources.readers import PAGE, Fetch, register_pages


class NotReady(RuntimeError):
    """A set that is still being loaded; ask again later."""


def remote_set(spark: SparkSession, fetch: Fetch, uuid: str, path: str, size: int = PAGE, cursors: Callable[[str, int], list[str]] | None = None) -> DataFrame:
    """Distinct ids (segment_id) of a remote set, which executors fetch and write to `path`; `cursors` splits it into tasks (see
    `register_pages`). The pages go to a folder beside it, which takes the name only when all are there: after a fetch that
    failed there is no set, or the one that was there before."""
    register_pages(spark, fetch, cursors)
    beside = f"{path.rstrip('/')}.{ids.uuid4().hex}"
    try:
        spark.read.format("segment_pages").option("set", uuid).option("pageSize", size).load().write.parquet(beside)
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        system = hadoop(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        remove_folder(spark, path)
        if not system.rename(hadoop(beside), hadoop(path)):
            raise OSError(f"{path} could not be published")
    finally:
        remove_folder(spark, beside)
    return spark.read.parquet(path).distinct()


def set_filter(df: DataFrame, ids: DataFrame | None, status: str = "ready") -> DataFrame:
    """Rows whose segment is in the set. A set that is loading, failed or empty is refused, not taken for no filter."""
    if status == "loading":
        raise NotReady("the segment set is still loading")
    if status == "error" or ids is None:
        raise ValueError("the segment set could not be read")
    if ids.isEmpty():
        raise ValueError("the segment set is empty")
    return df.join(ids.select("segment_id").distinct(), "segment_id", "left_semi").select(*df.columns)


def since_version(df: DataFrame, versions: DataFrame, version: int, *, created: str = "created_at_unix_s") -> DataFrame:
    """Rows created at or after the commit (version, committed_at) of a corpus version; an unknown one is refused."""
    at = versions.where(F.col("version") == version).agg(F.max("committed_at")).first()[0]
    if at is None:
        raise ValueError(f"corpus version {version} is unknown")
    return df.where(F.col(created) >= F.lit(at))
