"""Versioned tags, marks, an idempotent export ledger and usage counts, as append-only logs with latest-wins views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, key: list[str], order: list[str | Column]) -> DataFrame:
    """The last row of each key."""
    w = Window.partitionBy(*key).orderBy(*[F.desc(o) if isinstance(o, str) else o for o in order])
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def tag_versions(events: DataFrame) -> DataFrame:
    """Tag log over `events`: one tag a user, a version an event."""
    v = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return events.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("tag"), v.cast("long").alias("version"), (F.col("value") / 1000).alias("threshold"), F.col("event_type").alias("project"), F.col("ts").alias("created_at"), "event_id")


def list_tags(versions: DataFrame, *, project: str | None = None, text: str | None = None, creator: str | None = None, number: int = 1, size: int = 50) -> DataFrame:
    """A page of latest versions, newest first. Text is looked for in the name and, if there is one, the description; the
    creator is that of the latest version."""
    if not 1 <= size <= 500:
        raise ValueError("size is 1 to 500")
    now = latest(versions, ["tag"], ["version"])
    if project is not None:
        now = now.where(F.col("project") == project)
    if text is not None:
        found = F.lower("tag").contains(text.lower())
        if "description" in now.columns:
            found = found | F.coalesce(F.lower("description").contains(text.lower()), F.lit(False))
        now = now.where(found)
    if creator is not None:
        now = now.where(F.col("created_by") == creator)
    return now.orderBy(F.col("created_at").desc(), "tag").offset((number - 1) * size).limit(size)


def resolve_version(versions: DataFrame, pins: DataFrame) -> DataFrame:
    """(tag, version): the pinned one, else the latest."""
    last = versions.groupBy("tag").agg(F.max("version").alias("_last"))
    return last.join(pins.select("tag", "pinned_version"), "tag", "left").select("tag", F.coalesce("pinned_version", "_last").alias("version"))


def marks(events: DataFrame) -> DataFrame:
    """Latest mark of each (user, chunk): clicks are up, errors down."""
    k = F.get_json_object("props", "$.k").cast("long")
    m = events.where("event_type in ('click', 'error')").select("user_id", k.alias("chunk"), F.when(F.col("event_type") == "click", "up").otherwise("down").alias("mark"), "ts", "event_id")
    return latest(m, ["user_id", "chunk"], ["ts", "event_id"]).select("user_id", "chunk", "mark")


def reclaimable(ledger: DataFrame, now: Column, hours: int = 3) -> DataFrame:
    """Exports that are pending or running and have not moved for `hours`."""
    old = F.col("started_at") < now - F.expr(f"interval {hours} hours")
    return ledger.where(F.col("status").isin("pending", "running") & old)


def usage(events: DataFrame) -> DataFrame:
    """Queries by text: count and last time, most used first, ties by text."""
    q = F.concat_ws(" ", "event_type", F.get_json_object("props", "$.k"))
    return events.where("event_type = 'click'").groupBy(F.trim(q).alias("query")).agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("last")).orderBy(F.col("n").desc(), "query")


def feedback_backfill(log: DataFrame, ledger: DataFrame) -> DataFrame:
    """Marks of exploded export rows that the ledger lacks; of equal keys the first id."""
    rows = log.select("id", "query", "user_email", F.explode("segments").alias("segment_id"))
    fresh = rows.join(ledger.select("query", "segment_id", "user_email").distinct(), ["query", "segment_id", "user_email"], "left_anti")
    return latest(fresh, ["query", "segment_id", "user_email"], [F.col("id").asc()])


def record(versions: DataFrame, exports: DataFrame) -> DataFrame:
    """(tag, versions, exports): of each tag its version numbers and the ids of its exports, newest first."""
    newest = lambda by, what: F.transform(F.reverse(F.array_sort(F.collect_list(F.struct(F.col(by).alias("by"), F.col(what).alias("what"))))), lambda x: x["what"])
    made = exports.groupBy("tag").agg(newest("finished_at", "export_id").alias("exports"))
    return versions.groupBy("tag").agg(newest("version", "version").alias("versions")).join(made, "tag", "left")


def version_marks(given: DataFrame, *, order: list[str]) -> tuple[DataFrame, int]:
    """(the last mark of each tag, version and chunk; how many were given)."""
    return latest(given, ["tag", "version", "chunk"], order).select("tag", "version", "chunk", "mark"), given.count()
