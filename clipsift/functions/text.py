"""String and time functions of columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def slug(c: Column, most: int = 40) -> Column:
    """Lower case, runs of other characters than a-z and 0-9 one underscore, none at the ends, at most `most` characters."""
    return F.left(F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), F.lit("_")), F.lit(most))


def vehicle_of(segment: Column) -> Column:
    """Vehicle in a segment id: trailing -digits (15 or more) go; of the parts by _, the last if the first is a date, else the first."""
    s = F.regexp_replace(segment, r"(-\d{15,})+$", "")
    first = F.substring_index(s, "_", 1)
    return F.when(first.rlike(r"^\d{4}-\d{2}-\d{2}"), F.substring_index(s, "_", -1)).otherwise(first)


def query_key(c: Column) -> Column:
    """Normal form of a query text."""
    return F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))


def items_of(c: Column) -> Column:
    """Items of a list parted by commas or blanks, empty ones dropped."""
    return F.filter(F.split(c, r"[,\s]+"), lambda x: x != "")


def utc(seconds: Column) -> Column:
    """ISO text in UTC, whatever the session's time zone."""
    part = lambda per, of: F.lpad(F.pmod(F.floor(seconds / per), F.lit(of)).cast("string"), 2, "0")
    return F.concat(utc_day(seconds), F.lit("T"), F.concat_ws(":", part(3600, 24), part(60, 60), part(1, 60)), F.lit("Z"))


def utc_day(seconds: Column) -> Column:
    """ISO day in UTC, whatever the session's time zone."""
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor(seconds / 86400).cast("int")).cast("string")


def valid_tag(c: Column) -> Column:
    return F.trim(c).rlike(r"^[a-z0-9_]{1,64}$")


def chunk_run(c: Column) -> Column:
    """Run of a `run#tSTART` name; empty if it is none."""
    return F.regexp_extract(c, r"^(.+)#t([0-9]+)$", 1)


def chunk_start(c: Column) -> Column:
    """Start of a `run#tSTART` name in seconds; null if it is none."""
    return F.regexp_extract(c, r"^(.+)#t([0-9]+)$", 2).try_cast("long")


def seconds_of(c: Column) -> Column:
    """Seconds of a number that is either seconds or, from 1e12 on, nanoseconds."""
    return F.when(c < 1_000_000_000_000, c.cast("double")).otherwise(c / 1_000_000_000)


def score_class(c: Column) -> Column:
    """Colour class of a score."""
    return F.when(c > 0.32, "high").when(c > 0.24, "good").when(c > 0.16, "fair").otherwise("low")


def uri_key(c: Column) -> Column:
    """Cache name of an address: up to 40 safe characters of its last part, and 16 digits of its hash."""
    last = F.left(F.regexp_replace(F.substring_index(c, "/", -1), "[^A-Za-z0-9._-]+", "_"), F.lit(40))
    return F.concat(last, F.lit("-"), F.left(F.sha2(c.cast("binary"), 256), F.lit(16)))


def bucket_of(c: Column) -> Column:
    """Bucket of an s3:// or s3a:// address; empty for others."""
    return F.regexp_extract(c, r"^s3a?://([^/]+)/(.+)$", 1)


def path_of(c: Column) -> Column:
    return F.regexp_extract(c, r"^s3a?://([^/]+)/(.+)$", 2)


def routed(c: Column, prefixes: list[tuple[str, str]], default: str) -> Column:
    """Project of the first registered prefix that fits."""
    return F.coalesce(*[F.when(c.startswith(p), F.lit(project)) for p, project in prefixes], F.lit(default))


def seconds_until(hhmm: str, now_seconds: int) -> int:
    """Seconds from a second of the day to the next HH:MM in UTC; a whole day if it is now."""
    h, m = (int(x) for x in hhmm.split(":"))
    if not (0 <= h < 24 and 0 <= m < 60):
        raise ValueError(f"not a time of day: {hhmm}")
    return (h * 3600 + m * 60 - now_seconds - 1) % 86400 + 1
