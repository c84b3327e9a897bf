"""Mutable catalog state as append-only logs: every change is a row, the present is the last row of each key.

Several drivers may write. A change reads one version of the log, decides by it, and becomes the next version only if no other
writer was first; else it is decided anew on what that writer left (`commits`). Readers see whole changes only.
"""

from __future__ import annotations

import functools
import hashlib
import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clipsift.operators.catalog import latest
from clipsift.operators.commits import Commits, Conflict

EXPORTS = "export_id string, seq long, status string, moved_at long, detail string"
MARKS = "tag string, version long, project string, chunk_id string, seq long, mark string, born long, by string"
TAGS = "tag string, seq long, version long, thresholds map<string,double>, stale array<string>, pinned long, deleted boolean, created_by string, created_at long, description string"
#: An export that has not moved for so long may be claimed anew.
RECLAIM_SECONDS = 3 * 3600
LONGEST_ERROR = 2000
#: Ids of a set of segments at most.
MOST_SEGMENTS = 500_000
#: A change gives up after so many other writers that were first.
MOST_TRIES = 50


class SetSize(ValueError):
    """A set of no ids, or of too many."""


def export_id(request: dict) -> str:
    """The same for equal requests, whatever the order of their keys."""
    return hashlib.sha1(json.dumps(request, sort_keys=True, separators=(",", ":")).encode()).hexdigest()[:20]


def change(f):
    """A method that reads the present and appends: decided and written as one, again if another writer was first. Within another
    change it is a part of that."""

    @functools.wraps(f)
    def run(self, *args, **named):
        if self._at is not None:
            return f(self, *args, **named)
        for _ in range(MOST_TRIES):
            self._at, self._fresh = self.log.version(), []
            try:
                at, out, fresh = self._at, f(self, *args, **named), self._fresh
            finally:
                self._at, self._fresh = None, []
            if not fresh:
                return out
            if self.log.put(at + 1, self.spark.createDataFrame(fresh, self.schema).coalesce(1)):
                self.log.tidy()
                return out
        raise Conflict(f"{MOST_TRIES} times another writer was first in {self.path}")

    return run


class _Log:
    schema = ""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path
        self.log = Commits(spark, path, self.schema)
        self._at: int | None = None  # the version that a change is decided on
        self._fresh: list[tuple] = []

    def rows(self) -> DataFrame:
        return self.log.rows(self._at)

    def _append(self, *rows: tuple) -> None:
        self._fresh += rows

    def _next(self) -> int:
        return (self.rows().agg(F.max("seq")).first()[0] or 0) + 1 + len(self._fresh)


class Exports(_Log):
    """Export jobs: claimed (pending), running, ready or error."""

    schema = EXPORTS

    def current(self) -> DataFrame:
        return latest(self.rows(), ["export_id"], ["seq"]).where("status != 'gone'")

    def state(self, key: str) -> str | None:
        r = self.current().where(F.col("export_id") == key).first()
        return r and r["status"]

    @change
    def claim(self, key: str, now: int) -> bool:
        """Whether the caller has the job: it is new, failed to move for RECLAIM_SECONDS, or ended in an error."""
        r = self.current().where(F.col("export_id") == key).first()
        if r and r["status"] != "error" and (r["status"] == "ready" or now - r["moved_at"] < RECLAIM_SECONDS):
            return False
        self._append((key, self._next(), "pending", now, None))
        return True

    @change
    def move(self, key: str, status: str, now: int, detail: str | None = None) -> None:
        """running, ready (detail: where the result is) or error (detail: why, cut to LONGEST_ERROR characters)."""
        if status not in ("running", "ready", "error"):
            raise ValueError(f"no such status: {status}")
        self._append((key, self._next(), status, now, detail and detail[:LONGEST_ERROR]))

    @change
    def forget_error(self, key: str, now: int) -> None:
        if self.state(key) == "error":
            self._append((key, self._next(), "gone", now, None))


class Tags(_Log):
    """Versioned tags with a threshold for each project; thresholds that a new version inherits are stale."""

    schema = TAGS

    def versions(self) -> DataFrame:
        """Last state of each version of the tags that are not deleted."""
        rows = self.rows()
        gone = latest(rows, ["tag"], ["seq"]).where("deleted").select("tag")
        since = rows.where("deleted").groupBy("tag").agg(F.max("seq").alias("_since"))
        live = rows.join(gone, "tag", "left_anti").join(since, "tag", "left").where((F.col("seq") > F.coalesce("_since", F.lit(0))) & ~F.col("deleted"))
        return latest(live.drop("_since"), ["tag", "version"], ["seq"])

    def resolve(self, tag: str, version: int | None = None):
        """The asked, else the pinned, else the latest version's row; None for unknown and deleted ones."""
        rows = {r["version"]: r for r in self.versions().where(F.col("tag") == tag).collect()}  # versions of one tag
        if not rows:
            return None
        last = rows[max(rows)]
        return rows.get(version if version is not None else last["pinned"] or last["version"])

    def _put(self, r, **changes) -> None:
        new = {**r.asDict(), **changes, "seq": self._next()}
        self._append(tuple(new[c] for c in self._names()))

    @change
    def create(self, tag: str, project: str, threshold: float, by: str, now: int, description: str = "") -> None:
        """Version 1, or the project's threshold on the latest version; a project that has one already is a conflict. A tag that
        was deleted starts anew, without its versions and marks. A description is that of all versions."""
        r = self.resolve(tag, None)
        if r is None:
            self._append((tag, self._next(), 1, {project: threshold}, [], None, False, by, now, description))
            return
        r = max(self._known(tag), key=lambda r: r["version"])
        if project in r["thresholds"]:
            raise ValueError(f"{tag} has a threshold for {project}")
        self._put(r, thresholds={**r["thresholds"], project: threshold})
        if description:
            self.update(tag, description=description)

    @change
    def new_version(self, tag: str, project: str, threshold: float, by: str, now: int) -> int:
        """The next version; other projects' thresholds are carried over as stale."""
        known = self._known(tag)
        last = max(known, key=lambda r: r["version"])
        self._put(last, version=last["version"] + 1, thresholds={**last["thresholds"], project: threshold}, stale=sorted(set(last["thresholds"]) - {project}), created_by=by, created_at=now)
        return last["version"] + 1

    @change
    def set_threshold(self, tag: str, version: int, project: str, threshold: float) -> None:
        r = self.resolve(tag, version)
        if r is None:
            raise KeyError(f"{tag} v{version}")
        self._put(r, thresholds={**r["thresholds"], project: threshold}, stale=[p for p in r["stale"] if p != project])

    @change
    def update(self, tag: str, **fields) -> None:
        """Set pinned (a version up to the latest, or None) and description on all versions at once."""
        if not fields or set(fields) - {"pinned", "description"}:
            raise ValueError("pinned or description is needed")
        now = {r["version"]: r.asDict() for r in self._known(tag)}
        now |= {r[2]: dict(zip(self._names(), r, strict=True)) for r in self._fresh if r[0] == tag}
        pinned = fields.get("pinned")
        if pinned is not None and not 1 <= pinned <= max(now):
            raise ValueError("no such version")
        for r in now.values():
            self._append(tuple({**r, **fields, "seq": self._next()}[c] for c in self._names()))

    def pin(self, tag: str, version: int | None) -> None:
        self.update(tag, pinned=version)

    @staticmethod
    def _names() -> list[str]:
        return [c.split()[0] for c in TAGS.split(", ")]

    def born(self) -> DataFrame:
        """(tag, born): of living tags, the number of the change that last deleted them, else 0."""
        rows = self.rows()
        lives = latest(rows, ["tag"], ["seq"]).where("not deleted").select("tag")
        return lives.join(rows.where("deleted").groupBy("tag").agg(F.max("seq").alias("born")), "tag", "left").select("tag", F.coalesce("born", F.lit(0).cast("long")).alias("born"))

    @change
    def delete(self, tag: str) -> None:
        """Soft: a tag that is created again starts anew. A pinned tag stays."""
        known = self._known(tag)
        if any(r["pinned"] for r in known):
            raise ValueError(f"{tag} is pinned")
        self._put(known[0], deleted=True)

    def _known(self, tag: str) -> list:
        rows = self.versions().where(F.col("tag") == tag).collect()
        if not rows:
            raise KeyError(tag)
        return rows


class Marks(_Log):
    """Marks of clips, up or down, by version of a tag; the last one of a clip counts. A mark belongs to the life of its tag in which
    it was set: deleting the tag and creating it again needs no change here, as marks of an earlier life are not shown."""

    schema = MARKS

    @change
    def add(self, tags: Tags, tag: str, version: int, project: str, marks: dict[str, str], by: str = "") -> int:
        """Marks (up or down) by name of the clip; how many. An unknown tag or version is an error."""
        wrong = sorted(set(marks.values()) - {"up", "down"})
        if wrong:
            raise ValueError(f"a mark is up or down, not {', '.join(wrong)}")
        if tags.resolve(tag, version) is None:
            raise KeyError(f"{tag} v{version}")
        born = tags.born().where(F.col("tag") == tag).first()["born"]
        for name, mark in marks.items():
            self._append((tag, version, project, name, self._next(), mark, born, by))
        return len(marks)

    def current(self, tags: Tags) -> DataFrame:
        """Marks of living tags, set since they were last created."""
        return living_marks(self.rows(), tags.born())


def living_marks(marks: DataFrame, born: DataFrame) -> DataFrame:
    """The last mark of each clip of a version, of those that were set in the present life of their tag (tag, born)."""
    return latest(marks.join(born, ["tag", "born"]), ["tag", "version", "chunk_id"], ["seq"]).drop("born")


def thresholds_by_project(versions: DataFrame) -> DataFrame:
    """(tag, project, threshold, version, stale): each project's last threshold; stale if a later version did not set it."""
    top = F.max("version").over(Window.partitionBy("tag"))
    now = latest(versions.withColumn("_top", top), ["tag", "project"], ["version"])
    return now.select("tag", "project", "threshold", "version", (F.col("version") < F.col("_top")).alias("stale"))


def one_per_tag(tags: DataFrame) -> DataFrame:
    """Of rows of one tag, the one with a vector, then the newest, then the largest id."""
    return latest(tags, ["tag"], [F.col("has_vector").desc(), F.col("created_at").desc(), F.col("id").desc()])


def register_set(df: DataFrame, column: str = "segment_id", most: int = MOST_SEGMENTS) -> DataFrame:
    """Distinct non-empty ids in order; none, or more than `most`, is an error."""
    ids = df.select(column).where(F.col(column).isNotNull() & (F.col(column) != "")).distinct()
    n = ids.count()
    if not 0 < n <= most:
        raise SetSize(f"a set of {n} ids")
    return ids.orderBy(column)


def find_sets(sets: DataFrame, text: str) -> DataFrame:
    """Sets with a uuid, a name and a version other than 0 whose name holds every token, by name and newest version."""
    df = sets.where("version != 0 and uuid is not null and name is not null and name != ''")
    for token in text.lower().split():
        df = df.where(F.lower("name").contains(token))
    return df.orderBy("name", F.col("version").desc())


def set_usage(uses: DataFrame) -> DataFrame:
    """By set: name, uses, last use and rows, the last used first."""
    out = uses.groupBy("uuid").agg(F.max("name").alias("name"), F.count(F.lit(1)).alias("uses"), F.max("ts").alias("last"), F.sum("n_rows").alias("n_rows"))
    return out.orderBy(F.col("last").desc(), "uuid")


def internal_ids(df: DataFrame, lookup: DataFrame, key: str = "row", *, drop: bool = False) -> DataFrame:
    """Carry the lookup's internal_id over, null where it has none; of several the least; rows without one go if asked."""
    out = df.join(lookup.groupBy(key).agg(F.min("internal_id").alias("internal_id")), key, "left")
    return out.where("internal_id is not null") if drop else out


def zipped_ids(ids: DataFrame, bits: DataFrame) -> DataFrame:
    """(segment_id, internal_id): the n-th id in order with the n-th number; unequal lengths are an error. For one set (up to
    500,000 ids): each side is numbered in one task."""
    a, b = ids.count(), bits.count()
    if a != b:
        raise ValueError(f"{a} ids and {b} numbers")
    n = lambda df, c: df.select(c, F.row_number().over(Window.orderBy(c)).alias("_n"))
    return n(ids, "segment_id").join(n(bits, "internal_id"), "_n").select("segment_id", "internal_id")


def tag_record(versions: DataFrame) -> DataFrame:
    """(tag, versions, n): the versions of each tag, the newest first, as text."""
    newest = F.sort_array(F.collect_list("version"), asc=False)
    return versions.groupBy("tag").agg(F.array_join(newest.cast("array<string>"), ",").alias("versions"), F.count(F.lit(1)).alias("n"))


def backfill(log: DataFrame, tags: DataFrame) -> DataFrame:
    """(tag, threshold, uri, status) of logged exports (id, tag, has_vector, threshold, uri) whose tag is named, has a vector and
    is not known yet; of one tag the first. A threshold of 0 or less is none; one with a file is ready."""
    fresh = log.where("tag is not null and tag != '' and has_vector").join(tags.select("tag").distinct(), "tag", "left_anti")
    first = latest(fresh, ["tag"], [F.col("id").asc()])
    return first.select("tag", F.when(F.col("threshold") > 0, F.col("threshold")).alias("threshold"), "uri", F.when(F.col("uri") != "", "ready").alias("status"))
