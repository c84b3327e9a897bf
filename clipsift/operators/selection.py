"""Screened selection: int8 scores with a proved error bound, exact scores only where the bound cannot decide."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clipsift.operators.vectors import bound_cauchy, directions, dot, literal, maxsim, mean_vector, quantise, weights
from clipsift.sources.clips import key_column, key_values


@dataclass(frozen=True)
class Screen:
    """Unit directions, scale per dimension and error bound."""

    queries: Sequence[Sequence[float]]
    scale: Sequence[float]

    @property
    def eps(self) -> float:
        return bound_cauchy(self.scale)

    def apply(self, df: DataFrame) -> DataFrame:
        """Add score, from the quantised vectors; a null vector counts as zeros."""
        i8 = quantise(F.col("vec"), self.scale)
        return df.withColumn("score", F.coalesce(F.round(maxsim(i8, [weights(q, self.scale) for q in self.queries]), 9), F.lit(0.0)))

    def exact(self) -> Column:
        return F.coalesce(F.round(F.array_max(F.array(*[dot(F.col("vec"), literal(q)) for q in self.queries])), 9), F.lit(0.0))


def classify(score: Column, tau: float, eps: float) -> Column:
    """above: surely over tau; below: surely under; band: undecided (closed below, open above)."""
    return F.when(score >= F.lit(tau + eps), "above").when(score < F.lit(tau - eps), "below").otherwise("band")


def ordered(df: DataFrame, score: str = "score") -> DataFrame:
    return df.orderBy(F.col(score).desc(), F.col("row").asc())


def kth_score(scored: DataFrame, k: int) -> float | None:
    """Score of the k-th row (the last if there are fewer); one number reaches the driver."""
    return scored.orderBy(F.col("score").desc()).limit(k).agg(F.min("score")).first()[0]


def select(corpus: DataFrame, screen: Screen, *, k: int | None = None, tau: float | None = None, refine: bool = True) -> DataFrame:
    """Rows by top k or by threshold, with score, class and exact (null where not needed).

    k: candidates are all rows within twice the bound of the k-th screened score; with refine they are ordered by exact
    scores. tau: rows surely above, and those of the band whose exact score reaches tau, by score; scores stay screened.
    """
    if (k is None) == (tau is None):
        raise ValueError("exactly one of k and tau")
    scored = screen.apply(corpus)
    if k is not None and not refine:
        return ordered(scored.withColumn("class", F.lit("above")).withColumn("exact", F.lit(None).cast("double"))).limit(k)
    if k is not None:
        cut = kth_score(scored, k)
        if cut is None:
            return scored.withColumn("class", F.lit("above")).withColumn("exact", F.col("score"))
        window = scored.withColumn("class", classify(F.col("score"), cut, 2 * screen.eps)).where("class != 'below'")
        return ordered(window.withColumn("exact", screen.exact()), "exact").limit(k)
    kept = scored.withColumn("class", classify(F.col("score"), tau, screen.eps)).where("class != 'below'")
    exact = F.when(F.col("class") == "band", screen.exact())
    kept = kept.withColumn("exact", exact if refine else F.lit(None).cast("double"))
    return ordered(kept.where((F.col("class") == "above") | (F.coalesce("exact", "score") >= tau)))


def filtered(
    df: DataFrame,
    *,
    vehicles: Sequence[str] | None = None,
    runs: Sequence[str] | None = None,
    segments: DataFrame | None = None,
    since: int | None = None,
    until: int | None = None,
    exclude: Sequence[int] | None = None,
) -> DataFrame:
    """All filters joined by and; None does not filter, an empty set matches nothing, nulls never match a set."""
    for column, values in (("vehicle", vehicles), ("run_uuid", runs)):
        if values is not None:
            df = df.where(F.col(column).isin(list(values)) if len(values) else F.lit(False))
    if segments is not None:
        df = df.join(segments.select("segment_id").distinct(), "segment_id", "left_semi")
    if since is not None:
        df = df.where(F.col("chunk_start_unix") >= since)
    if until is not None:
        df = df.where(F.col("chunk_start_unix") < until)
    if exclude:
        df = df.where(~F.col("row").isin(list(exclude)))
    return df


def window_rows(df: DataFrame, *, run: str | None = None, segment: str | None = None, start: int = 0, end: int = 0) -> DataFrame:
    """Clips of a run or segment that overlap [start, end), by start; 0 leaves a side open, a null end is start + 8."""
    if run is None and segment is None:
        raise ValueError("a run or a segment is needed")
    if run is not None:
        df = df.where(F.col("run_uuid") == run)
    if segment is not None:
        df = df.where(F.col("segment_id") == segment)
    if start:
        df = df.where(F.coalesce("chunk_end_unix", F.col("chunk_start_unix") + 8) > start)
    if end:
        df = df.where(F.col("chunk_start_unix") < end)
    return df.orderBy("chunk_start_unix", "row")


#: Clips of a window that are pooled, and directions of one query, at most.
MOST_POOLED, MOST_DIRECTIONS = 512, 64


def window_directions(window: DataFrame, *, pooling: str = "mean", most: int = MOST_POOLED) -> list[list[float]]:
    """Unit directions of a window's clips with a vector, of the `most` that start first: their mean, or by `individual` each one
    (up to MOST_DIRECTIONS). No such clips, or a mean of zero, are errors."""
    if pooling not in ("mean", "individual"):
        raise ValueError("pooling is mean or individual")
    held = window.where("vec is not null").orderBy("chunk_start_unix", "row").limit(most)
    if pooling == "mean":
        mean = mean_vector(held)
        if not mean:
            raise ValueError("no embedded clips in the window")
        return directions([mean])
    found = [[float(x) for x in r["vec"]] for r in held.select("vec").limit(MOST_DIRECTIONS + 1).collect()]
    return directions(found, MOST_DIRECTIONS)


def vehicles(df: DataFrame) -> list[str]:
    """Names of the vehicles, in order, without null and empty ones."""
    return [r["vehicle"] for r in df.where("vehicle is not null and vehicle != ''").select("vehicle").distinct().orderBy("vehicle").collect()]


def downsampled(df: DataFrame, table: DataFrame) -> DataFrame:
    """Rows whose segment (or scenario, which is a segment by another name) or run is in a table that is keyed by it. A table of
    numbers that only few rows have is refused, as it would drop nearly all of them without a word."""
    column = key_column(table.columns)
    at = {"segment_id": "segment_id", "scenario_id": "segment_id", "run_uuid": "run_uuid"}.get(column)
    if at is None:
        raise ValueError(f"a table keyed by {column} cannot filter; give one keyed by segment_id or run_uuid")
    return df.join(key_values(table).withColumnRenamed("key", at), at, "left_semi")


def resolve_chunks(df: DataFrame, wanted: DataFrame) -> DataFrame:
    """(chunk_id, row) of `run#tSTART` names; the first row wins, unknown names are left out."""
    parsed = wanted.select("chunk_id", F.regexp_extract("chunk_id", r"^(.+)#t([0-9]+)$", 1).alias("run_uuid"), F.regexp_extract("chunk_id", r"^(.+)#t([0-9]+)$", 2).alias("t"))
    parsed = parsed.where("t != ''").select("chunk_id", "run_uuid", F.expr("try_cast(t as bigint)").alias("chunk_start_unix"))
    return parsed.join(df, ["run_uuid", "chunk_start_unix"]).groupBy("chunk_id").agg(F.min("row").alias("row"))


def cut_to(df: DataFrame, *, k: int | None = None, max_rows: int = 0) -> tuple[DataFrame, bool]:
    """(rows, truncated): with k at most k rows, never truncated; else at most max_rows (0: all), truncated if there are more."""
    if k is not None:
        return ordered(df).limit(k), False
    if not max_rows or df.limit(max_rows + 1).count() <= max_rows:
        return df, False
    return ordered(df).limit(max_rows), True


def day_bounds(first: str | None, last: str | None, held: tuple[int, int] | None = None) -> tuple[int | None, int | None]:
    """ISO days to seconds from 00:00 of the first to 00:00 after the last, in UTC. With the first and last start that the corpus
    holds, a side that begins on or before its first day, or ends on or after its last, is open."""
    if held is not None:
        lo, hi = (datetime.fromtimestamp(x, timezone.utc).date().isoformat() for x in held)
        first = None if first is not None and first <= lo else first
        last = None if last is not None and last >= hi else last
    at = lambda d: int(datetime.fromisoformat(d).replace(tzinfo=timezone.utc).timestamp())
    return (at(first) if first else None), (at(last) + 86400 if last else None)


def merged(*filters: dict[str, set[str] | None]) -> dict[str, set[str] | None]:
    """Filters by key, intersected; None does not filter, an empty set stays empty."""
    out: dict[str, set[str] | None] = {}
    for f in filters:
        for k, v in f.items():
            old = out.get(k)
            out[k] = v if old is None else old if v is None else old & v
    return out


def unresolved_chunks(df: DataFrame, wanted: DataFrame) -> DataFrame:
    """Names that resolve_chunks leaves out."""
    return wanted.select("chunk_id").distinct().join(resolve_chunks(df, wanted), "chunk_id", "left_anti")


def take(df: DataFrame, rows: Sequence[int], *columns: str) -> DataFrame:
    """Rows by number in the caller's order, with their place in it; unknown numbers are left out."""
    wanted = df.sparkSession.createDataFrame([(i, int(r)) for i, r in enumerate(rows)], "place int, row long")
    return df.select("row", *columns).join(F.broadcast(wanted), "row").orderBy("place")  # as many as the caller names


def rescore(df: DataFrame, names: DataFrame, score: Column, name: Column) -> DataFrame:
    """(row, chunk_id, score) of (row, chunk_id) pairs; a row that has another name than the caller's stops the query."""
    found = df.select("row", name.alias("_name"), score.alias("score")).join(names, "row")
    same = F.when(F.col("_name").eqNullSafe(F.col("chunk_id")), F.col("score")).otherwise(F.raise_error(F.concat(F.lit("row "), F.col("row").cast("string"), F.lit(" has another name"))))
    return found.select("row", "chunk_id", same.alias("score"))


def span(df: DataFrame) -> DataFrame:
    """(rows, embedded, first, last, vehicles): what a corpus holds; times are 0 without rows."""
    return df.agg(
        F.count(F.lit(1)).alias("rows"), F.count("vec").alias("embedded"), F.coalesce(F.min("chunk_start_unix"), F.lit(0)).alias("first"),
        F.coalesce(F.max("chunk_start_unix"), F.lit(0)).alias("last"), F.countDistinct(F.when(F.col("vehicle") != "", F.col("vehicle"))).alias("vehicles"),
        F.coalesce(F.bool_or(F.col("segment_id").isNotNull() & (F.col("segment_id") != "")), F.lit(False)).alias("has_segments"),
    )
