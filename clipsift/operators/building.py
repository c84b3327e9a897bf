"""An export built in one call from a written corpus: filters, selection, exact order, the artifact, its figures and a segment set.

The codes decide what is selected; exact vectors are read for the selected rows only, by `cascade.fetched`, which sends or
shuffles the rows by their counted number. Ranks are dealt by ranges of the score, so no task orders the whole artifact.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clipsift.operators import cascade, exporting, ledger, order, selection
from clipsift.operators import intervals as iv
from clipsift.operators.selection import Screen
from clipsift.session import checkpointed
from clipsift.sinks import files


@dataclass(frozen=True)
class Request:
    """What is exported of a tag.

    One of k and tau selects; with `below` all filtered rows are exported and both, tau before k, or none only mark a cutoff.
    filters: arguments of `selection.filtered`; since: rows must be created by then or later. Both act before a cut.
    by_interval: intervals of the rows instead of clips; by_segment: the best clip of each segment. segment_set: folder of a set
    to be written of the exported segments.
    """

    tag: str
    version: int
    project: str
    corpus_version: str
    prefix: str = ""
    k: int | None = None
    tau: float | None = None
    filters: dict = field(default_factory=dict)
    since: float | None = None
    below: bool = False
    by_interval: bool = False
    by_segment: bool = False
    confidence: bool = False
    segment_set: str | None = None
    most: int = exporting.MOST_EXPORTED


@dataclass(frozen=True)
class Built:
    """path and format of the artifact; cutoff (None: there is none); rows without an exact score; rows that reach the cutoff, if
    rows below were asked for; segments of the set, or why there is none."""

    path: str
    output: str
    num_rows: int
    cutoff: float | None
    rows_unscorable: int
    rows_above: int | None = None
    set_segments: int | None = None
    set_error: str | None = None


def chosen(corpus: cascade.Written, screen: Screen, request: Request, *, queries: Sequence[Sequence[float]] | None = None, most_sent: int = cascade.MOST_SENT) -> tuple[DataFrame, float | None]:
    """(rows of codes with their exact score, cutoff). A score that is no number is null. Of more than `most` rows the best by
    screened score are taken. The cutoff is tau; else the least exact score, or with `below` the k-th screened one."""
    codes = selection.filtered(corpus.codes, **request.filters)
    if request.since is not None:
        codes = codes.where(F.col("created_at_unix_s") >= F.lit(request.since))
    of, directions = cascade.Written(codes, corpus.vectors), queries or screen.queries
    if request.below:
        best = order.top(cascade.scores(codes, screen), request.most).withColumn("exact", F.lit(None).cast("double"))
    else:
        found = cascade.select(of, screen, k=request.k, tau=request.tau, queries=queries, most_sent=most_sent)
        best = found.select("row", "score", "exact") if request.k is not None else order.top(found.select("row", "score", "exact"), request.most)
    best = checkpointed(best)
    missing = cascade.fetched(corpus.vectors, best.where("exact is null"), directions, most_sent=most_sent).withColumnRenamed("exact", "_exact")
    exact = F.nanvl(F.coalesce("exact", "_exact"), F.lit(None).cast("double"))
    few = best.join(missing, "row", "left").select("row", F.col("score").alias("_screened"), exact.alias("score"))
    rows = checkpointed(codes.drop("i8").join(few, "row"))
    cutoff = request.tau
    if cutoff is None and request.below:
        n = rows.count() if request.k else 0
        cutoff = order.kth(rows, "_screened", request.k) if request.k and n >= request.k else None
    elif cutoff is None:
        cutoff = rows.agg(F.min("score")).first()[0]
    return rows.drop("_screened"), cutoff


def clip_table(rows: DataFrame, cutoff: float | None, request: Request, source: DataFrame | None = None) -> DataFrame:
    """The clip artifact: export columns and what was asked for. Rows without a score come last, are not above the cutoff and
    have no confidence. `source` carries its columns over by segment; a segment that it holds twice doubles its clips."""
    if request.by_segment:
        rows = exporting.first_per_segment(rows, empty_is_none=True)
    more = []
    rows = exporting.ranked(rows)
    if request.below:
        rows, more = rows.withColumn("above_threshold", F.coalesce(F.col("score") >= F.lit(cutoff).cast("double"), F.lit(False))), ["above_threshold"]
    if request.confidence:
        rows, more = exporting.confidence(rows, cutoff), [*more, "confidence"]
    table = exporting.export_columns(rows, request.tag, request.prefix, *more)
    table = _named(table, request)
    return table if source is None else exporting.passthrough(table, source)


def _named(table: DataFrame, request: Request) -> DataFrame:
    return table.withColumns({"project": F.lit(request.project), "tag_version": F.lit(request.version).cast("int"), "corpus_version": F.lit(request.corpus_version)})


def build(
    corpus: cascade.Written, screen: Screen, request: Request, folder: str, *, output: str = "parquet", source: DataFrame | None = None,
    queries: Sequence[Sequence[float]] | None = None, most_sent: int = cascade.MOST_SENT,
) -> Built:
    """Write the export under a name of its own in `folder`. Nothing selected, or no interval, is an error; a segment set that
    cannot be made is not, as the artifact is what was asked for."""
    if output not in ("parquet", "csv"):
        raise ValueError("output is parquet or csv")
    if not request.below and (request.k is None) == (request.tau is None):
        raise ValueError("exactly one of k and tau")
    rows, cutoff = chosen(corpus, screen, request, queries=queries, most_sent=most_sent)
    n, unscorable, least = rows.agg(F.count(F.lit(1)), F.count_if(F.col("score").isNull()), F.min("score")).first()
    if not n:
        raise ValueError("nothing matched the tag and filters")
    if request.by_interval:
        scored = rows.where("score is not null")
        found = iv.intervals(scored, cutoff if cutoff is not None else least)
        table = _named(exporting.interval_export(found, scored, request.tag, request.prefix), request)
    else:
        table = clip_table(rows, cutoff, request, source)
    table = checkpointed(table)
    num = table.count()
    if not num:
        raise ValueError("no intervals formed above the cutoff")
    path = f"{folder}/{files.stem(f'{request.tag}_v{request.version}_{request.project}')}"
    (files.write_parquet if output == "parquet" else files.write_csv)(table, path)
    above = table.where("above_threshold").count() if request.below and not request.by_interval else None
    made, error = None, None
    if request.segment_set is not None:
        about = {"source": "export", "tag": request.tag, "version": request.version, "project": request.project, "corpus_version": request.corpus_version, "since": request.since}
        about |= {k: v if isinstance(v, (str, int, float, list, tuple)) else "table" for k, v in request.filters.items() if v is not None}
        try:
            made = write_set(table, request.segment_set, about)
        except ledger.SetSize as e:
            error = str(e)
    return Built(path, output, num, cutoff, unscorable, above, made, error)


def write_set(table: DataFrame, folder: str, about: dict) -> int:
    """Write the segments of a table as a set: ids in order, and beside them where they come from, without empty entries. How many
    there are."""
    ids = checkpointed(ledger.register_set(table))
    n = ids.count()
    known = {k: v for k, v in about.items() if v not in (None, "", [], ())} | {"num_segments": n}
    ids.write.parquet(f"{folder}/segments")
    table.sparkSession.createDataFrame([(json.dumps(known, sort_keys=True),)], "about string").coalesce(1).write.text(f"{folder}/about")
    return n


def provenance(spark, folder: str) -> dict:
    """What `write_set` noted of a set."""
    return json.loads(spark.read.text(f"{folder}/about").first()[0])
