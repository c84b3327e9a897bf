"""Two-layer selection on a written corpus: int8 codes decide what their error bound can, exact vectors are fetched only for the
rows in doubt.

A written corpus is two tables: codes (row, i8 and what else is known of a clip) and vectors (row, vec). A selection reads row
and i8 of all rows, in Arrow batches that give back only what can still matter; the few candidates are checkpointed and
counted; and by this count the vectors are found by a broadcast of the candidates' rows or, if there are many, by a shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clipsift.operators import order, screening
from clipsift.operators.selection import Screen, classify
from clipsift.operators.vectors import arrow_scores, weights
from clipsift.session import checkpointed

#: Up to so many candidates (8 bytes each) are broadcast to the vectors.
MOST_SENT = 2_000_000
#: Batches give back their best rows only up to this k; beyond it a batch holds hardly more.
BEST_OF_BATCH = 4096


@dataclass(frozen=True)
class Written:
    """codes: row, i8 and other columns; vectors: row, vec."""

    codes: DataFrame
    vectors: DataFrame

    @classmethod
    def read(cls, spark: SparkSession, folder: str) -> Written:
        return cls(spark.read.parquet(f"{folder}/codes"), spark.read.parquet(f"{folder}/vectors"))


def write(df: DataFrame, scale: Sequence[float], folder: str) -> Written:
    """Write a corpus (row, vec and other columns) to a new folder."""
    screening.store(df, scale).write.parquet(f"{folder}/codes")
    df.select("row", "vec").write.parquet(f"{folder}/vectors")
    return Written.read(df.sparkSession, folder)


def scores(codes: DataFrame, screen: Screen, *, best: int | None = None, least: float | None = None) -> DataFrame:
    """(row, score) from row and i8 alone. With `best`, a batch gives only rows that reach its best-th score (all that reach the
    best-th score of the table are there); with `least`, only rows that reach it."""
    w = np.array([weights(q, screen.scale) for q in screen.queries]).T

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            score, keep = screening.products(b.column(1), w), None
            if least is not None:
                keep = np.flatnonzero(score >= least)
            elif best is not None and len(score) > best:
                keep = np.flatnonzero(score >= np.partition(score, len(score) - best)[len(score) - best])
            rows = b.column(0)
            yield pa.RecordBatch.from_arrays([rows, pa.array(score)] if keep is None else [rows.take(pa.array(keep)), pa.array(score[keep])], names=["row", "score"])

    return codes.select("row", "i8").mapInArrow(run, "row long, score double")


def kth_score(codes: DataFrame, screen: Screen, k: int, few: int = order.FEW) -> float | None:
    """Screened score of the k-th row (the last if there are fewer)."""
    return order.kth(scores(codes, screen, best=k if k <= BEST_OF_BATCH else None), "score", k, few=few)


def fetched(vectors: DataFrame, wanted: DataFrame, queries: Sequence[Sequence[float]], *, most_sent: int = MOST_SENT) -> DataFrame:
    """(row, exact): largest products of the vectors of the wanted rows; null vectors give 0."""
    rows = wanted.select("row")
    near = F.broadcast(rows) if wanted.count() <= most_sent else rows
    found = arrow_scores(vectors.join(near, "row"), queries)
    return found.select("row", F.round("score", 9).alias("exact"))


def select(corpus: Written, screen: Screen, *, k: int | None = None, tau: float | None = None, refine: bool = True, queries: Sequence[Sequence[float]] | None = None, most_sent: int = MOST_SENT, few: int = order.FEW) -> DataFrame:
    """Rows of codes, without i8, by top k or by threshold, with score, class and exact (null where not needed), as
    `selection.select` gives them from vectors.

    k: candidates are all rows within twice the bound of the k-th screened score; with refine exact scores order them. tau: rows
    surely above, and those of the band whose exact score reaches tau. `queries`: the directions in the basis of the vectors'
    table, if that is not the screen's. Any k is answered without one task that holds k rows, as long as it is over `few`.
    """
    if (k is None) == (tau is None):
        raise ValueError("exactly one of k and tau")
    none = F.lit(None).cast("double")
    if k is not None:
        cut = kth_score(corpus.codes, screen, k, few)
        if cut is None:
            return corpus.codes.drop("i8").withColumns({"score": none, "class": F.lit("above"), "exact": none}).limit(0)
        if not refine:
            best = order.top(scores(corpus.codes, screen, least=cut), k, few=few).withColumns({"class": F.lit("above"), "exact": none})
            return _with_columns(best, corpus.codes, "score")
        near = checkpointed(scores(corpus.codes, screen, least=cut - 2 * screen.eps))
        found = near.join(fetched(corpus.vectors, near, queries or screen.queries, most_sent=most_sent), "row")
        best = order.top(found, k, score="exact", few=few)
        return _with_columns(best.withColumn("class", classify(F.col("score"), cut, 2 * screen.eps)), corpus.codes, "exact")
    near = checkpointed(scores(corpus.codes, screen, least=tau - screen.eps)).withColumn("class", classify(F.col("score"), tau, screen.eps))
    if refine:
        band = near.where("class = 'band'")
        near = near.join(fetched(corpus.vectors, band, queries or screen.queries, most_sent=most_sent), "row", "left")
    else:
        near = near.withColumn("exact", none)
    return _with_columns(near.where((F.col("class") == "above") | (F.coalesce("exact", "score") >= tau)), corpus.codes, "score")


def probe(corpus: Written, screen: Screen, *, most: int = 64) -> bool | None:
    """Whether the vectors say more than the codes, by at most `most` rows spread by a hash; None if that cannot be told. Vectors
    that are only the codes multiplied out decide nothing: their products lie within the bound wherever the truth is."""
    spread = corpus.codes.where("i8 is not null").orderBy(F.xxhash64("row"), "row").limit(most).select("row", "i8")
    scale = np.array(screen.scale)
    off = []
    for r in corpus.vectors.join(F.broadcast(spread), "row").select("i8", "vec").collect():  # `most` rows
        vec = np.array(r["vec"] if r["vec"] is not None else [], np.float64)
        if len(vec) == len(scale) and vec.any():
            off.append(np.abs(vec - np.frombuffer(r["i8"], np.int8) * scale / 127).max())
    worst = max(off, default=math.nan) if not any(math.isnan(x) for x in off) else math.nan
    return None if math.isnan(worst) else bool(worst >= 1e-3 * (scale / 127).max())


def selection(corpus: Written, screen: Screen, *, k: int | None = None, tau: float | None = None, refine: str = "auto", **more) -> tuple[DataFrame, bool]:
    """(select()'s rows, whether exact vectors decided). refine: never; always, an error if the probe finds the vectors of no use;
    auto, which then keeps to screened scores. `more`: arguments of select()."""
    if refine not in screening.REFINE:
        raise ValueError(f"refine is one of {', '.join(screening.REFINE)}")
    exact = refine != "never" and bool(probe(corpus, screen))
    if refine == "always" and not exact:
        raise ValueError("exact vectors are not usable")
    return select(corpus, screen, k=k, tau=tau, refine=exact, **more), exact


def _with_columns(found: DataFrame, codes: DataFrame, by: str) -> DataFrame:
    """The found rows with the other columns of codes, the highest first."""
    more = codes.drop("i8")
    return more.join(found, "row").select(*more.columns, "score", "class", "exact").orderBy(F.col(by).desc(), F.col("row").asc())
