"""A tag refined by marks: a new query vector, its threshold and what it selects."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clipsift.operators import calibration, vectors


def one_direction(query: Sequence | None) -> list[float] | None:
    """The vector of a tag. One that holds several directions cannot be moved by marks, as there is no single thing to move."""
    if query is None or not len(query) or not hasattr(query[0], "__len__"):
        return query if query is None else list(query)
    if len(query) > 1:
        raise ValueError(f"a tag of {len(query)} directions is not refined by marks; make it anew of their mean")
    return list(query[0])


def sample(scored: DataFrame, name: Column, n: int = 3) -> DataFrame:
    """(chunk_id, score) of the n best rows, to look at."""
    best = scored.where("score is not null").orderBy(F.col("score").desc(), "row").limit(n)
    return best.select(name.alias("chunk_id"), F.round("score", 4).alias("score"))


def refine(corpus: DataFrame, marks: DataFrame, text: Sequence | None = None, *, objective: str | None = "f_beta", negative_weight: float = 0.5, text_weight: float = 0.3) -> tuple[DataFrame, DataFrame]:
    """(scored corpus, summary) from marks (row, label 1 or 0): the vector leans to the mean of the good and away from that of
    the bad. summary: tau, fitted to the marks if there are both classes and an objective, else from the scores' statistics,
    rounded to 4; fitted; selected, counted with the rounded tau; marked; unresolved (marks of rows that are not there). `text`: the
    tag's vector so far, of one direction.
    """
    text = one_direction(text)
    held = corpus.join(marks.select("row", "label"), "row")
    n = held.agg(F.count_if(F.col("label") == 1).alias("good"), F.count_if(F.col("label") == 0).alias("bad")).first()
    if not n["good"]:
        raise ValueError("good marks are needed")
    good = [vectors.mean_vector(held.where("label = 1"))]
    bad = [vectors.mean_vector(held.where("label = 0"))] if n["bad"] else []
    query = vectors.rocchio(good, bad, text, negative_weight, text_weight)
    scored = corpus.withColumn("score", F.round(vectors.dot(F.col("vec"), vectors.literal(query)), 9))
    fitted = bool(n["bad"]) and objective is not None
    if fitted:
        tau = calibration.pick_tau(calibration.sweep(scored.join(marks.select("row", "label"), "row")), objective).first()["tau"]
    else:
        tau = calibration.heuristic_tau(calibration.score_stats(scored)).first()["tau"]
    tau = round(tau, 4)
    found = n["good"] + n["bad"]
    summary = scored.agg(F.count_if(F.col("score") >= F.lit(tau)).alias("selected"))
    return scored, summary.select(F.lit(tau).alias("tau"), F.lit(fitted).alias("fitted"), "selected", F.lit(found).cast("long").alias("marked"), F.lit(marks.count() - found).cast("long").alias("unresolved"))


def calibrate(scored: DataFrame, filters: DataFrame, *, tau: float | None = None) -> DataFrame:
    """Statistics over all scored rows, and how many rows of the filtered (row) set reach tau (else the statistics' own)."""
    stats = calibration.score_stats(scored)
    t = tau if tau is not None else calibration.heuristic_tau(stats).first()["tau"]
    kept = scored.join(filters.select("row").distinct(), "row", "left_semi")
    counts = kept.agg(F.count_if(F.col("score") >= F.lit(t)).alias("selected"), F.count(F.lit(1)).alias("candidates"))
    return stats.crossJoin(counts).withColumn("tau", F.lit(t))  # one row each
