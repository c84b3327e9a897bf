"""Score statistics, histograms, threshold sweeps and samples for labelling."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clipsift.operators import order
from clipsift.operators.exporting import in_groups, ranked


def score_stats(df: DataFrame, score: str = "score") -> DataFrame:
    """mean, population std, quantiles, max and top gap over finite scores, rounded to 6; zeros when there are none. Quantiles
    are exact: one buffer where Spark knows the rows to be few, else by brackets."""
    s = F.col(score).cast("double")
    ok = df.where(s.isNotNull() & ~F.isnan(s) & (F.abs(s) < float("inf"))).select(s.alias("s"))
    shares = (0.5, 0.9, 0.99, 0.999)
    few = order.surely_small(ok)
    p = F.percentile("s", F.array(*[F.lit(x) for x in shares])) if few else F.first(F.array(*[F.lit(x).cast("double") for x in order.quantiles(ok, "s", shares)]))
    a = ok.agg(F.avg("s").alias("mean"), F.stddev_pop("s").alias("std"), p.alias("p"), F.max("s").alias("max"), F.count("s").alias("n"))
    gap = F.when(F.col("std") > 1e-9, (F.col("p")[3] - F.col("mean")) / F.col("std"))
    r = lambda c: F.coalesce(F.round(c, 6), F.lit(0.0))
    return a.select(r(F.col("mean")).alias("mean"), r(F.col("std")).alias("std"), *[r(F.col("p")[i]).alias(n) for i, n in enumerate(("p50", "p90", "p99", "p999"))], r(F.col("max")).alias("max"), r(gap).alias("top_gap"), "n")


def heuristic_tau(stats: DataFrame) -> DataFrame:
    """mean + 3 std, held within 0.05 and 0.9."""
    return stats.select(F.round(F.least(F.greatest(F.col("mean") + 3 * F.col("std"), F.lit(0.05)), F.lit(0.9)), 6).alias("tau"))


def histogram(df: DataFrame, bins: int = 50, score: str = "score") -> DataFrame:
    """(bin, n) of equal bins from least to largest score, empty ones too; the last is closed. Equal scores widen by 0.5."""
    ends = df.agg(F.min(score).alias("lo"), F.max(score).alias("hi")).select(F.when(F.col("lo") == F.col("hi"), F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"), F.when(F.col("lo") == F.col("hi"), F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi")).first()
    if ends["lo"] is None:
        return df.sparkSession.range(0).select(F.col("id").alias("bin"), F.col("id").alias("n"))
    at = F.least(F.lit(bins - 1), F.floor((F.col(score) - F.lit(ends["lo"])) / F.lit(ends["hi"] - ends["lo"]) * bins)).cast("long")
    counted = df.groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return df.sparkSession.range(bins).select(F.col("id").alias("bin")).join(counted, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def sweep(df: DataFrame, score: str = "score", label: str = "label", *, rows_per_range: int = 1_000_000) -> DataFrame:
    """(tau, tp, fp, precision, recall, fpr, gain) at each distinct score, from the highest; gain is the step of recall there.
    Scores are grouped, cut at percentiles into ranges of about rows_per_range, added up within each and moved on by the sums of
    the ranges before, so that no task orders all of them. Null scores come last; null labels count as neither."""
    by = df.groupBy(F.col(score).alias("tau")).agg(F.coalesce(F.sum(F.col(label).cast("long")), F.lit(0)).alias("p"), F.coalesce(F.sum(1 - F.col(label).cast("long")), F.lit(0)).alias("q"))
    down = lambda *by: Window.partitionBy(*by).orderBy(F.col("tau").desc_nulls_last())
    parts = 1 if rows_per_range >= order.FEW and order.surely_small(df) else -(-df.count() // rows_per_range)
    if parts <= 1:
        to_here, whole = down().rowsBetween(Window.unboundedPreceding, 0), down().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        by = by.withColumns({"tp": F.sum("p").over(to_here), "fp": F.sum("q").over(to_here), "_all_p": F.sum("p").over(whole), "_all_q": F.sum("q").over(whole)})
        return _curve(by, F.col("_all_p"), F.col("_all_q"))
    found = df.agg(F.percentile_approx(score, [i / parts for i in range(1, parts)], 100_000)).first()[0] or []
    bounds = sorted(set(found), reverse=True)
    reached = F.size(F.filter(F.array(*[F.lit(float(x)) for x in bounds]), lambda x: F.col("tau") < x)) if bounds else F.lit(0)
    by = by.withColumn("_range", F.when(F.col("tau").isNull(), F.lit(len(bounds))).otherwise(reached))
    sums = sorted(tuple(r) for r in by.groupBy("_range").agg(F.sum("p"), F.sum("q")).collect())  # one row a range
    before, p, q = [], 0, 0
    for k, more_p, more_q in sums:
        before.append((k, p, q))
        p, q = p + more_p, q + more_q
    offsets = F.broadcast(df.sparkSession.createDataFrame(before, "_range int, _p long, _q long"))
    here = down("_range").rowsBetween(Window.unboundedPreceding, 0)
    by = by.join(offsets, "_range").withColumn("tp", F.sum("p").over(here) + F.col("_p")).withColumn("fp", F.sum("q").over(here) + F.col("_q"))
    return _curve(by, F.lit(p), F.lit(q))


def _curve(by: DataFrame, p: Column, q: Column) -> DataFrame:
    """Ratios at each tau, of p positives and q negatives in all."""
    ratio = lambda a, b, none=1.0: F.when(b > 0, a / b).otherwise(none)
    return by.select(
        "tau", "tp", "fp", ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), ratio(F.col("tp"), p).alias("recall"),
        ratio(F.col("fp"), q).alias("fpr"), ratio(F.col("p"), p, 0.0).alias("gain"),
    )


def average_precision(curve: DataFrame) -> DataFrame:
    """Sum of recall steps times precision, of a sweep's rows in any order."""
    return curve.agg(F.round(F.sum(F.col("gain") * F.col("precision")), 6).alias("ap"))


def pick_tau(curve: DataFrame, objective: str = "f_beta", *, beta: float = 1.0, floor: float = 0.9) -> DataFrame:
    """(tau, met): of equal objectives the highest tau. precision: most recall at precision >= floor, else most precision."""
    p, r = F.col("precision"), F.col("recall")
    f = F.when((beta * beta * p + r) > 0, (1 + beta * beta) * p * r / (beta * beta * p + r)).otherwise(0.0)
    met = F.lit(True)
    if objective == "youden":
        goal = F.struct(F.round(r - F.col("fpr"), 12).alias("o"), "tau")
    elif objective == "precision":
        met = p >= floor
        goal = F.struct(met.cast("int").alias("m"), F.round(F.when(met, r).otherwise(p), 12).alias("o"), "tau")
    else:
        goal = F.struct(F.round(f, 12).alias("o"), "tau")
    return curve.agg(F.max_by(F.struct("tau", met.alias("met")), goal).alias("x")).select("x.*")


def boundary_sample(df: DataFrame, tau: float, band: float, n: int, exclude: list[int]) -> DataFrame:
    """n rows to label: half by nearness to tau within the band, the rest one from each of n - n/2 score groups; labelled rows stay out."""
    free = df.where(~F.col("row").isin(exclude)) if exclude else df
    draw = (F.col("row") * 7919) % 10007
    near = free.where(F.abs(F.col("score") - tau) <= band).withColumn("_o", draw).orderBy("_o", "row").limit(n // 2).drop("_o")
    rest = free.join(near.select("row"), "row", "left_anti")
    groups = in_groups(rest.withColumn("_low", -F.col("score")), n - n // 2, "_low").drop("_low")
    one = groups.withColumn("_n", F.row_number().over(Window.partitionBy("_g").orderBy(draw, "row"))).where("_n = 1").drop("_g", "_n")
    return near.unionByName(one.select(near.columns))


def metrics_at(df: DataFrame, tau: float, *, beta: float = 1.0, score: str = "score", label: str = "label") -> DataFrame:
    """(captured, excluded, precision, recall, f) of labelled scores at tau; 0 where undefined."""
    hit, good = F.col(score) >= F.lit(tau), F.col(label) == 1
    a = df.agg(F.count_if(hit & good).alias("tp"), F.count_if(hit & ~good).alias("fp"), F.count_if(~hit & good).alias("fn"), F.count_if(~hit & ~good).alias("excluded"))
    ratio = lambda x, y: F.when(y > 0, x / y).otherwise(0.0)
    a = a.withColumn("p", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("r", ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    f = ratio((1 + beta * beta) * F.col("p") * F.col("r"), beta * beta * F.col("p") + F.col("r"))
    return a.select(F.col("tp").alias("captured"), "excluded", F.round("p", 6).alias("precision"), F.round("r", 6).alias("recall"), F.round(f, 6).alias("f"))


def fit_threshold(df: DataFrame, objective: str = "f_beta", *, held_out: Column | None = None, beta: float = 1.0, floor: float = 0.9) -> DataFrame:
    """(tau, met, ap, captured, excluded, precision, recall, f): tau and average precision fitted on the rows outside held_out,
    the rest measured inside (on all rows without it). Both classes are needed to fit."""
    held = F.coalesce(held_out, F.lit(False)) if held_out is not None else F.lit(False)
    used = df.where(~held)
    n = used.agg(F.count_if(F.col("label") == 1).alias("p"), F.count_if(F.col("label") == 0).alias("q")).first()
    if not n["p"] or not n["q"]:
        raise ValueError("labels of both classes are needed")
    curve = sweep(used)
    tau = pick_tau(curve, objective, beta=beta, floor=floor)
    t = tau.first()["tau"]
    return tau.crossJoin(average_precision(curve)).crossJoin(metrics_at(df.where(held) if held_out is not None else df, t, beta=beta))  # one row each


def threshold_for(df: DataFrame, *, tau: float | None = None, k: int | None = None, score: str = "score") -> DataFrame:
    """(tau, selected): a given threshold, or that of the k-th score; rows are counted in single precision before tau is
    rounded to 4."""
    if tau is None:
        tau = order.kth(df, score, k)
    t = F.lit(tau).cast("float")
    return df.agg(F.count_if(F.col(score).cast("float") >= t).alias("selected")).select(F.round(F.lit(tau), 4).alias("tau"), "selected")


def fraction_above(hist: DataFrame, lo: float, hi: float, value: float, bins: int = 50) -> DataFrame:
    """Share of a histogram's rows at or above a value, with part of the bin that holds it."""
    width = (hi - lo) / bins
    left = F.lit(lo) + F.col("bin") * F.lit(width)
    part = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (left + width - F.lit(value)) / F.lit(width)))
    return hist.agg(F.round(F.sum(F.col("n") * part) / F.sum("n"), 6).alias("fraction"))


def separation(df: DataFrame, eps: float, score: str = "score") -> DataFrame:
    """(top, low, spread, times_eps): how far shown scores lie apart, in terms of the error bound."""
    a = df.agg(F.max(score).alias("top"), F.min(score).alias("low")).withColumn("spread", F.col("top") - F.col("low"))
    return a.select("top", "low", "spread", (F.col("spread") / F.lit(eps)).alias("times_eps"))


def guessed_tau(k: int, n: int) -> float:
    """A first guess of the threshold that selects k of n rows: scores are taken as normal."""
    share = min(max(k / (0.4 * n), 1e-6), 0.399)
    return min(max(0.05 + 0.25 * math.sqrt(-math.log(share)), 0.0), 0.42)


def histogram_summary(df: DataFrame, tau: float | None = None, score: str = "score") -> DataFrame:
    """(total, min, max, mean, above_tau) of finite scores, rounded to 4; no row if there are none."""
    s = F.col(score).cast("double")
    ok = df.where(s.isNotNull() & ~F.isnan(s) & (F.abs(s) < float("inf"))).select(s.alias("s"))
    above = F.count_if(F.col("s") >= F.lit(tau)) if tau is not None else F.lit(None).cast("long")
    a = ok.agg(F.count("s").alias("total"), *[F.round(f("s"), 4).alias(n) for f, n in ((F.min, "min"), (F.max, "max"), (F.avg, "mean"))], above.alias("above_tau"))
    return a.where("total > 0")


def curve_points(curve: DataFrame, most: int = 200) -> DataFrame:
    """At most `most` points of a curve, evenly spread from its first to its last by descending tau, both ends included."""
    placed = ranked(curve, "tau", ties=()).withColumn("_at", F.col("rank") - 1).drop("rank")
    n = curve.count()
    if n > most:
        at = sorted({round(i * (n - 1) / (most - 1)) for i in range(most)})
        placed = placed.join(F.broadcast(curve.sparkSession.createDataFrame([(i,) for i in at], "_at long")), "_at")  # `most` rows
    return placed.drop("_at")


def topped_up_sample(df: DataFrame, tau: float, band: float, n: int, exclude: list[int], *, seed: int = 0) -> DataFrame:
    """n rows to label, or all there are, highest scores first: up to half by a seeded hash from the band around tau, and as many
    groups of scores as are then missing give one each, so that a thin band does not shorten the sample."""
    free = df.where(~F.col("row").isin(exclude)) if exclude else df
    draw = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("row").cast("string")))
    near = free.where(F.abs(F.col("score") - tau) <= band).withColumn("_o", draw).orderBy("_o", "row").limit(n // 2).drop("_o")
    got = near.count()
    rest = free.join(near.select("row"), "row", "left_anti")
    groups = in_groups(rest, max(1, n - got), "score")
    one = groups.withColumn("_n", F.row_number().over(Window.partitionBy("_g").orderBy(draw, "row"))).where("_n = 1").drop("_g", "_n")
    return near.unionByName(one.select(near.columns)).orderBy(F.col("score").desc(), "row").limit(n)
