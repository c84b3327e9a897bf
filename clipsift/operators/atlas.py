"""A 2-D map of clips: sampling, scaling, colourings, neighbours and lasso."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clipsift.functions.text import utc_day
from clipsift.operators.encoding import Reducer, placed
from clipsift.operators.exporting import chunk_id
from clipsift.operators.pca import fit, project
from clipsift.operators.vectors import dot, literal, norm


def cap_per_run(df: DataFrame, cap: int) -> DataFrame:
    """At most `cap` rows of each run, in order of row; null runs are one group."""
    w = Window.partitionBy(F.coalesce("run_uuid", F.lit(""))).orderBy("row")
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= cap).drop("_n")


def uniform_sample(df: DataFrame, n: int) -> DataFrame:
    """n rows by a fixed integer hash of the row, without null vectors."""
    return df.where("vec is not null").withColumn("_o", (F.col("row") * 7919) % 10007).orderBy("_o", "row").limit(n).drop("_o")


def seeded_sample(df: DataFrame, n: int, seed: int, cap: int | None = None) -> DataFrame:
    """Up to n rows by a hash of seed and row, in order of row: twice as many are drawn, those without a vector go, and of each
    run (null runs are one) the first `cap` by the hash stay."""
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.col("row").cast("string")).cast("binary"))
    drawn = df.withColumn("_o", order).orderBy("_o", "row").limit(2 * n).where("vec is not null")
    if cap is not None:
        w = Window.partitionBy(F.coalesce("run_uuid", F.lit(""))).orderBy("_o", "row")
        drawn = drawn.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= cap).drop("_n")
    return drawn.orderBy("_o", "row").limit(n).orderBy("row").drop("_o")


def scaled_points(df: DataFrame) -> DataFrame:
    """x, y: the first two vector dimensions, centred and scaled by the largest absolute value to [-1, 1]."""
    xy = df.where("vec is not null").withColumn("x", F.col("vec")[0].cast("double")).withColumn("y", F.col("vec")[1].cast("double"))
    c = xy.agg(F.avg("x").alias("cx"), F.avg("y").alias("cy")).first()
    xy = xy.withColumn("x", F.col("x") - F.lit(c["cx"])).withColumn("y", F.col("y") - F.lit(c["cy"]))
    m = xy.agg(F.max(F.greatest(F.abs("x"), F.abs("y")))).first()[0]
    return xy.withColumn("x", F.col("x") / F.lit(m)).withColumn("y", F.col("y") / F.lit(m))


def colouring(df: DataFrame, column: str, top: int = 23) -> DataFrame:
    """(row, label): the `top` most frequent categories (ties by label), the others `other`, null `(none)`."""
    named = df.withColumn("_c", F.coalesce(F.col(column), F.lit("(none)")))
    n = named.groupBy("_c").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "_c").limit(top)
    kept = F.broadcast(n.select("_c", F.col("_c").alias("label")))  # `top` rows
    return named.join(kept, "_c", "left").select("row", F.coalesce("label", F.lit("other")).alias("label"))


def density(points: DataFrame, bins: int = 256, buckets: int = 8) -> DataFrame:
    """(row, cell_count, bucket): points of a point's cell of a grid over [-1, 1]^2, and its quantile bucket."""
    at = lambda c: F.least(F.lit(bins - 1), F.floor((F.col(c) + 1) / 2 * bins)).cast("long")
    p = points.withColumn("bx", at("x")).withColumn("by", at("y"))
    counted = p.join(p.groupBy("bx", "by").agg(F.count(F.lit(1)).alias("cell_count")), ["bx", "by"])
    edges = counted.agg(F.percentile("cell_count", F.array(*[F.lit(i / buckets) for i in range(1, buckets)]))).first()[0] or []
    over = sum((F.col("cell_count") >= F.lit(e)).cast("int") for e in edges) if edges else F.lit(0)
    return counted.select("row", "cell_count", F.concat(F.lit("q"), (over + 1).cast("string")).alias("bucket"))


def neighbours(df: DataFrame, query: Sequence[float], self_row: int, k: int) -> DataFrame:
    """The k rows most similar by cosine, without the query's own; one pass and a bounded heap in each task."""
    sim = F.round(dot(F.col("vec"), literal(query)) / (F.greatest(norm(F.col("vec")), F.lit(1e-12)) * norm(literal(query))), 6)
    return df.where(F.col("vec").isNotNull() & (F.col("row") != self_row)).select("row", sim.alias("similarity")).orderBy(F.col("similarity").desc(), "row").limit(k)


def in_polygon(points: DataFrame, polygon: Sequence[tuple[float, float]]) -> DataFrame:
    """Points inside by the even-odd rule."""
    if len(polygon) < 3:
        raise ValueError("a polygon needs three vertices")
    inside = F.lit(False)
    for (ax, ay), (bx, by) in zip(polygon, [*polygon[1:], polygon[0]], strict=True):
        if ay != by:
            crosses = ((F.lit(ay) > F.col("y")) != (F.lit(by) > F.col("y"))) & (F.col("x") < F.lit(ax) + (F.col("y") - F.lit(ay)) * F.lit((bx - ax) / (by - ay)))
            inside = inside != crosses
    return points.where(inside)


def lasso(points: DataFrame, polygon: Sequence[tuple[float, float]], limit: int = 48) -> DataFrame:
    """Points inside, nearest to the mean of the vertices first."""
    cx, cy = sum(p[0] for p in polygon) / len(polygon), sum(p[1] for p in polygon) / len(polygon)
    d = (F.col("x") - F.lit(cx)) * (F.col("x") - F.lit(cx)) + (F.col("y") - F.lit(cy)) * (F.col("y") - F.lit(cy))
    return in_polygon(points, polygon).withColumn("d2", F.round(d, 9)).orderBy("d2", "row").limit(min(limit, 96))


def point_detail(points: DataFrame, row: int, prefix: str) -> DataFrame:
    """Name, day, place and media address of one point; no row for an unknown one."""
    day = utc_day(F.col("chunk_start_unix"))
    uri = F.concat(F.lit(prefix), F.lit("dt="), day, F.lit("/"), F.col("run_uuid"), F.lit("_t"), F.col("chunk_start_unix").cast("string"), F.lit(".mp4"))
    return points.where(F.col("row") == row).select("row", chunk_id().alias("chunk_id"), "run_uuid", day.alias("dt"), "chunk_start_unix", uri.alias("source_media_uri"), "x", "y")


def reduced(df: DataFrame, reducer: Reducer | None = None) -> DataFrame:
    """(row, position): vectors in two dimensions by a fitted reducer, by default along their two strongest axes."""
    return placed(df, reducer, vec="vec") if reducer else project(df, fit(df, 2)).withColumnRenamed("projected", "position")
