"""Exact order statistics of columns that no task could sort: a sketch brackets the place, a count proves the bracket, and only
what lies in it is looked at again."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: So many rows may be sorted by one task.
FEW = 1_000_000
#: Of the sketch: its rank error is the rows over this.
ACCURACY = 10_000


def surely_small(df: DataFrame, most: int = 8 << 20) -> bool:
    """Whether Spark puts the plan's result under `most` bytes, without a job. It only chooses between plans of equal results."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= most


def bracket(values: DataFrame, n: int, k: int, accuracy: int = ACCURACY) -> tuple:
    """(lo, hi, values above hi, values from lo to hi) of n values `v`, the k-th largest being among the latter. The sketch guesses,
    and is asked for more until the counts agree; at the worst lo and hi are the ends."""
    share, slack = 1 - k / n, 2 / accuracy
    while True:
        lo, hi = values.agg(F.percentile_approx("v", [max(0.0, share - slack), min(1.0, share + slack)], accuracy)).first()[0]
        above, inside = values.agg(F.count_if(F.col("v") > F.lit(hi)), F.count_if(F.col("v").between(F.lit(lo), F.lit(hi)))).first()
        if above < k <= above + inside:
            return lo, hi, above, inside
        if slack > 1:
            return values.agg(F.min("v")).first()[0], values.agg(F.max("v")).first()[0], 0, n
        slack *= 8


def kth(df: DataFrame, column: str, k: int, *, few: int = FEW, accuracy: int = ACCURACY):
    """The k-th largest value (the least if there are fewer); None without values. Nulls do not count."""
    values = df.select(F.col(column).alias("v")).where("v is not null")
    if k > few:
        n = values.count()
        k = min(k, n)
        while min(k, n - k + 1) > few:
            lo, hi, above, inside = bracket(values, n, k, accuracy)
            if lo == hi:
                return lo
            if inside == n:
                break
            values, n, k = values.where(F.col("v").between(F.lit(lo), F.lit(hi))), inside, k - above
        if n - k + 1 < k:
            return values.orderBy("v").limit(n - k + 1).agg(F.max("v")).first()[0]
    return values.orderBy(F.col("v").desc()).limit(k).agg(F.min("v")).first()[0]


def top(df: DataFrame, k: int, *, score: str = "score", tie: str = "row", few: int = FEW, accuracy: int = ACCURACY) -> DataFrame:
    """The k rows that come first by score from the highest, then by `tie`, a number of their own; in any order. Rows without a
    score are not among them. Up to `few` are sorted out directly; of more, the last score and the last of its ties are found
    first, and the rows are a filter."""
    df = df.where(F.col(score).isNotNull())
    if k <= few:
        return df.orderBy(F.col(score).desc(), F.col(tie).asc()).limit(k)
    cut = kth(df, score, k, few=few, accuracy=accuracy)
    if cut is None:
        return df
    at = F.lit(cut)
    above, equal = df.agg(F.count_if(F.col(score) > at), F.count_if(F.col(score) == at)).first()
    if above + equal <= k:
        return df.where(F.col(score) >= at)
    last = kth(df.where(F.col(score) == at).select((-F.col(tie)).alias(tie)), tie, k - above, few=few, accuracy=accuracy)
    return df.where((F.col(score) > at) | ((F.col(score) == at) & (F.col(tie) <= F.lit(-last))))


def quantiles(df: DataFrame, column: str, shares: Sequence[float], *, few: int = FEW, accuracy: int = ACCURACY) -> list[float | None]:
    """Exact quantiles, interpolated between neighbours as percentile() does, which holds all distinct values in one buffer and is
    taken up to `few` rows. Nulls do not count."""
    values = df.select(F.col(column).cast("double").alias("v")).where("v is not null")
    n = values.limit(few + 1).count()
    if n <= few:
        return values.agg(F.percentile("v", F.array(*[F.lit(float(x)) for x in shares]))).first()[0] or [None] * len(shares)
    n = values.count()
    out = []
    for x in shares:
        at = (n - 1) * x
        lo = kth(values, "v", n - math.floor(at), few=few, accuracy=accuracy)
        hi = lo if at == math.floor(at) else kth(values, "v", n - math.ceil(at), few=few, accuracy=accuracy)
        out.append(lo + (hi - lo) * (at - math.floor(at)))
    return out
