"""Operator 1: mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

Sources get target sizes by water filling (`source_targets`). The mix is then dealt in blocks of `block_words` words:
`sainte_lague` gives each source its integer number of blocks by highest quotients target / (2 k + 1), and once more each
shard of a source (documents by a seeded hash, about `shard_words` words) its quota by highest quotients size / (2 k + 1).
Within a shard the documents lie in a seeded order and are cut into blocks; a quota q over n blocks takes every block
q div n times and q mod n of them, chosen systematically from a seeded start, once more. Each document's share follows in
closed form from its first and last word, so no block is ever a row.

DataFrame functions only. One shuffle deals (id, source, size) by (source, shard): a source with a third of all rows has
a third of all shards, each bounded. Only per-source and per-shard sums are ranked in windows over a whole group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clipsift.llm.common import cut, word_count


def _hash32(*parts: Column) -> Column:
    """32 seeded bits, the same in any SQL dialect that has md5."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 8), 16, 10).cast("long")


def source_targets(sources: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """Add rank, weight and target to (source, source_size): sources by code point, null last, weigh `weights`, repeating,
    and share `share` of all sizes; none gets over `most` times its size, the excess goes to the others by weight."""
    whole = Window.partitionBy()
    cap = F.col("source_size") * F.lit(float(most))
    by_ratio = Window.orderBy("ratio", "rank")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    return (
        sources.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
        .withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("rank") - 1) % len(weights) + 1).cast("int")))
        .withColumn("ratio", cap / F.col("weight"))
        .withColumn("goal", F.sum("source_size").over(whole) * F.lit(float(share)))
        .withColumn(
            "level",
            (F.col("goal") - F.coalesce(F.sum(cap).over(before), F.lit(0.0))) / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))),
        )
        .withColumn("level", F.min_by(F.when(F.col("ratio") > F.col("level"), F.col("level")), F.when(F.col("ratio") > F.col("level"), F.col("ratio"))).over(whole))
        .withColumn("target", F.coalesce(F.least(cap, F.col("weight") * F.col("level")), cap))
        .drop("ratio", "level")
    )


def sainte_lague(units: DataFrame, group: Sequence[str], votes: str, seats: str, cap: str, key: Sequence[str], out: str) -> DataFrame:
    """Add `out`: of the group's `seats`, those of each unit by highest quotients votes / (2 k + 1), at most `cap` each; what a
    cap keeps from a unit goes to the others, until every unit with votes is at its cap.

    Shares at which all seats are dealt, none above its cap, follow by water filling in the order of cap / votes. Rounding
    them misses the seats by at most half a seat a unit, and all units move the same way from there to the true quotas: so
    those of m units differ by at most 1.5 m times the unit's part of the votes below their caps, 1.5 m in all, plus 2. Only
    quotients in that span are made rows and ranked; those before it are won anyway. Ties go to the lower key.
    """
    whole = Window.partitionBy(*group)
    by_ratio = Window.partitionBy(*group).orderBy("_ratio", *key)
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    m, zero = F.count(F.lit(1)).over(whole), F.lit(0.0)
    voted = units.withColumn("_v", F.greatest(F.coalesce(F.col(votes).cast("double"), zero), zero))
    voted = voted.withColumn("_c", F.when(F.col("_v") > 0, F.col(cap).cast("double")).otherwise(zero))
    voted = voted.withColumn("_ratio", F.when(F.col("_v") > 0, F.col("_c") / F.col("_v")).otherwise(F.lit(float("inf"))))
    # The level of seats a vote if this unit is the first that no cap holds.
    left = F.col(seats) - F.coalesce(F.sum("_c").over(before), zero)
    below = F.sum("_v").over(whole) - F.coalesce(F.sum("_v").over(before), zero)
    voted = voted.withColumn("_level", F.when((F.col("_v") > 0) & (below > 0), left / below)).withColumn("_below", below)
    free = F.col("_ratio") > F.col("_level")
    voted = voted.withColumn("_first", F.min(F.when(free, F.struct("_ratio", "_level", "_below"))).over(whole))
    share = F.when(F.col("_first").isNotNull(), F.least(F.col("_c"), F.col("_v") * F.greatest(F.col("_first._level"), zero)))
    span = F.least(F.lit(1.5) * m * F.col("_v") / F.col("_first._below"), F.lit(1.5) * m)
    spanned = (
        voted.withColumn("_share", F.coalesce(share, F.col("_c")))
        .withColumn("_span", F.when(F.col("_first").isNotNull(), F.ceil(span) + 2).otherwise(F.lit(0)).cast("long"))
        .withColumn("_sure", F.greatest(F.floor(F.col("_share") + 0.5).cast("long") - F.col("_span"), F.lit(0).cast("long")))
        # Beyond its cap by the span: a unit that keeps all its seats.
        .withColumn("_sure", F.when(F.col("_v") * F.col("_first._level") - F.col("_span") >= F.col("_c"), F.col("_c").cast("long")).otherwise(F.least(F.col("_sure"), F.col("_c").cast("long"))))
        .withColumn("_last", F.least(F.col("_sure") + 2 * F.col("_span"), F.col("_c").cast("long") - 1))
        .withColumn("_need", F.col(seats) - F.sum("_sure").over(whole))
    )
    asked = spanned.withColumn("_k", F.explode_outer(F.when((F.col("_last") >= F.col("_sure")) & (F.col("_v") > 0), F.sequence("_sure", "_last"))))
    order = Window.partitionBy(*group).orderBy(F.col("_q").desc_nulls_last(), *[F.col(k).asc_nulls_last() for k in key], "_k")
    won = asked.withColumn("_q", F.col("_v") / (2 * F.col("_k") + 1)).withColumn("_won", F.row_number().over(order) <= F.col("_need"))
    keep = [c for c in units.columns]
    return won.groupBy(*keep, "_sure").agg(F.count_if(F.col("_won") & F.col("_k").isNotNull()).alias("_more")).withColumn(out, F.col("_sure") + F.col("_more")).drop("_sure", "_more")


def mix(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[float] = (5, 2, 1),
    share: float = 1.5,
    most: float = 2.0,
    block_words: int = 16,
    shard_words: int = 1_000_000,
    seed: int = 11,
    row_col: str | None = None,
) -> DataFrame:
    """One row per document: id, source, size, source_size, target (its source's), taken (words that the mix takes, repeats
    counted), shard, quota (blocks of its shard), and as `row` the column row_col, if named, to know the document by.

    Null texts and texts without words have size 0 and taken 0. A null source is a source of its own, after the others. Rows
    that repeat an id are dealt as documents of their own; rows equal in id and size are interchangeable. Texts of any
    length count whole. An empty table gives no rows. `most` is a whole number, as documents are repeated by whole blocks;
    others are refused. Other columns, whatever their names, are ignored.
    """
    if most != int(most) or most < 1:
        raise ValueError("most is not a whole number")
    sized = cut(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"), *([F.col(row_col).alias("row")] if row_col else [])))
    block = F.lit(block_words).cast("long")
    targets = source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most)
    sources = (
        targets.withColumn("_seats", F.floor(F.col("goal") / block_words + 0.5).cast("long"))
        .withColumn("_cap", (F.ceil(F.col("source_size") / block_words) * int(most)).cast("long"))
        .withColumn("shards", F.greatest(F.ceil(F.col("source_size") / shard_words), F.lit(1)).cast("long"))
    )
    sources = sainte_lague(sources, [], "target", "_seats", "_cap", ["rank"], "source_seats")
    sources = cut(sources.select("source", "source_size", "target", "shards", "source_seats", "rank"))
    s = sources.select(F.col("source").alias("_source"), "source_size", "target", "shards", "source_seats", "rank")
    dealt = sized.join(s, sized["source"].eqNullSafe(s["_source"])).drop("_source")
    dealt = dealt.withColumn("shard", _hash32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(str(seed))) % F.col("shards"))
    quotas = dealt.groupBy("rank", "shard", "source_seats").agg(F.sum("size").alias("shard_size"))
    quotas = quotas.withColumn("blocks", F.ceil(F.col("shard_size") / block_words).cast("long")).withColumn("_cap", F.col("blocks") * int(most))
    quotas = sainte_lague(quotas, ["rank"], "shard_size", "source_seats", "_cap", ["shard"], "quota")
    quotas = quotas.select(F.col("rank").alias("_rank"), F.col("shard").alias("_shard"), "blocks", "quota")
    quotas = quotas.withColumn("_from", F.when(F.col("blocks") > 0, _hash32(F.col("_rank").cast("string"), F.col("_shard").cast("string"), F.lit(str(seed))) % F.col("blocks")).otherwise(F.lit(0).cast("long")))
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    order = Window.partitionBy("rank", "shard").orderBy(key, F.col("doc_id").asc_nulls_last(), "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = dealt.withColumn("_end", F.sum("size").over(order)).join(quotas, (F.col("rank") == F.col("_rank")) & (F.col("shard") == F.col("_shard")))
    blocks = F.greatest(F.col("blocks"), F.lit(1).cast("long"))
    rest = F.col("quota") % blocks

    def extra(at: Column) -> Column:
        """Words in blocks of the extra choice among the shard's first `at` words."""
        whole = F.floor(at / block).cast("long")
        chosen = lambda b: F.floor((b * rest + F.col("_from")) / blocks).cast("long")
        return chosen(whole) * block + (at % block) * (chosen(whole + 1) - chosen(whole))

    taken = F.col("size") * F.floor(F.col("quota") / blocks).cast("long") + extra(F.col("_end")) - extra(F.col("_end") - F.col("size"))
    return placed.select("doc_id", "source", "size", "source_size", F.col("target"), taken.alias("taken"), "shard", "quota", *(["row"] if row_col else []))
