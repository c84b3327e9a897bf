"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Words are maximal runs of other bytes than space, tab, LF, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def id_mod(column: str, n: int) -> Column:
    """crc32 of the id written as text, modulo n; null ids count as an empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(n))


def draw(seed: int, *columns: str) -> Column:
    """A number from 0 to under 1 by a hash of the columns: 53 bits, so that small shares of very large tables stay small."""
    return F.shiftrightunsigned(F.xxhash64(*[F.col(quoted(c)) for c in columns], F.lit(seed)), 11) / F.lit(2.0**53)


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it. Without one, a temporary folder serves a
    local master (tests), and a cluster is refused: its executors would not find what others wrote."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError(f"set spark.checkpoint.dir to a folder that driver and executors share, for {purpose}")
    return tempfile.mkdtemp(prefix="clipsift-")


def shared_dir(spark: SparkSession) -> None:
    """Use the checkpoint folder that the cluster names; set one of our own only where none is named (tests)."""
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_folder(spark, "checkpoints"))


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage by a reliable checkpoint in the shared folder; Spark removes it with its last user."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def text_size(docs: DataFrame, text: str = "text") -> tuple[int, int]:
    """(rows, bytes of text) of the whole table, to derive numbers of buckets from."""
    row = docs.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(text)).alias("b")).first()
    return row["n"], row["b"] or 0


def spread(n_bytes: int, per: int) -> int:
    """Number of buckets for so many bytes."""
    return max(1, -(-n_bytes // per))


def carried(docs: DataFrame, keep, added, *more: Column) -> tuple[DataFrame, list]:
    """(columns `keep` and then `more`, named by place so that no name clashes; fields of the former). Columns to keep that
    are named like an added one, in any case, are left out."""
    names = {a.lower() for a in added}
    both = docs.select(*keep, *more)
    fields = both.schema.fields[: len(both.columns) - len(more)]
    placed = both.toDF(*[f"_{i}" for i in range(len(both.columns))])
    at = [i for i, f in enumerate(fields) if f.name.lower() not in names]
    out = placed.select(*[f"_{i}" for i in [*at, *range(len(fields), len(both.columns))]])
    return out, [fields[i] for i in at]


def quoted(name: str) -> str:
    """A column name as a reference, whatever characters it has."""
    return "`" + name.replace("`", "``") + "`"


def drop_ids(docs: DataFrame, gone: DataFrame, id_col: str = "doc_id", most_rows: int = 4_000_000) -> DataFrame:
    """Rows of docs whose id is not among the distinct ids of `gone`. Up to most_rows ids (about 32 MB) are broadcast, so docs
    are not shuffled; more are joined by a shuffle."""
    gone = cut(gone)
    if gone.count() <= most_rows:
        gone = F.broadcast(gone)
    return docs.join(gone, id_col, "left_anti").select(*map(quoted, docs.columns))


def remove_folder(spark: SparkSession, folder: str) -> None:
    """Remove a folder of the shared store, if it is there."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def numbered(rows: DataFrame, group: str, order: list[Column], name: str = "pos", part_rows: int = 200_000) -> DataFrame:
    """rows with their place, from 0, in the order of their group (null is a group). Ties are settled as Spark happens to sort them,
    once: the sorted rows are checkpointed.

    Rows are sorted by ranges of (group, order), so a group of any size is shared among tasks. A place is that within the
    range plus the rows of the group in ranges before; only groups that cross ranges have such, at most one a range, so these
    offsets are broadcast. Columns that begin with _run are used here.
    """
    keys = [F.col(group).asc_nulls_first(), *order]
    parts = spread(rows.count(), part_rows)
    ranges = cut(rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumns({"_run": F.spark_partition_id(), "_run_at": F.monotonically_increasing_id()}))
    before = Window.partitionBy(group).orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranges.groupBy(group, "_run").agg(F.count(F.lit(1)).alias("_run_n"))
    offsets = sizes.select(F.col(group).alias("_run_group"), F.col("_run").alias("_run_no"), F.sum("_run_n").over(before).alias("_run_before")).where("_run_before > 0")
    within = F.col("_run_at") - F.min("_run_at").over(Window.partitionBy(group, "_run"))
    placed = ranges.withColumn(name, within).join(F.broadcast(offsets), F.col(group).eqNullSafe(F.col("_run_group")) & (F.col("_run") == F.col("_run_no")), "left")
    return placed.withColumn(name, F.col(name) + F.coalesce("_run_before", F.lit(0))).select(*rows.columns, name)
