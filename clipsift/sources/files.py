"""Readers of the files beside a corpus: records, line sets, ranks, matrices, versions; and checks of schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clipsift.sources.readers import SPLIT_BYTES, MatrixSource, splits

VECTOR_NAMES = ("vector", "embedding_vec", "embedding", "vec")


def vector_column(columns: list[str]) -> str:
    """The first known name of a vector column."""
    for c in VECTOR_NAMES:
        if c in columns:
            return c
    raise ValueError("no vector column")


def model_column(columns: list[str]) -> str:
    """The one quantised vector column, vector_* but not vector_fp_*."""
    found = [c for c in columns if c.startswith("vector_") and not c.startswith("vector_fp_")]
    if len(found) != 1:
        raise ValueError(f"one vector column is needed, not {len(found)}")
    return found[0]


def chunk_start(columns: list[str]) -> Column:
    """Seconds of a clip's start, by the first of three columns there is; 0 where a name holds none."""
    if "chunk_start_unix" in columns:
        return F.col("chunk_start_unix").cast("long")
    if "start_timestamp_ns" in columns:
        return F.floor(F.col("start_timestamp_ns") / 1_000_000_000).cast("long")
    return F.coalesce(F.substring_index("chunk_id", "#t", -1).try_cast("long"), F.lit(0).cast("long"))


def chunk_end(columns: list[str]) -> Column | None:
    """Seconds of a clip's end, by the first of two columns there is; null where it is unknown (null or negative), None if no column
    tells it."""
    if "chunk_end_unix" in columns:
        return F.col("chunk_end_unix").cast("long")
    if "end_timestamp_ns" in columns:
        return F.when(F.col("end_timestamp_ns") >= 0, F.floor(F.col("end_timestamp_ns") / 1_000_000_000).cast("long"))
    return None


def read_records(spark: SparkSession, path: str, order: str, schema: str) -> DataFrame:
    """JSON records, the newest first; unreadable ones are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").option("recursiveFileLookup", "true").json(path).orderBy(F.col(order).desc())


def read_tables(spark: SparkSession, path: str) -> DataFrame:
    """All Parquet files below a folder."""
    return spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(path)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(segment_id): non-empty lines of text files, which may be compressed."""
    return spark.read.text(path).where("value != ''").select(F.col("value").alias("segment_id"))


def read_ranks(spark: SparkSession, path: str) -> DataFrame:
    """Parquet shards in rank=NNNNN folders, with their rank."""
    return spark.read.parquet(path)


def read_matrices(spark: SparkSession, path: str, metadata: DataFrame, row: str = "row", split: int = SPLIT_BYTES) -> DataFrame:
    """Rows of .npy matrices, numbered through the files in order of name, beside the metadata of the same row. A task reads at
    most `split` bytes of a file. Unequal numbers of rows, known from the files' headers, are an error."""
    total = sum(p.hi - p.lo for p in splits(path, split))
    if total != metadata.count():
        raise ValueError(f"{total} vectors for {metadata.count()} rows")
    spark.dataSource.register(MatrixSource)
    found = spark.read.format("npy").option("splitBytes", split).load(path)
    return metadata.join(found.withColumnRenamed("row", row), row)


def latest_version(spark: SparkSession, path: str, name: str = "version") -> int | None:
    """The highest version=N folder, without reading data; None if there is none."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(hadoop):
        return None
    found = [s.getPath().getName().partition("=") for s in system.listStatus(hadoop)]
    return max((int(v) for k, _, v in found if k == name and v.isdigit()), default=None)


def null_rate(df: DataFrame, column: str, rows: int | None = 200_000) -> float | None:
    """Share of nulls over at most `rows` rows, a quick look, or over all if that is None; None if there is no such column."""
    if rows is not None:
        df = df.limit(rows)
    return df.agg(F.avg(F.col(column).isNull().cast("double"))).first()[0] if column in df.columns else None


def validate(df: DataFrame, kinds: dict[str, str]) -> None:
    """Stop unless the columns are there with their types."""
    have = dict(df.dtypes)
    wrong = [f"{c}: {have.get(c, 'absent')}, not {k}" for c, k in kinds.items() if have.get(c) != k]
    if wrong:
        raise ValueError("; ".join(wrong))


#: Entry of a vector column's metadata that names its encoder.
MODEL = "model_id"


def with_model(df: DataFrame, column: str, model: str) -> DataFrame:
    """The table, its vector column naming its encoder; Parquet files that Spark writes keep the entry."""
    return df.withMetadata(column, {**df.schema[column].metadata, MODEL: model})


def validate_model(df: DataFrame, column: str, model: str) -> str:
    """The encoder that a vector column names. Stop if it names none, or another than `model` (blanks around it, letters of either
    case, - and _ do not matter): scores would look right and mean nothing."""
    if column not in df.columns:
        raise ValueError(f"{column}: absent")
    found = df.schema[column].metadata.get(MODEL)
    if not found:
        raise ValueError(f"{column} does not name its encoder")
    plain = lambda x: x.strip().lower().replace("-", "_")
    if plain(found) != plain(model):
        raise ValueError(f"{column} is of {found}, not of {model}")
    return found


def unit_vectors(v: Column) -> Column:
    """A vector scaled to unit length, by at least 1e-12."""
    n = F.sqrt(F.aggregate(F.transform(v, lambda x: x.cast("double") * x), F.lit(0.0), lambda a, x: a + x))
    return F.transform(v, lambda x: x / F.greatest(n, F.lit(1e-12)))
