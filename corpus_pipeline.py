"""A corpus pipeline of five stages; each is written as Parquet and read again as the next one's documents."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clipsift.llm import decontam, jaccard, langid, mixing, secrets
from clipsift.llm.common import cut, drop_ids, quoted, remove_folder, shared_folder

#: Below this posterior probability of its best language a document is rejected.
LEAST_SCORE = 0.6


def packed(docs: DataFrame) -> DataFrame:
    """Rows as (_doc, _text): all columns in a struct, so that none clashes with those an operator adds."""
    return docs.select(F.struct(*[F.col(quoted(c)) for c in docs.columns]).alias("_doc"), F.col("text").alias("_text"))


def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, and those of no clear language, go."""
    model = langid.train(docs)
    judged = langid.predict(packed(docs), model, text_col="_text", keep=["_doc"])
    return judged.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select("_doc.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by five-word shingles at a similarity of 0.8, the smallest id stays."""
    gone = jaccard.join(docs, n=5, num=80, den=100).where("component_id < doc_id").select("doc_id").distinct()
    return drop_ids(docs, gone)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, within the error budget, go."""
    return decontam.screen(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the text; n_chars follows."""
    found = secrets.scan(packed(docs), secrets.train(secrets.ordinary_sample(docs)), text_col="_text", keep=["_doc"], redact=True)
    changed = {"text": F.col("redacted"), "n_chars": F.length("redacted").cast("long")}
    return found.select(*[changed[c].alias(c) if c in changed else F.col("_doc").getField(c).alias(c) for c in docs.columns])


#: What the last stage adds to the columns of documents.
MIXED = ("size", "source_size", "target", "taken")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which the mix takes something, with all their columns and how many words it takes; the others go. Columns
    named like those of the mix give way to these. Rows are known by a number given to the written rows, as ids may repeat."""
    rows = cut(docs.select(F.struct(*[F.col(quoted(c)) for c in docs.columns]).alias("_doc")).withColumn("_row", F.monotonically_increasing_id()))
    of = lambda c: F.col("_doc").getField(c)
    mixed = mixing.mix(rows.select(of("doc_id").alias("doc_id"), of("source").alias("source"), of("text").alias("text"), "_row"), row_col="_row")
    taken = mixed.where("taken > 0").select(F.col("row").alias("_row"), F.struct(*MIXED).alias("_mix"))
    kept = [of(c).alias(c) for c in docs.columns if c.lower() not in MIXED]
    return rows.join(taken, "_row").select(*kept, "_mix.*")


STAGES = [
    ("language", keep_known_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("secrets", mask_secrets),
    ("mixing", mix_sources),
]
#: Learned and iterative stages: not expressible in SQL.
ORACLE_SQL = None


def _stages(spark: SparkSession, sf_dir: str, base: str) -> DataFrame:
    """The last stage's result; what is between stages is kept under `base` until the next is written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
        if before:
            remove_folder(spark, before)
        before = f"{base}/{name}"
    return STAGES[-1][1](spark, docs, sf_dir)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over documents: the corpus with masked texts, all its columns and what the mix takes. The result reads
    checkpoints only, so nothing stays in the shared folder but these, which go with it."""
    base = f"{shared_folder(spark, 'the stages of the pipeline')}/pipeline-{uuid.uuid4().hex}"
    out = _stages(spark, sf_dir, base)
    remove_folder(spark, base)
    return out


def write(spark: SparkSession, sf_dir: str, path: str) -> None:
    """The corpus as Parquet in a new folder."""
    run(spark, sf_dir).write.parquet(path)
