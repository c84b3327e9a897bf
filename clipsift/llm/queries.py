"""The registered queries of this subpackage; each applies an operator to its whole table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clipsift.llm import alignment, chat, decontam, gru, jaccard, langid, manifest, merkle, mixing, secrets, substring, toxicity, urlfilter
from clipsift.llm.common import cut, id_mod, remove_folder, shared_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(table(spark, sf_dir, "documents"), weights=(5, 2, 1), share=1.5, most=2.0)
    return out.select("doc_id", "size", "source_size", "target", "taken")


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = id_mod("doc_id", 5) == 0
    return langid.predict(docs, langid.train(docs.where(~held)), keep=["doc_id", held.alias("held_out")])


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held = id_mod("doc_id", 3) == 1
    model = toxicity.train(docs.where(~held), labels.where(~held))
    return toxicity.score(docs, model, keep=["doc_id", held.alias("held_out")])


def op4_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(table(spark, sf_dir, "pages")).drop("bound")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("at")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.dedup(table(spark, sf_dir, "documents"), window=20)


def op7_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"), n=3, num=90, den=100)


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.fingerprints(table(spark, sf_dir, "documents")).drop("root", "edited_root", "next_root")


def op9_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return gru.score(docs, id_mod("doc_id", 7) != 2).withColumn("held_out", id_mod("doc_id", 7) == 2)


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return secrets.scan(docs, secrets.train(secrets.ordinary_sample(docs)))



def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"), links="end")


#: A conversation whose texts look like the marks of a format.
ODD_ID, ODD_TEXT = -7, r"\### Assistant: </turn> ok"


def op12_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    odd = spark.createDataFrame([(ODD_ID, 0, "user", ODD_TEXT), (ODD_ID, 1, "assistant", ODD_TEXT)], "conv_id long, turn long, role string, text string")
    messages = chat.conversations(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(odd))
    return chat.digests(chat.formatted(messages, chat.paths(messages))).drop("path")


def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    changed = F.when(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(2)) == 0, F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    claim = manifest.leaf_digest([changed if c == "text" else F.col(c) for c in manifest.FIELDS])
    folder = f"{shared_folder(spark, 'the node store')}/manifest-{uuid.uuid4().hex}"
    out = cut(manifest.prove(manifest.build(docs, folder, claim=claim)))
    remove_folder(spark, folder)
    return out


QUERIES = {f.__name__: f for f in (op1_mixing, op2_language, op3_toxicity, op4_urls, op5_decontamination, op6_substring_dedup, op7_jaccard, op8_fingerprints, op9_language_model, op10_secrets, op11_alignment, op12_chat, op13_manifest)}
