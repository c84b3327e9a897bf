"""Operator 2: language identification by multinomial naive Bayes over hashed character n-grams.

n-grams of `ORDERS` characters (code points) of the case-folded text, in which other characters than letters and marks are
blanks, are hashed into 2**BITS buckets per order. Training counts buckets per language over a bounded sample of labelled rows (`per_language` rows of each,
by a hash of the id), summed by Spark; only the (languages x buckets) counts reach the driver. The log-probability matrix
has that fixed size and travels with the tasks; texts are scored in numpy, a piece of an Arrow batch at a time, from sparse
counts of (document, bucket): each count times its row of the matrix. Scoring is map-only and sees whole texts, of any length.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from clipsift.llm.common import carried, draw, quoted
from clipsift.llm.textkit import pieces, tidy

ORDERS, BITS = (2, 3, 4), 14
#: Code points with a place in the table of folding; those beyond count as letters as they are.
_LETTERS = 0x10000


def _folding() -> np.ndarray:
    """Of each code point under _LETTERS: its lower case if it is a letter or mark, else a blank."""
    out = np.full(_LETTERS, 32, np.uint32)
    for i in range(_LETTERS):
        c = chr(i)
        if unicodedata.category(c)[0] in "LM":
            low = c.lower()
            out[i] = ord(low) if len(low) == 1 else i
    return out


_FOLD = _folding()
UNKNOWN = "und"
#: Names of the columns added; columns to keep that clash with them are left out.
ADDED = ("lang_pred", "score")


def characters(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(folded code points, first of each document and the end) of documents one after another in UTF-8."""
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le", "replace"), np.uint32)
    begins = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    return np.where(points < _LETTERS, _FOLD[np.minimum(points, _LETTERS - 1)], points), begins[offsets]


def _hashed(code: np.ndarray, order: int) -> np.ndarray:
    """Bucket of the n-gram from each of `code`, but the last order - 1."""
    n = max(0, len(code) - order + 1)
    h = np.zeros(n, np.uint32)
    for j in range(order):
        h = h * np.uint32(0x01000193) + code[j : n + j]
    return ((h * np.uint32(2654435761)) >> np.uint32(32 - BITS)).astype(np.int64) + (ORDERS.index(order) << BITS)


def sparse_counts(data: np.ndarray, offsets: np.ndarray, most: int = 1 << 21) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, bucket, count) of the n-grams that occur, by document, then bucket. A single document of over `most`
    characters is counted in stretches of as many, so that memory stays near that of its characters."""
    code, at = characters(data, offsets)
    n, size = len(code), len(ORDERS) << BITS
    if len(at) == 2 and n > most:
        total = np.zeros(size, np.int64)
        for lo in range(0, n, most):
            for order in ORDERS:
                total += np.bincount(_hashed(code[lo : lo + most + order - 1], order), minlength=size)
        bucket = np.flatnonzero(total)
        return np.zeros(len(bucket), np.int64), bucket, total[bucket]
    doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
    left = at[1:][doc] - np.arange(n)
    keys = []
    for order in ORDERS:
        bucket = _hashed(code, order)
        keys.append((doc[: len(bucket)] * size + bucket)[left[: len(bucket)] >= order])
    key, count = np.unique(np.concatenate(keys), return_counts=True)
    return key // size, key % size, count


@dataclass
class LanguageModel:
    """languages and matrix (buckets, languages) of log probabilities, prior: their log frequencies."""

    languages: list[str]
    matrix: np.ndarray
    prior: np.ndarray

    def scores(self, column: pa.Array) -> np.ndarray:
        """Log joint probability of each text with each language."""
        out = np.tile(self.prior, (len(column), 1))
        for lo, _, data, offsets in pieces(column, 1 << 20):
            doc, bucket, count = sparse_counts(data, offsets)
            if len(doc):
                first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
                out[lo + doc[first]] += np.add.reduceat(self.matrix[bucket] * count[:, None], first, axis=0, dtype=np.float64)
        return out


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, bucket, n) of each batch."""
    size = len(ORDERS) << BITS
    for batch in batches:
        lang = np.array(batch.column("lang").to_pylist(), dtype=object)
        for name in sorted(set(lang)):
            total = np.zeros(size, np.int64)
            for _, _, data, offsets in pieces(batch.column("text").filter(pa.array(lang == name)), 1 << 20):
                _, bucket, count = sparse_counts(data, offsets)
                np.add.at(total, bucket, count)
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at), pa.array(total[at])], names=["lang", "bucket", "n"])


def train(labelled: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int | None = 1500, alpha: float = 0.5) -> LanguageModel:
    """Fit on at most about `per_language` rows of each language, chosen by a hash of the id, or on all rows if that is None. Rows
    with a null text or language are not used."""
    rows = labelled.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    n = {r["lang"]: r["n"] for r in rows.groupBy(F.col(lang_col).alias("lang")).agg(F.count(F.lit(1)).alias("n")).collect()}
    if not n:
        return LanguageModel([], np.zeros((len(ORDERS) << BITS, 0), np.float32), np.zeros(0))
    names = sorted(n)
    if per_language is not None:
        part = F.create_map(*[F.lit(x) for k in names for x in (k, min(1.0, per_language / n[k]))])
        rows = rows.where(draw(2, id_col) < part[F.col(lang_col)])
    sample = rows.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    counted = sample.mapInArrow(_counts, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    matrix = np.full((len(ORDERS), 1 << BITS, len(names)), alpha)
    matrix.reshape(-1, len(names))[counted["bucket"], counted["lang"].map(names.index)] += counted["n"]
    matrix = np.log(matrix / matrix.sum(axis=1, keepdims=True)).reshape(-1, len(names))
    total = sum(n.values())
    return LanguageModel(names, matrix.astype(np.float32), np.log([n[k] / total for k in names]))


def predict(docs: DataFrame, model: LanguageModel, *, text_col: str = "text", keep: list[str | Column] = ("doc_id",)) -> DataFrame:
    """`keep` columns with lang_pred and score, the posterior probability of lang_pred.

    Null texts and texts without a letter get und and score 0, as does everything if the model knows no language. Ties go to
    the first language by name. Repeated rows are judged each, empty tables give no rows, texts of any length count whole.
    Columns to keep may have any names, those of helpers too; the ones named like an added column are left out.
    """
    kept, fields = carried(docs, keep, ADDED, F.coalesce(F.col(quoted(text_col)).rlike(r"\p{L}"), F.lit(False)), F.col(quoted(text_col)))
    k = len(fields)
    schema = StructType([*fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            letter = batch.column(k).to_numpy(zero_copy_only=False).astype(bool)
            if model.languages:
                joint = model.scores(batch.column(k + 1))
                best = joint.argmax(axis=1)
                p = 1 / np.exp(joint - joint.max(axis=1, keepdims=True)).sum(axis=1)
                lang = np.array(model.languages, dtype=object)[best]
            else:
                lang, p = np.full(batch.num_rows, UNKNOWN, dtype=object), np.zeros(batch.num_rows)
            lang[~letter], p[~letter] = UNKNOWN, 0.0
            yield pa.RecordBatch.from_arrays([*batch.columns[:k], pa.array(lang, pa.string()), pa.array(p)], names=[f.name for f in schema])
        tidy()

    return kept.mapInArrow(score, schema)
