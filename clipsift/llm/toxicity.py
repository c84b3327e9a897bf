"""Operator 3: toxicity by a convolutional text classifier.

A word's embedding is the sum of those of its hash and of the hashes of its first 4 and 6 letters, so that inflected forms
share most of theirs; each kind has 2**BITS of them. Filters of widths 1, 2 and 3 slide over them, each filter keeps its maximum over
the whole text, and a logistic unit combines them.

All labelled rows are learnt from. A fifth of them, by a hash of the id, is held back. Of the others Spark counts in how many
documents of each class a bucket occurs, and embeddings start from the shrunken log odds of these counts. Descent (numpy)
is begun on the driver on at most `per_class` rows of each class, which is only where it starts: then, for `rounds` rounds, shards
of about `shard_bytes` of text each take the parameters through all of their rows, and Spark averages them: embeddings by the
shard's documents that hold the bucket, the rest by the shard's rows. All held-back rows are then scored and counted by
language (as identified from the text), class and score, which sets a threshold for each language; scores are scaled so that it
becomes 0.7. The languages' model counts all rows that have a language. Only sums of fixed size reach the driver.

Scoring is map-only. As a filter is linear in its words, each (width, position) is folded into a table by bucket, and a
convolution is a sum of looked-up rows; the table has a fixed size and travels with the tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from clipsift.llm.langid import LanguageModel
from clipsift.llm.langid import train as train_languages
from clipsift.llm.common import carried, cut, draw, quoted, spread
from clipsift.llm.textkit import mix, pieces, tidy, words

BITS, DIM, FILTERS, WIDTHS = 15, 8, 6, (1, 2, 3)
CUT = 0.7
#: Documents of a step of descent, embeddings of a block when they are averaged, and steps of the scores that thresholds part.
BATCH, BLOCK, BINS = 32, 1 << 12, 1 << 12
#: Lengths in bytes of the beginnings of a word that have embeddings of their own.
STEMS = (4, 6)
_KINDS = 1 + len(STEMS)
_PAD = _KINDS << BITS
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_FOLD = np.arange(256, dtype=np.uint64)
_FOLD[65:91] += np.uint64(32)
#: Names of the columns added; columns to keep that clash with them are left out.
ADDED = ("score", "predicted")


def word_buckets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of each word by kind, one row a word; first word of each document and the end), A-Z folded."""
    w = words(data, offsets, lower=True)
    out = np.empty((len(w.hash), _KINDS), np.int32)
    out[:, 0] = w.hash >> np.uint64(64 - BITS)
    h, at, more, kind = np.zeros(len(w.hash), np.uint64), w.start.copy(), np.ones(len(w.hash), bool), 0
    for k in range(max(STEMS)):
        more &= at < w.end
        byte = data[np.minimum(at, len(data) - 1)] if len(data) else np.zeros(0, np.uint8)
        more &= _LETTER[byte]
        h = np.where(more, h * np.uint64(257) + _FOLD[byte], h)
        at += 1
        if k + 1 in STEMS:
            kind += 1
            out[:, kind] = (mix(h) >> np.uint64(64 - BITS)).astype(np.int32) + (kind << BITS)
    return out, w.ptr


def _padded(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Documents one after another, each followed by blanks so that every filter fits and none crosses."""
    blank = np.full((max(WIDTHS), _KINDS), _PAD, np.int32)
    ids = np.concatenate([x for p in parts for x in (p, blank)])
    return ids, np.cumsum([0, *[len(p) + len(blank) for p in parts]])


@dataclass
class Classifier:
    """table: what each bucket adds to the filters, by position, then width (ascending) of those that reach it; logistic
    weights; thresholds by language."""

    table: np.ndarray
    bias: np.ndarray
    weights: np.ndarray
    offset: float
    thresholds: dict[str, float]
    languages: LanguageModel

    def features(self, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Maximum of each filter over each padded document."""
        x = self.table.take(ids[:, 0], axis=0)
        for kind in range(1, _KINDS):
            x += self.table.take(ids[:, kind], axis=0)
        filters = lo = len(self.bias)
        for j in range(1, max(WIDTHS)):
            n = sum(w > j for w in WIDTHS) * FILTERS
            x[:-j, filters - n : filters] += x[j:, lo : lo + n]
            lo += n
        for j in range(1, max(WIDTHS)):
            x[at[1:] - j, :filters] = -np.inf  # blanks from which a filter reaches the next document
        return np.maximum(np.maximum.reduceat(x[:, :filters], at[:-1], axis=0) + self.bias, 0)

    def raw(self, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.features(ids, at) @ self.weights + self.offset, -30, 30)))

    def probabilities(self, column: pa.Array) -> np.ndarray:
        """Of each text, before it is scaled by a threshold."""
        p = np.zeros(len(column))
        blank = max(WIDTHS)
        for lo, hi, data, offsets in pieces(column, 1 << 17):
            ids, ptr = word_buckets(data, offsets)
            padded = np.full((len(ids) + blank * (hi - lo), _KINDS), _PAD, np.int32)
            padded[np.arange(len(ids)) + np.repeat(np.arange(hi - lo), np.diff(ptr)) * blank] = ids
            p[lo:hi] = self.raw(padded, ptr + np.arange(hi - lo + 1) * blank)
        return p

    def identified(self, column: pa.Array) -> np.ndarray:
        """Language of each text; empty if none is known."""
        if not self.languages.languages:
            return np.full(len(column), "", dtype=object)
        return np.array(self.languages.languages, dtype=object)[self.languages.scores(column).argmax(axis=1)]

    def scores(self, column: pa.Array) -> np.ndarray:
        t = np.array([self.thresholds.get(x, self.thresholds[""]) for x in self.identified(column)])
        return scaled(self.probabilities(column), t)


def scaled(p: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Monotone: 0 to 0, the threshold t to 0.7, 1 to 1."""
    return np.where(p < t, CUT * p / t, CUT + (1 - CUT) * (p - t) / (1 - t))


@dataclass
class Parameters:
    """Embeddings by bucket, filters by width (positions, DIM, FILTERS), and the logistic unit."""

    emb: np.ndarray
    filters: list[np.ndarray]
    bias: np.ndarray
    weights: np.ndarray
    offset: float

    @classmethod
    def start(cls, seen: np.ndarray, seed: int = 5) -> Parameters:
        """From how many documents of each class (clean, toxic) hold each bucket; the last place counts all documents."""
        rng = np.random.default_rng(seed)
        n0, n1 = np.maximum(1, seen[:, _PAD])
        odds = np.log((seen[1] + 0.5) / (n1 + 1)) - np.log((seen[0] + 0.5) / (n0 + 1))
        emb = rng.normal(0, 0.01, (_PAD + 1, DIM))
        certain = odds**2 / (1 / (seen + 0.5)).sum(0)  # squared standard score
        emb[:, 0] = odds * np.maximum(0, 1 - 6 / np.maximum(certain, 1e-9))
        emb[_PAD] = 0
        filters = [rng.normal(0, 0.1, (w, DIM, FILTERS)) for w in WIDTHS]
        for f in filters:
            f[0, 0] += 0.5 * np.where(np.arange(FILTERS) % 2 == 0, 1, -1)
        return cls(emb, filters, np.zeros(len(WIDTHS) * FILTERS), np.tile(np.where(np.arange(FILTERS) % 2 == 0, 0.5, -0.1), len(WIDTHS)), 0.0)

    def rest(self) -> np.ndarray:
        """All but the embeddings, in a row."""
        return np.concatenate([*[f.ravel() for f in self.filters], self.bias, self.weights, [self.offset]])

    def with_rest(self, emb: np.ndarray, rest: np.ndarray) -> Parameters:
        """Others of this shape."""
        *filters, bias, weights, offset = np.split(rest, np.cumsum([*[f.size for f in self.filters], self.bias.size, self.weights.size]))
        return Parameters(emb, [x.reshape(f.shape) for x, f in zip(filters, self.filters, strict=True)], bias, weights, float(offset[0]))

    def classifier(self, model: LanguageModel) -> Classifier:
        table = np.concatenate([self.emb @ f[j] for j in range(max(WIDTHS)) for f in self.filters if j < len(f)], axis=1)
        return Classifier(table.astype(np.float32), self.bias.astype(np.float32), self.weights.astype(np.float32), float(self.offset), {"": 0.5}, model)


def fit(start: Parameters, texts: list[np.ndarray], y: np.ndarray, *, epochs: int, rate: float = 0.05, seed: int = 5) -> Parameters:
    """Descent from `start` over documents of word buckets, every one of them once an epoch."""
    rng = np.random.default_rng(seed)
    net = start.with_rest(start.emb.copy(), start.rest())
    emb, filters, bias, weights, offset = net.emb, net.filters, net.bias, net.weights, net.offset
    cache = [np.full_like(x, 1e-3) for x in (emb, *filters, bias, weights)]
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for lo in range(0, len(order), BATCH):
            take = order[lo : lo + BATCH]
            ids, at = _padded([texts[i] for i in take])
            x = emb[ids].sum(axis=1)
            best, top = [], []
            for f in filters:
                conv = x @ f[0]
                for j in range(1, len(f)):
                    conv[:-j] += x[j:] @ f[j]
                where = np.array([conv[a : b - max(WIDTHS) + 1].argmax(axis=0) + a for a, b in zip(at[:-1], at[1:], strict=True)])
                best.append(where)
                top.append(np.take_along_axis(conv, where, axis=0))
            z = np.concatenate(top, axis=1) + bias
            feat = np.maximum(z, 0)
            p = 1 / (1 + np.exp(-np.clip(feat @ weights + offset, -30, 30)))
            err = (p - y[take]) / BATCH
            g_weights, g_offset = feat.T @ err + 1e-4 * weights, err.sum()
            g_feat = err[:, None] * weights * (z > 0)
            g_filters = [np.zeros_like(f) for f in filters]
            rows, grads = [], []
            for k, f in enumerate(filters):
                g = g_feat[:, k * FILTERS : (k + 1) * FILTERS]
                for j in range(len(f)):
                    pos = np.minimum(best[k] + j, len(ids) - 1)
                    g_filters[k][j] = np.einsum("nfd,nf->df", x[pos], g)
                    part = (g[:, :, None] * f[j].T[None]).reshape(-1, DIM)
                    for kind in range(_KINDS):
                        rows.append(ids[pos, kind].ravel())
                        grads.append(part)
            rows, grads = np.concatenate(rows), np.concatenate(grads)
            uniq, inv = np.unique(rows, return_inverse=True)
            g_emb = np.zeros((len(uniq), DIM))
            np.add.at(g_emb, inv, grads)
            cache[0][uniq] += g_emb**2
            emb[uniq] -= rate * g_emb / np.sqrt(cache[0][uniq])
            emb[_PAD] = 0
            for v, g, c in zip((*filters, bias, weights), (*g_filters, g_feat.sum(0), g_weights), cache[1:], strict=True):
                c += g**2
                v -= rate * g / np.sqrt(c)
            offset -= rate * g_offset
    return Parameters(emb, filters, bias, weights, float(offset))


def best_threshold(counts: np.ndarray, default: float, least: int = 20) -> float:
    """From rows counted by class (clean, toxic) and step of the score: at the most right decisions, in the middle of the widest
    gap; the default below `least` rows of a class."""
    if counts.sum(axis=1).min() < least:
        return default
    right = np.concatenate([[0], np.cumsum(counts[0])]) + counts[1].sum() - np.concatenate([[0], np.cumsum(counts[1])])
    top = np.flatnonzero(right == right.max())
    apart = np.flatnonzero((np.diff(top) > 1) | (counts.sum(axis=0)[top[:-1]] > 0)) + 1
    gaps = [(g[0], g[-1]) for g in np.split(top, apart)]
    lo, hi = max(gaps, key=lambda g: g[1] - g[0])
    return float(np.clip((lo + hi) / 2 / counts.shape[1], 0.02, 0.98))


def _words(column: pa.Array | pa.ChunkedArray) -> list[np.ndarray]:
    """Word buckets of each text."""
    out = []
    for _, _, data, offsets in pieces(column):
        ids, ptr = word_buckets(data, offsets)
        out += [ids[a:b] for a, b in zip(ptr[:-1], ptr[1:], strict=True)]
    return out


def _reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = [x.astype("<i4").tobytes() for x in _words(batch.column("text"))]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), pa.array(out, pa.binary())], names=["doc_id", "toxic", "words"])


def _seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(toxic, bucket, n): documents of a task that hold each bucket, and all of them as those that hold the blank."""
    seen = np.zeros((2, _PAD + 1), np.int64)
    for batch in batches:
        for y, x in zip(batch.column("toxic").to_pylist(), _words(batch.column("text")), strict=True):
            seen[y, np.unique(x)] += 1
            seen[y, _PAD] += 1
    y, bucket = np.nonzero(seen)
    yield pa.RecordBatch.from_arrays([pa.array(y.astype(np.int32)), pa.array(bucket.astype(np.int32)), pa.array(seen[y, bucket])], names=["toxic", "bucket", "n"])


def _learn(table: pa.Table, net: Parameters, epochs: int, rate: float, seed: int) -> pa.Table:
    """Of one shard: the parameters after all its rows, in blocks of rows of a weight each."""
    rows = sorted(zip(table["doc_id"].to_pylist(), [x.tobytes() for x in _words(table["text"])], table["toxic"].to_pylist(), strict=True))
    texts = [np.frombuffer(x, np.int32).reshape(-1, _KINDS) for _, x, _ in rows]
    weight = np.zeros(_PAD + 1, "<f4")
    for x in texts:
        weight[np.unique(x)] += 1
    net = fit(net, texts, np.array([y for _, _, y in rows], float), epochs=epochs, rate=rate, seed=seed)
    tidy()
    blocks = [(net.emb[a : a + BLOCK], weight[a : a + BLOCK]) for a in range(0, _PAD + 1, BLOCK)]
    blocks.append((net.rest(), np.array([len(rows)], "<f4")))
    n, shard = len(blocks), table["shard"][0].as_py()
    cols = [pa.array(range(n), pa.int32()), pa.array([shard] * n, pa.int32()), pa.array([w.tobytes() for _, w in blocks], pa.binary()), pa.array([v.astype("<f4").tobytes() for v, _ in blocks], pa.binary())]
    return pa.table(cols, names=["block", "shard", "weight", "value"])


def _mean(table: pa.Table) -> pa.Table:
    """Of one block: the weighted mean of each of its rows over the shards, and the weights' sums."""
    total, weight = 0.0, 0.0
    for _, w, v in sorted(zip(*(table[c].to_pylist() for c in ("shard", "weight", "value")), strict=True)):
        w = np.frombuffer(w, "<f4").astype(np.float64)
        total, weight = total + w[:, None] * np.frombuffer(v, "<f4").reshape(len(w), -1), weight + w
    value = total / np.maximum(weight, 1)[:, None]
    return pa.table([table["block"][:1], pa.array([weight.astype("<f8").tobytes()], pa.binary()), pa.array([value.astype("<f8").tobytes()], pa.binary())], names=["block", "weight", "value"])


def _round(rows: DataFrame, net: Parameters, epochs: int, rate: float, seed: int) -> Parameters:
    """All shards' descents from `net`, averaged. Buckets that no shard has stay as they were."""
    learnt = rows.groupBy("shard").applyInArrow(lambda t: _learn(t, net, epochs, rate, seed), "block int, shard int, weight binary, value binary")
    *emb, rest = sorted(learnt.groupBy("block").applyInArrow(_mean, "block int, weight binary, value binary").collect())
    weight = np.concatenate([np.frombuffer(r["weight"]) for r in emb])
    value = np.concatenate([np.frombuffer(r["value"]) for r in emb]).reshape(-1, DIM)
    return net.with_rest(np.where(weight[:, None] > 0, value, net.emb), np.frombuffer(rest["value"]).copy())


def _steps(batches: Iterator[pa.RecordBatch], model: Classifier) -> Iterator[pa.RecordBatch]:
    """(lang, toxic, step, n) of held-back rows by batch."""
    for batch in batches:
        p = np.minimum(model.probabilities(batch.column("text")) * BINS, BINS - 1).astype(np.int32)
        t = pa.table([pa.array(model.identified(batch.column("text")), pa.string()), batch.column("toxic"), pa.array(p)], names=["lang", "toxic", "step"])
        yield from t.group_by(["lang", "toxic", "step"]).aggregate([([], "count_all")]).rename_columns(["lang", "toxic", "step", "n"]).to_batches()


def within_bytes(rows: DataFrame, most: int) -> DataFrame:
    """Of a sample (doc_id, text, ..), the rows whose text still fits into `most` bytes, in the order of a hash. Only ids and
    sizes are ranked, a few thousand rows."""
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if total <= most:
        return rows
    order = Window.orderBy(F.xxhash64("doc_id", F.lit(3)), "doc_id", "_n").rowsBetween(Window.unboundedPreceding, 0)
    fits = rows.select("doc_id", F.octet_length("text").alias("_n")).withColumn("_sum", F.sum("_n").over(order)).where(F.col("_sum") <= most)
    return rows.withColumn("_n", F.octet_length("text")).join(F.broadcast(fits.select("doc_id", "_n").distinct()), ["doc_id", "_n"]).drop("_n")


def train(docs: DataFrame, labels: DataFrame, *, per_class: int = 3000, sample_bytes: int = 64 << 20, shard_bytes: int = 24 << 20, rounds: int = 2, languages: LanguageModel | None = None, id_col: str = "doc_id", text_col: str = "text", toxic_col: str = "toxic") -> Classifier:
    """Fit on all labelled rows. `per_class` rows of each class and `sample_bytes` of their text bound only the rows on which the
    driver begins, so that even very long texts do not fill it.

    A document with labels of both classes counts as toxic; null labels are not used; ids may be of any type that labels and
    documents share. Without rows of both classes every score is low.
    """
    model = languages or train_languages(docs, id_col=id_col, text_col=text_col, per_language=None)
    key = F.col(quoted(id_col)).cast("string")
    known = labels.where(F.col(quoted(toxic_col)).isNotNull()).groupBy(key.alias("doc_id")).agg((F.max(F.col(quoted(toxic_col)).cast("int")) == 1).cast("int").alias("toxic"))
    held = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(5)) == 0
    rows = cut(docs.select(key.alias("doc_id"), F.col(quoted(text_col)).alias("text")).where(F.col("text").isNotNull()).join(known.hint("merge"), "doc_id").withColumn("held", held))
    used = rows.where(~F.col("held")).drop("held")
    seen = np.zeros((2, _PAD + 1))
    counted = used.mapInArrow(_seen, "toxic int, bucket int, n long").groupBy("toxic", "bucket").agg(F.sum("n").alias("n")).toPandas()
    seen[counted["toxic"], counted["bucket"]] = counted["n"]
    n = seen[:, _PAD]
    if not n.all():
        return Classifier(np.zeros((_PAD + 1, sum(WIDTHS) * FILTERS), np.float32), np.zeros(len(WIDTHS) * FILTERS, np.float32), np.zeros(len(WIDTHS) * FILTERS, np.float32), -5.0, {"": 0.5}, model)
    part = F.when(F.col("toxic") == 1, min(1.0, per_class / n[1])).otherwise(min(1.0, per_class / n[0]))
    sample = sorted(within_bytes(used.where(draw(3, "doc_id") < part), sample_bytes).mapInArrow(_reduce, "doc_id string, toxic int, words binary").collect())
    net = Parameters.start(seen)
    if sample:
        net = fit(net, [np.frombuffer(r["words"], "<i4").reshape(-1, _KINDS) for r in sample], np.array([r["toxic"] for r in sample], float), epochs=3)
    n_bytes = used.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    dealt = used.withColumn("shard", F.pmod(F.xxhash64("doc_id", "text", F.lit(5)), F.lit(spread(n_bytes, shard_bytes))).cast("int"))
    for k in range(rounds):
        net = _round(dealt, net, 2, 0.05 / (k + 1), k)
    out = net.classifier(model)
    steps = rows.where("held").mapInArrow(lambda b: _steps(b, out), "lang string, toxic int, step int, n long").groupBy("lang", "toxic", "step").agg(F.sum("n").alias("n")).toPandas()
    counts = {name: np.zeros((2, BINS), np.int64) for name in ("", *sorted(set(steps["lang"])))}
    for r in steps.itertuples():
        counts[r.lang][r.toxic, r.step] += r.n
    every = best_threshold(sum(counts.values()), 0.5)
    out.thresholds = {name: best_threshold(c, every) for name, c in counts.items()}
    out.thresholds[""] = every
    return out


def score(docs: DataFrame, model: Classifier, *, text_col: str = "text", keep: list[str | Column] = ("doc_id",)) -> DataFrame:
    """`keep` columns with score and predicted (1 if score >= 0.7).

    Null and empty texts get the score of a text without words; texts of any length count whole. Repeated rows are scored
    each, empty tables give no rows. Columns to keep may have any names, those of helpers too; the ones named like an added
    column are left out.
    """
    kept, fields = carried(docs, keep, ADDED, F.col(quoted(text_col)))
    k = len(fields)
    schema = StructType([*fields, StructField("score", DoubleType()), StructField("predicted", IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = model.scores(batch.column(k))
            yield pa.RecordBatch.from_arrays([*batch.columns[:k], pa.array(s), pa.array((s >= CUT).astype(np.int32))], names=[f.name for f in schema])
        tidy()

    return kept.mapInArrow(run, schema)
