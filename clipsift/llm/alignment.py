"""Operator 11: alignment of two tokenizers over elementary intervals.

Both tokenizers encode the same bytes, so their tokens are ranges that end at certain offsets. The union of both arrays of
ends cuts the bytes into elementary intervals; each lies in one token of either side (its owners, by searchsorted), and is
one overlap of the two. Where both sides end, a group closes. What counts as a link is a choice: tokens that end together,
that overlap, or all products of a group.

A text is encoded by segments, cut before single blanks at which neither tokenizer can join what stands on both sides: A cuts
there before it merges, and no piece of B has a blank after another character. So tokens are those of the whole text, equal
segments of a slice are encoded once, and a text of any length needs the memory of a slice or of its longest segment.

How often a pair is linked in the corpus: slices of about `slice_bytes` of text send their distinct pairs to parts by a hash of
the pair, so a frequent pair costs one entry a slice; parts add up and send totals back. The highest total of each B id, at
most one number for each entry of B's vocabulary, goes to all tasks. The encoded slices are checkpointed, and not made again.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import sentencepiece
import tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clipsift.llm.common import cut, quoted, spread
from clipsift.llm.textkit import mix, pieces, tidy

FOLDER = "/opt/tokenizers"
A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Before such blanks a text may be cut: not next to other white space, nor after or before the mark U+2581 (E2 96 81).
CUT = re.compile(rb"(?<=[^\x09-\x0d\x20\x81]) (?=[\x21-\x7e\xc3-\xe0\xe4-\xf4])")
#: So many segments are encoded at once.
AT_ONCE = 5_000
MARK = "▁"
SLICES = "slice long, row array<long>, doc_id array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, n_overlaps array<long>, groups_sha256 array<string>, n_pairs long, pairs binary, link binary"
LINKS = "part int, slice long, pairs binary, counts binary"
DOCS = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, n_overlaps long, n_best long, count_sum long, groups_sha256 string"
_LOW = np.uint64((1 << 32) - 1)


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in byte-level vocabularies: itself if printable, else the next from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(c): b for b, c in [*zip(plain, plain, strict=True), *zip(others, range(256, 256 + len(others)), strict=True)]}


def pack(values: np.ndarray) -> bytes:
    """Integers as compressed bytes, low bytes of all first."""
    v = np.ascontiguousarray(values)
    size = len(v).to_bytes(8, "little") + bytes([v.itemsize])
    return size + pa.compress(np.ascontiguousarray(v.view(np.uint8).reshape(-1, v.itemsize).T).tobytes(), codec="zstd", asbytes=True) if len(v) else size


def unpack(blob: bytes) -> np.ndarray:
    """Reverse of pack, unsigned."""
    n, width = int.from_bytes(blob[:8], "little"), blob[8]
    if not n:
        return np.zeros(0, f"<u{width}")
    flat = np.frombuffer(pa.decompress(blob[9:], decompressed_size=n * width, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(flat.reshape(width, -1).T).reshape(-1).view(f"<u{width}")


class Tokenizers:
    """Both tokenizers, the bytes of their tokens, and the alignment of segments."""

    def __init__(self, a: bytes, b: bytes) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.a = tokenizers.Tokenizer.from_buffer(a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b)
        alphabet, spec = byte_alphabet(), json.loads(a)
        self.a_bytes = [b""] * (max(spec["model"]["vocab"].values()) + 1)
        for entry, i in spec["model"]["vocab"].items():
            self.a_bytes[i] = bytes(alphabet[c] for c in entry) if all(c in alphabet for c in entry) else entry.encode()
        named = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(named)]
        self.a_size, self.b_size = (np.array([len(t) for t in x], np.int64) for x in (self.a_bytes, self.b_bytes))
        split = spec.get("pre_tokenizer") or {}
        by_words = spec.get("normalizer") is None and split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space")
        self.cuts = bool(by_words) and not any(re.search(f"[^{MARK}]{MARK}", p) for p in named)
        n = max(len(self.a_bytes), len(self.b_bytes))
        self.n, self.written = n, [f"{i}{mark}".encode() for mark in ",|;" for i in range(n)]

    def segments(self, text: bytes) -> list[bytes]:
        return CUT.split(text) if self.cuts else [text]

    def ids(self, segments: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        a = self.a.encode_batch([f" {s}" for s in segments], add_special_tokens=False)
        return [e.ids for e in a], self.b.encode(segments, num_threads=1)


class Aligned:
    """Distinct segments and, by segment: whether both sides give its bytes, numbers of tokens, groups, overlaps and links, its
    groups in writing, and its links as keys (A id << 32 | B id) from ptr on."""

    def __init__(self, tok: Tokenizers, segments: list[bytes], links: str) -> None:
        n = len(segments)
        self.ok = np.zeros(n, bool)
        self.n_a, self.n_b, self.n_groups, self.n_overlaps, self.n_links = (np.zeros(n, np.int64) for _ in range(5))
        self.written: list[bytes] = [b""] * n
        keys = []
        for lo in range(0, n, AT_ONCE):
            keys.append(self._align(tok, segments[lo : lo + AT_ONCE], lo, links))
        self.keys = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
        self.ptr = np.concatenate([[0], np.cumsum(self.n_links)])

    def _align(self, tok: Tokenizers, segments: list[bytes], lo: int, links: str) -> np.ndarray:
        a, b = tok.ids([s.decode() for s in segments])
        name_a, name_b = tok.a_bytes.__getitem__, tok.b_bytes.__getitem__
        good = [i for i, s in enumerate(segments) if b"".join(map(name_a, a[i])) == b" " + s == b"".join(map(name_b, b[i]))]
        if not good:
            return np.zeros(0, np.uint64)
        at = np.array(good) + lo
        n_a, n_b = (np.array([len(x[i]) for i in good]) for x in (a, b))
        a, b = (np.fromiter(chain.from_iterable(x[i] for i in good), np.int64) for x in (a, b))
        end_a, end_b = np.cumsum(tok.a_size[a]), np.cumsum(tok.b_size[b])
        # Elementary intervals, their owners, and the ends that both sides share.
        ends = np.union1d(end_a, end_b)
        own_a, own_b = np.searchsorted(end_a, ends), np.searchsorted(end_b, ends)
        shared = (end_a[own_a] == ends) & (end_b[own_b] == ends)
        closes = ends[shared]
        group_a, group_b = np.searchsorted(closes, end_a), np.searchsorted(closes, end_b)
        last = end_a[np.cumsum(n_a) - 1]  # where segments end
        of = lambda where: np.searchsorted(last, where)  # noqa: E731  the segment that an offset ends in
        self.ok[at], self.n_a[at], self.n_b[at] = True, n_a, n_b
        self.n_groups[at] = np.bincount(of(closes), minlength=len(at))
        self.n_overlaps[at] = np.bincount(of(ends), minlength=len(at))
        if links == "group":
            size_a, size_b = np.bincount(group_a), np.bincount(group_b)
            g = np.repeat(np.arange(len(closes)), size_a * size_b)
            k = np.arange(len(g)) - np.repeat(np.cumsum(size_a * size_b) - size_a * size_b, size_a * size_b)
            x, y = a[(np.cumsum(size_a) - size_a)[g] + k // size_b[g]], b[(np.cumsum(size_b) - size_b)[g] + k % size_b[g]]
            where = of(closes[g])
        else:
            some = shared if links == "end" else np.ones(len(ends), bool)
            x, y, where = a[own_a[some]], b[own_b[some]], of(ends[some])
        self.n_links[at] = np.bincount(where, minlength=len(at))
        # In writing: tokens by group and side; the last of a side gets a bar or semicolon, others a comma.
        side = np.concatenate([group_a * 2, group_b * 2 + 1])
        order = np.argsort(side, kind="stable")
        side, token = side[order], np.concatenate([a, b])[order]
        mark = np.where(np.append(side[1:] != side[:-1], True), 1 + side % 2, 0)
        written = list(map(tok.written.__getitem__, (mark * tok.n + token).tolist()))
        cuts = np.concatenate([[0], np.cumsum(n_a + n_b)]).tolist()
        for i, (p, q) in zip(at.tolist(), pairwise(cuts), strict=True):
            self.written[i] = b"".join(written[p:q])
        return x.astype(np.uint64) << np.uint64(32) | y.astype(np.uint64)


def stretches(text: bytes, limit: int) -> Iterator[bytes]:
    """A long text in stretches of `limit` bytes or somewhat more, cut where segments are."""
    lo = 0
    while len(text) - lo > limit:
        m = CUT.search(text, lo + limit)
        if not m:
            break
        yield text[lo : m.start()]
        lo = m.end()
    yield text[lo:]


def _sums(values: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(values)])[cuts])


class Encoder:
    """Slices from texts, in one task."""

    def __init__(self, tok: Tokenizers, links: str, slice_bytes: int) -> None:
        self.tok, self.links, self.limit = tok, links, slice_bytes
        self.n_slices = self.n_rows = 0
        context = TaskContext.get()
        self.base = (context.partitionId() if context else 0) << 33

    def aligned(self, texts: list[bytes]) -> tuple[Aligned, np.ndarray, np.ndarray]:
        """(distinct segments, the segments of all texts as numbers of these, where each text begins)."""
        parts = [self.tok.segments(t) if t else [] for t in texts]
        flat = list(chain.from_iterable(parts))
        number: dict[bytes, int] = {}
        at = np.fromiter((number.setdefault(s, len(number)) for s in flat), np.int64, len(flat))
        return Aligned(self.tok, list(number), self.links), at, np.concatenate([[0], np.cumsum([len(p) for p in parts], dtype=np.int64)])

    def slice(self, rows: list[int], ids: list[int | None], texts: list[bytes], digests: list | None = None, known: bool | None = None) -> list:
        """One row of SLICES. digests: running digests of stretches, None to make them; known: whether all the stretches of the
        text agree, if these are some of them."""
        of, at, cuts = self.aligned(texts)
        ok = _sums(~of.ok[at], cuts) == 0 if known is None else np.full(len(texts), known)
        keep = ok & (np.diff(cuts) > 0)
        used = np.repeat(keep, np.diff(cuts))
        sums = [np.where(keep, _sums(v[at], cuts), 0).tolist() for v in (of.n_a, of.n_b, of.n_groups, of.n_links, of.n_overlaps)]
        written, place, sha = of.written.__getitem__, at.tolist(), []
        for i, (p, q) in enumerate(pairwise(cuts.tolist())):
            joined = b"".join(map(written, place[p:q])) if keep[i] else b""
            if digests is None:
                sha.append(hashlib.sha256(joined[:-1]).hexdigest() if joined else "")
            else:
                digests[i].update(joined)
                sha.append("")
        # Links in order: those of each segment, one after another.
        chosen = at[used]
        n = of.n_links[chosen]
        where = np.repeat(of.ptr[chosen] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        pairs, link = np.unique(of.keys[where], return_inverse=True)
        self.n_slices += 1
        tidy()
        return [self.base + self.n_slices - 1, rows, ids, *sums, sha, len(pairs), pack(pairs), pack(link.astype(np.uint32))]

    def text(self, row: int, doc_id: int | None, text: bytes) -> Iterator[list]:
        """Slices of a text longer than a slice: looked through first, as one odd stretch leaves the whole without tokens."""
        good = all(self.aligned([s])[0].ok.all() for s in stretches(text, self.limit))
        digest = hashlib.sha256()
        held = b""
        for s in stretches(text, self.limit) if good else []:

            class Later:  # the last semicolon of all is not hashed
                @staticmethod
                def update(joined: bytes) -> None:
                    nonlocal held
                    digest.update(held + joined[:-1])
                    held = joined[-1:]

            yield self.slice([row], [doc_id], [s], [Later], True)
        yield [self.base + self.n_slices, [row], [doc_id], *[[0]] * 5, [digest.hexdigest() if good else ""], 0, pack(np.zeros(0, np.uint64)), pack(np.zeros(0, np.uint32))]
        self.n_slices += 1

    def batch(self, batch: pa.RecordBatch) -> Iterator[list]:
        ids = batch.column(0).to_pylist()
        for lo, hi, data, offsets in pieces(batch.column(1), self.limit):
            rows = list(range(self.base + self.n_rows, self.base + self.n_rows + hi - lo))
            self.n_rows += hi - lo
            texts = [data[x:y].tobytes() for x, y in pairwise(offsets)]
            if hi - lo == 1 and len(texts[0]) > 2 * self.limit and self.tok.cuts:
                yield from self.text(rows[0], ids[lo], texts[0])
            else:
                yield self.slice(rows, ids[lo:hi], texts)


_LOADED: dict[tuple[int, int], Tokenizers] = {}


def loaded(a: bytes, b: bytes) -> Tokenizers:
    """Tokenizers, once a process."""
    key = (hash(a), hash(b))
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Tokenizers(a, b)
    return _LOADED[key]


def _table(rows: list[list], kinds: list[pa.DataType], names: str) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [[] for _ in kinds]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=[n.split()[0] for n in names.split(", ")])


_LONGS = pa.list_(pa.int64())
_SLICES = [pa.int64(), *[_LONGS] * 7, pa.list_(pa.string()), pa.int64(), pa.binary(), pa.binary()]
_LINKS = [pa.int32(), pa.int64(), pa.binary(), pa.binary()]


def dealt(pairs: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """(order by part, where each part begins in it)."""
    part = (mix(pairs) >> np.uint64(8)) % np.uint64(parts)
    order = np.argsort(part, kind="stable")
    return order, np.searchsorted(part[order], np.arange(parts + 1, dtype=np.uint64))


def _send(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """Of each slice: by part, its distinct pairs and how often it has them."""
    for batch in batches:
        for s, pairs, link in zip(*(batch.column(c).to_pylist() for c in ("slice", "pairs", "link")), strict=True):
            keys, link = unpack(pairs), unpack(link)
            if not len(keys):
                continue
            counts = np.bincount(link, minlength=len(keys)).astype(np.uint64)
            order, cuts = dealt(keys, parts)
            keys, counts = keys[order], counts[order]
            yield _table([[p, s, pack(keys[x:y]), pack(counts[x:y])] for p, (x, y) in enumerate(pairwise(cuts)) if y > x], _LINKS, LINKS)


def _add_up(table: pa.Table) -> pa.Table:
    """Of one part: to each slice, the totals of its pairs; and as slice -1 the highest total of each B id."""
    part, slices = table["part"][0].as_py(), table["slice"].to_pylist()
    got = [unpack(x) for x in table["pairs"].to_pylist()]
    counts = np.concatenate([unpack(x) for x in table["counts"].to_pylist()])
    keys, at = np.unique(np.concatenate(got), return_inverse=True)
    totals = np.zeros(len(keys), np.uint64)
    np.add.at(totals, at, counts)
    ids = keys & _LOW
    order = np.argsort(ids, kind="stable")
    first = np.flatnonzero(np.append(True, np.diff(ids[order]) > 0))
    tops = np.maximum.reduceat(totals[order], first)
    back = np.split(totals[at], np.cumsum([len(g) for g in got])[:-1])
    rows = [[part, s, None, pack(c)] for s, c in zip(slices, back, strict=True)]
    return pa.Table.from_batches([_table([*rows, [part, -1, pack(ids[order][first]), pack(tops)]], _LINKS, LINKS)])


def _finish(slices: pa.Table, totals: pa.Table, parts: int, tops: np.ndarray) -> pa.Table:
    """Of one slice: its texts, or stretches of one, with what their links count."""
    out = [slices[c].combine_chunks().flatten() for c in ("row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_overlaps", "groups_sha256")]
    names = ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_overlaps", "groups_sha256"]
    keys, link = unpack(slices["pairs"][0].as_py()), unpack(slices["link"][0].as_py()).astype(np.int64)
    order, cuts = dealt(keys, parts)
    total = np.zeros(len(keys), np.uint64)
    for p, blob in zip(totals["part"].to_pylist(), totals["counts"].to_pylist(), strict=True):
        total[order[cuts[p] : cuts[p + 1]]] = unpack(blob)
    best = total == tops[(keys & _LOW).astype(np.int64)]
    ends = np.concatenate([[0], np.cumsum(out[5].to_numpy())])
    n_best, count_sum = _sums(best[link].astype(np.int64), ends), _sums(total[link].astype(np.int64), ends)
    table = pa.table([*out[:7], pa.array(n_best), pa.array(count_sum), out[7]], names=[*names[:7], "n_best", "count_sum", names[7]])
    tidy()
    return table


def _tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for pairs, counts in zip(batch.column("pairs").to_pylist(), batch.column("counts").to_pylist(), strict=True):
            yield pa.RecordBatch.from_arrays([pa.array(unpack(pairs).astype(np.int64)), pa.array(unpack(counts).astype(np.int64))], names=["id", "top"])


def align(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", folder: str = FOLDER, a_file: str = A_FILE, b_file: str = B_FILE, links: str = "end", slice_bytes: int = 8 << 20, part_pairs: int = 2_000_000) -> DataFrame:
    """One row a document: doc_id, n_a, n_b (tokens), n_groups, n_links, n_best, count_sum, groups_sha256, n_overlaps.

    `links` chooses what is linked: A and B tokens that "end" together, that "overlap", or all pairs of a "group". A pair's
    count is how many links of the corpus hold it; n_best counts the links whose pair has the highest count of its B id, ties
    included; count_sum adds the counts of a document's links. Null and empty texts, and those of which the joined bytes of
    either side differ from blank and text, have no tokens: zeros and an empty digest; they add to no count. Strings of special
    tokens are plain text. Repeated rows give repeated rows, null ids are kept, empty tables give no rows; other columns,
    whatever their names, are ignored. The files of the tokenizers are read by the driver and sent with the tasks.
    """
    if links not in ("end", "overlap", "group"):
        raise ValueError(f"links: {links}")
    spark = docs.sparkSession
    files = []
    for name in (a_file, b_file):
        with open(os.path.join(folder, name), "rb") as f:
            files.append(f.read())
    sent = spark.sparkContext.broadcast(tuple(files))  # two vocabularies, some megabytes
    vocabulary = sentencepiece.SentencePieceProcessor(model_proto=files[1]).vocab_size()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(loaded(*sent.value), links, slice_bytes)
        for batch in batches:
            for row in encoder.batch(batch):
                yield _table([row], _SLICES, SLICES)

    rows = docs.select(F.col(quoted(id_col)).cast("long").alias("doc_id"), F.col(quoted(text_col)).alias("text"))
    slices = cut(rows.mapInArrow(encode, SLICES))
    parts = spread(slices.agg(F.sum("n_pairs")).first()[0] or 0, part_pairs)
    pairs = slices.select("slice", "pairs", "link").mapInArrow(lambda b: _send(b, parts), LINKS)
    totals = cut(pairs.groupBy("part").applyInArrow(_add_up, LINKS))
    highest = totals.where("slice < 0").mapInArrow(_tops, "id long, top long").groupBy("id").agg(F.max("top").alias("top")).collect()  # at most B's vocabulary
    tops = np.zeros(vocabulary, np.uint64)
    for r in highest:
        tops[r["id"]] = r["top"]
    found = slices.groupBy("slice").cogroup(totals.where("slice >= 0").groupBy("slice")).applyInArrow(lambda s, t: _finish(s, t, parts, tops), DOCS)
    added = [F.sum(c).alias(c) for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")]
    whole = found.groupBy("row").agg(F.max("doc_id").alias("doc_id"), *added, F.max("groups_sha256").alias("groups_sha256"), F.sum("n_overlaps").alias("n_overlaps"))
    return whole.drop("row")
