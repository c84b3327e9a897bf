"""Operator 6: exact substring dedup by fixed-block anchors.

A window of `window` words that occurs twice holds, in either place, an aligned block of half as many words. Blocks at
multiples of that length are the index; every rolling window of block length probes it; hits are anchors. Hits are
extended over whole windows: around anchors the full windows are told apart by two hashes, made of two independent hashes of
each word, 112 bits in all between buckets and 128 within one, the first occurrence of each (smallest id, then smallest start) is found, and the words
covered by later ones - maximal repeats, as neighbouring windows merge - are removed.

Documents are dealt to buckets of about `bucket_bytes` of text by a hash of id and text, and hashes to parts of about
`part_rows` by their value, so no window or passage, however frequent, fills a task: within a bucket a hash is sent once.
Buckets and parts exchange packed sorted hashes. Three steps read the buckets; Spark reuses the one shuffle of the texts.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clipsift.llm.textkit import both_hashes, buffers, member, pack_sorted, planes, rolling, spread_parts, tidy, unpack_sorted, unplanes, within

_LOW31, _LOW48, _LAST = np.uint64((1 << 31) - 1), np.uint64((1 << 48) - 1), np.iinfo(np.int64).max
LINKS = "part int, bucket int, blob binary, ids binary, checks binary"


class Bucket:
    """Documents of one bucket by id (null last), then text; hashes of their words and windows."""

    def __init__(self, table: pa.Table, window: int, parts: int) -> None:
        self.table = table.sort_by([("doc_id", "ascending"), ("text", "ascending")])
        self.hash, self.other, self.ptr = both_hashes(self.table["text"])
        self.window, self.block, self.parts = window, window // 2, np.uint64(parts)
        self.long = within(self.ptr, window, max(0, len(self.hash) - window + 1))

    def blocks(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(positions, keys, aligned) of the rolling block-length windows that lie in a full window."""
        h = rolling(self.hash, self.block)
        start = np.repeat(self.ptr[:-1], np.diff(self.ptr))[: len(h)]
        size = np.repeat(np.diff(self.ptr), np.diff(self.ptr))[: len(h)]
        at = np.flatnonzero(within(self.ptr, self.block, len(h)) & (size >= self.window))
        h = h[at]
        return at, ((h >> np.uint64(40)) % self.parts) << np.uint64(31) | (h & _LOW31), (at - start[at]) % self.block == 0

    def windows(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two hashes of the full windows at positions, of independent hashes of their words."""
        return rolling(self.hash, self.window)[at], rolling(self.other, self.window)[at]

    def keys(self, h: np.ndarray) -> np.ndarray:
        """48 bits of window hashes with their part above."""
        return ((h >> np.uint64(48)) % self.parts) << np.uint64(48) | (h & _LOW48)


def repeated(h: np.ndarray, check: np.ndarray) -> np.ndarray:
    """Whether an earlier position has the same pair of hashes."""
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    if (same & (check[order][1:] != check[order][:-1])).any():
        order = np.lexsort((check, h))
        same = h[order][1:] == h[order][:-1]
    out = np.zeros(len(h), bool)
    out[order[1:]] = same & (check[order][1:] == check[order][:-1])
    return out


def _by_part(keys: np.ndarray, bits: int) -> list[tuple[int, slice]]:
    """(part, slice) of ascending keys with the part above `bits`."""
    part = keys >> np.uint64(bits)
    cuts = np.flatnonzero(np.diff(part)) + 1
    return [(int(part[a]), slice(a, b)) for a, b in zip(np.concatenate([[0], cuts]), np.concatenate([cuts, [len(part)]]), strict=True)] if len(part) else []


def _links(rows: list[tuple[int, int, bytes, bytes | None, bytes | None]]) -> pa.Table:
    cols = list(zip(*rows, strict=True)) if rows else [[], [], [], [], []]
    kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
    return pa.table([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["part", "bucket", "blob", "ids", "checks"])


def send_blocks(table: pa.Table, window: int, parts: int) -> pa.Table:
    """Of one bucket: by part, its distinct block hashes, each with a bit for an aligned (indexed) one."""
    b = Bucket(table, window, parts)
    _, keys, aligned = b.blocks()
    if not len(keys):
        return _links([])
    order = np.argsort(keys)
    keys, aligned = keys[order], aligned[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    indexed = np.logical_or.reduceat(aligned, first)
    keys = keys[first]
    values = (keys & _LOW31) << np.uint64(1) | indexed.astype(np.uint64)
    bucket = table["bucket"][0].as_py()
    return _links([(p, bucket, pack_sorted(values[s]), None, None) for p, s in _by_part(keys, 31)])


def probe_blocks(table: pa.Table) -> pa.Table:
    """Of one part: to each bucket, the hashes it has in common with another where either is an indexed block."""
    part, buckets = table["part"][0].as_py(), table["bucket"].to_pylist()
    got = [unpack_sorted(x) for x in table["blob"].to_pylist()]
    values, owner = np.concatenate(got), np.repeat(np.arange(len(got)), [len(g) for g in got])
    order = np.argsort(values >> np.uint32(1), kind="stable")
    values, owner = values[order], owner[order]
    v = values >> np.uint32(1)
    first = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))
    size = np.diff(np.concatenate([first, [len(v)]]))
    hit = np.repeat((size > 1) & np.logical_or.reduceat((values & np.uint32(1)) == 1, first), size)
    v, owner = v[hit], owner[hit]
    order = np.argsort(owner, kind="stable")
    v, owner = v[order], owner[order]
    cuts = np.searchsorted(owner, np.arange(len(got) + 1))
    return _links([(part, buckets[i], pack_sorted(v[a:b]), None, None) for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if b > a])


def _keys(links: pa.Table) -> np.ndarray:
    """Ascending block keys from what parts sent to one bucket."""
    got = [unpack_sorted(x).astype(np.uint64) | np.uint64(p) << np.uint64(31) for p, x in zip(links["part"].to_pylist(), links["blob"].to_pylist(), strict=True)]
    return np.sort(np.concatenate(got)) if got else np.zeros(0, np.uint64)


def send_windows(table: pa.Table, links: pa.Table, window: int, parts: int) -> pa.Table:
    """Of one bucket: by part, the distinct full windows that hold an anchor, each with the id where it is first."""
    if not table.num_rows:
        return _links([])
    b = Bucket(table, window, parts)
    at, keys, _ = b.blocks()
    if not len(keys):
        return _links([])
    order = np.argsort(keys)
    same = np.zeros(len(keys), bool)
    equal = keys[order][1:] == keys[order][:-1]
    same[order[1:]] |= equal
    same[order[:-1]] |= equal
    anchor = np.zeros(len(b.hash) + 1, np.int64)
    anchor[1:][at[same | member(keys, _keys(links))]] = 1
    anchor = np.cumsum(anchor)
    start = np.flatnonzero(b.long)
    start = start[anchor[start + window - b.block + 1] > anchor[start]]
    h, check = b.windows(start)
    first = ~repeated(h, check)
    start, check, keys = start[first], check[first], b.keys(h[first])
    order = np.argsort(keys >> np.uint64(48), kind="stable")  # by part, else in order of place
    keys, start, check = keys[order], start[order], check[order]
    ids = b.table["doc_id"].fill_null(_LAST).to_numpy()[np.searchsorted(b.ptr, start, side="right") - 1].astype("<i8")
    bucket = table["bucket"][0].as_py()
    return _links([(p, bucket, planes(keys[s], 6), ids[s].tobytes(), planes(check[s], 6)) for p, s in _by_part(keys, 48)])


def find_first(table: pa.Table) -> pa.Table:
    """Of one part: to each bucket, the windows whose first place is in another bucket."""
    table = table.sort_by("bucket")
    part, buckets = table["part"][0].as_py(), table["bucket"].to_pylist()
    got = [unplanes(x, 6) for x in table["blob"].to_pylist()]
    values, owner = np.concatenate(got), np.repeat(np.arange(len(got)), [len(g) for g in got])
    check = np.concatenate([unplanes(x, 6) for x in table["checks"].to_pylist()])
    ids = np.concatenate([np.frombuffer(x, "<i8") for x in table["ids"].to_pylist()])
    order = np.lexsort((ids, check, values))
    values, owner, check = values[order], owner[order], check[order]
    later = np.concatenate([[False], (values[1:] == values[:-1]) & (check[1:] == check[:-1])])
    values, owner, check = values[later], owner[later], check[later]
    tidy()
    order = np.argsort(owner, kind="stable")
    values, owner, check = values[order], owner[order], check[order]
    cuts = np.searchsorted(owner, np.arange(len(got) + 1))
    return _links([(part, buckets[i], planes(values[a:b], 6), None, planes(check[a:b], 6)) for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if b > a])


def _known(links: pa.Table, keys: np.ndarray, check: np.ndarray) -> np.ndarray:
    """Which windows, as (key, check), parts have sent back to a bucket."""
    if not links.num_rows:
        return np.zeros(len(keys), bool)
    sent = np.concatenate([unplanes(x, 6) | np.uint64(p) << np.uint64(48) for p, x in zip(links["part"].to_pylist(), links["blob"].to_pylist(), strict=True)])
    marks = np.concatenate([unplanes(x, 6) for x in links["checks"].to_pylist()])
    out = member(keys, np.sort(sent))
    near = np.flatnonzero(out)
    pair = np.dtype([("k", "<u8"), ("c", "<u8")])
    have, want = np.empty(len(near), pair), np.empty(len(sent), pair)
    have["k"], have["c"], want["k"], want["c"] = keys[near], check[near] & _LOW48, sent, marks
    # Both sides in one order: equal pairs lie together, one that was sent first.
    both = np.concatenate([want, have])
    order = np.lexsort((np.arange(len(both)), both["c"], both["k"]))
    new = np.concatenate([[True], both[order][1:] != both[order][:-1]])
    begins = order[np.flatnonzero(new)][np.cumsum(new) - 1] < len(want)
    found = np.empty(len(both), bool)
    found[order] = begins
    out[near] = found[len(want) :]
    return out


def remove(table: pa.Table, links: pa.Table, window: int, parts: int, keep_text: bool) -> pa.Table:
    """Of one bucket: the documents without their covered words."""
    names = ["doc_id", "n_words", "n_removed", "kept_sha256"] + ["kept"] * keep_text
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()] + [pa.string()] * keep_text
    if not table.num_rows:
        return pa.table([pa.array([], t) for t in kinds], names=names)
    b = Bucket(table, window, parts)
    start = np.flatnonzero(b.long)
    h, check = b.windows(start)
    later = repeated(h, check) | _known(links, b.keys(h), check)
    cover = np.zeros(len(b.hash) + 1, np.int32)
    np.add.at(cover, start[later], 1)
    np.add.at(cover, start[later] + window, -1)
    kept = np.cumsum(cover[:-1]) == 0
    data, offsets = buffers(b.table["text"])
    sizes = np.diff(b.ptr)
    total = np.concatenate([[0], np.cumsum(kept)])[b.ptr]
    n_kept = np.diff(total)
    out, texts = [], []
    for i, (x, y) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)):
        found = data[x:y].tobytes().split()
        text = b" ".join(found if n_kept[i] == sizes[i] else compress(found, kept[b.ptr[i] : b.ptr[i + 1]].tolist()))
        out.append(hashlib.sha256(text).hexdigest())
        if keep_text:
            texts.append(text.decode())
    tidy()
    cols = [b.table["doc_id"], sizes, sizes - n_kept, out] + [texts] * keep_text
    return pa.table([c if isinstance(c, pa.ChunkedArray) else pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=names)


def dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = 20, bucket_bytes: int = 8 << 20, part_rows: int = 2_000_000, keep_text: bool = False) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256 and, if asked for, kept (its text without the repeats).

    Null and empty texts have no words. Texts under `window` words keep all. A null id comes after all others; of rows that
    repeat an id, or have none, some one counts as first: they go by bucket, then by text. Texts of any length count whole. `window` must be even. Empty tables
    give no rows; other columns, whatever their names, are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    buckets, parts = spread_parts(rows, bucket_bytes, part_rows)
    dealt = rows.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(buckets)).cast("int").alias("bucket"), "doc_id", "text")
    by_bucket = lambda: dealt.groupBy("bucket")
    probes = by_bucket().applyInArrow(lambda t: send_blocks(t, window, parts), LINKS)
    hits = probes.groupBy("part").applyInArrow(probe_blocks, LINKS)
    candidates = by_bucket().cogroup(hits.groupBy("bucket")).applyInArrow(lambda a, b: send_windows(a, b, window, parts), LINKS)
    later = candidates.groupBy("part").applyInArrow(find_first, LINKS)
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * keep_text
    return by_bucket().cogroup(later.groupBy("bucket")).applyInArrow(lambda a, b: remove(a, b, window, parts, keep_text), schema)
