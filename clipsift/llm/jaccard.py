"""Operator 7: exact n-gram Jaccard join with set-relation skipping, down to connected components.

Sets are the distinct word shingles of a text, as 64-bit hashes. Equal sets, told by two sums of scrambled hashes, become
one. Shingles are ordered rarest first by counting sketches of words and of shingles over all documents (2**SKETCH_BITS
and 2**WORD_BITS counters, a fixed size): frequent passages and chance phrases of frequent words fall to the end. A set's prefix - as many as it may miss of a partner, and one more - is indexed.

An index list is ordered by set size and skipped in blocks by position: what a set has left from the shingle on bounds the
sizes that it can link with (its reach). Sets that reach nothing in the list leave it, and it is cut wherever no set before
reaches the next size; short stretches are cut by every pair. The sets of a stretch that remains meet at their smallest id,
so a list of k gives k rows, not k**2. Where sets meet, links are verified over whole
sets: the first set is compared with all others through lists by shingle, which skip to the sizes that can link. Sets that it
links need no comparison among themselves. The others follow; a set's overlaps are derived from those of the set before by
the shingles in which the two differ, where they are similar enough. Meetings of over `slice_rows` sets or `slice_shingles`
shingles are compared with their leader in slices; only sets that do not link with it are compared with all slices, a pair of slices in a task. Links
become components by stars.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clipsift.llm.common import cut, spread, text_size
from clipsift.llm.components import components
from clipsift.llm.textkit import member, mix, pack_sorted, pieces, planes, rolling, tidy, unpack_sorted, unplanes, words

SKETCH_BITS, WORD_BITS, BLOCKS = 20, 16, 16
_SKETCH = (1 << SKETCH_BITS) + (1 << WORD_BITS)
_A, _B = np.uint64(0xA5A5B6C7D8E9F011), np.uint64(0x5851F42D4C957F2D)


def shingle_sets(column: pa.Array, n: int, words_of: np.ndarray | None = None) -> Iterator[tuple]:
    """(row, ascending distinct shingle hashes) of every row; a text of fewer words gives its whole sequence as one. With
    words_of, values by bucket of a word, also the sum of its words' values for each shingle."""
    for lo, _, data, offsets in pieces(column, 1 << 20):
        w = words(data, offsets, lower=True)
        rolled = rolling(w.hash, n)
        if words_of is not None:
            value = words_of[w.hash >> np.uint64(64 - WORD_BITS)]
            value = sum(value[j : len(value) - n + 1 + j] for j in range(n)) if len(value) >= n else value[:0]
        for k, (a, b) in enumerate(zip(w.ptr[:-1].tolist(), w.ptr[1:].tolist(), strict=True)):
            if b - a >= n:
                if words_of is None:
                    yield lo + k, np.unique(rolled[a : b - n + 1])
                else:
                    s, at = np.unique(rolled[a : b - n + 1], return_index=True)
                    yield lo + k, s, value[a + at]
            else:
                s = mix(rolling(w.hash[a:b], b - a) ^ np.uint64(b - a)) if b > a else np.zeros(0, np.uint64)
                yield (lo + k, s) if words_of is None else (lo + k, s, np.zeros(len(s)))


def most(n: np.ndarray | int, num: int, den: int) -> np.ndarray | int:
    """Least overlap of a set of n with any partner: ceil(n * num / den)."""
    return -(-n * num // den)


def _signatures(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n", "a", "b", "block", "counts"]
    sketch = np.zeros(_SKETCH, np.int64)  # of shingles, then of words
    for batch in batches:
        rows, seen = [], []
        for _, s in shingle_sets(batch.column("text"), n):
            rows.append((len(s), mix(s ^ _A).sum(dtype=np.uint64), mix(s ^ _B).sum(dtype=np.uint64)))
            seen.append(s >> np.uint64(64 - SKETCH_BITS))
        seen = [np.concatenate(seen)] if seen else []
        for _, _, data, offsets in pieces(batch.column("text"), 1 << 20):
            seen.append((words(data, offsets, lower=True).hash >> np.uint64(64 - WORD_BITS)) + np.uint64(1 << SKETCH_BITS))
        for x in seen:
            sketch += np.bincount(x.astype(np.int64), minlength=_SKETCH)
        size, a, b = (np.array(c) for c in zip(*rows, strict=True)) if rows else (np.zeros(0, np.int64),) * 3
        none = pa.nulls(len(rows), pa.int32())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(size, pa.int64()), pa.array(a.astype(np.uint64).view(np.int64)), pa.array(b.astype(np.uint64).view(np.int64)), none, pa.nulls(len(rows), pa.binary())], names=names)
    tidy()
    if sketch.any():
        width = len(sketch) // BLOCKS
        null = pa.nulls(BLOCKS, pa.int64())
        blobs = [zlib.compress(planes(sketch[i * width : (i + 1) * width].astype("<u4"), 4), 1) for i in range(BLOCKS)]
        yield pa.RecordBatch.from_arrays([null, null, null, null, pa.array(range(BLOCKS), pa.int32()), pa.array(blobs, pa.binary())], names=names)


def _add_blocks(table: pa.Table) -> pa.Table:
    total = sum(unplanes(zlib.decompress(x), 4, "<u4").astype(np.int64) for x in table["counts"].to_pylist())
    return pa.table({"block": table["block"].slice(0, 1), "total": pa.array([total.astype("<i8").tobytes()], pa.binary())})


def _values(total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(by bucket of a shingle: how much more frequent than usual, by bucket of a word: log count), to order shingles by."""
    shingles, found = total[: 1 << SKETCH_BITS].astype(float), total[1 << SKETCH_BITS :].astype(float)
    return (40 * np.log(np.maximum(1, shingles / max(1.0, 1.1 * shingles.mean())))).astype(np.float32), np.log1p(found)


def _prefixes(batches: Iterator[pa.RecordBatch], n: int, num: int, den: int, values: tuple[np.ndarray, np.ndarray]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        size, blobs = [], []
        for _, s, v in shingle_sets(batch.column("text"), n, values[1]):
            take = len(s) - most(len(s), num, den) + 1 if len(s) else 0
            order = np.argsort(v + values[0][s >> np.uint64(64 - SKETCH_BITS)], kind="stable")[:take]
            size.append(len(s))
            blobs.append(s[order].astype("<u8").tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(size, pa.int64()), pa.array(blobs, pa.binary())], names=["doc_id", "n", "prefix"])
    tidy()


def _entries(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """By part of the shingle hash: packed (shingle, id, size, position) entries of the batch's prefixes."""
    for batch in batches:
        ids = batch.column("doc_id").to_numpy()
        order = np.argsort(ids, kind="stable")
        blobs = batch.column("prefix").to_pylist()
        got = [np.frombuffer(blobs[i], "<u8") for i in order]
        token = np.concatenate(got) if got else np.zeros(0, np.uint64)
        owner = np.repeat(order, [len(g) for g in got])
        place = np.concatenate([np.arange(len(g)) for g in got]) if got else owner
        part = (token >> np.uint64(40)) % np.uint64(parts)
        by = np.argsort(part, kind="stable")
        cuts = np.searchsorted(part[by], np.arange(parts + 1, dtype=np.uint64))
        size = batch.column("n").to_numpy()
        out = [(p, planes(token[x], 5), pack_sorted(ids[owner[x]].view(np.uint64), 8), planes(size[owner[x]].astype("<u4"), 4), planes(place[x].astype("<u4"), 4)) for p, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if b > a for x in [by[a:b]]]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=["part", "tokens", "ids", "sizes", "places"])


#: Stretches up to this length, after cuts by position, are cut further by every pair of their members.
SHORT = 64


def reach(size: np.ndarray, place: np.ndarray, num: int, den: int) -> np.ndarray:
    """Largest size that a set can link with when both have the shingle, no other before it, and it is at this place in the
    set's order: the overlap, at most size - place, must be num / (num + den) of both sizes."""
    return (size - place) * (num + den) // num - size


def stretches(token: np.ndarray, size: np.ndarray, far: np.ndarray) -> np.ndarray:
    """First entries of the stretches of lists (token, then size ascending): a new one where no set before in the list
    reaches the next size."""
    new = np.concatenate([[True], token[1:] != token[:-1]])
    top = int(max(far.max(initial=0), size.max(initial=0))) + 1
    number = np.cumsum(new) - 1
    so_far = np.maximum.accumulate(np.maximum(far, 0) + number * top) - number * top
    new[1:] |= size[1:] > so_far[:-1]
    return np.flatnonzero(new)


def _short_lists(ids: np.ndarray, size: np.ndarray, place: np.ndarray, num: int, den: int) -> np.ndarray:
    """(lists, k) members by size: of each member, the smallest id connected through pairs that sizes and positions allow."""
    rest = size - place
    need = num * (size[:, :, None] + size[:, None, :])
    may = (np.minimum(rest[:, :, None], rest[:, None, :]) * (num + den) >= need) & (np.minimum(size[:, :, None], size[:, None, :]) * den >= np.maximum(size[:, :, None], size[:, None, :]) * num)
    may |= np.eye(ids.shape[1], dtype=bool)
    label = ids
    while True:
        new = np.where(may, label[:, None, :], np.iinfo(np.int64).max).min(axis=2)
        if (new == label).all():
            return label
        label = new


def _meet(table: pa.Table, num: int, den: int) -> pa.Table:
    """Of one part: (leader, doc_id, n) where ids of a stretch of an index list meet at their smallest, itself included."""
    token = np.concatenate([unplanes(x, 5) for x in table["tokens"].to_pylist()])
    ids = np.concatenate([unpack_sorted(x, 8) for x in table["ids"].to_pylist()]).view(np.int64)
    size = np.concatenate([unplanes(x, 4, "<u4") for x in table["sizes"].to_pylist()]).astype(np.int64)
    place = np.concatenate([unplanes(x, 4, "<u4") for x in table["places"].to_pylist()]).astype(np.int64)
    order = np.lexsort((size, token))
    token, ids, size, place = token[order], ids[order], size[order], place[order]
    far = reach(size, place, num, den)
    least = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
    least = np.repeat(size[least], np.diff(np.concatenate([least, [len(token)]])))
    able = far >= least  # the others reach nothing in their list
    token, ids, size, place, far = token[able], ids[able], size[able], place[able], far[able]
    if not len(token):
        return pa.table({"leader": pa.array([], pa.int64()), "doc_id": pa.array([], pa.int64()), "n": pa.array([], pa.int64())})
    first = stretches(token, size, far)
    length = np.diff(np.concatenate([first, [len(token)]]))
    leader = np.repeat(np.minimum.reduceat(ids, first), length)
    for k in np.unique(length[(length > 1) & (length <= SHORT)]):
        starts = first[length == k]
        step = max(1, 400_000 // int(k) ** 2)
        for lo in range(0, len(starts), step):
            at = starts[lo : lo + step, None] + np.arange(k)
            leader[at] = _short_lists(ids[at], size[at], place[at], num, den)
    # A leader counts where somebody else follows it in the same list.
    follows = leader != ids
    led = np.unique(leader[follows])
    by_id = np.argsort(ids, kind="stable")
    led_size = size[by_id[np.searchsorted(ids, led, sorter=by_id)]]
    pairs = np.concatenate([np.stack([leader[follows], ids[follows], size[follows]], axis=1), np.stack([led, led, led_size], axis=1)])
    pairs = np.unique(pairs, axis=0)
    tidy()
    return pa.table({"leader": pa.array(pairs[:, 0]), "doc_id": pa.array(pairs[:, 1]), "n": pa.array(pairs[:, 2])})


class Meeting:
    """Whole sets that met, by size; finds which are connected by links among them."""

    def __init__(self, ids: list[int], sets: list[np.ndarray], num: int, den: int) -> None:
        order = sorted(range(len(ids)), key=lambda i: (len(sets[i]), ids[i]))
        self.ids = [ids[i] for i in order]
        sets = [sets[i] for i in order]
        self.size = np.array([len(s) for s in sets])
        self.num, self.den = num, den
        token = np.concatenate(sets)
        owner = np.repeat(np.arange(len(sets)), self.size)
        by = np.argsort(token, kind="stable")
        self.lists = owner[by]  # members of each shingle, by size
        new = np.flatnonzero(np.concatenate([[True], token[by][1:] != token[by][:-1]]))
        self.at = np.concatenate([new, [len(token)]])
        number = np.empty(len(token), np.int64)
        number[by] = np.repeat(np.arange(len(new)), np.diff(self.at))
        self.sets = np.split(number, np.cumsum(self.size)[:-1])  # shingle numbers, ascending
        self.up = list(range(len(sets)))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def counts(self, shingles: np.ndarray) -> np.ndarray:
        """How many of the shingles each member has."""
        a, b = self.at[shingles], self.at[shingles + 1]
        n = b - a
        flat = self.lists[np.repeat(a - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())]
        return np.bincount(flat, minlength=len(self.sets))

    def connect(self) -> list[tuple[int, int]]:
        """(id, smallest id connected) for every member that has a smaller one."""
        n = len(self.sets)
        before, overlap = None, None
        start = min(range(n), key=lambda i: self.ids[i])
        done = np.zeros(n, bool)
        for x in [start, *range(n)]:
            if done[x] or (x != start and self.root(x) == self.root(start)):
                continue
            done[x] = True
            mine = self.sets[x]
            lo = int(np.searchsorted(self.size, most(len(mine), self.num, self.den)))
            hi = int(np.searchsorted(self.size, len(mine) * self.den // self.num, side="right"))
            gone = np.setdiff1d(before, mine, assume_unique=True) if before is not None else None
            if gone is not None and 4 * len(gone) < len(mine):
                come = np.setdiff1d(mine, before, assume_unique=True)
                overlap = overlap - self.counts(gone) + self.counts(come)
            else:
                overlap = self.counts(mine)
            before = mine
            self._link(x, overlap, lo, hi)
        least: dict[int, int] = {}
        for i, d in enumerate(self.ids):
            r = self.root(i)
            least[r] = min(d, least.get(r, d))
        return [(d, least[self.root(i)]) for i, d in enumerate(self.ids) if least[self.root(i)] < d]

    def _link(self, x: int, overlap: np.ndarray, lo: int, hi: int) -> None:
        part = overlap[lo:hi]
        for y in np.flatnonzero(part * self.den >= (len(self.sets[x]) + self.size[lo:hi] - part) * self.num) + lo:
            a, b = self.root(x), self.root(int(y))
            if a != b:
                self.up[b] = a


def _verify(table: pa.Table, n: int, num: int, den: int) -> pa.Table:
    sets: list[np.ndarray] = [np.zeros(0, np.uint64)] * table.num_rows
    for i, s in shingle_sets(table["text"].combine_chunks(), n):
        sets[i] = s
    found = Meeting(table["doc_id"].to_pylist(), sets, num, den).connect() if table.num_rows > 1 else []
    return pa.table({"u": pa.array([f[0] for f in found], pa.int64()), "v": pa.array([f[1] for f in found], pa.int64())})


def _near_leader(table: pa.Table, n: int, num: int, den: int) -> pa.Table:
    """Of one slice, with its leader's texts as heads: (leader, doc_id, near), whether each row links with its leader."""
    sets = [np.zeros(0, np.uint64)] * table.num_rows
    for i, s in shingle_sets(table["text"].combine_chunks(), n):
        sets[i] = s
    head = table["head"].to_pylist()
    leaders = [s for s, h in zip(sets, head, strict=True) if h]

    def links(s: np.ndarray) -> bool:
        for other in leaders:
            k = int(member(s, other).sum())
            if k * den >= (len(s) + len(other) - k) * num:
                return True
        return False

    rows = [i for i, h in enumerate(head) if not h]
    near = [links(sets[i]) for i in rows]
    tidy()
    return pa.table({"leader": table["leader"].take(rows), "doc_id": table["doc_id"].take(rows), "near": pa.array(near, pa.bool_())})


def _tiles(rows: DataFrame, met: DataFrame, n: int, num: int, den: int, slice_rows: int, slice_shingles: int) -> tuple[DataFrame, DataFrame | None]:
    """((leader, tile_a, tile_b, doc_id) to compare, links found on the way).

    A meeting of up to slice_rows sets and slice_shingles shingles is one tile. Of a larger one every set is first compared with its leader's, a slice at a
    time; sets that link are of one component and need no comparison among themselves. What is left is cut in slices, and
    each is compared with every slice: a group of copies costs one pass.
    """
    zero = F.lit(0).alias
    slices = lambda rows, shingles: F.ceil(F.greatest(rows / slice_rows, F.coalesce(shingles, F.lit(0)) / slice_shingles)).cast("int")
    large = cut(met.groupBy("leader").agg(slices(F.count(F.lit(1)), F.sum("n")).alias("slices")).where("slices > 1"))
    if large.isEmpty():
        return met.select("leader", zero("tile_a"), zero("tile_b"), "doc_id"), None
    place = F.xxhash64("doc_id", F.lit(7))
    big = met.join(large, "leader").select("leader", "doc_id", F.pmod(place, F.col("slices")).cast("int").alias("slice"), F.lit(False).alias("head"))
    heads = large.select("leader", F.col("leader").alias("doc_id"), F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), F.lit(True).alias("head"))
    told = rows.join(big.unionByName(heads), "doc_id").groupBy("leader", "slice").applyInArrow(lambda t: _near_leader(t, n, num, den), "leader long, doc_id long, near boolean")
    # Rows that repeat an id are one document: it is linked by any of them, and settled if all are.
    told = told.groupBy("leader", "doc_id").agg(F.min("near").alias("settled"), F.max("near").alias("near"))
    told = cut(told.join(met.select("leader", "doc_id", "n"), ["leader", "doc_id"]))
    is_open, is_closed = F.when(~F.col("settled"), F.col("n")), F.when(F.col("settled"), F.col("n"))
    n_slices = told.groupBy("leader").agg(slices(F.count(is_open), F.sum(is_open)).alias("open"), slices(F.count(is_closed), F.sum(is_closed)).alias("closed"))
    near = told.where(F.col("near") & (F.col("doc_id") != F.col("leader"))).select(F.col("doc_id").alias("u"), F.col("leader").alias("v"))
    told = told.join(n_slices.where("open > 0"), "leader")
    mine = F.when(F.col("settled"), F.col("open") + F.pmod(place, F.greatest("closed", F.lit(1)))).otherwise(F.pmod(place, F.greatest("open", F.lit(1)))).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.when(F.col("settled"), F.col("open")).otherwise(F.col("open") + F.col("closed")) - 1))
    cut_up = told.withColumn("_m", mine).withColumn("_o", other).select("leader", F.least("_m", "_o").alias("tile_a"), F.greatest("_m", "_o").alias("tile_b"), "doc_id")
    small = met.join(large.select("leader"), "leader", "left_anti").select("leader", zero("tile_a"), zero("tile_b"), "doc_id")
    return small.unionByName(cut_up), near


def join(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", n: int = 3, num: int = 90, den: int = 100, part_rows: int = 1_000_000, slice_rows: int = 4000, slice_shingles: int = 4_000_000) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest id reachable by links of Jaccard >= num / den).

    Null texts and texts without words have no shingles and link with nothing. Rows that repeat an id are one document for
    its links and stay apart as rows. Rows with a null id link with nothing and have a null component. Texts of any length
    count whole. Empty tables give no rows; other columns, whatever their names, are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    _, n_bytes = text_size(rows)
    out = cut(rows.mapInArrow(lambda b: _signatures(b, n), "doc_id long, n long, a long, b long, block int, counts binary"))
    signed = out.where("block is null").drop("block", "counts")
    blocks = out.where("block is not null").select("block", "counts").groupBy("block").applyInArrow(_add_blocks, "block int, total binary").collect()
    total = np.concatenate([np.frombuffer(r["total"], "<i8") for r in sorted(blocks, key=lambda r: r["block"])]) if blocks else np.zeros(_SKETCH, np.int64)
    values = _values(total)

    usable = signed.where("n > 0 and doc_id is not null")
    same = usable.groupBy("a", "b", "n").agg(F.min("doc_id").alias("rep"))
    first = cut(same.select("rep", "a", "b", "n"))
    prefixes = rows.mapInArrow(lambda b: _prefixes(b, n, num, den, values), "doc_id long, n long, prefix binary").join(first.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi")
    parts = spread(n_bytes // 6 * (den - num) // den, part_rows)
    entries = prefixes.mapInArrow(lambda b: _entries(b, parts), "part int, tokens binary, ids binary, sizes binary, places binary")
    met = entries.groupBy("part").applyInArrow(lambda t: _meet(t, num, den), "leader long, doc_id long, n long")
    met = cut(met.groupBy("leader", "doc_id").agg(F.max("n").alias("n")))
    tiled, near = _tiles(rows, met, n, num, den, slice_rows, slice_shingles)
    texts = rows.join(tiled, "doc_id")
    links = texts.groupBy("leader", "tile_a", "tile_b").applyInArrow(lambda t: _verify(t, n, num, den), "u long, v long")
    several = usable.groupBy("doc_id").agg(F.min("a").alias("lo"), F.max("a").alias("hi")).where("lo < hi").select("doc_id")
    own = usable.join(several, "doc_id").join(first, ["a", "b", "n"]).select(F.col("doc_id").alias("u"), F.col("rep").alias("v"))
    links = links if near is None else links.unionByName(near)
    found = components(links.unionByName(own)).select(F.col("u").alias("rep"), F.col("v").alias("_least"))
    members = signed.join(first.withColumnRenamed("n", "_n"), ["a", "b"], "left").withColumn("rep", F.when(F.col("n") > 0, F.coalesce("rep", "doc_id")).otherwise(F.col("doc_id")))
    return members.join(found, "rep", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("_least", "rep")).alias("component_id"))
