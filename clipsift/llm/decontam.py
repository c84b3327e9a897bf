"""Operator 5: benchmark decontamination by pigeonhole edit matching.

Texts are compared in a plain form: A-Z lower-cased, every run of other bytes than letters and digits one blank. An item of
m bytes has an error budget of e = `rate` * m edits, rounded down, and is split into e + 1 pieces, however short, so any copy
within the budget holds some piece unchanged. More than that: going around the pieces in a ring, some unchanged piece is
followed by runs of any i pieces with at most i edits in all (e edits over e + 1 pieces; the cycle lemma). An Aho-Corasick
automaton of all pieces finds them in whole documents; where a piece hits, the pieces after it are tried for this, first the
next one by comparing its halves, then the next `RUN`, and only then the stretch that could hold the item is verified with
Myers' bit-parallel edit distance. Neither test loses a copy within the budget. The scan is map-only.

An item too short for a single edit (under 1 / `rate` bytes) counts only where it stands as whole words, unchanged.

The benchmark travels with the tasks in groups of at most `group_bytes` of items; a larger benchmark takes more scans.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clipsift.llm.textkit import pieces, tidy

_PLAIN = np.full(256, 32, np.uint8)
_PLAIN[48:58] = np.arange(48, 58)
_PLAIN[97:123] = np.arange(97, 123)
_PLAIN[65:91] = np.arange(97, 123)
_PLAIN[128:] = np.arange(128, 256)
#: After a piece that hits, so many of the next are tried before the whole item.
RUN = 4
SCHEMA = "doc_id long, item_id long, distance int, similarity double, at long"


def plain(data: np.ndarray, offsets: np.ndarray) -> list[str]:
    """Plain form of each document, one character a byte."""
    b = _PLAIN[data]
    blank = b == 32
    keep = ~blank
    keep[1:] |= ~blank[:-1]
    keep[offsets[:-1][offsets[:-1] < len(b)]] = True
    at = np.concatenate([[0], np.cumsum(keep)])[offsets]
    text = b[keep].tobytes().decode("latin-1")
    return [text[x:y] for x, y in zip(at[:-1], at[1:], strict=True)]


def plain_one(text: str) -> str:
    data = np.frombuffer(text.encode(), np.uint8)
    return plain(data, np.array([0, len(data)]))[0].strip() if len(data) else ""


def budget(m: int, rate: float) -> int:
    """Edits allowed for an item of m bytes."""
    return max(0, min(int(rate * m), m - 1))


def split(item: str, parts: int) -> list[tuple[int, str]]:
    """(start, piece) of `parts` pieces of nearly equal length."""
    cuts = [len(item) * i // parts for i in range(parts + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def masks(pattern: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, c in enumerate(pattern):
        out[c] = out.get(c, 0) | 1 << i
    return out


def myers(pattern: str, where: dict[str, int], text: str) -> tuple[int, int]:
    """(least edit distance of the pattern to any stretch of the text, end of that stretch), by Myers' bit vectors."""
    m = len(pattern)
    full, high = (1 << m) - 1, 1 << (m - 1)
    up, down, score, best, end = full, 0, m, m, 0
    for i, c in enumerate(text):
        eq = where.get(c, 0)
        v = eq | down
        h = (((eq & up) + up) ^ up) | eq
        right, left = down | (~(h | up) & full), up & h
        if right & high:
            score += 1
        elif left & high:
            score -= 1
        right, left = (right << 1) & full, (left << 1) & full
        up, down = left | (~(v | right) & full), right & v
        if score < best:
            best, end = score, i + 1
    return best, end


class Matcher:
    """Items of (id, plain text), their pieces in one automaton, and the search of a text. With `whole_words`, items without an
    error budget are found only where they stand between blanks or ends."""

    def __init__(self, items: list[tuple[int | None, str]], rate: float, whole_words: bool = False) -> None:
        self.whole_words = whole_words
        self.items = [(i, t, budget(len(t), rate), masks(t)) for i, t in items if t]
        # Of each piece: its item, its start there, the halves of the next piece round the ring, and whether it is the last.
        found: dict[str, list[tuple[int, int, str, str, bool]]] = {}
        self.runs: dict[tuple[int, int], tuple[int, str, dict[str, int]]] = {}
        for k, (_, t, e, _) in enumerate(self.items):
            parts = split(t, e + 1)
            for j, (start, piece) in enumerate(parts):
                after = parts[(j + 1) % len(parts)][1]
                found.setdefault(piece, []).append((k, start, after[: len(after) // 2], after[len(after) // 2 :], j == e))
                run = [p for _, p in parts[j + 1 : j + 1 + RUN]]
                self.runs[k, start] = (len(run), "".join(run), masks("".join(run)))
        self.tree = ahocorasick.Automaton()
        for piece, places in found.items():
            self.tree.add_word(piece, (len(piece), places))
        self.tree.make_automaton()

    def follows(self, text: str, k: int, start: int, at: int, end: int, last: bool) -> bool:
        """Whether the pieces after one that hits text[at:end] can be a copy's: i of them with at most i edits."""
        e = self.items[k][2]
        if last:
            if not e:
                return True
            # Round the ring: the first pieces, up to e edits off their places.
            t = self.items[k][1]
            run = [p for _, p in split(t, e + 1)[: min(RUN, e)]]
            n, head = len(run), "".join(run)
            return myers(head, masks(head), text[max(0, at - start - e) : max(0, at - start + e + len(head) + n)])[0] <= n
        n, run, where = self.runs[k, start]
        return myers(run, where, text[end : end + len(run) + n])[0] <= n

    def search(self, text: str) -> dict[int | None, tuple[int, int, int]]:
        """item id -> (distance, - bytes of the item's text that matched, start of the stretch searched) at its least distance
        within the budget; of texts of one id as near, the longest."""
        out: dict[int | None, tuple[int, int, int]] = {}
        if not self.items:
            return out
        tried: dict[int, set[int]] = {}
        for end, (length, places) in self.tree.iter(text):
            end += 1
            for k, start, left, right, last in places:
                if self.whole_words and not self.items[k][2]:
                    if text[end - length - 1 : end - length] in ("", " ") and text[end : end + 1] in ("", " "):
                        found = (0, -length, end - length)
                        out[self.items[k][0]] = min(out.get(self.items[k][0], found), found)
                    continue
                if last:
                    e, first = self.items[k][2], end - length - start
                    near = text[max(0, first - e) : max(0, first + e + len(left) + len(right) + 1)]
                    if left not in near and right not in near:
                        continue
                # At most one edit in the next piece: one of its halves is as it was, the right one off by one place at most.
                elif not text.startswith(left, end) and right not in text[end + len(left) - 1 : end + len(left) + len(right) + 1]:
                    continue
                item, t, e, where = self.items[k]
                if out.get(item, (1,)) <= (0, -len(t)):
                    continue
                at = end - length - start
                slot = at // (e + 1)
                if slot in tried.setdefault(k, set()) or not self.follows(text, k, start, end - length, end, last):
                    continue
                tried[k].add(slot)
                lo = max(0, slot * (e + 1) - e)
                distance, _ = myers(t, where, text[lo : max(0, slot * (e + 1) + len(t) + 2 * e + 1)])
                if distance <= e:
                    out[item] = min(out.get(item, (e + 1,)), (distance, -len(t), lo))
        return out


def _groups(benchmark: DataFrame, item_col: str, item_text: str, group_bytes: int) -> Iterator[list[tuple[int | None, str]]]:
    """Items as (id, plain text), a group of about group_bytes at a time; all texts of an id are in one."""
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text).alias("text")).where("text is not null")
    groups = max(1, -(-(items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // group_bytes))
    for g in range(groups):
        found = items.where(F.pmod(F.xxhash64("item_id"), F.lit(groups)) == g).collect()
        yield sorted(((r["item_id"], plain_one(r["text"])) for r in found), key=lambda i: (i[0] is None, i[0] or 0, i[1]))


def matches(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", rate: float = 0.1, group_bytes: int = 4 << 20) -> DataFrame:
    """One row for each document and item that it holds within the error budget: doc_id, item_id, distance, similarity
    (1 - distance / length of the item's text that matched), at (start of the stretch in the plain text).

    Null and empty texts, and items without a letter or digit, match nothing. Repeated documents give repeated rows;
    repeated items (same id, a null one too) the one with the nearest text, of several as near the longest. Items that differ in case, punctuation or spacing only match
    alike. Texts of any length are searched whole. Empty tables give no rows; other columns, whatever their names, are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    out = None
    for part in _groups(benchmark, item_col, item_text, group_bytes):

        def scan(batches: Iterator[pa.RecordBatch], part: list = part) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(part, rate, whole_words=True)
            for batch in batches:
                ids = batch.column("doc_id").to_pylist()
                for lo, _, data, offsets in pieces(batch.column("text")):
                    hits = [(ids[lo + k], item, d, 1 + d / m, at) for k, text in enumerate(plain(data, offsets)) for item, (d, m, at) in matcher.search(text).items()]
                    if hits:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*hits, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.float64(), pa.int64()), strict=True)], names=["doc_id", "item_id", "distance", "similarity", "at"])

        found = rows.mapInArrow(scan, SCHEMA)
        out = found if out is None else out.unionByName(found)
    return out


def screen(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", rate: float = 0.1, group_bytes: int = 4 << 20, least: int = 16) -> DataFrame:
    """The rows of docs, with all columns, that hold no item within the error budget; map-only.

    Items of under `least` bytes in plain form, such as a one-word answer, remove nothing: ordinary prose holds them too
    (`matches` reports them). Items count whatever their id. Null and empty texts stay, as do repeated rows; columns may
    have any names.
    """
    out = docs
    at = docs.columns.index(text_col)
    for part in _groups(benchmark, item_col, item_text, group_bytes):

        def scan(batches: Iterator[pa.RecordBatch], part: list = part) -> Iterator[pa.RecordBatch]:
            matcher = Matcher([i for i in part if len(i[1]) >= least], rate, whole_words=True)
            for batch in batches:
                clean = [not matcher.search(text) for _, _, data, offsets in pieces(batch.column(at)) for text in plain(data, offsets)]
                yield batch.filter(pa.array(clean, pa.bool_()))
            tidy()

        out = out.toDF(*[f"_{i}" for i in range(len(docs.columns))]).mapInArrow(scan, docs.schema)
    return out
