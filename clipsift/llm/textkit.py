"""Words, hashes and packed integers of Arrow text columns, vectorised in numpy.

A text column arrives as one buffer of UTF-8 bytes with offsets, so words are cut and hashed for thousands of documents
at once without building Python strings. Words are maximal runs of bytes other than 0x20 and 0x09-0x0D; `lower` folds
A-Z only.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Of each of the two word hashes, where it starts. Words over LONG bytes are hashed one by one.
_SEEDS, LONG = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F), 64
_MASK = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, n: int = 1) -> list[np.ndarray]:
    """n (1 or 2) independent 64-bit hashes of the words data[start:end]. Eight bytes at a time go through a scrambling that
    depends on all before, so no pattern within words makes two alike; nor do their lengths, which come first."""
    size = end - start
    out = [mix(size.astype(np.uint64) ^ np.uint64(s)) for s in _SEEDS[:n]]
    lanes = np.ndarray(len(data) + 1, "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))
    at = np.flatnonzero(size <= LONG)
    for k in range(0, LONG, 8):
        at = at[size[at] > k] if k else at
        if not len(at):
            break
        lane = lanes[start[at] + k] & _MASK[np.minimum(size[at] - k, 8)]
        for h in out:
            h[at] = mix(h[at] ^ lane)
    for i in np.flatnonzero(size > LONG).tolist():
        whole = xxhash.xxh3_128_intdigest(data[start[i] : end[i]].tobytes())
        for k, h in enumerate(out):
            h[i] ^= np.uint64(whole >> 64 * k & 0xFFFFFFFFFFFFFFFF)
    return out


@dataclass
class Words:
    """Words of consecutive documents: hash (and a second, independent one, if asked for), byte range in `data`, and ptr: first
    word of each document (and the end)."""

    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray
    ptr: np.ndarray
    data: np.ndarray
    offsets: np.ndarray
    other: np.ndarray | None = None


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    if column.null_count:
        column = column.fill_null("")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type)
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)), offsets


def pieces(column: pa.Array | pa.ChunkedArray, limit: int = 4 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets from 0) of runs of rows of about `limit` bytes; a row is never cut."""
    data, offsets = buffers(column)
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = False, both: bool = False) -> Words:
    """Cut and hash the words of documents that lie one after another in `data`."""
    n = len(data)
    if n == 0:
        z, none = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        return Words(none, z, z, np.zeros(len(offsets), np.int64), data, offsets, none if both else None)
    space = _SPACE[data]
    inside = ~space
    first, last = inside.copy(), inside.copy()
    first[1:] &= space[:-1]
    last[:-1] &= space[1:]
    edge = offsets[(offsets > 0) & (offsets < n)]
    first[edge] = inside[edge]
    last[edge - 1] = inside[edge - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    found = word_hashes(_LOWER[data] if lower else data, start, end, 1 + both)
    return Words(found[0], start, end, np.searchsorted(start, offsets), data, offsets, found[1] if both else None)


def rolling(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive entries of h (positions 0 .. len(h) - k), by doubling; two neighbours are scrambled into one."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    join = lambda x, y: mix(x * np.uint64(0xD6E8FEB86659FD93) + y)
    out, have, width, block, rest = None, 0, 1, h, k
    while rest:
        if rest & 1:
            if out is None:
                out, have = block, width
            else:
                m = len(block) - have
                out = join(out[:m], block[have : have + m]) if m > 0 else out[:0]
                have += width
        rest >>= 1
        if rest:
            block = join(block[:-width], block[width:])
            width *= 2
    return mix(out[: len(h) - k + 1])


def within(ptr: np.ndarray, k: int, n: int) -> np.ndarray:
    """For positions 0 .. n - 1 of words: whether k consecutive words from there belong to one document."""
    ok = np.zeros(n, bool)
    delta = np.zeros(n + 1, np.int32)
    size = np.diff(ptr)
    have = size >= k
    np.add.at(delta, ptr[:-1][have], 1)
    np.add.at(delta, ptr[1:][have] - (k - 1), -1)
    ok[:] = np.cumsum(delta[:-1]) > 0
    return ok


def pack_sorted(values: np.ndarray, width: int = 4) -> bytes:
    """Ascending integers under 2**(8 * width) as byte planes of their differences, which compress well."""
    kind = "<u4" if width == 4 else "<u8"
    d = values.astype(kind)
    d[1:] = d[1:] - d[:-1]
    return np.ascontiguousarray(d.view(np.uint8).reshape(-1, d.itemsize)[:, :width].T).tobytes()


def unpack_sorted(blob: bytes, width: int = 4) -> np.ndarray:
    """Reverse of pack_sorted."""
    kind = np.dtype("<u4" if width == 4 else "<u8")
    planes = np.frombuffer(blob, np.uint8).reshape(width, -1)
    out = np.zeros((planes.shape[1], kind.itemsize), np.uint8)
    out[:, :width] = planes.T
    return np.cumsum(out.reshape(-1).view(kind), dtype=kind)


def member(values: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Whether each value is in the ascending array `of`."""
    if len(of) == 0:
        return np.zeros(len(values), bool)
    at = np.searchsorted(of, values)
    at[at == len(of)] = 0
    return of[at] == values


def hashes(column: pa.Array | pa.ChunkedArray, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(word hashes of all rows, first word of each row and the end), a piece at a time."""
    found, _, ptr = both_hashes(column, lower, False)
    return found, ptr


def both_hashes(column: pa.Array | pa.ChunkedArray, lower: bool = False, both: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word hashes of all rows, their second hashes, first word of each row and the end), a piece at a time."""
    parts, others, sizes = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)], [np.zeros(1, np.int64)]
    for _, _, data, offsets in pieces(column, 1 << 20):
        w = words(data, offsets, lower, both)
        parts.append(w.hash)
        others += [w.other] if both else []
        sizes.append(np.diff(w.ptr))
    return np.concatenate(parts), np.concatenate(others), np.cumsum(np.concatenate(sizes))


def planes(values: np.ndarray, width: int) -> bytes:
    """The low `width` bytes of integers, plane by plane."""
    v = np.ascontiguousarray(values)
    return np.ascontiguousarray(v.view(np.uint8).reshape(-1, v.itemsize)[:, :width].T).tobytes()


def unplanes(blob: bytes, width: int, kind: str = "<u8") -> np.ndarray:
    """Reverse of planes."""
    p = np.frombuffer(blob, np.uint8).reshape(width, -1)
    out = np.zeros((p.shape[1], np.dtype(kind).itemsize), np.uint8)
    out[:, :width] = p.T
    return out.reshape(-1).view(kind)


def spread_parts(rows, bucket_bytes: int, part_rows: int) -> tuple[int, int]:
    """(buckets of texts, parts of word positions) for a table with a text column; a word is taken as six bytes."""
    from clipsift.llm.common import spread, text_size

    _, n_bytes = text_size(rows)
    return spread(n_bytes, bucket_bytes), spread(n_bytes // 6, part_rows)


def tidy() -> None:
    """Give freed memory back to the system: a worker that is kept would else hold the most it ever used."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def hold(most: int = 8 << 20, kept: int = 128 << 20) -> None:
    """Let this process keep freed memory for its next arrays, up to `kept` and for such of up to `most` bytes, rather than take
    new pages from the system each time; `tidy` still gives it back."""
    option = getattr(ctypes.CDLL(None), "mallopt", None)
    if option is not None:
        option(-3, most)  # M_MMAP_THRESHOLD
        option(-1, kept)  # M_TRIM_THRESHOLD
