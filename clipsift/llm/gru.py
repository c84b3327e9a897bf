"""Operator 9: language-model scoring by a gated recurrent network with a softmax by classes, leaves and words.

Word counts of all training documents give the base model, the network's shortlist of most frequent words, which grows with
the square root of the vocabulary, and the share of each other word. The network is trained in numpy by truncated
backpropagation on all training documents: it is begun on a sample of about `sample_docs`, from there shards of about
`shard_bytes` of text each take it through all of their training documents, and the shards' parameters are averaged by
their tokens. The output factors into class, leaf of the class and word of the leaf; the most frequent words, the first leaf, stand
beside the classes. Leaves are runs of ranks of one size. Classes are runs of leaves, small for frequent words and large for rare
ones, so that the classes and an average leaf's fellows are together as few as can be. A word outside the shortlist has the chance of the unknown slot times its add-one share among such words.

Documents are dealt to buckets of about `bucket_bytes` of text. Each sends its distinct words by hash to parts, which
add the counts up and send totals back, so the vocabulary is never in one place. A bucket then runs its documents
side by side in lanes; the state is carried through a document, however long, and reset at its start.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clipsift.llm.common import cut, draw, spread, text_size
from clipsift.llm.textkit import hashes, hold, pack_sorted, planes, spread_parts, tidy, unpack_sorted, unplanes

#: The least slots of a network, and its widths.
SLOTS, HIDDEN, EMBED = 1024, 24, 16
#: Parameters sent in a row when they are averaged, and parameters and softmax rows worked on at a time, within the cache.
BLOCK, STRIDE, ROWS = 1 << 14, 1 << 16, 1 << 10
#: The most lanes of a shard: a step costs passes over all parameters, which so many tokens share.
LANES = 1024
#: Logits up to this size need no shift before exp in 32-bit floats.
SAFE = 60.0
END, UNKNOWN = 0, 1
_END_HASH = np.uint64(0xE4D0F0D0E4D0F0D1)
_BITS = np.uint64(48)
_KEY = np.uint64((1 << 48) - 1)
COUNTS = "bucket int, part int, words binary, counts binary, n long, v long"


def slots_for(v: int, most: int) -> int:
    """Slots for a vocabulary of v words: a power of 2, at least 16 times its root, within SLOTS and most."""
    return min(most, max(SLOTS, 1 << (math.isqrt(256 * max(v, 1)) - 1).bit_length()))


def tokens(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the words of each row, A-Z folded, each row closed by an end; first token of each row and the end)."""
    h, ptr = hashes(column, lower=True)
    rows = len(ptr) - 1
    out = np.full(len(h) + rows, _END_HASH, np.uint64)
    out[np.arange(len(h)) + np.repeat(np.arange(rows), np.diff(ptr))] = h
    return out, ptr + np.arange(rows + 1)


def _table(rows: list[tuple]) -> pa.Table:
    kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64())
    cols = list(zip(*rows, strict=True)) if rows else [[] for _ in kinds]
    return pa.table([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["bucket", "part", "words", "counts", "n", "v"])


def _cuts(keys: np.ndarray) -> list[tuple[int, int, int]]:
    part = keys >> _BITS
    at = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [len(part)]]) if len(part) else [0]
    return [(int(part[a]), int(a), int(b)) for a, b in zip(at[:-1], at[1:], strict=True)]


def keyed(h: np.ndarray, parts: int) -> np.ndarray:
    """Part of each hash, from its high bits, above its 48 low bits; there are at most 65536 parts."""
    return ((h >> _BITS) % np.uint64(min(parts, 1 << 16))) << _BITS | (h & _KEY)


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct keys, ascending; which of them each key is), as by np.unique, without sorting all keys."""
    coded = pa.array(keys).dictionary_encode()
    found = coded.dictionary.to_numpy(zero_copy_only=False)
    order = np.argsort(found)
    place = np.empty(len(found), np.int32)
    place[order] = np.arange(len(found), dtype=np.int32)
    return found[order], place[coded.indices.to_numpy()]


def send_words(table: pa.Table, parts: int) -> pa.Table:
    """Of one bucket: by part, its distinct words and how often they occur in training documents (0 counts too)."""
    h, ptr = tokens(table["text"])
    train = np.repeat(table["train"].to_numpy(), np.diff(ptr))
    words, at = distinct(keyed(h, parts))
    counts = np.bincount(at, weights=train, minlength=len(words)).astype(np.int64)
    bucket = table["bucket"][0].as_py()
    return _table([(bucket, p, pack_sorted(words[a:b] & _KEY, 6), planes(counts[a:b], 5), None, None) for p, a, b in _cuts(words)])


def add_words(table: pa.Table, parts: int, most_slots: int) -> pa.Table:
    """Of one part: to each bucket the totals of its words, in their order; and with no bucket the part's most frequent words
    (four times its share of a shortlist and more: parts are dealt by hash), their counts, all occurrences (n) and distinct
    words (v)."""
    part, buckets = table["part"][0].as_py(), table["bucket"].to_pylist()
    got = [unpack_sorted(x, 6) for x in table["words"].to_pylist()]
    counts = np.concatenate([unplanes(x, 5) for x in table["counts"].to_pylist()]).astype(np.int64)
    words, at = distinct(np.concatenate(got))
    total = np.bincount(at, weights=counts, minlength=len(words)).astype(np.int64)
    cuts = np.cumsum([0, *[len(g) for g in got]])
    out = [(buckets[i], part, None, planes(total[at[a:b]], 5), None, None) for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True))]
    tidy()
    known = np.flatnonzero(total)
    top = known[np.lexsort((words[known], -total[known]))][: SLOTS + 4 * slots_for(2 * parts * len(known), most_slots) // parts]
    return _table([*out, (None, part, words[top].astype("<u8").tobytes(), total[top].astype("<i8").tobytes(), int(total.sum()), len(known))])


def _top_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, words, counts in zip(*(batch.column(c).to_pylist() for c in ("part", "words", "counts")), strict=True):
            key = np.frombuffer(words, "<u8") | np.uint64(part) << _BITS
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(np.frombuffer(counts, "<i8"))], names=["key", "c"])


def fan_for(slots: int) -> int:
    """Words of a leaf: about the cube root of the slots."""
    return 1 << round(math.log2(slots) / 3)


def class_cuts(weight: np.ndarray) -> np.ndarray:
    """Bounds of the classes of leaves of such weights: about 1 / sqrt(chance) leaves a class, where the number of classes plus
    the expected size of a leaf's class is least."""
    k = np.floor(np.cumsum(np.sqrt(weight / weight.sum()))).astype(np.int64)
    return np.concatenate([[0], np.flatnonzero(np.diff(k)) + 1, [len(k)]])


def shift(e: np.ndarray) -> None:
    """Takes the largest of each row from logits, in place, if they need it before exp in 32-bit floats."""
    if e.max() > SAFE or e.min() < -SAFE:
        e -= e.max(axis=-1, keepdims=True)


def log_softmax(h: np.ndarray, w: np.ndarray, y: np.ndarray, grads: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """Natural log of the chance of places y under the softmax of h w'; adds the gradients of the loss to those of w and
    h. The last column of h is 1, that of w the bias."""
    e = h @ w.T
    shift(e)
    rows = np.arange(len(y))
    out = e[rows, y]
    np.exp(e, out=e)
    s = e @ np.ones(len(w), e.dtype)
    out -= np.log(s)
    if grads is not None:
        dw, dh = grads
        e *= (1 / s)[:, None]
        e[rows, y] -= 1
        dw += e.T @ h
        dh += e @ w
    return out


def leaf_softmax(h: np.ndarray, w: np.ndarray, leaf: np.ndarray, y: np.ndarray, grads: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """As log_softmax, with weights w[leaf] of each row; leaves ascend. Leaves with about as many rows are taken at once, filled
    up to one number of rows with such as count nothing."""
    n, fan = len(y), w.shape[1]
    out = np.empty(n, h.dtype)
    if not n:
        return out
    first = np.concatenate([[0], np.flatnonzero(np.diff(leaf)) + 1])
    ids, rows = leaf[first].astype(np.int64), np.diff(np.append(first, n))
    power = 1 << (np.frexp(np.maximum(rows, 4))[1] - 1).astype(np.int64)
    size = np.where(rows <= power, power, np.where(2 * rows <= 3 * power, 3 * power // 2, 2 * power))
    for filled in np.unique(size).tolist():
        alike = np.flatnonzero(size == filled)
        per, row = max(1, STRIDE // (filled * fan)), np.arange(filled)
        for a in range(0, len(alike), per):
            some = alike[a : a + per]
            real = (row < rows[some, None]).ravel()
            at = np.minimum(first[some, None] + row, n - 1).ravel()
            wk, full = np.take(w, ids[some], axis=0), np.take(h, at, axis=0)
            e = full.reshape(len(some), filled, -1) @ wk.transpose(0, 2, 1)
            shift(e)
            flat, word = e.reshape(-1), np.arange(0, e.size, fan) + np.take(y, at)
            got = flat[word]
            np.exp(e, out=e)
            s = e.reshape(-1, fan) @ np.ones(fan, e.dtype)
            got -= np.log(s)
            at = at[real]
            out[at] = got[real]
            if grads is not None:
                dw, dh = grads
                e.reshape(-1, fan)[:] *= (real / s)[:, None].astype(e.dtype)
                flat[word] -= real
                dw[ids[some]] += e.transpose(0, 2, 1) @ full.reshape(len(some), filled, -1)
                dh[at] += (e @ wk).reshape(full.shape)[real]
    return out


@dataclass
class Network:
    """p: parameters by name. Gates lie side by side: update, reset, candidate. Slots are words of leaves, leaves are dealt to
    classes, in order: wc leads to the first leaf's words and the classes, wm to the leaves of each class, wo to words; their last
    columns are biases."""

    p: dict[str, np.ndarray]
    cuts: np.ndarray | None = None

    def __post_init__(self) -> None:
        slots, leaves = len(self.p["emb"]), len(self.p["wm"])
        self.fan = slots // leaves
        if self.cuts is None:
            self.cuts = np.linspace(0, leaves, len(self.p["wc"]) - self.fan + 1).astype(np.int64)
        self.of = np.repeat(np.arange(len(self.cuts) - 1), np.diff(self.cuts))

    @classmethod
    def start(cls, seed: int = 9, slots: int = SLOTS, weight: np.ndarray | None = None) -> Network:
        """With weights of the slots (counts), classes by these, and biases that give each slot its share; else of one size."""
        rng = np.random.default_rng(seed)
        fan, wide = fan_for(slots), HIDDEN + 1
        leaf = None if weight is None else weight.reshape(-1, fan).sum(1) * (np.arange(slots // fan) > 0)
        cuts = np.linspace(0, slots // fan, math.isqrt(slots // fan) + 1).astype(np.int64) if leaf is None else class_cuts(leaf)
        shape = {"emb": (slots, EMBED), "wo": (slots, wide), "wm": (slots // fan, wide), "wc": (fan + len(cuts) - 1, wide), "wx": (EMBED, 3 * HIDDEN), "b": (3 * HIDDEN,), "u": (HIDDEN, 3 * HIDDEN)}
        inputs = {"emb": slots, "wx": EMBED, "u": HIDDEN, "wc": HIDDEN, "wm": HIDDEN, "wo": HIDDEN}
        p = {k: (rng.normal(0, 1 / np.sqrt(inputs[k]), s) if k in inputs else np.zeros(s)).astype(np.float32) for k, s in shape.items()}
        for w in ("wo", "wm", "wc"):
            p[w][:, -1] = 0
        if leaf is not None:
            group = np.add.reduceat(leaf, cuts[:-1])
            p["wo"][:, -1] = np.log(weight * fan / np.repeat(np.maximum(leaf, 1), fan))
            p["wm"][:, -1] = np.log(np.maximum(leaf, 1) * np.repeat(np.diff(cuts) / group, np.diff(cuts)))
            p["wc"][:, -1] = np.log(np.concatenate([weight[:fan], group]) / weight.sum() * len(p["wc"]))
        return cls(p, cuts)

    def inputs(self) -> np.ndarray:
        """What each slot adds to the gates."""
        return self.gates(self.p["emb"])

    def gates(self, emb: np.ndarray) -> np.ndarray:
        """What such embeddings add to the gates, column by column: so a gate's numbers lie together."""
        x = self.p["wx"].T @ emb.T
        x += self.p["b"][:, None]
        return x.T

    def step(self, x: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
        """(new state, update, reset, candidate, the state's part of the candidate), best from arrays that lie column by column."""
        g = (self.p["u"].T @ h.T).T
        zr = x[:, : 2 * HIDDEN] + g[:, : 2 * HIDDEN]
        logistic(zr)
        z, r, un = zr[:, :HIDDEN], zr[:, HIDDEN:], g[:, 2 * HIDDEN :]
        n = r * un
        n += x[:, 2 * HIDDEN :]
        n *= 2
        logistic(n)  # at twice x it is half of tanh + 1
        n *= 2
        n -= 1
        new = h - n
        new *= z
        new += n
        return new, z, r, n, un

    def losses(self, h: np.ndarray, y: np.ndarray, grads: dict[str, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """Natural log probability of slots y after states h, which may have a column of ones; with grads, adds the output gradients and returns that of h."""
        p, fan, cuts = self.p, self.fan, self.cuts
        leaf = (y // fan).astype(np.uint16)
        order = np.argsort(leaf, kind="stable")
        if h.shape[1] == HIDDEN:
            h = np.column_stack([h, np.ones(len(h), h.dtype)])
        h, y, leaf = np.take(h, order, axis=0), np.take(y, order), np.take(leaf, order)
        out, dh = np.empty(len(y), h.dtype), None if grads is None else np.zeros_like(h)
        tree = int(np.searchsorted(leaf, 1))  # the first leaf's words are at the root
        top = np.where(leaf == 0, y, self.of[leaf] + fan)
        for a in range(0, len(y), ROWS):
            at = slice(a, a + ROWS)
            out[at] = log_softmax(h[at], p["wc"], top[at], None if grads is None else (grads["wc"], dh[at]))
        ends = np.maximum(tree, np.searchsorted(leaf, cuts))
        for k in np.flatnonzero(np.diff(ends)).tolist():
            below = slice(max(1, cuts[k]), cuts[k + 1])
            for a in range(ends[k], ends[k + 1], ROWS):
                at = slice(a, min(a + ROWS, ends[k + 1]))
                out[at] += log_softmax(h[at], p["wm"][below], leaf[at].astype(np.int64) - below.start, None if grads is None else (grads["wm"][below], dh[at]))
        cube = (-1, fan, HIDDEN + 1)
        out[tree:] += leaf_softmax(h[tree:], p["wo"].reshape(cube), leaf[tree:], y[tree:] % fan, None if grads is None else (grads["wo"].reshape(cube), dh[tree:]))
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        return np.take(out, back), None if dh is None else np.take(dh, back, axis=0)[:, :HIDDEN]

    @np.errstate(over="ignore")
    def score(self, ids: np.ndarray, ptr: np.ndarray, lanes: int = 1024, window: int = 3 << 12) -> np.ndarray:
        """Natural log probability of each document of slots ids[ptr[i]:ptr[i + 1]], the state starting anew in each. Documents
        of a lane are laid out one after another, so that a step is a place of every lane that is as long; windows are as many
        steps as hold about `window` tokens. Memory is that of the tokens, however long a document."""
        docs = len(ptr) - 1
        if not docs:
            return np.zeros(0)
        lane, size = dealt(np.diff(ptr), min(lanes, docs))
        lane = [lane[k] for k in np.argsort(-size, kind="stable")]
        size = -np.sort(-size)
        order = np.array([i for of in lane for i in of])
        length = np.diff(ptr)[order]
        first = np.cumsum([0, *length])  # of each document, in the order of the lanes
        laid = np.concatenate([ids[ptr[i] : ptr[i + 1]] for i in order])
        begin = np.cumsum([0, *size])[:-1]  # of each lane
        starts = np.zeros(len(laid) + 1, bool)
        starts[first] = True
        out, emb = np.zeros(len(laid), np.float64), self.p["emb"]
        h = np.zeros((HIDDEN, len(lane)), np.float32).T
        reach = np.searchsorted(-size, -np.arange(int(size[0])), side="left").astype(np.int32)  # lanes that reach each step
        ends = np.searchsorted(np.cumsum(reach, dtype=np.int64), np.arange(1, len(ids) // window + 2) * window)
        for t0, t1 in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True):
            busy = reach[t0:t1]
            if t0 == t1:
                continue
            lane_of = np.arange(busy.sum()) - np.repeat(np.cumsum(busy) - busy, busy)
            at = begin[lane_of] + np.repeat(np.arange(t0, t1), busy)
            new = starts[at]
            x, go_on = np.where(new, END, laid[at - 1]), (~new).astype(np.float32)[:, None]
            states, a = np.ones((len(at), HIDDEN + 1), np.float32), 0
            for n in busy.tolist():
                h = states[a : a + n, :HIDDEN] = self.step(self.gates(np.take(emb, x[a : a + n], axis=0)), h[:n] * go_on[a : a + n])[0]
                a += n
            out[at] = self.losses(states, laid[at])[0]
        scores = np.empty(docs)
        scores[order] = np.add.reduceat(out, first[:-1])
        return scores

    def backward(self, xs: np.ndarray, ys: np.ndarray, h: np.ndarray, grads: dict[str, np.ndarray] | None = None) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """(gradients of the summed loss of a window of slots xs, each predicting ys, by truncated backpropagation; the last
        state). The state starts from h, and anew after an end. Gradients are put into `grads`, which hold zeros."""
        p, kind, lanes, n_steps = self.p, h.dtype, len(h), len(xs)
        grads = {k: np.zeros_like(v) for k, v in p.items()} if grads is None else grads
        used = marked(xs, len(p["emb"]))
        place = np.zeros(len(p["emb"]), np.uint16 if len(used) <= 1 << 16 else np.int64)
        place[used] = np.arange(len(used))
        at = place[xs]
        go_on = (xs != END).astype(kind)
        before, after, steps = np.empty((n_steps, HIDDEN, lanes), kind), np.ones((n_steps, lanes, HIDDEN + 1), kind), []
        for t in range(n_steps):
            emb = np.take(p["emb"], xs[t], axis=0)
            np.multiply(h.T, go_on[t], out=before[t])
            h, *rest = self.step(self.gates(emb), before[t].T)
            after[t, :, :HIDDEN] = h
            steps.append((emb, *(v.T for v in rest)))
        _, dh_all = self.losses(after.reshape(-1, HIDDEN + 1), ys.ravel(), grads)
        dh_all = dh_all.reshape(n_steps, lanes, HIDDEN)
        dh, g, inner, d_emb = np.zeros((HIDDEN, lanes), kind), np.empty((3 * HIDDEN, lanes), kind), np.empty((3 * HIDDEN, lanes), kind), np.empty((EMBED, n_steps, lanes), kind)
        dz, dr, dn = g[:HIDDEN], g[HIDDEN : 2 * HIDDEN], g[2 * HIDDEN :]
        ones = np.ones(lanes, kind)
        for t in reversed(range(n_steps)):
            emb, z, r, n, un = steps[t]
            dh += dh_all[t].T
            rest = 1 - z
            np.multiply(dh, rest, out=dn)
            dn *= 1 - n * n
            rest *= z
            np.subtract(before[t], n, out=dz)
            dz *= dh
            dz *= rest
            np.multiply(dn, un, out=dr)
            dr *= r * (1 - r)
            inner[: 2 * HIDDEN] = g[: 2 * HIDDEN]
            np.multiply(dn, r, out=inner[2 * HIDDEN :])
            dh *= z
            dh += p["u"] @ inner
            dh *= go_on[t]
            grads["u"] += before[t] @ inner.T
            grads["wx"] += emb.T @ g.T
            grads["b"] += g @ ones
            d_emb[:, t] = p["wx"] @ g
        by_slot = np.argsort(at, axis=None, kind="stable")
        grads["emb"][used] = np.add.reduceat(np.take(d_emb.reshape(EMBED, -1), by_slot, axis=1), np.searchsorted(at.ravel()[by_slot], np.arange(len(used))), axis=1).T
        return grads, h

    @np.errstate(over="ignore")
    def fit(self, ids: np.ndarray, ptr: np.ndarray, *, epochs: int = 3, lanes: int = 32, window: int = 24, rate: float = 0.01, fade: float = 1.0, seed: int = 3) -> Network:
        """Adam over windows of `window` steps; the state is carried from window to window, gradients are not. Where under
        a fourth of the embeddings or leaves have tokens in a window, the others wait, with their moments. The rate goes from
        `rate` to `fade` times it over an epoch. The last lane is filled up from the first tokens, so none is left out."""
        rng = np.random.default_rng(seed)
        flat = self.flat()
        self.p = self.views(flat)
        grad, m1, m2 = np.zeros_like(flat), np.zeros_like(flat), np.zeros_like(flat)
        grads = self.views(grad)
        slots, fan, count = len(self.p["emb"]), self.fan, 0
        cut = [slots * EMBED, slots * (EMBED + HIDDEN + 1)]
        emb, leaves, rest = ([x[a:b].reshape(-1, wide) for x in (flat, grad, m1, m2)] for a, b, wide in ((0, cut[0], EMBED), (*cut, (HIDDEN + 1) * fan), (cut[1], len(flat), 1)))
        for _ in range(epochs):
            docs = rng.permutation(len(ptr) - 1)
            laid = np.concatenate([ids[ptr[i] : ptr[i + 1]] for i in docs])
            if len(laid) < 2 * lanes:
                lanes = 1
            y = np.concatenate([laid, laid[: -len(laid) % lanes]]).reshape(lanes, -1).T
            length = len(y)
            x = np.vstack([np.full((1, lanes), END), y[:-1]])
            h = np.zeros((lanes, HIDDEN), np.float32)
            for t0 in range(0, length, window):
                xs, ys = x[t0 : t0 + window], y[t0 : t0 + window]
                _, h = self.backward(xs, ys, h, grads)
                count += 1
                for part, rows in ((emb, marked(xs, slots)), (leaves, marked(ys // fan, slots // fan)), (rest, None)):
                    most = rows is None or 4 * len(rows) > len(part[0])
                    adam(*part, None if most else rows, lanes, rate * (1 - (1 - fade) * t0 / length), count)
        return self

    def views(self, flat: np.ndarray) -> dict[str, np.ndarray]:
        """Parts of a row of all parameters, by name."""
        cuts = np.cumsum([v.size for v in self.p.values()])[:-1]
        return {k: x.reshape(v.shape) for (k, v), x in zip(self.p.items(), np.split(flat, cuts), strict=True)}

    def flat(self) -> np.ndarray:
        """All parameters in a row."""
        return np.concatenate([v.ravel() for v in self.p.values()])

    def filled(self, flat: np.ndarray) -> Network:
        """A network of this shape with other parameters."""
        return Network(self.views(flat.astype(np.float32)), self.cuts)


def logistic(x: np.ndarray) -> None:
    """1 / (1 + exp(-x)), in place; 0 where exp is infinite."""
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    np.divide(1, x, out=x)


def marked(x: np.ndarray, n: int) -> np.ndarray:
    """Distinct values of x, which are below n, ascending."""
    seen = np.zeros(n, bool)
    seen[x] = True
    return np.flatnonzero(seen)


def adam(v: np.ndarray, g: np.ndarray, m: np.ndarray, s: np.ndarray, rows: np.ndarray | None, lanes: int, rate: float, count: int) -> None:
    """A step of Adam on some rows, ascending (None: all), of parameters v with gradients g, summed over the lanes, and moments, in
    place, by strides that stay in the cache; gradients are set to zero. The moments are kept as sums, 10 and 100 times the means."""
    root = np.sqrt(0.01 / (1 - 0.99**count))
    n, per = len(v) if rows is None else len(rows), max(1, STRIDE // v.shape[1])
    for a in range(0, n, per):
        at = slice(a, a + per) if rows is None else rows[a : a + per]
        vs, gs, ms, ss = (x[at] if rows is None else np.take(x, at, axis=0) for x in (v, g, m, s))
        if np.vdot(gs, gs) > lanes**2:
            np.clip(gs, -lanes, lanes, out=gs)
        ms *= 0.9
        ms += gs
        ss *= 0.99
        gs *= gs
        ss += gs
        np.sqrt(ss, out=gs)
        gs += 1e-6 * lanes / root
        np.divide(ms, gs, out=gs)
        gs *= 0.1 * rate / (1 - 0.9**count) / root
        vs -= gs
        if rows is not None:
            v[at], m[at], s[at] = vs, ms, ss
        g[at] = 0


def learn(table: pa.Table, network: Network) -> pa.Table:
    """Of one shard: the network after all its documents, in blocks of parameters, and its tokens as their weight."""
    rows = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["ids"]) for r in table.to_pylist())
    ids = [np.frombuffer(x, "<u4").astype(np.int64) for _, x in rows]
    n = sum(len(x) for x in ids)
    net = network.filled(network.flat())
    hold()
    lanes = min(LANES, max(32, n // 4096))
    net.fit(np.concatenate(ids), np.cumsum([0, *[len(x) for x in ids]]), epochs=1, lanes=lanes, rate=0.02 * math.sqrt(lanes / LANES), fade=0.1)
    flat, shard = net.flat(), table["shard"][0].as_py()
    tidy()
    blocks = [flat[a : a + BLOCK].astype("<f4").tobytes() for a in range(0, len(flat), BLOCK)]
    return pa.table([pa.array(range(len(blocks)), pa.int32()), pa.array([shard] * len(blocks), pa.int32()), pa.array([n] * len(blocks), pa.int64()), pa.array(blocks, pa.binary())], names=["block", "shard", "n", "value"])


def mean_block(table: pa.Table) -> pa.Table:
    """Of one block: its mean over the shards, weighted by tokens."""
    total, weight = 0.0, 0
    for _, n, x in sorted(zip(*(table[c].to_pylist() for c in ("shard", "n", "value")), strict=True)):
        total, weight = total + n * np.frombuffer(x, "<f4").astype(np.float64), weight + n
    return pa.table([table["block"][:1], pa.array([(total / weight).astype("<f4").tobytes()], pa.binary())], names=["block", "value"])


def dealt(size: np.ndarray, lanes: int) -> tuple[list[list[int]], np.ndarray]:
    """Documents of each lane, longest first to the shortest lane; the lanes' lengths."""
    out: list[list[int]] = [[] for _ in range(lanes)]
    heap = [(0, k) for k in range(lanes)]
    for i in np.argsort(-size, kind="stable").tolist():
        n, k = heapq.heappop(heap)
        out[k].append(i)
        heapq.heappush(heap, (n + int(size[i]), k))
    total = np.zeros(lanes, np.int64)
    for n, k in heap:
        total[k] = n
    return out, total


@dataclass
class Scorer:
    """shortlist: ascending word keys and their slots; n, v: occurrences and distinct words in training; rest: of those
    outside the shortlist."""

    keys: np.ndarray
    slots: np.ndarray
    n: int
    v: int
    rest_n: int
    rest_v: int
    parts: int
    network: Network

    def ids(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(keys), UNKNOWN)
        at = np.searchsorted(self.keys, keys)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == keys, self.slots[at], UNKNOWN)

    def score(self, table: pa.Table, links: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.table([pa.array([], t) for t in _KINDS], names=_NAMES)
        h, ptr = tokens(table["text"])
        words, at = distinct(keyed(h, self.parts))
        sent = dict(zip(links["part"].to_pylist(), links["counts"].to_pylist(), strict=True))
        c = np.concatenate([unplanes(sent[p], 5) for p, _, _ in _cuts(words)]).astype(np.float64)
        ids = self.ids(words)
        base = np.log10((c + 1) / (float(self.n) + 1.0 * (self.v + 1)))
        share = np.where(ids == UNKNOWN, np.log10((c + 1) / (self.rest_n + self.rest_v + 1.0)), 0.0)
        total = lambda x: np.add.reduceat(x[at], ptr[:-1])
        tidy()
        hold()
        net = self.network.score(ids[at], ptr) / np.log(10)
        cols = [table["doc_id"], pa.array(np.diff(ptr)), pa.array(total((c > 0).astype(np.int64))), pa.array(np.full(table.num_rows, self.n, np.int64)), pa.array(total(base)), pa.array(net + total(share))]
        return pa.table(cols, names=_NAMES)


_NAMES = ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
_KINDS = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]


def _slots(batches: Iterator[pa.RecordBatch], scorer: Scorer) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        h, ptr = tokens(batch.column("text"))
        words, at = distinct(keyed(h, scorer.parts))
        ids = scorer.ids(words).astype("<u4")[at]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([ids[a:b].tobytes() for a, b in zip(ptr[:-1], ptr[1:], strict=True)], pa.binary())], names=["doc_id", "ids"])


def score(docs: DataFrame, train: Column, *, id_col: str = "doc_id", text_col: str = "text", sample_docs: int = 600, bucket_bytes: int = 24 << 20, part_rows: int = 2_000_000, shard_bytes: int = 24 << 20, most_slots: int = 1 << 18) -> DataFrame:
    """One row per document: doc_id, n_tokens, n_known, train_tokens, base_score, score (log10 probabilities), learning from all
    documents where `train` holds. A network of most_slots slots has 43 MB of parameters.

    Null texts are empty and hold the end token only. A text of any length is scored whole, its state carried throughout.
    Without training documents all tokens are unknown and the network is untrained. Rows that repeat an id are scored each;
    ids are whole numbers or null. Empty tables give no rows; other columns, whatever their names, are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    buckets, parts = spread_parts(rows, bucket_bytes, part_rows)
    dealt_rows = rows.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(buckets)).cast("int").alias("bucket"), "doc_id", "text", "train")
    sums = cut(dealt_rows.groupBy("bucket").applyInArrow(lambda t: send_words(t, parts), COUNTS).groupBy("part").applyInArrow(lambda t: add_words(t, parts, most_slots), COUNTS))
    top = sums.where("bucket is null")
    seen = top.agg(F.sum("n").alias("n"), F.sum("v").alias("v")).first()
    n, v = seen["n"] or 0, seen["v"] or 0
    n_slots = slots_for(v, most_slots)
    best = top.mapInArrow(_top_rows, "key long, c long").orderBy(F.col("c").desc(), "key").limit(n_slots - 2).collect()
    end = int(keyed(np.array([_END_HASH]), parts)[0])
    listed = [(int(np.int64(r["key"]).view(np.uint64)), r["c"]) for r in best]
    listed = [x for x in listed if x[0] != end]
    keys = np.array([end, *[k for k, _ in listed]], np.uint64)
    order = np.argsort(keys)
    slots = np.array([END, *range(2, len(listed) + 2)])[order]
    ends = sum(r["c"] for r in best) - sum(c for _, c in listed)
    weight = np.ones(n_slots)
    weight[END] += ends
    weight[UNKNOWN] += n - ends - sum(c for _, c in listed)
    weight[2 : len(listed) + 2] += [c for _, c in listed]
    scorer = Scorer(keys[order], slots, n, v, n - sum(c for _, c in listed) - ends, v - len(listed) - (ends > 0), parts, Network.start(slots=n_slots, weight=weight))
    known = rows.where("train")
    n_train, n_bytes = text_size(known)
    coded = lambda x: x.mapInArrow(lambda b: _slots(b, scorer), "doc_id long, ids binary")
    chosen = known.where(draw(4, "doc_id") < min(1.0, sample_docs / max(1, n_train)))
    sample = sorted((r["doc_id"] or -1, r["ids"]) for r in coded(chosen).collect())
    network = scorer.network
    if sample:
        ids = [np.frombuffer(x, "<u4").astype(np.int64) for _, x in sample]
        network = network.filled(network.flat()).fit(np.concatenate(ids), np.cumsum([0, *[len(x) for x in ids]]))
    if n_train:
        shard = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(spread(n_bytes, shard_bytes))).cast("int").alias("shard")
        learnt = coded(known).select("*", shard).groupBy("shard").applyInArrow(lambda t: learn(t, network), "block int, shard int, n long, value binary")
        blocks = sorted(learnt.groupBy("block").applyInArrow(mean_block, "block int, value binary").collect())
        scorer.network = network.filled(np.concatenate([np.frombuffer(r["value"], "<f4") for r in blocks]))
    back = sums.where("bucket is not null").select("bucket", "part", "counts")
    return dealt_rows.groupBy("bucket").cogroup(back.groupBy("bucket")).applyInArrow(lambda a, b: scorer.score(a, b), "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double")
