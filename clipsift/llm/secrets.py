"""Operator 10: secret scans by patterns and by character Markov models.

Patterns give the base spans: assignments to secret-like names, access keys and long hexadecimal runs. Two first-order
Markov models of characters, one of random strings and one of ordinary identifiers, are trained from labelled samples and
compared by log-likelihood ratio; a run of `LEAST_RUN` or more key characters that reads as random adds a span, and so does,
in a run that does not, each part of as many characters between / - _ = that does. Not scored are shorter ones, those
without a letter (ordinary numbers, such as card numbers, are no identifiers), and joined ones without a digit.

The scan is map-only and sees whole texts. A vectorised test over the bytes finds the few documents with a long run, an
equals sign or a colon; only those are searched by expressions. Places count code points.
"""

from __future__ import annotations

import hashlib
import random
import re
import string
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from clipsift.llm.common import carried, draw, quoted
from clipsift.llm.textkit import pieces, tidy

KINDS = ("assign", "access", "hex", "markov")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS, HEX = re.compile(r"AKIA[A-Z0-9]+"), re.compile(r"[0-9a-f]{32,}")
LEAST_VALUE, LEAST_ACCESS, LEAST_RUN = 8, 16, 16
ALPHABET = string.ascii_letters + string.digits + "+/_=-"
RUN = re.compile(rf"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{{{LEAST_RUN},}}")
PART = re.compile(rf"[A-Za-z0-9+]{{{LEAST_RUN},}}")
_IN_RUN = np.zeros(256, bool)
_IN_RUN[[ord(c) for c in ALPHABET]] = True
_INDEX = {c: i for i, c in enumerate(ALPHABET)}
MASK = "[SECRET]"
#: Names of the columns added; columns to keep that clash with them are left out.
ADDED = ("n_assign", "n_access", "n_hex", "base_sha256", "spans", "redacted")


@dataclass
class RandomnessModel:
    """Log-likelihood ratio (random over ordinary) of each character pair, and the least mean ratio of a secret."""

    ratio: np.ndarray
    threshold: float

    def mean(self, s: str) -> float:
        """Mean ratio over the pairs of a string over ALPHABET; the first character counts as a pair with itself."""
        at = [_INDEX[c] for c in s]
        return float(self.ratio[[at[0], *at[:-1]], at].mean())


def random_strings(n: int = 2000, seed: int = 7) -> list[str]:
    """Labelled sample of random strings: base64, alphanumeric and hexadecimal, 16 to 64 characters."""
    rng = random.Random(seed)
    kinds = (string.ascii_letters + string.digits + "+/", string.ascii_letters + string.digits, string.ascii_uppercase + string.digits, "0123456789abcdef")
    return ["".join(rng.choices(kinds[i % len(kinds)], k=rng.randint(16, 64))) for i in range(n)]


def train(ordinary: Iterable[str], secrets: Iterable[str] | None = None, alpha: float = 0.5) -> RandomnessModel:
    """Fit both models; the threshold is where fewest of both samples fall on the wrong side, midway, at least above all
    but 1 in 1000 of the ordinary ones."""
    counts = np.full((2, len(ALPHABET), len(ALPHABET)), alpha)
    samples = [[s for s in (x if x is not None else random_strings()) if s and all(c in _INDEX for c in s)] for x in (ordinary, secrets)]
    pairs = []
    for k, sample in enumerate(samples):
        now = np.array([_INDEX[c] for c in "".join(sample)], np.int64)
        first = np.cumsum([0, *[len(s) for s in sample]])[:-1]
        before = np.concatenate([now[:1], now[:-1]])
        before[first] = now[first]  # the first character counts as a pair with itself
        np.add.at(counts[k], (before, now), 1)
        pairs.append((before, now, first))
    logs = np.log(counts / counts.sum(axis=2, keepdims=True))
    model = RandomnessModel(logs[1] - logs[0], 0.0)
    low, high = (np.add.reduceat(model.ratio[x, y], f) / np.diff([*f, len(x)]) if len(f) else np.zeros(1) for x, y, f in pairs)
    cuts = np.linspace(min(low.min(), high.min()), max(low.max(), high.max()), 200)
    wrong = [(low >= c).mean() + (high < c).mean() for c in cuts]
    best = np.flatnonzero(np.isclose(wrong, np.min(wrong)))
    model.threshold = max(float(cuts[best[len(best) // 2]]), float(np.quantile(low, 0.999)))
    return model


def base_spans(text: str) -> list[tuple[int, int, str, int]]:
    """(start, end, kind, start of the secret itself) of the patterns, by start, then kind."""
    out = [(m.start(), m.end(), "assign", m.start(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_VALUE]
    out += [(m.start(), m.end(), "access", m.start()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    out += [(m.start(), m.end(), "hex", m.start()) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def model_spans(text: str, model: RandomnessModel, base: list[tuple[int, int, str, int]]) -> list[tuple[int, int, str, int]]:
    """Runs that read as random, or else their parts that do, where they touch no base span."""
    starts = [x for x, _, _, _ in base]
    furthest = list(accumulate((y for _, y, _, _ in base), max))  # the last end of the spans so far

    def secret(a: int, b: int) -> bool:
        s = text[a:b]
        if not re.search("[A-Za-z]", s) or not (re.search("[0-9]", s) or s.isalpha()):
            return False
        before = bisect_left(starts, b)
        return not (before and furthest[before - 1] > a) and model.mean(s) > model.threshold

    out = []
    for m in RUN.finditer(text):
        places = [m.span()] if secret(*m.span()) else [p.span() for p in PART.finditer(text, *m.span()) if p.span() != m.span() and secret(*p.span())]
        out += [(a, b, "markov", a) for a, b in places]
    return out


def written(spans: list[tuple[int, int, str, int]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind, _ in spans)


def redacted(text: str, spans: list[tuple[int, int, str, int]]) -> str:
    """The text with each secret (of an assignment, the value) replaced by MASK; overlapping ones count as one."""
    out, at = [], 0
    for a, b in sorted((v, e) for _, e, _, v in spans):
        if a >= at:
            out += [text[at:a], MASK]
        at = max(at, b)
    return "".join([*out, text[at:]])


def suspects(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows that hold a run of LEAST_ACCESS key characters, an equals sign or a colon."""
    inside = _IN_RUN[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edge = offsets[(offsets > 0) & (offsets < len(data))]
    first[edge], last[edge - 1] = inside[edge], inside[edge - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    at = np.concatenate([start[end - start >= LEAST_ACCESS], np.flatnonzero((data == 58) | (data == 61))])
    return np.unique(np.searchsorted(offsets, at, side="right") - 1)


def identifiers(words: Iterable[str], n: int = 20_000, seed: int = 13) -> list[str]:
    """Labelled sample of ordinary identifiers, put together from ordinary words as programs, addresses and files do: camel
    case, snake and kebab case, paths, numbered names, versions and dates."""
    rng = random.Random(seed)
    known = sorted({w for w in words if w.isascii() and w.isalpha() and 2 < len(w) < 14}) or ["name", "value", "item", "page", "test"]
    number = lambda: str(rng.choice([rng.randrange(10), rng.randrange(100), rng.randrange(1000), 10 ** rng.randrange(1, 6) + rng.randrange(10), int("1234567890"[: rng.randint(1, 9)])])).zfill(rng.choice([1, 1, 2, 3]))
    date = lambda: f"{rng.randint(1990, 2035)}{(d := rng.choice(['-', '_', '/', '']))}{rng.randint(1, 12):02}{d}{rng.randint(1, 28):02}"
    out = []
    for _ in range(n):
        parts = [rng.choice(known).lower() for _ in range(rng.randint(2, 5))]
        style = rng.randrange(7)
        if style in (0, 6):
            s = parts[0] + "".join(p.capitalize() for p in parts[1:]) + rng.choice(["", "", number()])
        elif style == 1:
            s = "".join(p.capitalize() for p in parts) + rng.choice(["", number(), "V" + number()])
        elif style == 2:
            s = rng.choice("_-").join([*parts, *([number()] if rng.random() < 0.6 else [])])
        elif style == 3:
            s = "/".join([*parts, *([number()] if rng.random() < 0.3 else []), rng.choice(known).lower() + rng.choice(["", "-", "_"]) + rng.choice(["", number()])])
        elif style == 4:
            s = rng.choice("_-").join([date(), *parts[:3]] if rng.random() < 0.5 else [*parts[:3], date()])
        else:
            s = rng.choice("_-").join(p.upper() for p in parts) + rng.choice(["", "_" + number()])
        out.append(s)
    return out


def ordinary_sample(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", rows: int = 300, per_row: int = 200) -> list[str]:
    """Labelled sample of ordinary strings: words of letters from at most `rows` documents, at most `per_row` of each, chosen
    from the whole text by a hash, and identifiers made of them. Only about twice as many documents are drawn."""
    known = docs.where(F.col(quoted(text_col)).isNotNull())
    n = known.count()
    if not n:
        return []
    words = F.regexp_extract_all(F.col(quoted(text_col)), F.lit(r"(?<![A-Za-z0-9+/_=-])[A-Za-z][A-Za-z_-]{3,}(?![A-Za-z0-9+/_=-])"), F.lit(0))
    chosen = F.slice(F.array_sort(F.transform(F.array_distinct(words), lambda w: F.struct(F.xxhash64(w, F.lit(10)).alias("h"), w.alias("w")))), 1, per_row)
    drawn = known.where(draw(10, id_col) < min(1.0, 2 * rows / n + 50 / n))
    picked = drawn.select(F.xxhash64(F.col(quoted(id_col)), F.lit(10)).alias("h"), F.transform(chosen, lambda x: x["w"]).alias("w")).orderBy("h", "w").limit(rows).collect()
    found = [w for r in picked for w in r["w"]]
    return found + identifiers(found)


def scan(docs: DataFrame, model: RandomnessModel, *, text_col: str = "text", keep: list[str | Column] = ("doc_id",), redact: bool = False) -> DataFrame:
    """`keep` columns with n_assign, n_access, n_hex, base_sha256, spans (kind:start:end by start, then kind) and, if asked
    for, redacted (the text with its secrets masked; null stays null).

    Null and empty texts hold none; texts of any length are searched whole. Repeated rows are scanned each, empty tables give
    no rows. Columns to keep may have any names, those of helpers too; the ones named like an added column are left out, so
    pack them in a struct to carry all.
    """
    kept, fields = carried(docs, keep, ADDED, F.col(quoted(text_col)))
    m = len(fields)
    added = [*[StructField(f"n_{k}", LongType()) for k in KINDS[:3]], StructField("base_sha256", StringType()), StructField("spans", StringType())]
    schema = StructType([*fields, *added, *[StructField("redacted", StringType())] * redact])
    none = hashlib.sha256(b"").hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            counts, sha, spans = np.zeros((3, n), np.int64), [none] * n, [""] * n
            column = batch.column(m)
            clean = column.to_pylist() if redact else None
            for lo, _, data, offsets in pieces(column):
                for k in suspects(data, offsets) if len(data) else ():
                    text = data[offsets[k] : offsets[k + 1]].tobytes().decode()
                    base = base_spans(text)
                    every = sorted(base + model_spans(text, model, base), key=lambda s: (s[0], KINDS.index(s[2])))
                    if not every:
                        continue
                    for _, _, kind, _ in base:
                        counts[KINDS.index(kind), lo + k] += 1
                    sha[lo + k], spans[lo + k] = hashlib.sha256(written(base).encode()).hexdigest(), written(every)
                    if redact:
                        clean[lo + k] = redacted(text, every)
            out = [*batch.columns[:m], *[pa.array(c) for c in counts], pa.array(sha, pa.string()), pa.array(spans, pa.string())]
            yield pa.RecordBatch.from_arrays(out + ([pa.array(clean, pa.string())] if redact else []), names=[f.name for f in schema])
        tidy()

    return kept.mapInArrow(run, schema)
