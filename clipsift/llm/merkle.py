"""Operator 8: document fingerprints from a Merkle tree over paragraphs and sections.

A text's paragraphs are its lines; a paragraph's leaves are its pieces of `PIECE` code points, so that an edit inside a
long paragraph still shows where it is. Leaf digests of 64 bits are hashed to the digest of their paragraph, those of
`SECTION` paragraphs in a row to that of a section, and sections to the root (`tree`): roots test equality, and `differences`
follows the branches that differ down to the edited pieces, place by place, and `edit` aligns the paragraphs' digests from both
ends, so that lines put in or taken out do not shift the rest. A `fingerprint` is a tree in short writing, from the digits of
each leaf; the share of common leaves is the likeness.

DataFrame functions only. Neighbours in order of id come from windows over ranges of ids cut at percentiles, so no task
sees more than a range; only the first row of each range is passed to the range before.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clipsift.llm.common import cut, quoted, spread, text_size

#: Code points of a piece, paragraphs of a section, hex digits of a leaf digest.
PIECE, SECTION, LEAF = 24, 8, 16


def leaves(text: Column) -> Column:
    """Array by paragraph of the arrays of the 64-bit digests of its pieces, in hex."""
    pieces = lambda p: F.regexp_extract_all(p, F.lit(rf"(?s).{{1,{PIECE}}}"), F.lit(0))
    return F.transform(F.split(text, "\n"), lambda p: F.transform(pieces(p), lambda x: F.substring(F.md5(x), 1, LEAF)))


def _sha(parts: Column, between: str) -> Column:
    return F.sha2(F.array_join(parts, between).cast("binary"), 256)


def _by_section(nodes: Column, digest: Callable[[Column], Column]) -> Column:
    """Of every SECTION nodes in a row, their digest."""
    return F.transform(F.sequence(F.lit(1), F.size(nodes), F.lit(SECTION)), lambda i: digest(F.slice(nodes, i, F.lit(SECTION))))


def tree(leaf: Column) -> Column:
    """Struct of root, sections, paragraphs and leaves: every node is hashed from the whole digests of its children."""
    paragraphs = F.transform(leaf, lambda p: _sha(p, ""))
    sections = _by_section(paragraphs, lambda x: _sha(x, ""))
    return F.struct(_sha(sections, "").alias("root"), sections.alias("sections"), paragraphs.alias("paragraphs"), leaf.alias("leaves"))


def differences(a: Column, b: Column) -> Column:
    """Where two trees differ: (section, paragraph, piece) from 0, of either text. Only branches whose digests differ are
    followed, so equal roots give an empty array at once."""

    def unlike(x: Column, y: Column, lo: Column, hi: Column) -> Column:
        """Positions from lo to hi at which two arrays differ; one that ends earlier differs."""
        differ = lambda i: ~F.get(x, i).eqNullSafe(F.get(y, i))
        return F.when(hi >= lo, F.filter(F.sequence(lo, hi), differ)).otherwise(F.array().cast("array<int>"))

    last = lambda x, y: F.greatest(F.size(x), F.size(y)) - 1
    none = F.array().cast("array<struct<section:int,paragraph:int,piece:int>>")
    sections = unlike(a["sections"], b["sections"], F.lit(0), last(a["sections"], b["sections"]))
    end = last(a["paragraphs"], b["paragraphs"])
    paragraphs = F.flatten(F.transform(sections, lambda s: unlike(a["paragraphs"], b["paragraphs"], s * SECTION, F.least(s * SECTION + SECTION - 1, end))))

    def pieces(p: Column) -> Column:
        x, y = (F.coalesce(F.get(t["leaves"], p), F.array().cast("array<string>")) for t in (a, b))
        found = unlike(x, y, F.lit(0), last(x, y))
        # A paragraph without pieces that only one text has.
        found = F.when(F.size(found) == 0, F.array(F.lit(0))).otherwise(found)
        return F.transform(found, lambda i: F.struct((p / SECTION).cast("int").alias("section"), p.cast("int").alias("paragraph"), i.cast("int").alias("piece")))

    return F.when(a["root"] == b["root"], none).otherwise(F.flatten(F.transform(paragraphs, pieces)))


def edit(a: Column, b: Column) -> Column:
    """Where b was edited from a, of two arrays of paragraph digests: struct of first (paragraphs in common at the beginning), end_a
    and end_b (where the paragraphs in common at the end begin, in a and b), n_new and n_gone (distinct paragraphs in between
    that only b, or only a, has). Equal arrays have first = end_a = end_b. In time of the paragraphs."""
    n = F.least(F.size(a), F.size(b))
    same = lambda x, y: F.coalesce(F.nullif(F.array_position(F.zip_with(x, y, lambda p, q: ~p.eqNullSafe(q)), F.lit(True)), F.lit(0)) - 1, n).cast("int")
    first = F.least(same(a, b), n)
    last = F.least(same(F.reverse(a), F.reverse(b)), n - first)
    inner = lambda x: F.slice(x, first + 1, F.size(x) - last - first)
    count = lambda x, y: F.size(F.array_except(inner(x), inner(y)))
    return F.struct(first.cast("long").alias("first"), (F.size(a) - last).cast("long").alias("end_a"), (F.size(b) - last).cast("long").alias("end_b"), count(b, a).cast("long").alias("n_new"), count(a, b).cast("long").alias("n_gone"))


def shortened(leaf: Column, digits: int) -> Column:
    """The first digits of every leaf digest."""
    return leaf if digits >= LEAF else F.transform(leaf, lambda p: F.transform(p, lambda x: F.substring(x, 1, digits)))


def joined(leaf: Column) -> Column:
    """The leaf digests of each paragraph one after another."""
    return F.transform(leaf, lambda p: F.array_join(p, ""))


def fingerprint(paragraphs: Column) -> Column:
    """root|sections|leaves in writing, of joined() leaves and from their digits; paragraphs are apart by dots."""
    parts = F.array_join(_by_section(paragraphs, lambda x: F.substring(_sha(x, "."), 1, 16)), ",")
    return F.concat(F.sha2(parts.cast("binary"), 256), F.lit("|"), parts, F.lit("|"), F.array_join(paragraphs, "."))


def likeness(a: Column, b: Column) -> Column:
    """Common leaf digests of two sets over those of the larger set; 1 if both are empty."""
    most = F.greatest(F.size(a), F.size(b))
    return F.when(most == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / most)


def _ranges(bounds: list[int], lo: int, hi: int) -> Column:
    """Number of the range that _id lies in, by halving: ranges lo .. hi are parted by bounds[lo:hi]."""
    if lo == hi:
        return F.lit(lo)
    mid = (lo + hi) // 2
    return F.when(F.col("_id") <= F.lit(bounds[mid]), _ranges(bounds, lo, mid)).otherwise(_ranges(bounds, mid + 1, hi))


def with_next(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", range_bytes: int = 2 << 20, most_ranges: int = 4096, most_passed: int = 64 << 20, hashed: bool = False) -> DataFrame:
    """(doc_id, text, next_text): the text of the next document, by descending id; after the last comes the first. With
    `hashed` also leaf and next_leaf, their leaf digests: every text is hashed once, in its range, and passed on with it.

    Null texts are empty; null ids come last; rows of equal id go by text. The number of ranges follows the bytes of text
    up to most_ranges, beyond which ranges grow and their windows spill. First texts of ranges are broadcast up to
    most_passed bytes, else joined by a shuffle.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    n_rows, n_bytes = text_size(rows, "_text")
    parts = min(most_ranges, spread(n_bytes, range_bytes))
    bounds = []
    if parts > 1:
        found = rows.agg(F.percentile_approx("_id", [i / parts for i in range(1, parts)], 100_000).alias("b")).first()["b"]
        bounds = sorted(set(found or []))
    rows = rows.withColumn("_range", F.when(F.col("_id").isNull(), F.lit(-1)).otherwise(_ranges(bounds, 0, len(bounds))))
    order = [F.col("_id").desc_nulls_last(), F.col("_text").asc()]
    within = Window.partitionBy("_range").orderBy(*order)
    # Of each range, the first row: the largest id and, of its rows, the smallest text.
    heads = F.broadcast(rows.groupBy("_range").agg(F.max("_id").alias("_top")))  # at most most_ranges + 1 rows of numbers
    first = cut(
        rows.join(heads.withColumnRenamed("_range", "_r"), (F.col("_range") == F.col("_r")) & F.col("_id").eqNullSafe(F.col("_top")))
        .groupBy("_range")
        .agg(F.min("_text").alias("_head"))
    )
    down = Window.orderBy(F.col("_range").desc())
    ring = first.select("_range").withColumn("_to", F.coalesce(F.lead("_range").over(down), F.max("_range").over(Window.partitionBy())))
    passed = ring.join(first.withColumnRenamed("_range", "_to"), "_to").select(F.col("_range").alias("_from"), "_head")
    if (first.agg(F.sum(F.octet_length("_head"))).first()[0] or 0) <= most_passed:
        passed = F.broadcast(passed)
    led = rows.repartition("_range")  # the shuffle of the windows: what is added from here on is not sent
    if hashed:
        led = led.withColumn("_leaf", leaves(F.col("_text"))).withColumn("_next_leaf", F.lead("_leaf").over(within))
    led = led.withColumn("_next", F.lead("_text").over(within)).withColumn("_last", F.lead(F.lit(1)).over(within).isNull())
    tail = F.when(F.col("_last"), F.col("_range"))
    out = led.join(passed, tail == F.col("_from"), "left")
    more = [F.col("_leaf").alias("leaf"), F.coalesce("_next_leaf", leaves(F.col("_head"))).alias("next_leaf")] if hashed else []
    return out.select(F.col("_id").alias("doc_id"), F.col("_text").alias("text"), F.coalesce("_next", "_head").alias("next_text"), *more)


def with_edited_leaves(rows: DataFrame) -> DataFrame:
    """Add edited_leaf, the leaves of `edited`, which begins with `head`, as the text of `leaf` does: whole pieces within the
    head are taken over, and only the rest is hashed, once."""
    open_ = F.length(F.substring_index("head", "\n", -1))  # of the paragraph that the head ends in
    paragraph = F.length("head") - F.length(F.replace(F.col("head"), F.lit("\n"), F.lit("")))
    rows = rows.withColumn("_open", open_).withColumn("_paragraph", paragraph).withColumn("_whole", F.floor(F.col("_open") / PIECE).cast("int"))
    begin = F.length("head") - F.col("_open") + F.col("_whole") * PIECE + 1
    rows = rows.withColumn("_rest", leaves(F.substring(F.col("edited"), begin, F.length("edited"))))
    seam = F.concat(F.slice(F.get("leaf", F.col("_paragraph")), F.lit(1), F.col("_whole")), F.get("_rest", F.lit(0)))
    whole = F.concat(F.slice("leaf", F.lit(1), F.col("_paragraph")), F.array(seam), F.slice("_rest", F.lit(2), F.size("_rest")))
    return rows.withColumn("edited_leaf", whole).drop("_open", "_paragraph", "_whole", "_rest")


def trees(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_chars, tree) of every document; map-only. Null texts are empty; empty tables give no rows."""
    text = F.coalesce(F.col(quoted(text_col)), F.lit(""))
    rows = docs.select(F.col(quoted(id_col)).alias("doc_id"), F.length(text).cast("long").alias("n_chars"), leaves(text).alias("leaf"))
    return rows.select("doc_id", "n_chars", tree(F.col("leaf")).alias("tree"))


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", digits: int = LEAF) -> DataFrame:
    """Every document's fingerprint, that of its edited text, and their likeness: doc_id, n_chars, edited_sha256,
    fingerprint, edited_fingerprint, near_edited, near_next; root, edited_root, next_root; and where the edit is: edit_first,
    edit_end (paragraphs of the text from 0, end exclusive), n_new, n_gone (see `edit`).

    The edited text has the last floor(n_chars / 3) code points replaced by the first as many (or all) of the next
    document's. Equal texts have equal fingerprints and roots, and equal roots mean equal texts: they are hashed from leaf
    digests of 64 bits. Fingerprints show, and likeness compares, the first `digits` of 16: with all, as here unless asked
    otherwise, equal fingerprints too mean equal texts. Null texts are empty and print alike; texts of any length count whole. Rows that
    repeat an id go by text. A single row is its own next document; empty tables give no rows; other columns, whatever
    their names, are ignored.
    """
    rows = with_next(docs, id_col=id_col, text_col=text_col, hashed=True)
    n = F.length("text")
    swapped = F.floor(n / 3).cast("int")
    rows = rows.withColumn("head", F.substring(F.col("text"), F.lit(1), n - swapped)).withColumn("n_chars", n.cast("long"))
    rows = rows.withColumn("edited", F.concat("head", F.substring(F.col("next_text"), F.lit(1), swapped)))
    rows = with_edited_leaves(rows)
    short = lambda c: shortened(F.col(c), digits)
    root = lambda c: tree(F.col(c))["root"]
    rows = rows.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        short("leaf").alias("_own"), short("edited_leaf").alias("_edited"), short("next_leaf").alias("_next"),
        root("leaf").alias("root"), root("edited_leaf").alias("edited_root"), root("next_leaf").alias("next_root"),
    )
    # Paragraphs by their joined leaf digests, which are as good as digests of these.
    prints = rows.select("*", *[f(F.col(f"_{c}")).alias(f"_{c}_{k}") for c in ("own", "edited", "next") for k, f in (("set", lambda x: F.array_distinct(F.flatten(x))), ("joined", joined))])
    prints = prints.withColumn("_edit", edit(F.col("_own_joined"), F.col("_edited_joined")))
    return prints.select(
        "doc_id", "n_chars", "edited_sha256", fingerprint(F.col("_own_joined")).alias("fingerprint"), fingerprint(F.col("_edited_joined")).alias("edited_fingerprint"),
        likeness(F.col("_own_set"), F.col("_edited_set")).alias("near_edited"), likeness(F.col("_own_set"), F.col("_next_set")).alias("near_next"),
        "root", "edited_root", "next_root", F.col("_edit.first").alias("edit_first"), F.col("_edit.end_a").alias("edit_end"), F.col("_edit.n_new").alias("n_new"), F.col("_edit.n_gone").alias("n_gone"),
    )
