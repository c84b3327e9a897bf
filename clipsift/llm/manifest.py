"""Operator 13: Merkle manifest of a dataset in an external node store.

A row's leaf is the hash of its fields. Leaves are numbered within their tree (a source) in order of id, and written as sorted
runs. Every `FAN` consecutive nodes become their parent until one is left, and the trees' roots, in order of the trees, likewise
give the root of the dataset.

Levels go to Parquet, one folder each, and each is read once for the next: nodes are dealt by blocks of FAN ** BAND consecutive
ones, a block is read in order and gives its part of BAND levels at once. So a level is never sorted again, a tree of any size
is shared among tasks, and a task holds one block. Proofs go the other way: from the top band down, a block's stored nodes are
merged by coordinate with its elements, and each element gets its siblings up to the block's top and, behind them, the proof of
that top.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clipsift.llm.common import cut, numbered, quoted

#: Nodes that become one, and levels of a block.
FAN, BAND = 3, 7
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: The number of the tree over the trees' roots.
TOP = -1
NODES = "tree long, level int, pos long, digest string"
STEPS = "array<struct<place:int,siblings:string>>"


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_digest(columns: list[Column]) -> Column:
    """Hash of fields: each as its number of UTF-8 bytes, a colon and its value, or - if null."""
    texts = [c.cast("string") for c in columns]
    fields = [F.when(t.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts]
    return F.sha2(F.concat(*fields).cast("binary"), 256)


def height(n: Column) -> Column:
    """Levels above n nodes: the least h with FAN ** h >= n."""
    steps, size = [], 1
    while size < 2**63:
        steps.append((n > F.lit(size)).cast("int"))
        size *= FAN
    return sum(steps[1:], steps[0])


def grow(digests: list[str], levels: int) -> list[list[str]]:
    """The levels above consecutive nodes, at most so many."""
    out = []
    for _ in range(levels):
        digests = [digest("".join(digests[i : i + FAN])) for i in range(0, len(digests), FAN)]
        out.append(digests)
    return out


def fold(leaf: str, steps: list[tuple[int, str]]) -> str:
    """The root that a leaf and the siblings (place among them, their digests in a row) of every level lead to."""
    for place, siblings in steps:
        at = place * 64
        leaf = digest(siblings[:at] + leaf + siblings[at:])
    return leaf


def _in_order(batches: Iterator[pa.RecordBatch], names: tuple[str, ...]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(n).to_pylist() for n in names), strict=True)


def _flush(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[] for _ in schema], schema.types, strict=True)], schema=schema)


def _batched(rows: Iterator[tuple], schema: pa.Schema, size: int = 4096) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for r in rows:
        held.append(r)
        if len(held) == size:
            yield _flush(held, schema)
            held = []
    if held:
        yield _flush(held, schema)


_NODES = pa.schema([("tree", pa.int64()), ("level", pa.int32()), ("pos", pa.int64()), ("digest", pa.string())])


def climb(elements: DataFrame, level: int, band: int) -> DataFrame:
    """The next `band` levels over nodes (tree, height, pos, digest) at a level, as NODES; each block in one read, in order."""
    width = FAN**band
    blocks = elements.where(F.col("height") > level).withColumn("block", F.floor(F.col("pos") / width).cast("long"))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def nodes() -> Iterator[tuple]:
            for (tree, block, top), rows in groupby(_in_order(batches, ("tree", "block", "height", "digest")), key=lambda r: r[:3]):
                for k, found in enumerate(grow([r[3] for r in rows], min(band, top - level)), 1):
                    begin = block * FAN ** (band - k)
                    yield from ((tree, level + k, begin + i, d) for i, d in enumerate(found))

        yield from _batched(nodes(), _NODES)

    return blocks.repartition("tree", "block").sortWithinPartitions("tree", "block", "pos").mapInArrow(build, NODES)


def _store(leaves: DataFrame, trees: DataFrame, top: int, folder: str, band: int) -> None:
    """Write the levels over leaves (tree, pos, digest) of trees (tree, height), each band read from the one before."""
    spark = leaves.sparkSession
    elements, level = leaves, 0
    while level < top:
        found = climb(elements.join(trees, "tree"), level, band)
        found.write.mode("append").partitionBy("level").parquet(folder)
        level += band
        elements = spark.read.schema(NODES).parquet(folder).where(F.col("level") == level).select("tree", "pos", "digest")


def _nodes(spark: SparkSession, folder: str, top: int) -> DataFrame:
    return spark.read.schema(NODES).parquet(folder) if top else spark.createDataFrame([], NODES)


class Manifest:
    """What `build` has written: leaves and trees, nodes of the trees and of the tree above them, and the root."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.folder, self.spark = folder, spark
        self.leaves, self.trees = spark.read.parquet(f"{folder}/leaves"), spark.read.parquet(f"{folder}/trees")
        row = self.trees.agg(F.max("height").alias("top"), F.count(F.lit(1)).alias("n")).select("top", "n", height(F.col("n")).alias("above")).first()
        self.top, self.n_trees, self.above = row["top"] or 0, row["n"], row["above"]

    def nodes(self) -> DataFrame:
        return _nodes(self.spark, f"{self.folder}/nodes", self.top)

    def upper(self) -> DataFrame:
        return _nodes(self.spark, f"{self.folder}/upper", self.above)

    def subroots(self) -> DataFrame:
        """(tree, digest): the node at the height of each tree."""
        high = self.nodes().join(self.trees.select("tree", "height"), "tree").where(F.col("level") == F.col("height"))
        alone = self.leaves.join(self.trees.where("height = 0"), "tree", "left_semi")
        return high.select("tree", "digest").unionByName(alone.select("tree", F.col("leaf").alias("digest")))

    def root(self) -> str | None:
        """The root; None for an empty dataset."""
        if not self.n_trees:
            return None
        if not self.above:
            return self.subroots().first()["digest"]
        return self.upper().where(F.col("level") == self.above).first()["digest"]


def build(docs: DataFrame, folder: str, *, fields: tuple[str, ...] = FIELDS, id_col: str = "doc_id", tree_col: str = "source", claim: Column | None = None, band: int = BAND) -> Manifest:
    """Write the node store of docs to a new folder that all executors reach, and give the manifest.

    Leaves of a tree ascend by id (null first) and, where ids repeat, by digest; trees ascend by name (null first, by UTF-8
    bytes). `claim` is a further digest of each row, to be audited against the store. Null fields have a form of their own;
    texts of any length count whole; repeated rows are leaves of their own; an empty table has no root.
    """
    spark = docs.sparkSession
    col = lambda c: F.col(quoted(c))
    own = leaf_digest([col(c) for c in fields])
    rows = docs.select(col(id_col).cast("long").alias("doc_id"), col(tree_col).cast("string").alias("name"), own.alias("leaf"), (own if claim is None else claim).alias("claim"))
    placed = numbered(rows, "name", [F.col("doc_id").asc_nulls_first(), F.col("leaf").asc()])
    sizes = cut(placed.groupBy("name").agg(F.count(F.lit(1)).alias("n")))
    trees = numbered(sizes.withColumn("all", F.lit(0)), "all", [F.col("name").asc_nulls_first()], name="tree")
    trees.select("tree", "name", "n", height(F.col("n")).alias("height")).write.parquet(f"{folder}/trees")
    trees = spark.read.parquet(f"{folder}/trees")
    named = trees.select(F.col("name").alias("_name"), "tree")
    placed.join(named, F.col("name").eqNullSafe(F.col("_name"))).select("tree", "pos", "doc_id", "leaf", "claim").write.parquet(f"{folder}/leaves")
    made = Manifest(spark, folder)
    _store(made.leaves.select("tree", "pos", F.col("leaf").alias("digest")), trees.select("tree", "height"), made.top, f"{folder}/nodes", band)
    if made.above:
        whole = spark.createDataFrame([(TOP, made.above)], "tree long, height int")
        _store(made.subroots().select(F.lit(TOP).cast("long").alias("tree"), F.col("tree").alias("pos"), "digest"), whole, made.above, f"{folder}/upper", band)
    return made


def _merged(elements: DataFrame, nodes: DataFrame, tails: DataFrame, level: int, band: int, extra: list[str], finish: Callable, schema: str, fields: pa.Schema) -> DataFrame:
    """Merge, block by block and in order of coordinates, the proof of the block's top (tails: tree, block, subroot, steps), the
    stored nodes of its levels, and its elements (tree, height, pos, digest and `extra`), which come in order and so with their
    siblings one after another. Each element with its steps goes through `finish`."""
    width = FAN**band
    null = lambda t: F.lit(None).cast(t)
    kinds = dict(elements.dtypes)
    blank = [null(kinds[c]).alias(c) for c in extra]
    parts = [
        tails.select("tree", "block", F.lit(0).alias("kind"), null("int").alias("height"), F.lit(0).alias("level"), F.lit(0).cast("long").alias("pos"), F.col("subroot").alias("digest"), "steps", *blank),
        nodes.where((F.col("level") > level) & (F.col("level") < level + band)).withColumn("_w", F.pow(F.lit(float(FAN)), F.lit(level + band) - F.col("level")))
        .select("tree", F.floor(F.col("pos") / F.col("_w")).cast("long").alias("block"), F.lit(1).alias("kind"), null("int").alias("height"), "level", "pos", "digest", null(STEPS).alias("steps"), *blank),
        elements.select("tree", F.floor(F.col("pos") / width).cast("long").alias("block"), F.lit(2).alias("kind"), "height", F.lit(level).alias("level"), "pos", "digest", null(STEPS).alias("steps"), *extra),
    ]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2])
    names = ("tree", "block", "kind", "height", "level", "pos", "digest", "steps", *extra)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> Iterator[tuple]:
            for (_, block), found in groupby(_in_order(batches, names), key=lambda r: r[:2]):
                above: dict[int, list[str]] = {}
                subroot, tail, known = None, [], {}

                def steps(k: int, at: int, row: list[str], block: int = block, above: dict = above, known: dict = known) -> list:
                    """Steps from a node `k` levels above the elements, at place `at` of its block's level, upwards; row: its run."""
                    place = at % FAN
                    first = (place, "".join(row[:place] + row[place + 1 :]))
                    parent = at // FAN
                    if k + 1 >= rise:
                        return [first, *tail]
                    if known.get(k, (None,))[0] != parent:
                        line = above[k + 1]
                        begin = parent - parent % FAN
                        known[k] = (parent, steps(k + 1, parent, line[begin : begin + FAN]))
                    return [first, *known[k][1]]

                for kind, some in groupby(found, key=lambda r: r[2]):
                    if kind == 0:
                        r = next(some)
                        subroot, tail = r[6], [(s["place"], s["siblings"]) for s in r[7]]
                    elif kind == 1:
                        for r in some:
                            above.setdefault(r[4] - level, []).append(r[6])
                    else:
                        for _, run_ in groupby(some, key=lambda r: r[5] // FAN):
                            row = list(run_)
                            rise = min(band, row[0][3] - level)
                            digests = [r[6] for r in row]
                            for r in row:
                                yield finish(r, subroot, steps(0, r[5] - block * width, digests) if rise else tail)

        yield from _batched(out(), fields, 1024)

    return rows.repartition("tree", "block").sortWithinPartitions("tree", "block", "kind", "level", "pos").mapInArrow(run, schema)


_STEP = pa.list_(pa.struct([("place", pa.int32()), ("siblings", pa.string())]))
_TAIL = "tree long, block long, subroot string, steps " + STEPS
_TAILS = pa.schema([("tree", pa.int64()), ("block", pa.int64()), ("subroot", pa.string()), ("steps", _STEP)])


def _as_tail(r: tuple, subroot: str, steps: list) -> tuple:
    return r[0], r[5], subroot, [{"place": p, "siblings": s} for p, s in steps]


def _descend(elements: DataFrame, sized: DataFrame, nodes: DataFrame, ends: DataFrame, top: int, band: int, extra: list[str], finish: Callable, schema: str, fields: pa.Schema) -> DataFrame:
    """Proofs of elements (tree, height, pos, digest) of trees (tree, height): bands from the top down. ends: (tree, subroot,
    steps) behind each tree's root."""
    levels = list(range(0, max(top, 1), band))
    tails = None
    for level in reversed(levels):
        last = (F.col("height") <= level + band) & ((F.col("height") > level) | F.lit(level == 0))
        own = ends.join(sized, "tree").where(last).select("tree", F.lit(0).cast("long").alias("block"), "subroot", "steps")
        tails = own if tails is None else own.unionByName(tails)
        if level:
            at = nodes.where(F.col("level") == level).join(sized, "tree").where(F.col("height") > level)
            tails = cut(_merged(at.select("tree", "height", "pos", "digest"), nodes, tails, level, band, [], _as_tail, _TAIL, _TAILS))
        else:
            return _merged(elements, nodes, tails, level, band, extra, finish, schema, fields)
    raise AssertionError


def prove(made: Manifest, band: int = BAND, steps: bool = False) -> DataFrame:
    """One row a leaf: doc_id, leaf, subroot, root, proof_sha256 (hash of all siblings in a row, level by level, left to right),
    folded_root (from the claimed leaf and the siblings), verified (whether that is the root) and, if asked for, steps: of each
    level the place among the siblings, and these. `band` must be that of the store."""
    root = made.root()
    if root is None:
        return made.leaves.select("doc_id", "leaf", F.lit(None).cast("string").alias("subroot"), *[F.lit(None).cast("string").alias(c) for c in ("root", "proof_sha256", "folded_root")], F.lit(None).cast("boolean").alias("verified"))
    subroots = made.subroots()
    if made.above:
        whole = made.spark.createDataFrame([(TOP, root, [])], f"tree long, subroot string, steps {STEPS}")
        tops = subroots.select(F.lit(TOP).cast("long").alias("tree"), F.lit(made.above).alias("height"), F.col("tree").alias("pos"), "digest")
        ends = _descend(tops, made.spark.createDataFrame([(TOP, made.above)], "tree long, height int"), made.upper(), whole, made.above, band, [], _as_end, _TAIL, _TAILS)
        ends = cut(ends.select(F.col("block").alias("tree"), "subroot", "steps"))
    else:
        ends = subroots.select("tree", F.col("digest").alias("subroot"), F.array().cast(STEPS).alias("steps"))

    def finish(r: tuple, subroot: str, path: list) -> tuple:
        doc_id, claim = r[8:]
        folded = fold(claim, path)
        return (doc_id, r[6], subroot, root, digest("".join(s for _, s in path)), folded, folded == root, *([[{"place": p, "siblings": s} for p, s in path]] if steps else []))

    kinds = [("doc_id", pa.int64()), *[(c, pa.string()) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")], ("verified", pa.bool_())]
    schema = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean" + f", steps {STEPS}" * steps
    elements = made.leaves.join(made.trees.select("tree", "height"), "tree").select("tree", "height", "pos", F.col("leaf").alias("digest"), "doc_id", "claim")
    return _descend(elements, made.trees.select("tree", "height"), made.nodes(), ends, made.top, band, ["doc_id", "claim"], finish, schema, pa.schema(kinds + [("steps", _STEP)] * steps))


def _as_end(r: tuple, subroot: str, steps: list) -> tuple:
    """Of the tree above: an element is a tree's root."""
    return r[0], r[5], r[6], [{"place": p, "siblings": s} for p, s in steps]
