"""Operator 12: reply trees as training conversations.

Messages reply to messages. Iterative self-joins enumerate the paths from the roots to the leaves: each round joins the table
with itself, so that every message knows the ancestor twice as far up, until all have met their root. Paths are ranked within
their conversation by the sum of the scores of their messages; only the chosen ones are written out, by the same joins in
reverse, and formatted as one conversation each. No round carries texts; their digests stand for them until the end.

The format of a turn is `### role: text</turn>` and a line feed. Backslash, a # before two others, </turn> and, in roles, the colon
get a backslash inside roles and texts, so control strings of theirs are never taken for the format's, and `read_back` gives
every role and text as it was. The loss mask covers what assistants say, without the marks around it.

A formatted conversation comes in parts of at most `part_chars` or one turn, most often a single one, so that one that holds a
large share of all rows is written and read by many tasks; only a digest over a whole conversation is one stream.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clipsift.llm.common import cut, numbered, quoted

#: One turn as `formatted` writes it; groups: role, text, both escaped.
TURN = re.compile(r"### ((?:[^\\:]+|\\.)*): ((?:[^\\<]+|\\.|<(?!/turn>))*)</turn>\n", re.DOTALL)
ASSISTANT = "assistant"
PARTS = "conv_id long, path long, part long, n_turns long, formatted string, loss array<struct<start:int,end:int>>"
TURNS = "conv_id long, path long, part long, at int, role string, text string, loss boolean"
DIGESTS = "conv_id long, path long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def escaped(text: Column, more: str = "") -> Column:
    """Control strings with a backslash in front; more: a further one."""
    return F.regexp_replace(text, rf"(\\|#(?=##)|</turn>{more})", r"\\$1")


def unescaped(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


def _message(role: Column, text: Column) -> list[Column]:
    """role, text (nulls are empty) and the digest of both that stands for them."""
    role, text = F.coalesce(role.cast("string"), F.lit("")), F.coalesce(text, F.lit(""))
    return [role.alias("role"), text.alias("text"), F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary")).alias("key")]


class Messages:
    """Messages numbered within their conversation: `tree` (conv_id, pos, parent, score, role, key), no texts, checkpointed; and
    `texts` (key, text)."""

    def __init__(self, tree: DataFrame, texts: DataFrame) -> None:
        self.tree, self.texts = cut(tree.select("conv_id", "pos", "parent", "score", "role", "key")), texts.select("key", "text")


def conversations(rows: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> Messages:
    """Plain conversations: each row replies to the one before, in order of turn (null last), then role, then a digest of both
    role and text. Null ids make one conversation."""
    col = lambda c: F.col(quoted(c))
    named = rows.select(col(conv_col).cast("long").alias("conv_id"), col(turn_col).cast("long").alias("turn"), *_message(col(role_col), col(text_col)))
    placed = numbered(named.drop("text"), "conv_id", [F.col("turn").asc_nulls_last(), F.col("role"), F.col("key")])
    parent = F.when(F.col("pos") > 0, F.col("pos") - 1)
    return Messages(placed.withColumns({"parent": parent, "score": F.lit(0.0)}), named)


def replies(rows: DataFrame, *, conv_col: str = "conv_id", node_col: str = "node", parent_col: str = "parent", role_col: str = "role", text_col: str = "text", score_col: str = "score") -> Messages:
    """Messages that name the message they reply to. One whose parent is null or not there begins a tree; null scores count 0.
    Of messages that repeat an id in a conversation, replies go to the first by role and digest; the others stay leaves."""
    col = lambda c: F.col(quoted(c))
    named = rows.select(col(conv_col).cast("long").alias("conv_id"), col(node_col).cast("string").alias("node"), col(parent_col).cast("string").alias("to"), F.coalesce(col(score_col).cast("double"), F.lit(0.0)).alias("score"), *_message(col(role_col), col(text_col)))
    placed = cut(numbered(named.drop("text"), "conv_id", [F.col("node").asc_nulls_last(), F.col("role"), F.col("key"), F.col("to"), F.col("score")]))
    firsts = placed.where("node is not null").groupBy(F.col("conv_id").alias("_conv"), F.col("node").alias("_node")).agg(F.min("pos").alias("parent"))
    joined = placed.join(firsts, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("to") == F.col("_node")), "left")
    return Messages(joined, named)


def _above(rows: DataFrame, to: str, of: DataFrame, names: dict[str, str]) -> DataFrame:
    """rows with columns of the message that column `to` names, under other names."""
    other = of.select(F.col("conv_id").alias("_conv"), F.col("pos").alias("_pos"), *[F.col(c).alias(n) for c, n in names.items()])
    return rows.join(other, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col(to) == F.col("_pos"))).drop("_conv", "_pos")


def paths(messages: Messages, keep: int | None = None) -> DataFrame:
    """(conv_id, path, rank, path_score, step, pos, role, key): the paths from root to leaf, the `keep` best of each conversation
    or all. A path is named by the place of its leaf; ranks go by the sum of scores, ties by that place.

    Messages on or behind a circle of replies have no root, and are in no path.
    """
    tree = messages.tree
    n = tree.count()
    # Of each message: the ancestor 2 ** k up, the messages before that one, and their scores.
    now = tree.select("conv_id", "pos", F.col("parent").alias("up"), F.lit(1).cast("long").alias("size"), F.col("score").alias("sum"))
    jumps = []
    while 2 ** len(jumps) <= 2 * n:
        open_ = now.where("up is not null")
        if open_.isEmpty():
            break
        jumps.append(open_.select("conv_id", "pos", "up"))
        further = _above(open_, "up", now, {"up": "_up", "size": "_size", "sum": "_sum"})
        further = further.select("conv_id", "pos", F.col("_up").alias("up"), (F.col("size") + F.col("_size")).alias("size"), (F.col("sum") + F.col("_sum")).alias("sum"))
        now = cut(further.unionByName(now.where("up is null")))
    parents = tree.where("parent is not null").select(F.col("conv_id").alias("_conv"), F.col("parent").alias("_pos")).distinct()
    leaves = now.where("up is null").join(parents, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("pos") == F.col("_pos")), "left_anti")
    ranked = numbered(leaves.select("conv_id", F.col("pos").alias("path"), "size", F.col("sum").alias("path_score")), "conv_id", [F.col("path_score").desc(), F.col("path").asc()], name="rank")
    if keep is not None:
        ranked = ranked.where(F.col("rank") < keep)
    found = cut(ranked.select("conv_id", "path", "rank", "path_score", "size", F.col("path").alias("pos"), F.lit(0).cast("long").alias("off")))
    for k in reversed(range(len(jumps))):
        more = _above(found.where(F.col("off") + 2**k < F.col("size")), "pos", jumps[k], {"up": "_up"})
        more = more.withColumns({"pos": F.col("_up"), "off": F.col("off") + 2**k}).drop("_up")
        found = cut(found.unionByName(more))
    steps = found.withColumn("step", F.col("size") - 1 - F.col("off"))
    return _above(steps, "pos", tree, {"role": "role", "key": "key"}).select("conv_id", "path", "rank", "path_score", "step", "pos", "role", "key")


_PARTS = pa.schema([("conv_id", pa.int64()), ("path", pa.int64()), ("part", pa.int64()), ("n_turns", pa.int64()), ("formatted", pa.string()), ("loss", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))])
_TURNS = pa.schema([("conv_id", pa.int64()), ("path", pa.int64()), ("part", pa.int64()), ("at", pa.int32()), ("role", pa.string()), ("text", pa.string()), ("loss", pa.bool_())])
_DIGESTS = pa.schema([("conv_id", pa.int64()), ("path", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def _rows(batches: Iterator[pa.RecordBatch], names: tuple[str, ...]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(n).to_pylist() for n in names), strict=True)


def _batched(rows: Iterator[tuple], schema: pa.Schema, chars: int, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Rows in batches of about `limit` characters of the column at `chars`, or 4096 rows."""
    held, size = [], 0
    flush = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)
    for r in rows:
        held.append(r)
        size += len(r[chars]) if isinstance(r[chars], str) else 0
        if size >= limit or len(held) == 4096:
            yield flush()
            held, size = [], 0
    if held:
        yield flush()


def _write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Turns in order of (conv_id, path, part, step), joined to parts with the places of the loss mask."""

    def parts() -> Iterator[tuple]:
        for key, turns in groupby(_rows(batches, ("conv_id", "path", "part", "piece", "lead", "body", "learn")), key=lambda r: r[:3]):
            at, pieces, loss = 0, [], []
            for _, _, _, piece, lead, body, learn in turns:
                if learn:
                    loss.append({"start": at + lead, "end": at + lead + body})
                pieces.append(piece)
                at += len(piece)
            yield *key, len(pieces), "".join(pieces), loss

    yield from _batched(parts(), _PARTS, 4)


def formatted(messages: Messages, chosen: DataFrame, *, learn: str = ASSISTANT, part_chars: int = 4 << 20) -> DataFrame:
    """The chosen paths as text: conv_id, path, part (from 0, in order), n_turns, formatted, loss (start and end of what is to be
    learnt, in code points of the part). A part ends with a turn."""
    texts = messages.texts.groupBy("key").agg(F.first("text").alias("text"))  # equal messages are one
    head = F.concat(F.lit("### "), escaped(F.col("role"), "|:"), F.lit(": "))
    turns = chosen.join(texts, "key").select("conv_id", "path", "step", (F.col("role") == learn).alias("learn"), head.alias("head"), escaped(F.col("text")).alias("said"))
    turns = turns.select("conv_id", "path", "step", "learn", F.concat("head", "said", F.lit("</turn>\n")).alias("piece"), F.length("head").alias("lead"), F.length("said").alias("body"))
    # Paths over part_chars are cut every so many turns that the longest of them would fit.
    long = chosen.join(messages.texts.groupBy("key").agg(F.first(F.length("text")).alias("chars")), "key").withColumn("chars", 2 * (F.col("chars") + F.length("role")) + 16)
    long = long.groupBy("conv_id", "path").agg(F.sum("chars").alias("all"), F.max("chars").alias("most")).where(F.col("all") > part_chars)
    long = long.select(F.col("conv_id").alias("_conv"), F.col("path").alias("_path"), F.greatest(F.lit(1), F.floor(F.lit(part_chars) / F.col("most"))).alias("_per"))
    turns = turns.join(long, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("path") == F.col("_path")), "left")
    turns = turns.withColumn("part", F.coalesce(F.floor(F.col("step") / F.col("_per")), F.lit(0)).cast("long")).drop("_conv", "_path", "_per")
    return turns.repartition("conv_id", "path", "part").sortWithinPartitions("conv_id", "path", "part", "step").mapInArrow(_write, PARTS)


def parsed(text: str) -> list[tuple[str, str, int, int]]:
    """(role, text, where the text begins, where it ends) of every turn; ValueError if anything else is there."""
    out, at = [], 0
    for m in TURN.finditer(text):
        if m.start() != at:
            break
        out.append((unescaped(m[1]), unescaped(m[2]), m.start(2), m.end(2)))
        at = m.end()
    if at != len(text):
        raise ValueError(f"not a formatted conversation from character {at} on")
    return out


def read_back(parts: DataFrame) -> DataFrame:
    """The turns of formatted parts: conv_id, path, part, at (from 0 in the part), role, text, loss (whether the mask covers it)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def turns() -> Iterator[tuple]:
            for conv, path, part, text, loss in _rows(batches, ("conv_id", "path", "part", "formatted", "loss")):
                masked = {(s["start"], s["end"]) for s in loss}
                for i, (role, said, begin, end) in enumerate(parsed(text)):
                    yield conv, path, part, i, role, said, (begin, end) in masked

        yield from _batched(turns(), _TURNS, 5)

    return parts.mapInArrow(read, TURNS)


def digests(parts: DataFrame) -> DataFrame:
    """Of every formatted conversation, read back from its parts in order: n_turns, turns_sha256 (of role, line feed, text, line
    feed of each turn), loss_chars and loss_sha256 (of the text under the mask, without escapes), formatted_chars."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> Iterator[tuple]:
            for key, some in groupby(_rows(batches, ("conv_id", "path", "formatted", "loss")), key=lambda r: r[:2]):
                turns, learnt = hashlib.sha256(), hashlib.sha256()
                n = n_loss = n_chars = 0
                for _, _, text, loss in some:
                    n_chars += len(text)
                    for role, said, _, _ in parsed(text):
                        turns.update(f"{role}\n{said}\n".encode())
                        n += 1
                    for span in loss:
                        said = unescaped(text[span["start"] : span["end"]])
                        learnt.update(said.encode())
                        n_loss += len(said)
                yield *key, n, turns.hexdigest(), n_loss, learnt.hexdigest(), n_chars

        yield from _batched(out(), _DIGESTS, 0)

    return parts.select("conv_id", "path", "part", "formatted", "loss").repartition("conv_id", "path").sortWithinPartitions("conv_id", "path", "part").mapInArrow(read, DIGESTS)
