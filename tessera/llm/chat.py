"""Chat formatting of reply trees.

Messages form trees by parent id. Root-to-leaf paths are enumerated by iterative self-joins in which each round doubles
the reach: a table of jumps (message to its ancestor 2^i above, with the scores and the number of messages in between) is joined with itself, so that depth d takes log2(d) rounds. Every branch is ranked by what its leaf has
added up on the way; only the chosen branches are then written out, by the same jumps. A round in which no message reaches its root ends this: what is left runs into a cycle. Branches are ranked by the mean score of their messages (a null score counts 0), ties to the
smaller leaf; the best ``top`` of each tree are formatted, one conversation each.

The template marks turns; control strings inside texts get a backslash in front of them and of the
backslashes before them, which reading back takes off again.

Defined results: null text or role is empty; a parent that is missing makes its child a root; messages on a cycle, or
whose ancestors run into one, have no root and are left out; of rows that repeat a message id the least by parent, tree, role, text
and score counts, messages without an id are left out; a branch whose messages name several trees is the least one's; rows of one turn are ordered by role and text, so repeats stay; an empty table gives an empty
table (but for added conversations); other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.common import discard, materialise, slices

CONTROL = r"</?s>|\[/?INST\]|<</?SYS>>|\[/?TURN\]|<\|"
_ESCAPE = re.compile(rf"(\\*)({CONTROL})")
_UNESCAPE = re.compile(rf"\\(\\*)({CONTROL})")
#: One turn of the output. A blank or line feed parts texts from marks, so a mark is never behind a backslash.
_TURN = re.compile(
    r"(?<!\\)(?:<<SYS>>\n(?P<system>.*?)\n(?<!\\)<</SYS>>\n|\[INST\] (?P<user>.*?) (?<!\\)\[/INST\]\n|<s> (?P<assistant>.*?) (?<!\\)</s>\n|\[TURN\](?P<role>.*?)\n(?<!\\)<\|(?P<other>.*?) (?<!\\)\[/TURN\]\n)",
    re.S,
)
_MARKS = {"system": ("<<SYS>>\n", "\n<</SYS>>\n"), "user": ("[INST] ", " [/INST]\n"), "assistant": ("<s> ", " </s>\n")}


def escape(text: str) -> str:
    return _ESCAPE.sub(r"\1\\\2", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1\2", text)


def format_turns(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The text and the spans under the loss mask: the assistants' texts."""
    out, spans, at = [], [], 0
    for role, text in turns:
        before, after = _MARKS.get(role) or (f"[TURN]{escape(role)}\n<|", " [/TURN]\n")
        body = escape(text)
        if role == "assistant":
            spans.append((at + len(before), at + len(before) + len(body)))
        out += [before, body, after]
        at += len(before) + len(body) + len(after)
    return "".join(out), spans


def parse_turns(formatted: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        kind = m.lastgroup
        out.append((unescape(m["role"]), unescape(m["other"])) if kind in ("role", "other") else (kind, unescape(m[kind])))
        at = m.end()
    return out


def tree_jumps(messages: DataFrame, max_rounds: int = 40) -> tuple[list[DataFrame], DataFrame]:
    """What each message of a tree jumps to, 1, 2, 4, ... messages up: tables (msg_id, up_id); and the leaves (leaf, tree, total, length) with what their ways to the root add up to. messages: (msg_id, parent_id, tree, score), ids unique.

    Sums are carried with the jumps, so no way is written out to rank it. Leaves whose way does not end at a root, as it runs into a cycle, are left out.
    """
    ids = messages.select("msg_id", "parent_id", "tree", F.coalesce("score", F.lit(0.0)).alias("total"), F.lit(1).cast("long").alias("length"))
    known = ids.select(F.col("msg_id").alias("_id"))
    # a parent that is no message is none
    held = ids.join(known, ids.parent_id == known._id, "left").select("msg_id", F.col("_id").alias("up_id"), "tree", "total", "length")
    now = materialise(held, "tree-jumps")
    parents = now.filter("up_id is not null").select(F.col("up_id").alias("_id")).distinct()
    leaves = materialise(now.join(parents, now.msg_id == parents._id, "left_anti").select(F.col("msg_id").alias("leaf")), "tree-leaves")
    # messages that have reached their root take no more part but as aims
    done, open_, levels = now.filter("up_id is null"), now.filter("up_id is not null"), []
    left = open_.count()
    while left and len(levels) < max_rounds:
        levels.append(open_.select("msg_id", "up_id"))
        above = open_.unionByName(done).select(F.col("msg_id").alias("_from"), F.col("up_id").alias("_up"), F.col("tree").alias("_tree"), F.col("total").alias("_total"), F.col("length").alias("_length"))
        met = open_.join(above, open_.up_id == above._from)
        met = materialise(met.select("msg_id", F.col("_up").alias("up_id"), F.least("tree", "_tree").alias("tree"), (F.col("total") + F.col("_total")).alias("total"), (F.col("length") + F.col("_length")).alias("length")), "tree-jumps")
        done, open_ = done.unionByName(met.filter("up_id is null")), met.filter("up_id is not null")
        before, left = left, open_.count()
        if left == before:  # a deeper tree would have a message of each depth
            break
    return levels, leaves.join(done, leaves.leaf == done.msg_id).select("leaf", "tree", "total", "length")


def tree_paths(leaves: DataFrame, jumps: list[DataFrame]) -> DataFrame:
    """(leaf, msg_id, up) for the messages on the way from each of these leaves to its root."""
    paths = leaves.select("leaf", F.col("leaf").alias("msg_id"), F.lit(0).cast("long").alias("up"))
    for i, level in enumerate(jumps):
        hops = level.select(F.col("msg_id").alias("_from"), "up_id")
        more = paths.join(hops, paths.msg_id == hops._from).select("leaf", F.col("up_id").alias("msg_id"), (F.col("up") + (1 << i)).alias("up"))
        longer = materialise(paths.unionByName(more), "tree-paths")
        if i:
            discard(paths)
        paths = longer
    return paths


def format_trees(messages: DataFrame, top: int = 1, unique: bool = False) -> DataFrame:
    """(tree, leaf, branch, formatted, loss_spans) of the best branches; messages: (tree, msg_id, parent_id, role, text, score). Branches are ranked by the mean score of their messages; only the chosen ones are written out."""
    if not unique:
        rest = F.min(F.struct("parent_id", "tree", "role", "text", "score")).alias("m")
        messages = materialise(messages.filter("msg_id is not null").groupBy("msg_id").agg(rest).select("msg_id", "m.*"), "tree-messages")
    jumps, leaves = tree_jumps(messages)
    best = W.partitionBy("tree").orderBy(F.desc(F.col("total") / F.col("length")), "leaf")
    ranked = materialise(leaves.withColumn("branch", F.row_number().over(best)).filter(F.col("branch") <= top), "tree-branches")
    paths = tree_paths(ranked, jumps)
    chosen = paths.join(ranked.select("leaf", "tree", "branch"), "leaf").join(messages.select("msg_id", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")), "msg_id")
    turns = chosen.groupBy("tree", "leaf", "branch").agg(F.sort_array(F.collect_list(F.struct((-F.col("up")).alias("at"), "role", "text"))).alias("turns"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for part in slices(batches):
            made = [format_turns([(t["role"], t["text"]) for t in turns]) for turns in part.column(3).to_pylist()]
            spans = [[{"start": a, "end": b} for a, b in s] for _, s in made]
            yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array([x for x, _ in made], pa.string()), pa.array(spans, kind)], ["tree", "leaf", "branch", "formatted", "loss_spans"])

    return turns.select("tree", "leaf", "branch", "turns").mapInArrow(run, f"tree long, leaf {dict(turns.dtypes)['leaf']}, branch int, formatted string, loss_spans array<struct<start:int,end:int>>")


def conversation_messages(conversations: DataFrame) -> DataFrame:
    """A conversation's rows by turn as a tree of one branch: each row replies to the one before it."""
    rows = conversations.select(F.col("conv_id").cast("long").alias("tree"), "turn", "role", "text")
    nth = F.row_number().over(W.partitionBy("tree").orderBy("turn", "role", "text"))
    numbered = rows.withColumn("_n", nth)
    named = numbered.select("tree", F.concat_ws(":", F.coalesce(F.col("tree").cast("string"), F.lit("-")), "_n").alias("msg_id"), F.when(F.col("_n") > 1, F.concat_ws(":", F.coalesce(F.col("tree").cast("string"), F.lit("-")), F.col("_n") - 1)).alias("parent_id"), "role", "text", F.lit(None).cast("double").alias("score"))
    return materialise(named, "chat-messages")


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def digest(formatted: DataFrame) -> DataFrame:
    """Reads formatted conversations back: turns from the template, loss text from the spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            rows = []
            for tree, text, spans in zip(*(c.to_pylist() for c in part.columns), strict=True):
                turns = parse_turns(text)
                loss = "".join(unescape(text[s["start"] : s["end"]]) for s in spans)
                whole = "".join(f"{r}\n{t}\n" for r, t in turns)
                rows.append((tree, len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
            types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], [x.split()[0] for x in DIGEST.split(", ")])

    return formatted.select("tree", "formatted", "loss_spans").mapInArrow(run, DIGEST)
