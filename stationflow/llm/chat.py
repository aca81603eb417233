"""Reply trees to training conversations.

Messages name the message they answer. Self-joins that double their reach each round (node to ancestor
at 1, 2, 4, ... steps) give every message its depth and the score of the path above it; the leaves of a
tree are ranked by their path's mean score, and the same joins list the messages of the chosen paths.
Each path becomes one conversation: turns are marked by a template, and control strings inside texts are
escaped so that the texts can be read back exactly.

Long conversations are written as several rows of ``SEGMENT`` turns; a reader walks them in order, so
neither side ever holds a whole conversation.

Edge cases: null roles and texts count as empty; a message whose parent is null or unknown is a root;
messages on a cycle of parents reach no root and are left out; repeated message ids are one message (the
least row); conversations without messages give no rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stage

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
SEGMENT = 256
# Turns are numbered by ranges of 2 to the power of this many.
RANGE_BITS = 16
_TURN = re.compile(r"<\|im_start\|>(.*?)\n(.*?)<\|im_end\|>\n", re.DOTALL)
_ESCAPED = re.compile(r"<(\\*)\\\|")


def escape(text: Column) -> Column:
    """``<|`` becomes ``<\\|``; what already looks escaped gets one more backslash."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: f"<{m[1]}|", text)


def escape_role(role: Column) -> Column:
    """The role stands on one line: backslash and line feed are written as two characters."""
    return F.replace(F.replace(escape(role), F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: str) -> str:
    return unescape(re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], role))


def reply_chain(conversations: DataFrame) -> DataFrame:
    """Messages of plain conversations: each turn answers the one before it, rows that repeat a turn in text order.

    The rows of one turn are sorted in one task, a whole conversation is not.
    """
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                                F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    # Counts per turn, then per range of turns, of ranges and so on; a range holds at most 1 << RANGE_BITS.
    level = rows.groupBy("conv_id", "turn").agg(F.count(F.lit(1)).alias("n")).withColumnRenamed("turn", "at")
    levels = []
    for k in range(-(-64 // RANGE_BITS)):
        # The last level's range is the whole conversation.
        up = F.shiftright("at", RANGE_BITS) if (k + 1) * RANGE_BITS < 64 else F.lit(0).cast("long")
        level = level.withColumn("up", up)
        before = Window.partitionBy("conv_id", "up").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
        levels.append(level.withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0))).select("conv_id", "at", "up", "offset"))
        level = level.groupBy("conv_id", "up").agg(F.sum("n").alias("n")).withColumnRenamed("up", "at")
    offsets = levels.pop()
    while levels:
        above = offsets.select(F.col("conv_id").alias("c"), F.col("at").alias("a"), F.col("offset").alias("more"))
        below = levels.pop()
        offsets = (below.join(above, below["conv_id"].eqNullSafe(above["c"]) & below["up"].eqNullSafe(above["a"]))
                   .select("conv_id", "at", (F.col("offset") + F.col("more")).alias("offset")))
    offsets = offsets.select(F.col("conv_id").alias("c"), F.col("at").alias("a"), "offset")
    rows = rows.join(offsets, rows["conv_id"].eqNullSafe(offsets["c"]) & rows["turn"].eqNullSafe(offsets["a"])).drop("c", "a")
    within = Window.partitionBy("conv_id", "turn").orderBy("role", "text")
    return (rows.withColumn("msg_id", (F.col("offset") + F.row_number().over(within)).cast("long"))
            .select("conv_id", "msg_id", F.when(F.col("msg_id") > 1, F.col("msg_id") - 1).alias("parent_id"), "role", "text",
                    F.lit(0.0).alias("score")))


def best_paths(messages: DataFrame, branches: int = 1) -> DataFrame:
    """conv_id, path (its leaf), rank, position (from 1), role, text of the ``branches`` best paths per conversation."""
    least = F.min(F.struct("parent_id", F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("role", F.lit("")).alias("role"),
                           F.coalesce("text", F.lit("")).alias("text")))
    nodes = stage(messages.where("conv_id IS NOT NULL AND msg_id IS NOT NULL").groupBy("conv_id", "msg_id")
                  .agg(least.alias("m")).select("conv_id", "msg_id", "m.*"), "messages")
    ids = nodes.select("conv_id", F.col("msg_id").alias("parent_id"), F.lit(True).alias("known"))
    reach = stage(nodes.join(ids, ["conv_id", "parent_id"], "left").select(
        "conv_id", "msg_id", F.when(F.col("known"), F.col("parent_id")).alias("up"), "score", F.lit(1).cast("long").alias("length")), "reach")
    jumps = []
    left = reach.where("up IS NOT NULL").count()
    total = nodes.count()
    while left and 1 << len(jumps) <= total:
        jumps.append(reach)
        above = reach.select("conv_id", F.col("msg_id").alias("up"), F.col("up").alias("next"),
                             F.col("score").alias("more"), F.col("length").alias("steps"))
        # Messages that have reached their root stay as they are.
        further = reach.where("up IS NOT NULL").join(above, ["conv_id", "up"]).select(
            "conv_id", "msg_id", F.col("next").alias("up"), (F.col("score") + F.col("more")).alias("score"),
            (F.col("length") + F.col("steps")).alias("length"))
        reach = stage(further.unionByName(reach.where("up IS NULL")), "reach")
        left = reach.where("up IS NOT NULL").count()
    parents = nodes.select("conv_id", F.col("parent_id").alias("msg_id")).where("msg_id IS NOT NULL").distinct()
    order = Window.partitionBy("conv_id").orderBy((F.col("score") / F.col("length")).desc(), F.col("length").desc(), "msg_id")
    chosen = (reach.where("up IS NULL").join(parents, ["conv_id", "msg_id"], "left_anti")
              .withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= branches))
    path = stage(chosen.select("conv_id", F.col("msg_id").alias("path"), "rank", "msg_id", F.col("length").alias("position")), "paths")
    for k, step in enumerate(jumps):
        above = path.join(step.where("up IS NOT NULL").select("conv_id", "msg_id", "up"), ["conv_id", "msg_id"])
        path = stage(path.unionByName(above.select("conv_id", "path", "rank", F.col("up").alias("msg_id"),
                                                   (F.col("position") - (1 << k)).alias("position"))), "paths")
    return path.join(nodes.select("conv_id", "msg_id", "role", "text"), ["conv_id", "msg_id"]).drop("msg_id")


def format_paths(paths: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """conv_id, path, rank, segment, formatted, loss (start and end code points of trained texts in ``formatted``)."""
    head = F.concat(F.lit(OPEN), escape_role(F.col("role")), F.lit("\n"))
    body = escape(F.col("text"))
    piece = F.struct("position", F.concat(head, body, F.lit(CLOSE + "\n")).alias("piece"), F.length(head).alias("head"),
                     F.length(body).alias("body"), (F.col("role") == trained_role).alias("trained"))
    rows = (paths.withColumn("segment", F.floor((F.col("position") - 1) / SEGMENT))
            .groupBy("conv_id", "path", "rank", "segment").agg(F.array_sort(F.collect_list(piece)).alias("turns")))
    zero = F.expr("named_struct('at', 0, 'spans', CAST(array() AS array<struct<start: int, end: int>>))")
    loss = F.aggregate("turns", zero, lambda a, t: F.struct(
        (a["at"] + F.length(t["piece"])).alias("at"),
        F.when(t["trained"], F.array_append(a["spans"], F.struct((a["at"] + t["head"]).alias("start"), (a["at"] + t["head"] + t["body"]).alias("end"))))
        .otherwise(a["spans"]).alias("spans")), lambda a: a["spans"])
    return rows.select("conv_id", "path", "rank", "segment", F.array_join("turns.piece", "").alias("formatted"), loss.alias("loss"))


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted conversation."""
    turns, at = [], 0
    for m in _TURN.finditer(formatted):
        if m.start() != at:
            raise ValueError("text outside of a turn")
        turns.append((unescape_role(m[1]), unescape(m[2])))
        at = m.end()
    if at != len(formatted):
        raise ValueError("text outside of a turn")
    return turns


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Walks segments in order and keeps running digests of the conversation at hand only."""
    names = ["conv_id", "path", "rank", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    key, state = None, None

    def closed():
        turns, loss, n, lost, chars = state
        return [*key, n, turns.hexdigest(), lost, loss.hexdigest(), chars]

    def batch_of(done):
        return pa.RecordBatch.from_arrays(
            [pa.array(c, pa.string() if name.endswith("sha256") else pa.int64()) for name, c in zip(names, zip(*done))], names)

    for batch in batches:
        done = []
        columns = [batch.column(c).to_pylist() for c in ("conv_id", "path", "rank", "formatted", "loss")]
        for conv, path, rank, text, spans in zip(*columns):
            if key != (conv, path, rank):
                if key is not None:
                    done.append(closed())
                key, state = (conv, path, rank), [hashlib.sha256(), hashlib.sha256(), 0, 0, 0]
            for role, said in parse(text):
                state[0].update(f"{role}\n{said}\n".encode())
                state[2] += 1
            for s in spans:
                trained = unescape(text[s["start"]:s["end"]])
                state[1].update(trained.encode())
                state[3] += len(trained)
            state[4] += len(text)
        if done:
            yield batch_of(done)
    if key is not None:
        yield batch_of([closed()])


def digests(written: DataFrame) -> DataFrame:
    """Per formatted conversation, from its segments: turns, digests of turns and of trained texts, size."""
    ordered = written.repartition("conv_id", "path").sortWithinPartitions("conv_id", "path", "rank", "segment")
    return ordered.mapInArrow(_digested, "conv_id long, path long, rank long, n_turns long, turns_sha256 string, "
                                         "loss_chars long, loss_sha256 string, formatted_chars long")
