"""Reply trees as chat conversations, with DataFrame operations alone.

Messages name their parent. Pointer doubling (a self-join per power of two)
finds each message's root, depth and score along its path, the best branches of
each tree are ranked, and the same jumps taken from the largest down list the
messages of the chosen branches. A tree of depth d takes about 2 log2(d) joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from historymine.llm.common import stored

# The control strings of the template. A turn is START role MIDDLE text END.
START, MIDDLE, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
LEARNED = "assistant"  # the role whose texts are under the loss mask


def escaped(text: Column) -> Column:
    r"""Breaks up control strings: ``\`` becomes ``\\`` and ``<|`` becomes ``<\|``."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _climb(nodes: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """``(node, root, depth, total)`` of all nodes, and the jump tables ``(node, far)`` of 1, 2, 4, ... steps up.

    A node that has reached its root is set aside, so a round joins only the
    nodes deeper than its step, and a few deep trees cost the others nothing.
    """
    at = stored(nodes.select("node", F.col("parent").alias("far"), F.lit(0).cast("bigint").alias("depth"), F.col("score").alias("total"), F.col("node").alias("root")), "chat-climb")
    settled, jumps = at.where("far is null"), []
    while True:
        climbing = at.where("far is not null")
        if climbing.isEmpty():
            return settled, jumps
        step = F.lit(1 << len(jumps))
        jumps.append(climbing.select("node", "far"))
        # The sum over 2**k messages, then over the next 2**k from the message after them.
        up = settled.unionByName(climbing).select(
            F.col("node").alias("far"), F.col("far").alias("farther"), F.col("depth").alias("more"), F.col("total").alias("above"), F.col("root").alias("root_above")
        )
        higher = climbing.join(up, "far").select(
            "node",
            F.col("farther").alias("far"),
            (F.col("more") + step).alias("depth"),
            (F.col("total") + F.col("above")).alias("total"),
            F.col("root_above").alias("root"),
        )
        at = stored(higher, "chat-climb")
        settled = settled.unionByName(at.where("far is null"))


def best_paths(messages: DataFrame, branches: int = 1, min_score: float | None = None) -> DataFrame:
    """``(path, depth, node, root, rank)``: the messages of the ``branches`` best branches of each tree.

    ``messages`` has ``(node, parent, score)``; ``node`` is unique, a parent that is null
    or missing makes a root, a null score counts as 0. A branch runs from the root
    to a leaf and scores the mean of its messages; ties go to the smaller leaf.
    ``path`` is the leaf.
    """
    nodes = messages.select("node", "parent", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    known = nodes.select(F.col("node").alias("parent"), F.lit(True).alias("known"))
    nodes = nodes.join(known, "parent", "left").select("node", F.when(F.col("known"), F.col("parent")).alias("parent"), "score")
    nodes = stored(nodes, "chat-messages")
    climbed, jumps = _climb(nodes)
    parents = nodes.where("parent is not null").select(F.col("parent").alias("node")).distinct()
    leaves = climbed.join(parents, "node", "left_anti").withColumn("mean", F.col("total") / (F.col("depth") + 1))
    if min_score is not None:
        leaves = leaves.where(F.col("mean") >= min_score)
    rank = F.row_number().over(Window.partitionBy("root").orderBy(F.desc("mean"), "node"))
    chosen = stored(leaves.withColumn("rank", rank).where(F.col("rank") <= branches).select(F.col("node").alias("path"), "node", "root", "rank", "depth"), "chat-chosen")
    # Each round adds what lies 2**k steps above all that was reached before; only new rows are written.
    reached = chosen
    for k in reversed(range(len(jumps))):
        higher = reached.join(jumps[k], "node").select("path", F.col("far").alias("node"), "root", "rank", (F.col("depth") - (1 << k)).alias("depth"))
        reached = reached.unionByName(stored(higher, "chat-path"))
    return reached


def format_paths(paths: DataFrame, messages: DataFrame) -> DataFrame:
    """``(path, root, rank, formatted, loss)`` from ``best_paths`` and ``messages (node, role, text)``.

    One string per path; ``loss`` lists the code points ``struct<start, end>`` (``end``
    exclusive) of the texts whose role is learned. Null roles and texts are empty.
    """
    said = messages.select("node", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = paths.join(said, "node")
    head = F.concat(F.lit(START), escaped(F.col("role")), F.lit(MIDDLE))
    turns = turns.withColumn("head", head).withColumn("piece", F.concat("head", escaped(F.col("text")), F.lit(END)))
    in_order = Window.partitionBy("path").orderBy("depth")
    end = F.sum(F.length("piece")).over(in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)).cast("int")
    placed = turns.withColumn("end", end)
    span = F.when(
        F.col("role") == LEARNED,
        F.struct((F.col("end") - F.length("piece") + F.length("head")).alias("start"), (F.col("end") - len(END)).alias("end")),
    )
    rows = F.array_sort(F.collect_list(F.struct("depth", "piece", span.alias("span"))))
    return (
        placed.groupBy("path", "root", "rank").agg(rows.alias("turns"))
        .select("path", "root", "rank", F.array_join("turns.piece", "").alias("formatted"), F.filter("turns.span", lambda s: s.isNotNull()).alias("loss"))
    )


def parsed(formatted: Column) -> Column:
    """``array<struct<role, text>>`` read back from a formatted conversation."""
    pieces = F.filter(F.split(formatted, F.lit(END.replace("|", r"\|"))), lambda p: p != "")
    return F.transform(
        pieces,
        lambda p: F.struct(
            unescaped(F.substring_index(F.substring(p, F.lit(len(START) + 1), F.length(p)), MIDDLE, 1)).alias("role"),
            unescaped(F.substring_index(p, MIDDLE, -1)).alias("text"),
        ),
    )


def learned_text(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped, with nothing between."""
    return F.array_join(F.transform(loss, lambda s: unescaped(F.substring(formatted, s["start"] + 1, s["end"] - s["start"]))), "")


def thread(turns: DataFrame) -> DataFrame:
    """``(node, parent, score, role, text, conv_id)``: each conversation as a tree without forks, in order of its turns.

    Turns of equal number follow by role, then text; null turns come first; rows
    with a null ``conv_id`` are one conversation.
    """
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))
    node = F.struct(F.col("conv_id").isNull().alias("lost"), F.coalesce("conv_id", F.lit(0).cast("bigint")).alias("conv"), F.col("place").alias("place"))
    above = F.struct(F.col("conv_id").isNull().alias("lost"), F.coalesce("conv_id", F.lit(0).cast("bigint")).alias("conv"), (F.col("place") - 1).alias("place"))
    numbered = turns.select(F.col("conv_id").cast("bigint").alias("conv_id"), "turn", "role", "text").withColumn("place", place)
    return numbered.select(node.alias("node"), F.when(F.col("place") > 1, above).alias("parent"), F.lit(1.0).alias("score"), "role", "text", "conv_id")


def format_conversations(turns: DataFrame) -> DataFrame:
    """``(conv_id, formatted, loss)`` per conversation of ``turns (conv_id, turn, role, text)``; other columns are ignored."""
    messages = stored(thread(turns), "chat-threads")
    formatted = format_paths(best_paths(messages), messages)
    return formatted.select(F.when(~F.col("root.lost"), F.col("root.conv")).alias("conv_id"), "formatted", "loss")
