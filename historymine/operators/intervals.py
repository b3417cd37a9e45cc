"""A history of trees as intervals: which content a path had from which commit to which.

A row per change instead of a row per commit and file. Intervals of a path do not
overlap; ``first_seq`` and ``last_seq`` are both inclusive.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from historymine.functions.ordinals import running_totals
from historymine.functions.scalars import has_suffix
from historymine.operators.history import ADDED, DELETED, MODIFIED, UNCHANGED

COMMITS_PER_BLOCK = 1024  # a path's changes are ordered block by block


def tree_intervals(changes: DataFrame, commits: DataFrame) -> DataFrame:
    """``(path, hash, first_seq, last_seq)`` from the changes of ``snapshot_diff`` over ``commits``.

    An interval ends before the next change of its path. That one is looked for among
    the path's changes of the same block of commits, and if there is none, among the
    first changes of its later blocks; so no window holds a path's whole life.
    """
    block = F.expr(f"seq div {COMMITS_PER_BLOCK}")
    moved = changes.where(F.col("kind") != UNCHANGED).select("path", "seq", "hash", block.alias("_block"))
    near = moved.withColumn("_next", F.lead("seq").over(Window.partitionBy("path", "_block").orderBy("seq")))
    first = moved.groupBy("path", "_block").agg(F.min("seq").alias("_first"))
    later = first.select("path", "_block", F.lead("_first").over(Window.partitionBy("path").orderBy("_block")).alias("_later"))
    last = commits.agg(F.max("seq").alias("last")).scalar()
    ended = near.join(later.where("_later IS NOT NULL"), ["path", "_block"], "left")
    until = F.coalesce(F.coalesce("_next", "_later") - 1, last)
    return ended.where("hash IS NOT NULL").select("path", "hash", F.col("seq").alias("first_seq"), until.alias("last_seq"))


def tree_at(intervals: DataFrame, seq: int) -> DataFrame:
    """``(path, hash)``: the tree of one commit, by a filter."""
    return intervals.where((F.col("first_seq") <= seq) & (F.col("last_seq") >= seq)).select("path", "hash")


def interval_changes(intervals: DataFrame, commits: DataFrame) -> DataFrame:
    """``(seq, path, kind, hash, prev_hash)``: the changes, back from the intervals.

    What begins where another interval of the path has just ended is modified, else
    added; what ends before the last commit, with nothing of the path right after, is deleted.
    """
    last = commits.agg(F.max("seq").alias("last")).scalar()
    begins = intervals.select("path", F.col("first_seq").alias("seq"), "hash")
    ends = intervals.where(F.col("last_seq") < last).select("path", (F.col("last_seq") + 1).alias("seq"), F.col("hash").alias("prev_hash"))
    kind = F.when(F.col("hash").isNull(), DELETED).when(F.col("prev_hash").isNull(), ADDED).otherwise(MODIFIED)
    return begins.join(ends, ["path", "seq"], "full").select("seq", "path", kind.alias("kind"), "hash", "prev_hash")


def files_in_intervals(commits: DataFrame, intervals: DataFrame, suffix: str = ".java") -> DataFrame:
    """``(seq, n_files)`` of every commit: what has begun less what has ended, as a running sum."""
    kept = intervals.where(has_suffix("path", suffix))
    steps = kept.select(F.explode(F.array(F.struct(F.col("first_seq").alias("seq"), F.lit(1).alias("n")), F.struct((F.col("last_seq") + 1).alias("seq"), F.lit(-1).alias("n")))).alias("_s"))
    summed = steps.groupBy("_s.seq").agg(F.sum("_s.n").alias("n_files"))
    rows = commits.select("seq").join(summed, "seq", "left").select("seq", F.coalesce("n_files", F.lit(0)).alias("n_files"))
    return running_totals(rows, "seq", ["n_files"])


def present_in_intervals(asked: DataFrame, intervals: DataFrame, how: str = "left_semi") -> DataFrame:
    """Asked-for ``(seq, path)`` that are there at their commit; ``left_anti`` gives those that are not.

    Intervals are cut at blocks of commits, so that a path with many changes or many
    questions meets itself one block at a time.
    """
    spans = F.sequence(F.expr(f"first_seq div {COMMITS_PER_BLOCK}"), F.expr(f"last_seq div {COMMITS_PER_BLOCK}"))
    cut = intervals.select(F.col("path").alias("_path"), "first_seq", "last_seq", F.explode(spans).alias("_block"))
    here = (F.col("path") == F.col("_path")) & (F.expr(f"seq div {COMMITS_PER_BLOCK}") == F.col("_block"))
    return asked.join(cut, here & F.col("seq").between(F.col("first_seq"), F.col("last_seq")), how)


def extend_intervals(intervals: DataFrame, changes: DataFrame, known: int, commits: DataFrame) -> DataFrame:
    """Intervals over all ``commits`` from those up to commit ``known`` and the ``changes`` of later ones.

    Intervals that had ended stay as they are; only those that reach ``known`` meet the changes.
    """
    open_ = intervals.where(F.col("last_seq") == known)
    as_added = open_.select("path", F.col("first_seq").alias("seq"), F.lit(ADDED).alias("kind"), "hash")
    later = changes.where(F.col("seq") > known).select("path", "seq", "kind", "hash")
    return intervals.where(F.col("last_seq") < known).unionByName(tree_intervals(as_added.unionByName(later), commits))
