"""What changed between commits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from historymine.functions.ordinals import number_rows
from historymine.functions.scalars import has_suffix
from historymine.session import materialize

ADDED, MODIFIED, DELETED, COPIED, RENAMED, UNCHANGED = "A", "M", "D", "C", "R", "U"
ANALYZED_KINDS = (ADDED, COPIED, MODIFIED)
BLOCK = 64  # commits per window of the diff


def commit_pairs(commits: DataFrame) -> DataFrame:
    """Each commit with its predecessor in the log, null for the first; an equi-join, no window."""
    previous = commits.select((F.col("seq") + 1).alias("seq"), F.col("commit").alias("prev_commit"))
    return commits.select("seq", "commit").join(previous, "seq", "left")


def snapshot_diff(trees: DataFrame, commits: DataFrame) -> DataFrame:
    """Classify every path of adjacent commits as A, M, D or U (unchanged).

    ``(seq, path)`` is unique in ``trees``. The commit before the first is the
    empty tree: all its files are A.

    The trees are read and shuffled once, hashes only, never contents. Commits
    are cut into blocks of BLOCK, and the last tree of a block is repeated at the
    start of the next; so each file finds its predecessor and successor in a
    window of at most BLOCK + 1 rows, however many commits a path lives through.
    """
    block, next_block = F.expr(f"seq div {BLOCK}"), F.expr(f"(seq + 1) div {BLOCK}")
    blocks = F.when(block == next_block, F.array(block)).otherwise(F.array(block, next_block))
    life = Window.partitionBy("_block", "path").orderBy("seq")
    rows = trees.select("seq", "path", "hash", F.explode(blocks).alias("_block")).select(
        "*",
        F.lag("seq").over(life).alias("_before"),
        F.lag("hash").over(life).alias("_before_hash"),
        F.lead("seq").over(life).alias("_after"),
    )

    follows = F.coalesce(F.col("_before") == F.col("seq") - 1, F.lit(False))
    kind = F.when(~follows, ADDED).when(F.equal_null("hash", "_before_hash"), UNCHANGED).otherwise(MODIFIED)
    here = F.when(
        F.col("_block") == block,
        F.struct(
            "seq", kind.alias("kind"), "hash", F.when(follows, F.col("_before_hash")).alias("prev_hash")
        ),
    )
    last = commits.agg(F.max("seq").alias("last")).scalar()
    ends = F.coalesce(F.col("_after") != F.col("seq") + 1, F.lit(True)) & (F.col("seq") < last)
    gone = F.when(
        (F.col("_block") == next_block) & ends,
        F.struct(
            (F.col("seq") + 1).alias("seq"),
            F.lit(DELETED).alias("kind"),
            F.lit(None).cast("string").alias("hash"),
            F.col("hash").alias("prev_hash"),
        ),
    )
    found = rows.select("path", F.explode(F.array_compact(F.array(here, gone))).alias("_c"))
    return found.select("_c.seq", "path", "_c.kind", "_c.hash", "_c.prev_hash")


def _may_move(changes: DataFrame) -> DataFrame:
    """Added and deleted rows ``(seq, hash, kind, path, _both)``; ``_both`` marks contents that a commit both adds and deletes.

    They are counted per commit and content with map-side combine, so that the
    many files that merely come or go, a first commit's whole tree among them, are not sorted.
    """
    moved = changes.where(F.col("kind").isin(ADDED, DELETED)).select("seq", F.coalesce("hash", "prev_hash").alias("hash"), "kind", "path")
    sides = moved.groupBy("seq", "hash").agg(F.min("kind").alias("_low"), F.max("kind").alias("_high"))
    both = sides.where(F.col("_low") != F.col("_high")).select("seq", "hash", F.lit(True).alias("_both"))
    return moved.join(both, ["seq", "hash"], "left")


def _moves(changes: DataFrame) -> DataFrame:
    """``(seq, hash, added, deleted)``: the i-th added and the i-th deleted path of a content side by side.

    Only contents with both are numbered, in path order, which copes with one
    content filling a whole commit.
    """
    candidates = _may_move(changes).where("_both").drop("_both")
    numbered = number_rows(candidates, ["path"], "n", within=["seq", "hash", "kind"])
    side = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("path")))
    return numbered.groupBy("seq", "hash", "n").agg(side(ADDED).alias("added"), side(DELETED).alias("deleted")).drop("n")


def exact_renames(changes: DataFrame) -> DataFrame:
    """``(seq, old_path, new_path, hash)``: deleted and added paths of one commit with equal content."""
    paired = _moves(changes).where(F.col("added").isNotNull() & F.col("deleted").isNotNull())
    return paired.select("seq", F.col("deleted").alias("old_path"), F.col("added").alias("new_path"), "hash")


def mark_renames(changes: DataFrame) -> DataFrame:
    """``(seq, path, kind, hash)``: exact renames become one R at the new path, the rest stays."""
    moves = _moves(changes)
    kind = F.when(F.col("added").isNull(), DELETED).when(F.col("deleted").isNull(), ADDED).otherwise(RENAMED)
    moved = moves.select("seq", F.coalesce("added", "deleted").alias("path"), kind.alias("kind"), "hash")
    others = changes.where(~F.col("kind").isin(ADDED, DELETED)).select("seq", "path", "kind", "hash")
    alone = _may_move(changes).where("_both IS NULL").select("seq", "path", "kind", "hash")
    return others.unionByName(alone).unionByName(moved)


def keep_kinds(changes: DataFrame, kinds: tuple[str, ...] = ANALYZED_KINDS) -> DataFrame:
    return changes.where(F.col("kind").isin(*kinds))


def keep_suffix(files: DataFrame, suffix: str = ".java") -> DataFrame:
    return files.where(has_suffix("path", suffix))


def existing_files(asked: DataFrame, trees: DataFrame) -> DataFrame:
    """Asked-for paths that are present at their commit."""
    return asked.join(trees.select("seq", "path"), ["seq", "path"], "left_semi")


def missing_files(asked: DataFrame, trees: DataFrame) -> DataFrame:
    """Asked-for paths that are absent at their commit, one row each."""
    return asked.join(trees.select("seq", "path"), ["seq", "path"], "left_anti")


def select_changes(trees: DataFrame, commits: DataFrame, suffix: str = ".java", renames: str = "exact") -> DataFrame:
    """The files to analyze: added or modified, with the suffix, exact renames left out on request.

    Without rename pairing the suffix is applied before the join, where it
    reaches the scan; a rename may cross suffixes, so pairing needs all paths.
    """
    if renames not in ("exact", "none"):
        raise ValueError(f"renames must be 'exact' or 'none', not {renames!r}")
    if renames == "none":
        changes = snapshot_diff(keep_suffix(trees, suffix), commits)
    else:
        changed = snapshot_diff(trees, commits).where(F.col("kind") != UNCHANGED)
        changes = mark_renames(materialize(changed, "changes"))
    return keep_suffix(keep_kinds(changes), suffix).select("seq", "path", "kind", "hash")
