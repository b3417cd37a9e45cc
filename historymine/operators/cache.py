"""The result cache: per-rule counts by content and rule set."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from historymine.functions.skew import pick_rows
from historymine.operators.scan import rule_tally


def known_entries(cache: DataFrame, ruleset: str, index: DataFrame) -> DataFrame:
    """The latest cache entry of each content in ``index`` (a stored table) under this rule set.

    The contents of a short run are broadcast, so that a large cache is read but not shuffled.
    """
    return cache_merge(pick_rows(cache.where(F.col("ruleset_id") == ruleset), index, ["hash"]))


def cache_misses(index: DataFrame, known: DataFrame | None) -> DataFrame:
    """First occurrences whose content has no known entry; one row per content."""
    return index if known is None else index.join(known.select("hash"), "hash", "left_anti")


def mark_hits(files: DataFrame, misses: DataFrame) -> DataFrame:
    """Add ``is_hit``: false for the row that gets analyzed, true for every reuse.

    Joined on ``(seq, path)`` instead of the content, so that copies of one
    content do not meet in one task.
    """
    fresh = misses.select("seq", "path", F.lit(True).alias("_fresh"))
    return files.join(fresh, ["seq", "path"], "left").withColumn("is_hit", F.col("_fresh").isNull()).drop("_fresh")


def backfill(file_findings: DataFrame, trees: DataFrame) -> DataFrame:
    """Attach the content hash to findings that name commit and path: ``(hash, rule, n)``.

    Findings are tallied per file before the join. Copies of a content report
    the same tally; one of them is kept.
    """
    tallies = rule_tally(file_findings, ["seq", "path"])
    hashed = tallies.join(trees.select("seq", "path", "hash"), ["seq", "path"])
    return hashed.groupBy("hash", "rule").agg(F.max("n").alias("n"))


def cache_entries(contents: DataFrame, tallies: DataFrame, ruleset: str, version: int = 0) -> DataFrame:
    """Cache rows for analyzed contents, also for those without findings.

    The map has an entry per rule, so its size is bounded by the rule set.
    """
    by_rule = tallies.groupBy("hash").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("rule", "n")))).alias("warnings_by_rule")
    )
    return (
        contents.select("hash")
        .join(by_rule, "hash", "left")
        .select(
            "hash",
            F.lit(ruleset).alias("ruleset_id"),
            F.coalesce("warnings_by_rule", F.create_map().cast("MAP<STRING,BIGINT>")).alias("warnings_by_rule"),
            F.lit(1).cast("bigint").alias("num_files"),
            F.lit(version).cast("bigint").alias("version"),
        )
    )


def cache_tallies(cache: DataFrame) -> DataFrame:
    """The cache in long form ``(hash, rule, n)``."""
    return cache.select("hash", F.explode("warnings_by_rule").alias("rule", "n"))


def cache_merge(*caches: DataFrame) -> DataFrame:
    """Union of cache tables; per content and rule set the highest version wins, among equal ones the greatest entry."""
    merged = caches[0]
    for other in caches[1:]:
        merged = merged.unionByName(other)
    names = ["warnings_by_rule", "num_files"]
    latest = merged.groupBy("hash", "ruleset_id").agg(
        F.max_by(F.struct(*names), F.struct("version", F.array_sort(F.map_entries("warnings_by_rule")), "num_files")).alias("_entry"),
        F.max("version").alias("version"),
    )
    return latest.select("hash", "ruleset_id", *[f"_entry.{n}" for n in names], "version")
