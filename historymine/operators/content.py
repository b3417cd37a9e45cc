"""Distinct contents: the unit of scanning and caching."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from historymine.functions.scalars import safe_ratio


def content_index(files: DataFrame) -> DataFrame:
    """``(hash, seq, path, n_copies)``: where each content occurs first, in ``(seq, path)`` order.

    One aggregate with map-side combine; a content that fills a third of the
    rows leaves each task as a single row.
    """
    return (
        files.groupBy("hash")
        .agg(F.min(F.struct("seq", "path")).alias("_first"), F.count(F.lit(1)).alias("n_copies"))
        .select("hash", "_first.seq", "_first.path", "n_copies")
    )


def dedup_stats(index: DataFrame) -> DataFrame:
    """Files, distinct contents, and the share of files a content cache serves."""
    sums = index.agg(
        F.coalesce(F.sum("n_copies"), F.lit(0)).alias("n_files"), F.count(F.lit(1)).alias("n_contents")
    )
    return sums.select(
        "n_files",
        "n_contents",
        (F.col("n_files") - F.col("n_contents")).alias("n_repeats"),
        safe_ratio(F.col("n_files") - F.col("n_contents"), "n_files").alias("hit_ratio"),
    )
