"""Commit logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from historymine.functions.ordinals import number_rows


def order_commits(log: DataFrame, order_by: Sequence[str] = ("committed_at", "commit")) -> DataFrame:
    """Give every commit its dense ordinal ``seq``, oldest first, blank hashes dropped."""
    return number_rows(log.where(F.col("commit") != ""), order_by, "seq")


def read_commit_log(spark: SparkSession, path: str) -> DataFrame:
    """``commits(seq, commit)`` from a text log with one hash per line, oldest first.

    The order is the order of the lines, which Spark keeps inside a split of the
    file; the splits follow each other by their offset.
    """
    lines = spark.read.text(path).select(
        F.trim("value").alias("commit"),
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_offset"),
        F.monotonically_increasing_id().alias("_line"),
    )
    numbered = number_rows(lines.where(F.col("commit") != ""), ("_file", "_offset", "_line"), "seq")
    return numbered.select("seq", "commit")
