"""Documents and tables that a run leaves behind."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F


def write_reports(reports: DataFrame, path: str, mode: str = "errorifexists", compression: str = "none") -> None:
    """Commit documents as JSON, one per line; null fields are left out. Names and rules repeat in every line, so ``gzip`` saves most of the space."""
    reports.write.mode(mode).json(path, compression=compression)


def write_errors(errors: DataFrame, path: str, mode: str = "errorifexists", with_seq: bool = False) -> None:
    """Error records ``{commit, error}``, apart from the results; ``with_seq`` adds the place in the log."""
    errors.select(*["seq"] * with_seq, "commit", "error").write.mode(mode).json(path)


def save_cache(cache: DataFrame, root: str) -> str:
    """Write the cache to a new version directory below ``root`` and return its path.

    A version is never overwritten, so a run may read the cache it extends.
    """
    path = f"{root.rstrip('/')}/cache-{uuid.uuid4().hex}"
    cache.write.parquet(path)
    return path


def summary_json(summary: DataFrame) -> DataFrame:
    """The summary row as JSON text."""
    return summary.select(F.to_json(F.struct(*summary.columns)).alias("value"))


def write_summary(summary: DataFrame, path: str, mode: str = "errorifexists") -> None:
    summary_json(summary).coalesce(1).write.mode(mode).text(path)  # one row
