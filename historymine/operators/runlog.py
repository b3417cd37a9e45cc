"""The run log: outcomes, durations, progress and what is left to do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from historymine.functions.ordinals import number_rows, running_totals
from historymine.functions.scalars import safe_ratio

CLASSES = ("skipped", "success", "analyzer_failed", "git_failed")


def exit_ok(code: str = "code") -> Column:
    """Analyzers exit with 0 (clean) or 4 (findings) when they worked."""
    return F.col(code).isin(0, 4)


def is_slow(duration_ms: str = "duration_ms", limit_ms: int = 1000) -> Column:
    return F.col(duration_ms) > limit_ms


def outcome_class(run_log: DataFrame) -> Column:
    """``skipped``, ``success``, ``git_failed`` or ``analyzer_failed``.

    A log with a ``cause`` column (``unchanged``, ``checkout``, ``analyzer``) is
    classified by it: unchanged commits become a class of their own, and an
    analyzer that fails without an exit code is not taken for a checkout failure.
    """
    skipped = F.col("ok") & (F.col("duration_ms") == 0)
    by_code = (
        F.when(skipped, "skipped")
        .when(F.col("ok"), "success")
        .when(F.col("code") == -1, "git_failed")
        .otherwise("analyzer_failed")
    )
    if "cause" not in run_log.columns:
        return by_code
    return (
        F.when(F.col("ok") & (F.col("cause") == "unchanged"), "unchanged")
        .when(~F.col("ok") & (F.col("cause") == "checkout"), "git_failed")
        .when(~F.col("ok") & (F.col("cause") == "analyzer"), "analyzer_failed")
        .otherwise(by_code)
    )


def outcome_counts(run_log: DataFrame) -> DataFrame:
    return run_log.groupBy(outcome_class(run_log).alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


def error_codes(run_log: DataFrame) -> DataFrame:
    failed = run_log.where(outcome_class(run_log) == "analyzer_failed")
    return failed.groupBy("code").agg(F.count(F.lit(1)).alias("n"))


def run_stats(run_log: DataFrame, wall_ms: int | None = None, target_ms: float = 1000.0) -> DataFrame:
    """Attempts, time of the successes, means and whether the mean per attempt meets the target.

    Without ``wall_ms`` the summed durations stand for the elapsed time.
    """
    success = outcome_class(run_log) == "success"
    sums = run_log.agg(
        F.count(F.lit(1)).alias("attempted"),
        F.count_if(success).alias("succeeded"),
        F.coalesce(F.sum(F.when(success, F.col("duration_ms"))), F.lit(0)).alias("success_ms"),
        F.coalesce(F.sum("duration_ms"), F.lit(0)).alias("all_ms"),
    )
    wall = F.col("all_ms") if wall_ms is None else F.lit(wall_ms)
    per_attempt = safe_ratio(wall, "attempted")
    return sums.select(
        "attempted",
        "succeeded",
        "success_ms",
        safe_ratio("success_ms", "succeeded").alias("ms_per_success"),
        per_attempt.alias("ms_per_attempt"),
        (per_attempt <= target_ms).alias("target_met"),
    )


def progress_checkpoints(run_log: DataFrame, order_by: str = "commit", every: int = 200) -> DataFrame:
    """State after every ``every``-th commit and after the last: processed so far, by outcome.

    Commits are numbered, counted in blocks of ``every``, and the blocks summed up.
    """
    log = run_log.select(order_by, outcome_class(run_log).alias("outcome"))
    numbered = number_rows(log, [order_by], "_n")
    blocks = numbered.groupBy(F.expr(f"_n div {every}").alias("block")).agg(
        F.count(F.lit(1)).alias("processed"), *[F.count_if(F.col("outcome") == c).alias(c) for c in CLASSES]
    )
    return running_totals(blocks, "block", ["processed", *CLASSES]).drop("block")


def done_commits(results: DataFrame, errors: DataFrame) -> DataFrame:
    """Commits with a result or an error record."""
    return results.select("commit").union(errors.select("commit")).distinct()


def pending_commits(commits: DataFrame, results: DataFrame, errors: DataFrame) -> DataFrame:
    return commits.join(done_commits(results, errors), "commit", "left_anti")
