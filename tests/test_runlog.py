"""Outcomes, statistics, progress and resumption."""

import pytest

from historymine import schema as S
from historymine.operators import runlog

LOG = [("a", True, 0, 0), ("b", True, 0, 1500), ("c", True, 0, 500), ("d", False, -1, 0), ("e", False, 1, 0)]


@pytest.fixture
def log(spark):
    return spark.createDataFrame(LOG, S.RUN_LOG)


def test_outcomes(log, rows):
    assert rows(runlog.outcome_counts(log)) == [("analyzer_failed", 1), ("git_failed", 1), ("skipped", 1), ("success", 2)]
    assert rows(runlog.error_codes(log)) == [(1, 1)]
    assert rows(log.where(runlog.is_slow()), "commit") == [("b",)]
    assert rows(log.where(runlog.exit_ok()), "commit") == [("a",), ("b",), ("c",)]


def test_causes_separate_what_codes_mix_up(spark, rows):
    log = spark.createDataFrame(
        [("a", True, 0, 0, "unchanged"), ("b", True, 0, 0, None), ("c", False, -1, 0, "analyzer"), ("d", False, -1, 0, "checkout")],
        S.RUN_LOG + ", cause STRING",
    )
    assert rows(runlog.outcome_counts(log)) == [("analyzer_failed", 1), ("git_failed", 1), ("skipped", 1), ("unchanged", 1)]


def test_stats(log, rows):
    assert rows(runlog.run_stats(log, wall_ms=10_000)) == [(5, 2, 2000, 1000.0, 2000.0, False)]
    assert rows(runlog.run_stats(log.limit(0))) == [(0, 0, 0, 0.0, 0.0, True)]


def test_progress(log, rows):
    assert rows(runlog.progress_checkpoints(log, every=2)) == [(2, 1, 1, 0, 0), (4, 1, 2, 0, 1), (5, 1, 2, 1, 1)]


def test_resume(log, rows):
    done = runlog.done_commits(log.where("ok"), log.where("code = -1"))
    assert rows(done) == [("a",), ("b",), ("c",), ("d",)]
    assert rows(runlog.pending_commits(log, log.where("ok"), log.where("code = -1")), "commit") == [("e",)]
