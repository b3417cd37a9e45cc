"""Scratch tables belong to a run."""

import glob

from historymine.plans import mine_history
from historymine.session import materialize, scratch_root, scratch_run
from historymine.sources import Rule


def test_a_run_leaves_nothing_behind(spark):
    log = spark.createDataFrame([(0, "c0"), (1, "c1")], "seq BIGINT, commit STRING")
    trees = spark.createDataFrame([(0, "a.java", "1 123"), (1, "a.java", "2"), (1, "b.java", "1 123")], "seq BIGINT, path STRING, content STRING")
    folder = scratch_root(spark).removeprefix("file:") + "/historymine"
    kept = materialize(log, "kept")
    with scratch_run(spark):
        found = mine_history(log, trees, [Rule("N", "s", "line_regex", "[0-9]{3}")]).commits.collect()
        assert glob.glob(f"{folder}/run-*/*")
    assert len(found) == 2 and not glob.glob(f"{folder}/run-*")
    assert kept.count() == 2
