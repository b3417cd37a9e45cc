"""Commit log, diffs, renames and selection."""

import random

import pytest

from historymine.operators import history, intervals, summary
from historymine.sources import read_commit_log

SNAPSHOTS = [
    (0, "A.java", "a"), (0, "B.java", "b"), (0, "C.txt", "c"),
    (1, "A2.java", "a"), (1, "B.java", "b2"), (1, "C.txt", "c"), (1, "D.JAVA", "d"),
    (2, "B.java", "b2"),
    (3, "A2.java", "a"), (3, "B.java", "b2"),
]


def _inputs(spark):
    trees = spark.createDataFrame(SNAPSHOTS, "seq BIGINT, path STRING, hash STRING")
    log = spark.createDataFrame([(i, f"c{i}") for i in range(4)], "seq BIGINT, commit STRING")
    return trees, log


def test_diff_kinds(spark, rows):
    assert rows(history.snapshot_diff(*_inputs(spark)), "seq", "path", "kind") == [
        (0, "A.java", "A"), (0, "B.java", "A"), (0, "C.txt", "A"),
        (1, "A.java", "D"), (1, "A2.java", "A"), (1, "B.java", "M"), (1, "C.txt", "U"), (1, "D.JAVA", "A"),
        (2, "A2.java", "D"), (2, "B.java", "U"), (2, "C.txt", "D"), (2, "D.JAVA", "D"),
        (3, "A2.java", "A"), (3, "B.java", "U"),
    ]


def test_empty_last_commit_deletes_all(spark, rows):
    trees, log = _inputs(spark)
    log = log.union(spark.createDataFrame([(4, "c4")], log.schema))
    last = history.snapshot_diff(trees, log).where("seq = 4")
    assert rows(last, "path", "kind") == [("A2.java", "D"), ("B.java", "D")]


def test_selection(spark, rows):
    trees, log = _inputs(spark)
    exact = history.select_changes(trees, log)
    assert rows(exact, "seq", "path") == [(0, "A.java"), (0, "B.java"), (1, "B.java"), (3, "A2.java")]
    plain = history.select_changes(trees, log, renames="none")
    assert rows(plain, "seq", "path") == [
        (0, "A.java"), (0, "B.java"), (1, "A2.java"), (1, "B.java"), (3, "A2.java"),
    ]
    assert rows(summary.files_changed(log, exact)) == [(0, 2), (1, 1), (2, 0), (3, 1)]
    assert rows(summary.files_in_tree(log, trees)) == [(0, 2), (1, 2), (2, 1), (3, 2)]


def test_rename_across_suffixes_is_not_an_addition(spark, rows):
    trees = spark.createDataFrame([(0, "a.txt", "h"), (1, "a.java", "h")], "seq BIGINT, path STRING, hash STRING")
    log = spark.createDataFrame([(0, "c0"), (1, "c1")], "seq BIGINT, commit STRING")
    assert rows(history.select_changes(trees, log), "seq", "path") == []
    assert rows(history.select_changes(trees, log, renames="none"), "seq", "path") == [(1, "a.java")]


def test_renames_when_one_content_fills_a_commit(spark, rows):
    """Thousands of equal files move; they are paired in path order, surplus stays added."""
    old = [(0, f"old/{i:05d}.java", "same") for i in range(3000)]
    new = [(1, f"new/{i:05d}.java", "same") for i in range(3010)]
    trees = spark.createDataFrame(old + new, "seq BIGINT, path STRING, hash STRING")
    log = spark.createDataFrame([(0, "c0"), (1, "c1")], "seq BIGINT, commit STRING")
    changes = history.snapshot_diff(trees, log)
    pairs = rows(history.exact_renames(changes), "old_path", "new_path")
    assert pairs == [(f"old/{i:05d}.java", f"new/{i:05d}.java") for i in range(3000)]
    selected = history.select_changes(trees, log).where("seq = 1")
    assert rows(selected, "path") == [(f"new/{i:05d}.java",) for i in range(3000, 3010)]


def test_pairs(spark, rows):
    _, log = _inputs(spark)
    assert rows(history.commit_pairs(log)) == [(0, "c0", None), (1, "c1", "c0"), (2, "c2", "c1"), (3, "c3", "c2")]


def test_existing_and_missing(spark, rows):
    trees, _ = _inputs(spark)
    asked = spark.createDataFrame([(1, "B.java"), (1, "gone.java")], "seq BIGINT, path STRING")
    assert rows(history.existing_files(asked, trees)) == [(1, "B.java")]
    assert rows(history.missing_files(asked, trees)) == [(1, "gone.java")]


def test_commit_log_keeps_line_order(spark, tmp_path, rows):
    hashes = [f"{(i * 7919) % 10007:040x}" for i in range(2000)]
    (tmp_path / "log.txt").write_text("\n".join(hashes[:1000]) + "\n\n" + "\n".join(hashes[1000:]) + "\n")
    log = read_commit_log(spark, str(tmp_path / "log.txt"))
    assert [r.commit for r in log.orderBy("seq").collect()] == hashes
    assert [r.seq for r in log.select("seq").orderBy("seq").collect()] == list(range(2000))


@pytest.mark.parametrize("block", [1, 2, 64])
def test_diff_equals_comparison_of_neighbours(spark, rows, monkeypatch, block):
    """Against a plain comparison of adjacent trees, whatever the block size."""
    monkeypatch.setattr(history, "BLOCK", block)
    rng = random.Random(5)
    trees = [{f"p{p}": rng.choice("abc") for p in range(12) if rng.random() < 0.7} for _ in range(9)] + [{}]
    trees[4] = {}
    expected = []
    for seq, now in enumerate(trees):
        before = trees[seq - 1] if seq else {}
        for path in now.keys() | before.keys():
            new, old = now.get(path), before.get(path)
            kind = "A" if old is None else "D" if new is None else "U" if new == old else "M"
            expected.append((seq, path, kind, new, old))
    files = [(seq, path, h) for seq, now in enumerate(trees) for path, h in now.items()]
    df = spark.createDataFrame(files, "seq BIGINT, path STRING, hash STRING")
    log = spark.createDataFrame([(i, f"c{i}") for i in range(len(trees))], "seq BIGINT, commit STRING")
    assert rows(history.snapshot_diff(df, log), "seq", "path", "kind", "hash", "prev_hash") == sorted(expected, key=repr)


def test_marked_renames(spark, rows):
    trees, log = _inputs(spark)
    marked = history.mark_renames(history.snapshot_diff(trees, log)).where("seq = 1")
    assert rows(marked, "path", "kind") == [("A2.java", "R"), ("B.java", "M"), ("C.txt", "U"), ("D.JAVA", "A")]


@pytest.mark.parametrize("block", [1, 4, 1024])
def test_intervals_hold_the_whole_history(spark, rows, monkeypatch, block):
    """Trees, changes, counts and questions from intervals equal those from the trees; a row per change, whatever the blocks."""
    monkeypatch.setattr(intervals, "COMMITS_PER_BLOCK", block)
    rng = random.Random(6)
    trees = [{f"p{p}.java": rng.choice("ab") for p in range(8) if rng.random() < 0.8} for _ in range(12)]
    trees[5] = {}
    trees[7] = trees[8] = trees[6]
    log = spark.createDataFrame([(i, f"c{i}") for i in range(len(trees))], "seq BIGINT, commit STRING")
    files = spark.createDataFrame([(i, p, h) for i, t in enumerate(trees) for p, h in t.items()], "seq BIGINT, path STRING, hash STRING")
    changes = history.snapshot_diff(files, log).where("kind <> 'U'").cache()
    held = intervals.tree_intervals(changes, log).cache()
    assert held.count() == changes.where("kind <> 'D'").count()
    for seq in (0, 5, 8, 11):
        assert dict(rows(intervals.tree_at(held, seq))) == trees[seq]
    assert rows(intervals.interval_changes(held, log)) == rows(changes.select("seq", "path", "kind", "hash", "prev_hash"))
    assert dict(rows(intervals.files_in_intervals(log, held), "seq", "n_files")) == {i: len(t) for i, t in enumerate(trees)}
    asked = log.select("seq").join(files.select("path").distinct(), how="cross")
    assert set(rows(intervals.present_in_intervals(asked, held), "seq", "path")) == {(i, p) for i, t in enumerate(trees) for p in t}
    absent = {(i, f"p{p}.java") for i in range(12) for p in range(8)} - {(i, p) for i, t in enumerate(trees) for p in t}
    assert set(rows(intervals.present_in_intervals(asked, held, "left_anti"), "seq", "path")) == absent
    earlier = intervals.tree_intervals(changes.where("seq <= 4"), log.where("seq <= 4"))
    assert rows(intervals.extend_intervals(earlier, changes, 4, log)) == rows(held)
