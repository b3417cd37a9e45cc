"""Content cache, mining runs and their invariants."""

import json

import pytest
from pyspark.sql import functions as F

from historymine import schema as S
from historymine.bindings import views as V
from historymine.operators import analyzers, cache, content, reports, summary
from historymine.plans import mine_full_tree, mine_history
from historymine.session import materialize
from historymine.sources import Rule, empty_cache, ruleset_id

FILES = [(0, "x", "h1"), (0, "y", "h2"), (1, "v", "h1"), (1, "z", "h3"), (2, "y", "h2"), (2, "w", "h2")]
TALLIES = [("h1", "R1", 2), ("h2", "R1", 1), ("h2", "R2", 1)]
SF = "/root/testdata/sf0.001"


@pytest.fixture
def files(spark):
    return spark.createDataFrame(FILES, "seq BIGINT, path STRING, hash STRING")


@pytest.fixture
def tallies(spark):
    return spark.createDataFrame(TALLIES, "hash STRING, rule STRING, n BIGINT")


def test_first_seen_hits_and_counts(spark, files, tallies, rows):
    index = content.content_index(files)
    assert rows(index) == [("h1", 0, "x", 2), ("h2", 0, "y", 3), ("h3", 1, "z", 1)]
    marked = cache.mark_hits(files, cache.cache_misses(index, None))
    hits = marked.groupBy("seq").agg(F.count_if("is_hit"), F.count_if(~F.col("is_hit")))
    assert rows(hits) == [(0, 0, 2), (1, 1, 1), (2, 2, 0)]
    log = files.select("seq").distinct()
    assert rows(summary.files_changed(log, marked)) == [(0, 2), (1, 2), (2, 2)]
    assert rows(summary.files_changed(log, marked, compat_double_count=True)) == [(0, 2), (1, 3), (2, 4)]
    counts = reports.fan_counts(marked, tallies)
    assert rows(counts, "seq", "rule", "findings", "fresh") == [
        (0, "R1", 3, 3), (0, "R2", 1, 1), (1, "R1", 2, 0), (2, "R1", 2, 0), (2, "R2", 2, 0),
    ]
    per_commit = counts.groupBy("seq").agg(F.sum("files"), F.sum("fresh_files"))
    assert rows(per_commit) == [(0, 2, 2), (1, 1, 0), (2, 2, 0)]


def test_dedup_stats(files, rows):
    assert rows(content.dedup_stats(content.content_index(files))) == [(6, 3, 3, 0.5)]


def test_known_contents_are_not_missed_again(spark, files, rows):
    stored = [("h1", "r", {"R1": 2}, 1, 1), ("h1", "r", {"R1": 7}, 1, 0), ("h3", "other", {}, 1, 0), ("h9", "r", {}, 1, 0)]
    index = materialize(content.content_index(files), "contents")
    known = cache.known_entries(spark.createDataFrame(stored, S.CACHE), "r", index)
    assert rows(known, "hash", "warnings_by_rule") == [("h1", {"R1": 2})]
    assert rows(cache.cache_misses(index, known), "hash") == [("h2",), ("h3",)]


def test_merge_takes_latest_version(spark, rows):
    old = spark.createDataFrame([("h", "r", {"R": 1}, 1, 1), ("g", "r", {}, 1, 1)], empty_cache(spark).schema)
    new = spark.createDataFrame([("h", "r", {"R": 5}, 1, 2), ("h", "s", {"R": 9}, 1, 1)], empty_cache(spark).schema)
    merged = cache.cache_merge(old, new)
    assert rows(cache.cache_tallies(merged)) == [("h", "R", 5), ("h", "R", 9)]
    assert rows(merged, "hash", "ruleset_id", "version") == [("g", "r", 1), ("h", "r", 2), ("h", "s", 1)]


def test_merged_maps(files, tallies, rows):
    maps = reports.count_maps(tallies, ["hash"])
    per_file = files.join(maps, "hash")
    assert rows(reports.merge_maps(per_file, ["seq"], "warnings_by_rule").where("seq = 2")) == [(2, "R1", 2), (2, "R2", 2)]


@pytest.fixture(scope="module")
def documents(spark):
    return V.commits(spark, SF).cache(), V.snapshots(spark, SF).cache()


@pytest.fixture(scope="module")
def run(documents):
    return mine_history(*documents, V.RULES)


def test_run_totals_agree(run):
    sums = run.commits.agg(*[F.sum(c).alias(c) for c in run.commits.columns if c not in ("seq", "commit")]).first()
    assert sums.cache_hits + sums.cache_misses == sums.files_changed
    assert sums.findings_fresh + sums.findings_cached == sums.findings
    by_rule = run.by_rule.agg(F.sum("findings").alias("a"), F.sum("fresh").alias("f")).first()
    assert (by_rule.a, by_rule.f) == (sums.findings, sums.findings_fresh)
    assert sums.findings_fresh == run.findings.count()
    row = run.summary("docs").first()
    assert sum(row.stat_of_warnings.values()) == sums.findings
    assert sum(run.summary("docs", include_cached=False).first().stat_of_warnings.values()) == sums.findings_fresh


def test_reports_of_a_run(run):
    documents = run.reports()
    sizes = documents.agg(F.sum(F.size(F.coalesce("violations", F.array()))).alias("w"), F.count_if(reports.is_header()).alias("n")).first()
    assert sizes.n == run.commits.count()
    assert sizes.w == run.commits.agg(F.sum("findings")).first()[0]


def test_first_commit_agrees_with_full_tree(run, documents):
    full = mine_full_tree(*documents, V.RULES).commits
    first = run.commits.where("seq = 0").first()
    assert full.where("seq = 0").first().findings == first.findings
    assert full.where("seq = 0").first().files_in_tree == first.files_changed


def test_second_run_scans_nothing_and_reports_the_same(run, documents, rows):
    again = mine_history(*documents, V.RULES, cache=run.cache, cache_version=1)
    assert again.findings.count() == 0
    totals = ["seq", "commit", "files_changed", "files_reported", "findings"]
    assert rows(again.commits, *totals) == rows(run.commits, *totals)
    assert again.commits.agg(F.sum("cache_misses")).first()[0] == 0
    assert rows(again.cache, "hash", "version") == rows(run.cache, "hash", "version")


def test_other_rules_do_not_reuse_the_cache(run, documents):
    other = mine_history(*documents, V.RULES[:1], cache=run.cache)
    assert other.commits.agg(F.sum("cache_misses")).first()[0] == run.commits.agg(F.sum("cache_misses")).first()[0]
    assert ruleset_id(V.RULES[:1]) != ruleset_id(V.RULES) == ruleset_id(reversed(V.RULES))


def test_all_hit_and_clean_commits_are_reported(spark, rows):
    log = spark.createDataFrame([(i, f"c{i}") for i in range(4)], "seq BIGINT, commit STRING")
    snapshots = spark.createDataFrame(
        [(0, "a.java", "x 123"), (0, "b.java", "clean"), (1, "a.java", "x 123"), (1, "b.java", "x 123"), (3, "c.java", "clean")],
        "seq BIGINT, path STRING, content STRING",
    )
    run = mine_history(log, snapshots, [Rule("N", "s", "line_regex", "[0-9]{3}")], renames="none")
    assert rows(run.commits, "seq", "files_changed", "cache_hits", "findings", "findings_fresh") == [
        (0, 2, 0, 1, 1), (1, 1, 1, 1, 0), (2, 0, 0, 0, 0), (3, 1, 1, 0, 0),
    ]


def test_commit_with_a_failing_file_becomes_an_error(spark, rows):
    log = spark.createDataFrame([(0, "c0"), (1, "c1")], "seq BIGINT, commit STRING")
    snapshots = spark.createDataFrame(
        [(0, "a.java", "123 BAD"), (0, "b.java", "456"), (1, "a.java", "123"), (1, "b.java", "456")],
        "seq BIGINT, path STRING, content STRING",
    )
    factory = analyzers.line_pattern_analyzer("[0-9]{3}", "N", "s", fail_on="BAD")
    run = mine_history(log, snapshots, analyzer=factory, analyzer_id="n")
    assert rows(run.errors, "commit", "error") == [("c0", "a.java: cannot analyze a file with BAD")]
    assert rows(run.commits, "commit", "findings") == [("c1", 1)]
    assert run.summary("x").first().stat_of_repository.number_of_commits == 1
    assert len(rows(run.cache)) == 2


def test_resumed_run_completes_the_first(run, documents, rows):
    """A run over the older half, then one over everything that skips what is done."""
    log, snapshots = documents
    older = log.where("seq < 5")
    first = mine_history(older, snapshots.where("seq < 5"), V.RULES)
    second = mine_history(log, snapshots, V.RULES, cache=first.cache, cache_version=1, done=first.commits)
    assert rows(second.commits, "seq") == [(i,) for i in range(5, 10)]
    assert rows(first.commits.unionByName(second.commits)) == rows(run.commits)
    assert rows(second.cache, "hash", "warnings_by_rule") == rows(run.cache, "hash", "warnings_by_rule")
    nothing = mine_history(log, snapshots, V.RULES, cache=second.cache, done=run.commits)
    assert nothing.commits.count() == 0 and nothing.findings.count() == 0


def test_written_run(run, spark, tmp_path):
    store = run.write(str(tmp_path), "docs")
    from_documents = summary.summarize_reports(store.reports(), "docs").first()
    assert from_documents.stat_of_repository == run.summary("docs").first().stat_of_repository
    assert json.loads(store.stored_summary().first().value)["location"] == "docs"
    assert store.cache().count() == run.cache.count()


def test_trees_beyond_the_log_do_not_count(spark):
    log = spark.createDataFrame([(0, "c0"), (1, "c1")], "seq BIGINT, commit STRING")
    trees = spark.createDataFrame([(i, f"f{i}.java", f"{i} 123") for i in range(3)], "seq BIGINT, path STRING, content STRING")
    run = mine_history(log, trees, [Rule("N", "s", "line_regex", "[0-9]{3}")], renames="none")
    row = run.summary("x").first()
    assert row.stat_of_warnings == {"N": 2} and row.stat_of_repository.avg_of_num_warnings == 1.0


def test_versions_rise_and_ties_have_one_winner(spark, rows, run, documents):
    again = mine_history(documents[0], documents[1], V.RULES[:2], cache=run.cache)
    assert rows(again.cache.select("version").distinct()) == [(0,), (1,)]
    one = spark.createDataFrame([("h", "r", {"R": 1}, 1, 0)], S.CACHE)
    two = spark.createDataFrame([("h", "r", {"R": 5}, 1, 0)], S.CACHE)
    assert rows(cache.cache_merge(one, two)) == rows(cache.cache_merge(two, one)) == [("h", "r", {"R": 5}, 1, 0)]
