"""Runs below one folder: whole or not at all, one row per commit, resumed where they were lost."""

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from historymine.functions import skew
from historymine.operators import analyzers, reports
from historymine.plans import RunStore, mine_history, mine_in_stages, mining
from historymine.sources import Rule

RULES = [Rule("N", "s", "line_regex", "[0-9]{3}"), Rule("X", "s", "line_regex", "x")]
TOTALS = ["commit", "files_changed", "cache_hits", "findings", "findings_fresh"]


@pytest.fixture(scope="module")
def history(spark):
    """Seven commits; contents come back, one commit changes nothing."""
    log = spark.createDataFrame([(i, f"c{i}") for i in range(7)], "seq BIGINT, commit STRING")
    trees = [(i, f"f{j}.java", f"{100 + (i * j) % 5} x" if i != 3 else f"{100 + (2 * j) % 5} x") for i in range(7) for j in range(3)]
    return log.cache(), spark.createDataFrame(trees, "seq BIGINT, path STRING, content STRING").cache()


@pytest.fixture(scope="module")
def whole(history):
    run = mine_history(*history, RULES)
    return replace(run, commits=run.commits.cache(), cache=run.cache.cache(), fresh_cache=run.fresh_cache.cache())


@pytest.fixture
def store(spark, tmp_path):
    return RunStore(spark, str(tmp_path / "runs"))


def same(store, whole, rows):
    assert rows(store.commits()) == rows(whole.commits)
    assert rows(store.by_rule()) == rows(whole.by_rule)
    assert rows(store.findings()) == rows(whole.findings)
    assert rows(store.cache(), "hash", "warnings_by_rule") == rows(whole.cache, "hash", "warnings_by_rule")
    assert store.summary("d").first() == whole.summary("d").first()
    slim = lambda docs: rows(docs.select("commit", "filename", F.to_json("warnings_by_rule"), F.to_json("violations")))
    assert slim(store.reports()) == slim(whole.reports())


def test_nothing_stored(store):
    assert store.runs() == [] and store.done().count() == 0 and store.cache().count() == 0
    assert store.commits().count() == store.errors().count() == store.findings().count() == store.progress().count() == 0
    assert store.discard_unfinished() == []


def test_stored_run_and_repeat(store, whole, rows):
    store.append(whole, "d")
    same(store, whole, rows)
    store.append(whole, "d")
    same(store, whole, rows)
    assert store.stored_summary().count() == 1 and len(store.runs()) == 2


def test_lost_after_any_step(spark, tmp_path, whole):
    """A run is read only once its last step is done; another one afterwards is complete."""
    steps = 8
    for step in range(steps + 1):
        store = RunStore(spark, str(tmp_path / f"after-{step}"))
        entry = store._entry("run", whole.identity, "d")
        done = [write() for _, write in zip(range(step), store._steps(whole, entry))]
        assert len(done) == step
        if step < steps:
            assert store.runs() == [] and store.commits().count() == 0 and store.done().count() == 0
        else:
            assert store.commits().count() == whole.commits.count()


def test_runs_beside_a_lost_one(store, whole, rows):
    entry = store._entry("run", whole.identity, "d")
    for _, write in zip(range(6), store._steps(whole, entry)):
        write()
    store.append(whole, "d")
    same(store, whole, rows)
    assert store.discard_unfinished() == [entry.run]
    same(store, whole, rows)


def test_stages_equal_one_run(store, history, whole, rows):
    every = 3
    assert mine_in_stages(*history, RULES, store=store, location="d", every=every, stages=1) == 1
    assert store.done().count() == every
    while mine_in_stages(*history, RULES, store=store, location="d", every=every, stages=1):
        pass
    same(store, whole, rows)
    assert mine_in_stages(*history, RULES, store=store, location="d", every=every) == 0
    last = store.progress().orderBy(F.desc("position")).first()
    assert (last.processed, last.succeeded, last.failed) == (7, 7, 0)


def test_a_later_run_replaces_what_failed(spark, store, rows):
    log = spark.createDataFrame([(0, "c0"), (1, "c1")], "seq BIGINT, commit STRING")
    trees = spark.createDataFrame([(0, "a.java", "123 BAD"), (1, "a.java", "456")], "seq BIGINT, path STRING, content STRING")
    failing = analyzers.line_pattern_analyzer("[0-9]{3}", "N", "s", fail_on="BAD")
    mine_history(log, trees, analyzer=failing, analyzer_id="n").write(store.root, "d")
    assert rows(store.errors(), "commit") == [("c0",)] and rows(store.commits(), "commit") == [("c1",)]
    assert rows(store.done()) == [("c0",), ("c1",)]
    assert rows(store.progress(), "processed", "succeeded", "failed") == [(2, 1, 1)]
    mine_history(log, trees, analyzer=analyzers.line_pattern_analyzer("[0-9]{3}", "N", "s"), analyzer_id="n").write(store.root, "d")
    assert store.errors().count() == 0 and rows(store.commits(), "commit", "findings") == [("c0", 1), ("c1", 1)]
    assert rows(store.progress(), "processed", "succeeded", "failed") == [(0, 0, 0), (2, 2, 0)]


def test_caches_of_rule_sets_stay_apart(store, history, whole, rows):
    store.append(whole, "d")
    fewer = mine_history(*history, RULES[:1], cache=store.cache())
    store.append(fewer, "d")
    assert rows(store.cache(whole.identity), "hash") == rows(whole.cache, "hash")
    assert store.cache().count() == 2 * whole.cache.count()
    assert {r.rule for r in store.findings(fewer.identity).collect()} == {"N"}
    before = rows(store.cache())
    store.compact_cache(whole.identity)
    assert rows(store.cache()) == before
    assert rows(store.commits(), *TOTALS) == rows(fewer.commits, *TOTALS)


def test_few_misses_write_few_rows(spark, store, history, whole):
    store.append(whole, "d")
    again = mine_history(*history, RULES, cache=store.cache())
    store.append(again, "d")
    sizes = [spark.read.parquet(f"{store.root}/cache/run={r.run}").count() for r in store.runs()]
    assert sizes == [whole.cache.count(), 0]


def test_documents_are_assembled_from_the_store(store, whole):
    store.append(whole, "d")
    assert reports.assemble_documents(store.reports()).count() == whole.commits.count()


def test_stages_read_the_contents_for_their_hashes_once(store, history, whole, rows, monkeypatch):
    """one pass of hashes for all stages of a call, and no count of keys where a table is too small for a hot one."""
    made = []
    for module in (mining, skew):
        monkeypatch.setattr(module, "materialize", lambda df, name, kept=module.materialize: made.append(name) or kept(df, name))
    assert mine_in_stages(*history, RULES, store=store, location="d", every=3) == 3
    assert made.count("trees") == 1 and made.count("hot-keys") == 0 and made.count("files") == 3
    same(store, whole, rows)


@pytest.mark.parametrize("rows_per_slice", [4, 5])
def test_small_tables_need_no_hot_keys(spark, rows, monkeypatch, rows_per_slice):
    facts, lookup = spark.createDataFrame([(1, n) for n in range(5)], "k INT, n INT"), spark.createDataFrame([(1, "a")], "k INT, t STRING")
    counted = []
    monkeypatch.setattr(skew, "hot_keys", lambda *args, kept=skew.hot_keys: counted.append(1) or kept(*args))
    joined = skew.spread_join(facts, lookup, ["k"], ["n"], rows_per_slice=rows_per_slice, within=facts)
    assert rows(joined, "k", "n", "t") == [(1, n, "a") for n in range(5)] and len(counted) == (rows_per_slice < 5)
