"""Registered queries: every operator over the whole test tables."""

from __future__ import annotations

import os
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from historymine import functions as fn, plans, schema as S, sinks, sources, streaming
from historymine.bindings import views as V
from historymine.operators import analyzers, cache, content, history, intervals, reports, runlog, scan, summary
from historymine.session import materialize, scratch_path
from historymine.streaming.jobs import latest_tally

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


# --- commit log and trees ---------------------------------------------------


@query
def commit_log(spark, sf):
    """The log as text, a hash per line with blank lines between, read back in its order."""
    path = scratch_path(spark, "log")
    blank = F.when(F.col("seq") % 7 == 3, "\n  \n").otherwise("")
    V.commits(spark, sf).orderBy("seq").select(F.concat(F.lit(" "), "commit", blank)).write.text(path)
    return sources.read_commit_log(spark, path).orderBy("seq")


@query
def commit_ordinal(spark, sf):
    log = V.table(spark, sf, "orders").select(
        F.col("o_orderkey").cast("string").alias("commit"), "o_orderkey", F.col("o_orderdate").alias("committed_at")
    )
    return sources.order_commits(log, ["committed_at", "o_orderkey"]).select("seq", "commit")


@query
def commit_pairs(spark, sf):
    return history.commit_pairs(V.commits(spark, sf))


@query
def short_hash(spark, sf):
    return V.commits(spark, sf).select("seq", fn.short_hash("commit").alias("short"))


@query
def snapshot_scan(spark, sf):
    return V.snapshots(spark, sf).select("seq", "path", F.octet_length("content").alias("n_bytes"), "hash")


@query
def ext_filter(spark, sf):
    return history.keep_suffix(V.snapshots(spark, sf)).select("seq", "path")


@query
def path_relativize(spark, sf):
    absolute = fn.absolute_path("/w", "path")
    return V.snapshots(spark, sf).select(
        "seq",
        absolute.alias("absolute"),
        fn.relative_path("/w", absolute).alias("relative"),
        fn.relative_path("/w/src1", absolute).alias("under_src1"),
        fn.absolute_path("/other", absolute).alias("unchanged"),
    )


@query
def content_hash(spark, sf):
    return V.table(spark, sf, "documents").select("doc_id", fn.content_hash("text").alias("hash"))


@query
def split_lines(spark, sf):
    lines = fn.non_blank_lines("content")
    return V.snapshots(spark, sf).select("seq", "path", F.size(lines).cast("bigint").alias("n_lines"))


@query
def files_in_tree(spark, sf):
    return summary.files_in_tree(V.commits(spark, sf), V.snapshots(spark, sf))


# --- history ----------------------------------------------------------------


def _daily_changes(spark, sf):
    return history.snapshot_diff(V.daily_trees(spark, sf), V.daily_commits(spark, sf))


@query
def snapshot_diff(spark, sf):
    return _daily_changes(spark, sf)


@query
def first_commit_full(spark, sf):
    first = V.snapshots(spark, sf).where(F.col("seq") == 0)
    changes = history.snapshot_diff(first, V.commits(spark, sf).where(F.col("seq") == 0))
    return history.keep_suffix(changes).select("path", "kind")


@query
def change_kind_filter(spark, sf):
    return history.keep_kinds(_daily_changes(spark, sf)).select("seq", "path", "kind")


@query
def rename_exact(spark, sf):
    return history.exact_renames(_daily_changes(spark, sf))


@query
def existing_files(spark, sf):
    changes = _daily_changes(spark, sf).select("seq", "path", "kind")
    return history.existing_files(changes, V.daily_trees(spark, sf))


@query
def missing_files(spark, sf):
    changes = _daily_changes(spark, sf).select("seq", "path")
    return history.missing_files(changes, V.daily_trees(spark, sf))


def _daily_intervals(spark, sf):
    """Stored as a first half of the days, extended by the others."""
    days = V.daily_commits(spark, sf)
    changes = materialize(_daily_changes(spark, sf).where(F.col("kind") != "U"), "changes")
    middle = days.agg((F.max("seq") / 2).cast("bigint")).first()[0]
    half = days.where(F.col("seq") <= middle)
    first = materialize(intervals.tree_intervals(changes.where(F.col("seq") <= middle), half), "intervals")
    return materialize(intervals.extend_intervals(first, changes, middle, days), "intervals")


@query
def tree_intervals(spark, sf):
    return _daily_intervals(spark, sf)


@query
def interval_diff(spark, sf):
    return intervals.interval_changes(_daily_intervals(spark, sf), V.daily_commits(spark, sf))


@query
def interval_files_in_tree(spark, sf):
    return intervals.files_in_intervals(V.daily_commits(spark, sf), _daily_intervals(spark, sf))


@query
def interval_existing_files(spark, sf):
    """Every path of two adjacent commits, asked for at the later one."""
    asked = _daily_changes(spark, sf).select("seq", "path")
    held = _daily_intervals(spark, sf)
    there = intervals.present_in_intervals(asked, held).withColumn("present", F.lit(True))
    return there.unionByName(intervals.present_in_intervals(asked, held, "left_anti").withColumn("present", F.lit(False)))


def _daily_selected(spark, sf):
    return history.select_changes(V.daily_trees(spark, sf), V.daily_commits(spark, sf))


@query
def files_changed(spark, sf):
    return summary.files_changed(V.daily_commits(spark, sf), _daily_selected(spark, sf))


@query
def files_changed_compat(spark, sf):
    selected = materialize(_daily_selected(spark, sf), "selected")
    files = cache.mark_hits(selected, content.content_index(selected))
    return summary.files_changed(V.daily_commits(spark, sf), files, compat_double_count=True)


@query
def placeholder_reports(spark, sf):
    changed = V.table(spark, sf, "lineitem").select(F.col("l_orderkey").cast("string").alias("commit"))
    placeholders = reports.placeholder_reports(V.order_commits(spark, sf), changed)
    return placeholders.select("commit", "num_java_files", F.size("warnings").cast("bigint").alias("n_warnings"))


# --- contents and cache -----------------------------------------------------


@query
def first_seen(spark, sf):
    return content.content_index(V.snapshots(spark, sf))


@query
def dedup_stats(spark, sf):
    return content.dedup_stats(content.content_index(V.snapshots(spark, sf)))


def _selected_files(spark, sf):
    trees = V.snapshots(spark, sf).select("seq", "path", "hash")
    return materialize(history.select_changes(trees, V.commits(spark, sf)).select("seq", "path", "hash"), "selected")


def _against_cache(spark, sf):
    """Files, and their contents that a cache of all even-numbered commits does not know."""
    files = _selected_files(spark, sf)
    index = materialize(content.content_index(files), "contents")
    older = content.content_index(files.where(F.col("seq") % 2 == 0))
    filled = cache.cache_entries(older, _content_tallies(spark, sf), sources.ruleset_id(V.RULES))
    path = sinks.save_cache(filled, scratch_path(spark, "cache"))
    known = cache.known_entries(sources.read_cache(spark, path), sources.ruleset_id(V.RULES), index)
    return files, cache.cache_misses(index, known)


@query
def cache_hits(spark, sf):
    return cache.mark_hits(*_against_cache(spark, sf)).where("is_hit").select("seq", "path", "hash")


@query
def cache_misses(spark, sf):
    return _against_cache(spark, sf)[1].select("seq", "path", "hash")


def _content_tallies(spark, sf):
    return scan.rule_tally(scan.scan_contents(V.contents(spark, sf), V.RULES))


def _cache(spark, sf):
    contents = content.content_index(V.snapshots(spark, sf))
    return cache.cache_entries(contents, _content_tallies(spark, sf), sources.ruleset_id(V.RULES))


@query
def cache_backfill(spark, sf):
    files = V.snapshots(spark, sf).select("seq", "path", "hash")
    reported = reports.findings_by_file(files, scan.scan_contents(V.contents(spark, sf), V.RULES))
    return cache.backfill(reported, files)


@query
def cache_load(spark, sf):
    documents = _cache(spark, sf).select(
        F.to_json(
            F.create_map("hash", F.struct("warnings_by_rule", F.col("num_files").alias("num_java_files")))
        ).alias("text")
    )
    loaded = sources.cache_from_json(documents, sources.ruleset_id(V.RULES))
    return loaded.select("hash", "num_files", F.explode_outer("warnings_by_rule").alias("rule", "n"))


@query
def cache_save(spark, sf):
    path = sinks.save_cache(_cache(spark, sf), scratch_path(spark, "cache"))
    return cache.cache_tallies(sources.read_cache(spark, path))


@query
def cache_merge(spark, sf):
    """Every occurrence of a content is a cache version; the latest commit wins."""
    versions = V.snapshots(spark, sf).select(
        "hash",
        F.lit("rules").alias("ruleset_id"),
        F.create_map(F.lit("chars"), F.length("content").cast("bigint") + F.col("seq")).alias("warnings_by_rule"),
        F.lit(1).cast("bigint").alias("num_files"),
        F.col("seq").alias("version"),
    )
    merged = cache.cache_merge(versions, versions)
    return merged.select("hash", "version", F.explode("warnings_by_rule").alias("rule", "n"))


# --- scans ------------------------------------------------------------------


@query
def rule_scan(spark, sf):
    return scan.scan_contents(V.contents(spark, sf), V.RULES).select("hash", "rule", "ruleset", "line")


@query
def rule_scan_table(spark, sf):
    """The same with rules from a user's table, over every file instead of every content."""
    table = spark.createDataFrame(
        [(r.rule, r.ruleset, r.kind, r.pattern, r.threshold, r.message, r.needle, "en" if r.rule == "LongLine" else None) for r in V.RULES], S.RULES
    )
    rules = sources.load_rules(table)
    return scan.rule_scan(V.contents(spark, sf), rules, ["seq", "path"]).select("seq", "path", "rule", "line", "message")


@query
def rule_tally_file(spark, sf):
    return _content_tallies(spark, sf)


@query
def findings_by_commit(spark, sf):
    found = scan.scan_contents(V.contents(spark, sf), V.RULES)
    return reports.findings_by_file(V.snapshots(spark, sf), found).select("seq", "path", "rule", "line")


def unreliable(pattern, rule, ruleset, fail_on):
    """Like ``line_pattern_analyzer``; a file with ``fail_on`` ends the process, or, if it has an odd number of characters, is never done."""

    def factory():
        plain = analyzers.line_pattern_analyzer(pattern, rule, ruleset)()

        def analyzer(batch):
            marked = batch["content"][batch["content"].str.contains(fail_on, regex=False)]
            while any(len(text) % 2 for text in marked):
                time.sleep(1)
            if len(marked):
                os._exit(3)
            return plain(batch)

        return analyzer

    return factory


def _distinct_contents(spark, sf):
    files = V.contents(spark, sf)
    firsts = materialize(content.content_index(files).select("seq", "path"), "firsts")
    return fn.pick_rows(files.select("seq", "path", "hash", "content"), firsts, ["seq", "path"])


@query
def analyzer_udf(spark, sf):
    factory = analyzers.line_pattern_analyzer("[0-9]{3,}", "LongNumber", "numbers")
    outcome = analyzers.analyze(_distinct_contents(spark, sf), factory)
    return analyzers.analyzer_findings(outcome).select("hash", "rule", "ruleset", "line")


@query
def analyzer_errors(spark, sf):
    factory = analyzers.line_pattern_analyzer("[0-9]{3,}", "LongNumber", "numbers", fail_on="@")
    return analyzers.analyzer_errors(analyzers.analyze(_distinct_contents(spark, sf), factory))


@query
def analyzer_supervised(spark, sf):
    """An analyzer that ends its process on some marked files and never returns on others; each costs one error."""
    outcome = analyzers.analyze(_distinct_contents(spark, sf), unreliable("[0-9]{3,}", "LongNumber", "numbers", fail_on="@"), seconds=1.5)
    kind = F.when(F.col("error").contains("longer than"), "hang").when(F.col("error").contains("exit code 3"), "crash").otherwise(F.col("error"))
    return outcome.select("hash", "rule", "line", kind.alias("failure"))


# --- findings and reports ---------------------------------------------------


@query
def rule_key_fallback(spark, sf):
    return reports.tally_fallback(V.findings(spark, sf))


@query
def rule_key_drop(spark, sf):
    return reports.tally_drop(V.findings(spark, sf))


@query
def rule_tally_global(spark, sf):
    """Findings per rule over all files, from counts per content and its number of copies."""
    index = content.content_index(V.snapshots(spark, sf)).select("hash", "n_copies")
    per_content = _content_tallies(spark, sf).join(index, "hash")
    return per_content.groupBy("rule").agg(F.sum(F.col("n") * F.col("n_copies")).alias("n"))


@query
def findings_per_commit(spark, sf):
    return reports.count_per_commit(V.order_commits(spark, sf), V.findings(spark, sf), "n_findings")


@query
def map_merge_sum(spark, sf):
    per_file = reports.tally_fallback(V.findings(spark, sf), "commit", "path")
    maps = reports.count_maps(per_file, ["commit", "path"])
    return reports.merge_maps(maps, ["commit"], "warnings_by_rule")


def _long(documents):
    """Findings of the documents, one row each."""
    found = documents.where(~reports.is_header()).select("commit", F.col("filename").alias("path"), F.explode("violations").alias("v"))
    return found.select("commit", "path", "v.rule", F.col("v.ruleSet").alias("ruleset"), "v.line")


def _with_headers(documents):
    """The same next to the header counts of each commit, one row of nulls for a commit without findings."""
    head = documents.where(reports.is_header()).select(
        "commit", "num_java_files", F.size("warnings_by_rule").cast("bigint").alias("n_rules"), F.aggregate(F.map_values("warnings_by_rule"), F.lit(0).cast("bigint"), lambda a, n: a + n).alias("n_warnings")
    )
    return head.join(_long(documents), "commit", "left")


@query
def nest_reports(spark, sf):
    return _long(reports.nest_reports(_stored_findings(spark, sf)))


@query
def flatten_findings(spark, sf):
    """By rows: every third commit has a list of its own, its first finding, which wins over those of its files."""
    documents = reports.nest_reports(_stored_findings(spark, sf))
    listed = F.coalesce(F.col("commit").cast("bigint") % 3 == 0, F.lit(False))
    first = F.min(F.struct("filename", F.col("violations")[0].alias("v")))["v"]
    own = documents.where(listed).groupBy("commit").agg(F.array(first).alias("warnings"))
    found = reports.flatten_rows(documents.where(~listed), own).withColumn("key", fn.rule_key("rule", "ruleSet"))
    return found.groupBy("commit").agg(F.count(F.lit(1)).alias("n_warnings"), F.min("key").alias("first_rule"), F.max("key").alias("last_rule"))


def _stored_findings(spark, sf):
    """The findings as a table; reports pass over them more than once."""
    return materialize(V.findings(spark, sf), "findings")


def _order_reports(spark, sf):
    log, found = V.order_commits(spark, sf), _stored_findings(spark, sf)
    per_file = reports.tally_fallback(found, "commit", "path")
    tallies = per_file.groupBy("commit", "rule").agg(F.sum("n").alias("n"))
    headers = reports.report_headers(log, per_file.select("commit", "path").distinct(), tallies)
    return reports.commit_reports(headers, found)


@query
def commit_reports(spark, sf):
    return _with_headers(_order_reports(spark, sf))


@query
def sink_reports(spark, sf):
    path = scratch_path(spark, "reports")
    sinks.write_reports(_order_reports(spark, sf), path, compression="gzip")
    return _with_headers(spark.read.schema(S.COMMIT_REPORT_JSON).json(path))


@query
def sink_errors(spark, sf):
    log = V.run_log(spark, sf)
    failed = log.where(runlog.outcome_class(log) == "git_failed")
    path = scratch_path(spark, "errors")
    sinks.write_errors(
        failed.select(F.col("commit").cast("string").alias("commit"), F.lit("checkout failed").alias("error")), path
    )
    return spark.read.schema(S.ERROR_JSON).json(path)


# --- report documents -------------------------------------------------------


def _parsed(spark, sf):
    return sources.parse_reports(V.report_documents(spark, sf))


@query
def report_scan(spark, sf):
    found = sources.explode_findings(sources.adapt_reports(_parsed(spark, sf)), "event_id", "file_name")
    return found.select("event_id", "file_name", "path", "rule", "line")


@query
def report_parse_status(spark, sf):
    """All reports, beside a log that also has orders, which left none."""
    log = V.table(spark, sf, "events").select("event_id").union(V.table(spark, sf, "orders").select("o_orderkey")).distinct()
    return sources.status_of_log(log, sources.adapt_reports(_parsed(spark, sf)), "event_id")


@query
def report_scan_nested(spark, sf):
    """Reports of several files with several findings each, written as JSON documents and read back."""
    path = scratch_path(spark, "nested-reports")
    documents = reports.nest_reports(V.findings(spark, sf))
    parts = documents.groupBy("commit").agg(F.ceil(F.count(F.lit(1)) / 50).alias("parts"))  # a report holds about 50 files
    part = F.pmod(F.xxhash64("filename"), "parts").alias("part")
    whole = documents.join(parts, "commit").groupBy("commit", part).agg(F.collect_list(F.struct("filename", "violations")).alias("files"))
    whole.select(F.to_json(F.struct("commit", "files")).alias("value")).write.text(path)
    parsed = sources.parse_reports(spark.read.text(path).withColumnRenamed("value", "text").withColumn("commit", F.get_json_object("text", "$.commit")))
    found = sources.explode_findings(sources.adapt_reports(parsed), "commit")
    return found.select("commit", "path", "rule", "ruleset", "line")


@query
def report_errors(spark, sf):
    return sources.corrupt_reports(_parsed(spark, sf), "event_id")


@query
def report_metadata(spark, sf):
    meta = sources.report_metadata(_parsed(spark, sf), "event_id")
    return meta.where(F.col("timestamp").isNotNull() | F.col("pmdVersion").isNotNull()).select("event_id", "timestamp", "formatVersion", "pmdVersion", "metrics")


@query
def report_bad_entries(spark, sf):
    return sources.bad_entries(sources.adapt_reports(_parsed(spark, sf)), "event_id")


@query
def field_fallback(spark, sf):
    adapted = sources.adapt_reports(_parsed(spark, sf))
    return adapted.select("event_id", F.explode("files").alias("f")).select("event_id", F.col("f.filename").alias("path"))


@query
def exclude_errors(spark, sf):
    return V.report_documents(spark, sf).where(~sources.is_error_file()).select("event_id", "file_name")


@query
def error_scan(spark, sf):
    return sources.parse_errors(V.error_documents(spark, sf)).select("file_name", "commit", "error")


@query
def json_parse(spark, sf):
    props = F.from_json("props", "k BIGINT")
    return V.table(spark, sf, "events").select("event_id", props["k"].alias("k"))


# --- summaries --------------------------------------------------------------


def _flat_summary(one_row):
    stat = "stat_of_repository"
    return one_row.select(
        F.col(f"{stat}.number_of_commits").alias("number_of_commits"),
        F.col(f"{stat}.avg_of_num_java_files").alias("avg_files"),
        F.col(f"{stat}.avg_of_num_warnings").alias("avg_warnings"),
        F.explode("stat_of_warnings").alias("rule", "n"),
    )


@query
def summary_parallel(spark, sf):
    return _flat_summary(summary.summarize_findings(V.order_commits(spark, sf), V.findings(spark, sf), "orders"))


@query
def summary_json(spark, sf):
    """Documents written, read back and summarized, the summary written and read back."""
    documents, out = scratch_path(spark, "reports"), scratch_path(spark, "summary")
    sinks.write_reports(_order_reports(spark, sf), documents)
    stored = spark.read.schema(S.COMMIT_REPORT_JSON).json(documents)
    sinks.write_summary(summary.summarize_reports(stored, "orders"), out)
    text = spark.read.text(out)
    return _flat_summary(text.select(F.from_json("value", S.SUMMARY_JSON).alias("s")).select("s.*"))


def _outcomes(spark, sf):
    log = V.run_log(spark, sf).select(F.col("commit").cast("string").alias("commit"), "ok", (F.col("code") != -1).alias("checked_out"))
    files = V.table(spark, sf, "lineitem").select(F.col("l_orderkey").cast("string").alias("commit"), "l_partkey").distinct()
    return log.join(reports.count_per_commit(log, files, "n_files"), "commit")


@query
def summary_sequential(spark, sf):
    return summary.sequential_stats(_outcomes(spark, sf), V.findings(spark, sf))


@query
def summary_sequential_tally(spark, sf):
    return summary.sequential_tally(_outcomes(spark, sf), V.findings(spark, sf))


@query
def round_means(spark, sf):
    cents = F.round(F.col("o_totalprice") * 100).cast("bigint")
    sums = V.table(spark, sf, "orders").groupBy("o_orderstatus", "o_orderpriority").agg(
        F.sum(cents).alias("cents"), F.count(F.lit(1)).alias("n")
    )
    return sums.select("o_orderstatus", "o_orderpriority", F.round(fn.safe_ratio("cents", "n"), 2).alias("mean_cents"))


@query
def safe_ratio(spark, sf):
    counts = V.findings(spark, sf).groupBy("commit").agg(
        F.count(F.lit(1)).alias("n_findings"), F.count_if(F.col("rule") != "").alias("n_named")
    )
    joined = V.order_commits(spark, sf).join(counts, "commit", "left")
    return joined.select("commit", fn.safe_ratio("n_named", "n_findings").alias("named_share"))


@query
def run_stamp(spark, sf):
    return V.table(spark, sf, "orders").select("o_orderkey", fn.run_stamp("o_orderdate").alias("stamp"))


# --- run log ----------------------------------------------------------------


@query
def exit_ok(spark, sf):
    return V.run_log(spark, sf).where(runlog.exit_ok()).select("commit", "code")


@query
def slow_commits(spark, sf):
    return V.run_log(spark, sf).where(runlog.is_slow()).select("commit", "duration_ms")


@query
def outcome_counts(spark, sf):
    return runlog.outcome_counts(V.run_log(spark, sf))


@query
def error_codes(spark, sf):
    return runlog.error_codes(V.run_log(spark, sf))


@query
def run_stats(spark, sf):
    return runlog.run_stats(V.run_log(spark, sf))


@query
def progress_checkpoints(spark, sf):
    return runlog.progress_checkpoints(V.run_log(spark, sf), "commit", every=200)


def _results_and_errors(spark, sf):
    log = V.run_log(spark, sf)
    return log, log.where("ok"), log.where(F.col("code") == -1)


@query
def done_commits(spark, sf):
    _, results, errors = _results_and_errors(spark, sf)
    return runlog.done_commits(results, errors)


@query
def resume_pending(spark, sf):
    return runlog.pending_commits(*_results_and_errors(spark, sf)).select("commit", "code")


# --- streams ----------------------------------------------------------------


@query
def stream_ingest(spark, sf):
    """Documents as deliveries of reports in several micro-batches, run twice: the second run finds nothing new."""
    table, checkpoint = scratch_path(spark, "ingested"), scratch_path(spark, "ingest-checkpoint")
    arriving = V.deliveries(V.snapshots(spark, sf).select(F.col("hash").alias("commit"), F.length("content").cast("bigint").alias("n_chars")))
    for _ in range(2):
        streaming.ingest_reports(arriving(), table, checkpoint)
    return spark.read.parquet(table).select("commit", "n_chars")


@query
def stream_rule_tally(spark, sf):
    table = scratch_path(spark, "tally")
    arriving = V.deliveries(V.snapshots(spark, sf).select("hash", "content"))
    streaming.running_tally(arriving(), V.RULES, table, scratch_path(spark, "tally-checkpoint"))
    return latest_tally(spark, table)


@query
def stream_dedup(spark, sf):
    """Contents in several micro-batches, then all of them again under another checkpoint."""
    table = scratch_path(spark, "contents")
    arriving = V.deliveries(V.snapshots(spark, sf).select("hash", F.lit(sources.ruleset_id(V.RULES)).alias("ruleset_id")))
    for _ in range(2):
        streaming.dedup_contents(arriving(), table, scratch_path(spark, "contents-checkpoint"))
    return spark.read.parquet(table).select("hash")


# --- whole runs -------------------------------------------------------------


def _mine(spark, sf, snapshots=V.snapshots, **options):
    return plans.mine_history(V.commits(spark, sf), snapshots(spark, sf).drop("hash"), V.RULES, **options)


@query
def mine_history(spark, sf):
    return _mine(spark, sf).commits


@query
def mine_history_by_rule(spark, sf):
    return _mine(spark, sf).by_rule.select("seq", "rule", "findings", "fresh")


@query
def mine_history_summary(spark, sf):
    one_row = _mine(spark, sf, renames="none").summary("documents")
    flat = _flat_summary(one_row)
    means = one_row.select("avg_files_changed", "avg_files_in_tree")
    return flat.select("*", *[means.select(c).scalar().alias(c) for c in means.columns])


@query
def mine_history_reports(spark, sf):
    return _with_headers(_mine(spark, sf).reports())


def _halves(spark, sf):
    """A run over the older half of the log, stored, and one over all of it that resumes and reuses the first."""
    log, trees = V.commits(spark, sf), V.snapshots(spark, sf).drop("hash")
    middle = log.agg((F.max("seq") / 2).cast("bigint").alias("seq")).scalar()
    first = plans.mine_history(log.where(F.col("seq") <= middle), trees, V.RULES)
    store = first.write(scratch_path(spark, "runs"), "documents")
    second = plans.mine_history(log, trees, V.RULES, cache=store.cache(), earlier_findings=store.findings(), done=store.done())
    second.write(store.root, "documents")
    return store


@query
def mine_history_warm(spark, sf):
    """The whole history once more with a full cache: nothing is scanned, documents are complete."""
    store = _mine(spark, sf).write(scratch_path(spark, "runs"), "documents")
    return _with_headers(_mine(spark, sf, cache=store.cache(), earlier_findings=store.findings()).reports())


@query
def mine_history_resumed(spark, sf):
    return _halves(spark, sf).commits()


@query
def mine_history_resumed_summary(spark, sf):
    """What the second run left as the summary of both."""
    summary_text = _halves(spark, sf).stored_summary()
    return _flat_summary(summary_text.select(F.from_json("value", S.SUMMARY_JSON).alias("s")).select("s.*"))


def _killed(spark, sf):
    """A run in stages that is lost after two of them, in the middle of writing the third, and called again."""
    log, trees = V.commits(spark, sf), V.snapshots(spark, sf).drop("hash")
    store = plans.RunStore(spark, scratch_path(spark, "runs"))
    every = -(-log.count() // 4)
    plans.mine_in_stages(log, trees, V.RULES, store=store, location="documents", every=every, stages=2)
    lost = plans.mine_history(log, trees, V.RULES, done=store.done())
    lost.commits.write.parquet(f"{store.root}/commits/run=lost")
    lost.fresh_cache.write.parquet(f"{store.root}/cache/run=lost")
    plans.mine_in_stages(log, trees, V.RULES, store=store, location="documents", every=every)
    return store


@query
def mine_history_killed(spark, sf):
    return _killed(spark, sf).commits()


@query
def mine_history_killed_reports(spark, sf):
    return _with_headers(_killed(spark, sf).reports())


@query
def mine_history_repeated(spark, sf):
    """One log written twice: every commit counts once, from the later run."""
    store = _mine(spark, sf).write(scratch_path(spark, "runs"), "documents")
    _mine(spark, sf).write(store.root, "documents")
    return _flat_summary(store.summary("documents"))


@query
def mine_history_metadata(spark, sf):
    """Fields of the analyzer's own report per commit, through a stored run, in the headers of its documents."""
    tool = F.when(F.col("seq") % 3 != 0, F.to_json(F.struct((F.col("seq") % 5).alias("formatVersion"), F.concat(F.lit("7."), "seq").alias("pmdVersion"), F.concat(F.lit("t"), "seq").alias("timestamp"))))
    parsed = sources.parse_reports(V.commits(spark, sf).select("commit", F.coalesce(tool, F.lit("")).alias("text")))
    store = _mine(spark, sf, metadata=sources.report_metadata(parsed, "commit")).write(scratch_path(spark, "runs"), "documents")
    return store.reports().where(reports.is_header()).select("commit", "num_java_files", *S.METADATA_FIELDS)


@query
def mine_history_analyzer(spark, sf):
    factory = analyzers.line_pattern_analyzer("[0-9]{3,}", "LongNumber", "numbers", fail_on="@")
    run = _mine(spark, sf, V.contents, analyzer=factory, analyzer_id="numbers")
    counted = run.commits.select("commit", "findings", F.lit(None).cast("string").alias("error"))
    failed = run.errors.select("commit", F.lit(None).cast("bigint").alias("findings"), "error")
    return counted.unionByName(failed)


@query
def mine_history_outcomes(spark, sf):
    factory = analyzers.line_pattern_analyzer("[0-9]{3,}", "LongNumber", "numbers", fail_on="@")
    return _mine(spark, sf, V.contents, analyzer=factory, analyzer_id="numbers").outcomes()


def _mine_full_tree(spark, sf):
    return plans.mine_full_tree(V.commits(spark, sf), V.contents(spark, sf), V.RULES)


@query
def mine_full_tree(spark, sf):
    return _mine_full_tree(spark, sf).commits.select("seq", "commit", "files_in_tree", "findings")


@query
def mine_full_tree_by_rule(spark, sf):
    return _mine_full_tree(spark, sf).by_rule


@query
def mine_full_tree_failures(spark, sf):
    """Trees reach beyond the log, some commits cannot be checked out, and an analyzer fails on some files."""
    commits = V.commits(spark, sf)
    log = commits.where(F.col("seq") < commits.agg(F.max("seq")).scalar()).withColumn("checked_out", F.col("seq") % 7 != 3)
    files = V.contents(spark, sf).where(F.col("seq") % 7 != 3)
    factory = analyzers.line_pattern_analyzer("[0-9]{3,}", "LongNumber", "numbers", fail_on="@")
    run = plans.mine_full_tree(log, files, analyzer=factory)
    one_row = run.summary("documents").select("stat_of_repository.*", F.col("stat_of_warnings")["LongNumber"].alias("long_numbers"))
    failed = run.commits.where(~F.col("ok")).join(run.errors.select("seq", "error"), "seq", "left").select("seq", "files_in_tree", "error")
    return failed.join(F.broadcast(one_row), how="cross")  # the one row of the summary beside each


@query
def mine_full_tree_summary(spark, sf):
    stat = "stat_of_repository"
    return _mine_full_tree(spark, sf).summary("documents").select(
        F.col(f"{stat}.number_of_commits_analyzed").alias("n_commits"),
        F.col(f"{stat}.avg_of_num_java_files").alias("avg_files"),
        F.col(f"{stat}.avg_of_num_warnings").alias("avg_warnings"),
        F.explode("stat_of_warnings").alias("rule", "n"),
    )
