"""Whole mining runs: which files, which contents, which findings, which reports."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window, functions as F

from historymine.functions.ordinals import running_totals
from historymine.functions.scalars import has_suffix, safe_ratio
from historymine.functions.skew import pick_rows, spread_join
from historymine.operators.analyzers import Analyzer, analyze, analyzer_errors, analyzer_findings
from historymine.operators.cache import (
    cache_entries,
    cache_merge,
    cache_misses,
    cache_tallies,
    known_entries,
    mark_hits,
)
from historymine.operators.content import content_index
from historymine.operators.history import ADDED, DELETED, UNCHANGED, select_changes, snapshot_diff
from historymine.operators.reports import commit_reports, count_maps, fan_counts, findings_by_file
from historymine.operators.scan import rule_tally, scan_contents
from historymine.operators.summary import files_in_tree, parallel_stats
from historymine.schema import METADATA_FIELDS
from historymine.session import materialize
from historymine.plans.store import RunStore
from historymine.sources.rules import Rule, ruleset_id
from historymine.sources.snapshots import with_hash


ANALYZER_SECONDS = 600.0  # per call
COMMITS_PER_BLOCK = 1024  # of the running sums per rule


@dataclass
class MiningRun:
    """Results of a run; every field is a DataFrame, computed when it is used.

    files      analyzed files ``(seq, path, hash, is_hit)``, a stored table
    findings   ``(hash, rule, ruleset, line, message)`` of the contents scanned in this run
    by_rule    ``(seq, rule, findings, fresh, ...)`` per commit
    commits    one row of counts per commit, failed commits left out
    cache      the cache to start the next run with
    fresh_cache  the entries that this run adds to it
    identity   the rule set or analyzer that the entries belong to
    errors     ``(seq, commit, error)`` of the failed commits; None where nothing can fail
    earlier    findings of earlier runs for the contents that came from the cache, if they were given
    metadata   ``commit`` and the metadata fields that the analyzer's own reports carried, if they were given
    """

    files: DataFrame
    findings: DataFrame
    by_rule: DataFrame
    commits: DataFrame
    cache: DataFrame
    fresh_cache: DataFrame
    identity: str
    errors: DataFrame | None
    earlier: DataFrame | None = None
    metadata: DataFrame | None = None

    def summary(self, location: str, include_cached: bool = True) -> DataFrame:
        """Repository summary; without cached findings it covers what this run scanned itself."""
        return summarize_commits(self.commits, self.by_rule, location, include_cached)

    def outcomes(self) -> DataFrame:
        """``(seq, commit, outcome)`` of every commit of the run: success, skipped for want of changes, or analyzer_failed."""
        done = F.when(F.col("files_changed") == 0, "skipped").otherwise("success")
        reported = self.commits.select("seq", "commit", done.alias("outcome"))
        if self.errors is None:
            return reported
        return reported.unionByName(self.errors.select("seq", "commit", F.lit("analyzer_failed").alias("outcome")))

    def reports(self) -> DataFrame:
        """A header document per commit and a document per file with findings, see ``commit_reports``.

        Findings of contents that came from the cache are in the documents if the
        run was given ``earlier_findings``; the counts in the headers have them in any case.
        """
        maps = count_maps(self.by_rule.select("seq", "rule", F.col("findings").alias("n")), ["seq"])
        headers = self.commits.join(maps, "seq", "left").select(
            "commit",
            F.col("files_changed").alias("num_java_files"),
            F.coalesce("warnings_by_rule", F.create_map().cast("MAP<STRING,BIGINT>")).alias("warnings_by_rule"),
        )
        files = spread_join(self.files, self.commits.select("seq", "commit"), ["seq"], ["path"], within=self.files)
        findings = self.findings if self.earlier is None else self.findings.unionByName(self.earlier)
        if self.metadata is None:
            return commit_reports(headers, findings_by_file(files, findings, "commit", within=self.files))
        headers = headers.join(self.metadata.select("commit", *METADATA_FIELDS), "commit", "left")
        return commit_reports(headers, findings_by_file(files, findings, "commit", within=self.files), METADATA_FIELDS)

    def write(self, root: str, location: str) -> RunStore:
        """Add this run to the results below ``root``, see ``RunStore``; a later run wins where both have a commit."""
        store = RunStore(self.commits.sparkSession, root)
        store.append(self, location)
        return store


def summarize_commits(commits: DataFrame, by_rule: DataFrame, location: str, include_cached: bool = True) -> DataFrame:
    """Repository summary from rows per commit, and per commit and rule."""
    files, found = ("files_reported", "findings") if include_cached else ("files_fresh", "findings_fresh")
    stats = commits.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(files).alias("reported"),
        F.sum(found).alias("found"),
        F.sum("files_changed").alias("changed"),
        F.sum("files_in_tree").alias("in_tree"),
    )
    per_rule = by_rule.groupBy("rule").agg(F.sum("findings" if include_cached else "fresh").alias("n"))
    rules = count_maps(per_rule.where(F.col("n") > 0), [], "m").select("m").scalar()
    return stats.select(
        F.lit(location).alias("location"),
        parallel_stats("n", "reported", "found").alias("stat_of_repository"),
        rules.alias("stat_of_warnings"),
        safe_ratio("changed", "n").alias("avg_files_changed"),
        safe_ratio("in_tree", "n").alias("avg_files_in_tree"),
    )


def _scan(
    snapshots: DataFrame, wanted: DataFrame, rules: Iterable[Rule] | None, analyzer: Callable[[], Analyzer] | None, seconds: float | None
) -> tuple[DataFrame, DataFrame | None]:
    """Findings, and errors of a Python analyzer, for the wanted first occurrences."""
    if analyzer is None:
        return scan_contents(snapshots, rules, wanted), None
    # an analyzer costs more than a shuffle: give it every content exactly once
    outcome = materialize(analyze(pick_rows(snapshots, wanted, ["seq", "path"]), analyzer, seconds=seconds), "outcome")
    return analyzer_findings(outcome), analyzer_errors(outcome)


def _hashed(snapshots: DataFrame) -> DataFrame:
    """``(seq, path, hash)``, stored: the contents are read once for their hashes."""
    return materialize(with_hash(snapshots).select("seq", "path", "hash"), "trees")


def _identity(rules: Iterable[Rule], analyzer: Callable[[], Analyzer] | None, analyzer_id: str | None) -> str:
    """What cache entries belong to."""
    if analyzer is None:
        return ruleset_id(rules)
    if analyzer_id is None:
        raise ValueError("analyzer_id is needed to key the cache of an analyzer")
    return analyzer_id


def mine_history(
    log: DataFrame,
    snapshots: DataFrame,
    rules: Iterable[Rule] = (),
    *,
    suffix: str = ".java",
    renames: str = "exact",
    cache: DataFrame | None = None,
    cache_version: int | None = None,
    earlier_findings: DataFrame | None = None,
    metadata: DataFrame | None = None,
    done: DataFrame | None = None,
    trees: DataFrame | None = None,
    analyzer: Callable[[], Analyzer] | None = None,
    analyzer_id: str | None = None,
    analyzer_seconds: float | None = ANALYZER_SECONDS,
) -> MiningRun:
    """Analyze what each commit changed, every distinct content once.

    ``log`` is ``(seq, commit)`` with ``seq`` dense from 0, ``snapshots`` is
    ``(seq, path, content)``, with ``hash`` if it is stored. Only keys, hashes
    and counts are shuffled; contents are read where they lie.

    ``cache`` holds results of earlier runs, ``done`` the commits they reported
    or failed on: those are skipped, and trees older than needed are not read.
    ``trees`` is ``(seq, path, hash)`` of the snapshots, stored, where contents were read for their hashes before.
    ``earlier_findings`` are the findings by content that earlier runs stored; with
    them the documents of cached contents are complete. ``metadata`` (``report_metadata`` per
    commit) goes into the headers of the documents. New cache entries get
    ``cache_version``, one above the highest stored version unless it is given.
    Trees of commits that are not in the log are left out.

    An ``analyzer`` runs in a process of its own per task, at most ``analyzer_seconds``
    per call of up to 32 files; None runs it inside the task.
    """
    rules = list(rules)
    identity = _identity(rules, analyzer, analyzer_id)
    pending = log
    needed = F.col("seq").between(0, log.agg(F.max("seq").alias("seq")).scalar())
    if done is not None:
        pending = materialize(log.join(done.select("commit"), "commit", "left_anti"), "pending")
        needed = needed & (F.col("seq") >= pending.agg((F.min("seq") - 1).alias("seq")).scalar())
    snapshots = snapshots.where(needed)
    if trees is not None:
        trees = trees.where(needed).select("seq", "path", "hash")
    elif "hash" in snapshots.columns:
        trees = snapshots.select("seq", "path", "hash")
    else:
        trees = _hashed(snapshots)
    snapshots = with_hash(snapshots)

    changes = select_changes(trees, log, suffix, renames).select("seq", "path", "hash")
    if done is not None:
        changes = materialize(changes, "kept-changes")
        changes = spread_join(changes, pending.select("seq"), ["seq"], ["path"], within=changes)
    selected = materialize(changes, "selected")
    misses = index = materialize(content_index(selected), "contents")
    known = None
    if cache is not None:
        known = materialize(known_entries(cache, identity, index), "known")
        misses = materialize(cache_misses(index, known), "misses")
    files = materialize(mark_hits(selected, misses), "files")

    scannable = snapshots.where(has_suffix("path", suffix)).select("seq", "path", "hash", "content", *(["lang"] if "lang" in snapshots.columns else []))
    found, failed = _scan(scannable, misses, rules, analyzer, analyzer_seconds)
    findings = materialize(found, "findings")
    tallies = rule_tally(findings)

    scanned, errors = misses, None
    if failed is not None:
        scanned = misses.join(failed, "hash", "left_anti")
        errors = _commit_errors(pending, files, failed)
    if cache_version is None:
        cache_version = 0 if cache is None else 1 + (cache.agg(F.max("version")).first()[0] or 0)
    fresh_cache = cache_entries(scanned, tallies, identity, cache_version)
    new_cache = fresh_cache if cache is None else cache_merge(cache, fresh_cache)
    earlier = None
    if known is not None:
        tallies = tallies.unionByName(cache_tallies(known))
        if earlier_findings is not None:
            columns = ["hash", "rule", "ruleset", "line", "message"]
            earlier = pick_rows(earlier_findings.select(*columns), known, ["hash"])

    by_rule, reported = fan_counts(files, tallies, within=files), pending
    if errors is not None:
        by_rule, reported = by_rule.join(errors, "seq", "left_anti"), pending.join(errors, "seq", "left_anti")
    by_rule = materialize(by_rule, "by-rule")
    return MiningRun(
        files=files,
        findings=findings,
        by_rule=by_rule,
        commits=_commit_counts(reported, trees, files, by_rule, suffix),
        cache=new_cache,
        fresh_cache=fresh_cache,
        identity=identity,
        errors=errors,
        earlier=earlier,
        metadata=metadata,
    )


def mine_in_stages(
    log: DataFrame,
    snapshots: DataFrame,
    rules: Iterable[Rule] = (),
    *,
    store: RunStore,
    location: str,
    every: int = 200,
    stages: int | None = None,
    analyzer: Callable[[], Analyzer] | None = None,
    analyzer_id: str | None = None,
    **options,
) -> int:
    """``mine_history`` over the next ``every`` commits at a time, each stage stored when it is done; returns the stages run.

    A run that is lost loses its last stage: called again with the same ``store``,
    it goes on after the last finished one. A stage reads the trees of its own commits and
    the one before them, and the stored cache. ``stages`` stops after so many. The log is read once per
    call, and so are contents without a hash, those of all commits that the call comes to.
    Later stages cost a listing of the earlier ones; ``store.compact_cache`` folds their caches.
    """
    rules = list(rules)
    identity = _identity(rules, analyzer, analyzer_id)
    log = materialize(log, "log")
    trees = options.pop("trees", None)
    ran = 0
    while stages is None or ran < stages:
        done = store.done()
        ahead = log.join(done, "commit", "left_anti").select("seq")
        upto = ahead.orderBy("seq").limit(every).agg(F.max("seq")).first()[0]
        if upto is None:
            break
        if trees is None and "hash" not in snapshots.columns:
            reached = ahead if stages is None else ahead.orderBy("seq").limit(stages * every)
            oldest, newest = reached.agg(F.min("seq") - 1, F.max("seq")).first()
            trees = _hashed(snapshots.where(F.col("seq").between(oldest, newest)))
        run = mine_history(
            log.where(F.col("seq") <= upto),
            snapshots,
            rules,
            cache=store.cache(identity),
            cache_version=store.next_position(),
            earlier_findings=store.findings(identity),
            done=done,
            trees=trees,
            analyzer=analyzer,
            analyzer_id=analyzer_id,
            **options,
        )
        store.append(run, location)
        ran += 1
    return ran


def _commit_errors(log: DataFrame, files: DataFrame, failed: DataFrame) -> DataFrame:
    """``(seq, commit, error)``: commits with a file whose analysis failed, naming the first such file."""
    placed = spread_join(files.select("seq", "path", "hash"), failed, ["hash"], ["seq", "path"])
    first = placed.groupBy("seq").agg(F.min(F.struct("path", "error")).alias("_e"))
    return first.join(log.select("seq", "commit"), "seq").select(
        "seq", "commit", F.concat_ws(": ", "_e.path", "_e.error").alias("error")
    )


def _commit_counts(log: DataFrame, trees: DataFrame, files: DataFrame, by_rule: DataFrame, suffix: str) -> DataFrame:
    """One row per commit of the log; a commit without changes or findings counts 0."""
    changed = files.groupBy("seq").agg(
        F.count(F.lit(1)).alias("files_changed"), F.count_if("is_hit").alias("cache_hits")
    )
    found = by_rule.groupBy("seq").agg(
        F.sum("files").alias("files_reported"),
        F.sum("fresh_files").alias("files_fresh"),
        F.sum("findings").alias("findings"),
        F.sum("fresh").alias("findings_fresh"),
    )
    joined = (
        log.select("seq", "commit")
        .join(files_in_tree(log, trees, suffix).withColumnRenamed("n_files", "files_in_tree"), "seq")
        .join(changed, "seq", "left")
        .join(found, "seq", "left")
    )
    zero = lambda name: F.coalesce(name, F.lit(0)).alias(name)
    return joined.select(
        "seq",
        "commit",
        "files_in_tree",
        zero("files_changed"),
        zero("cache_hits"),
        (F.coalesce("files_changed", F.lit(0)) - F.coalesce("cache_hits", F.lit(0))).alias("cache_misses"),
        zero("files_reported"),
        zero("files_fresh"),
        zero("findings"),
        zero("findings_fresh"),
        (F.coalesce("findings", F.lit(0)) - F.coalesce("findings_fresh", F.lit(0))).alias("findings_cached"),
    )


@dataclass
class FullTreeRun:
    """Every file of every commit, as running sums over what changed.

    commits  ``seq, commit, files_in_tree, findings, ok`` per commit, failed ones with what is known of them
    changes  ``seq, rule, change``: by how much a rule's findings differ from those of the commit before
    errors   ``seq, commit, error`` of the commits with a file that could not be analyzed; None where nothing can fail
    """

    commits: DataFrame
    changes: DataFrame
    errors: DataFrame | None = None

    @property
    def by_rule(self) -> DataFrame:
        """``(seq, rule, findings)`` of the analyzed commits, where there are any; a row per commit and rule."""
        block = F.expr(f"seq div {COMMITS_PER_BLOCK}")
        held = self.changes.groupBy("rule", block.alias("block")).agg(F.sum("change").alias("change"))
        life = Window.partitionBy("rule").orderBy("block")  # a row per block of commits
        last = F.expr(f"last_seq div {COMMITS_PER_BLOCK}")
        spans = held.join(self.commits.agg(F.max("seq").alias("last_seq")), how="cross").select(  # one row beside each
            "rule", "block", "last_seq", F.coalesce(F.lead("block").over(life) - 1, last).alias("until"), (F.sum("change").over(life) - F.col("change")).alias("before"), "change"
        )
        blocks = spans.select("rule", "last_seq", F.explode(F.sequence("block", "until")).alias("at"), F.when(F.col("at") == F.col("block"), F.col("before")).otherwise(F.col("before") + F.col("change")).alias("carried"))
        first = F.col("at") * COMMITS_PER_BLOCK
        seqs = F.explode(F.sequence(first, F.least(first + COMMITS_PER_BLOCK - 1, F.col("last_seq")))).alias("seq")
        rows = blocks.select("rule", "at", "carried", seqs).join(self.changes, ["seq", "rule"], "left")
        inside = Window.partitionBy("rule", "at").orderBy("seq")
        totals = rows.select("seq", "rule", (F.col("carried") + F.coalesce(F.sum("change").over(inside), F.lit(0))).alias("findings")).where(F.col("findings") > 0)
        return totals if self.errors is None else totals.join(self.commits.where("ok").select("seq"), "seq")

    def summary(self, location: str) -> DataFrame:
        """Repository summary with means rounded to two decimals: files over the commits checked out, findings over those analyzed.

        Zeros if no commit was analyzed. A rule's findings over all analyzed commits are its
        changes, each times the analyzed commits that come no earlier.
        """
        stats = self.commits.agg(
            F.count_if("ok").alias("analyzed"),
            F.count(F.lit(1)).alias("total"),
            F.count("files_in_tree").alias("seen"),
            F.sum("files_in_tree").alias("files"),
            F.sum(F.when(F.col("ok"), F.col("findings"))).alias("found"),
        )
        any_ok = F.col("analyzed") > 0
        upto = running_totals(self.commits.select("seq", F.col("ok").cast("bigint").alias("upto"), F.col("ok").cast("bigint").alias("own")), "seq", ["upto"])
        all_ok = self.commits.agg(F.count_if("ok")).scalar()
        later = upto.select("seq", (all_ok - F.col("upto") + F.col("own")).alias("commits"))
        per_rule = self.changes.join(later, "seq").groupBy("rule").agg(F.sum(F.col("change") * F.col("commits")).alias("n"))
        return stats.select(
            F.lit(location).alias("location"),
            F.struct(
                F.col("analyzed").alias("number_of_commits_analyzed"),
                F.col("total").alias("total_commits_in_repo"),
                F.when(any_ok, F.round(safe_ratio("files", "seen"), 2)).otherwise(0.0).alias("avg_of_num_java_files"),
                F.when(any_ok, F.round(safe_ratio("found", "analyzed"), 2)).otherwise(0.0).alias("avg_of_num_warnings"),
            ).alias("stat_of_repository"),
            count_maps(per_rule.where(F.col("n") > 0), [], "m").select("m").scalar().alias("stat_of_warnings"),
        )


def mine_full_tree(
    log: DataFrame,
    snapshots: DataFrame,
    rules: Iterable[Rule] = (),
    *,
    suffix: str = ".java",
    analyzer: Callable[[], Analyzer] | None = None,
    analyzer_seconds: float | None = ANALYZER_SECONDS,
) -> FullTreeRun:
    """Analyze the whole tree of every commit of the log, ``(seq, commit)`` with ``seq`` dense from 0.

    Each distinct content is analyzed once. What a commit holds is what the one
    before held, less the findings of files that went, plus those of files that
    came: only changes are joined with findings, and running sums do the rest, so
    rows are in proportion to changes, not to commits times files. Trees of commits
    that are not in the log are left out.

    A commit with a file that the analyzer fails on is not ``ok``. So is one that a
    boolean column ``checked_out`` of the log denies; its files are unknown.
    """
    newest = log.agg(F.max("seq").alias("seq")).scalar()
    snapshots = snapshots.where(F.col("seq").between(0, newest) & has_suffix("path", suffix))
    trees = with_hash(snapshots).select("seq", "path", "hash")
    if "hash" not in snapshots.columns:
        trees = materialize(trees, "trees")  # read the contents once for their hashes
    changes = materialize(snapshot_diff(trees, log).where(F.col("kind") != UNCHANGED), "changes")

    index = materialize(content_index(changes.where("hash is not null").select("seq", "path", "hash")), "contents")
    found, failed = _scan(with_hash(snapshots), index, rules, analyzer, analyzer_seconds)
    tallies = rule_tally(materialize(found, "findings"))

    sides = F.array(F.struct(F.col("hash"), F.lit(1).alias("sign")), F.struct(F.col("prev_hash").alias("hash"), F.lit(-1).alias("sign")))
    signed = changes.select("seq", F.explode(sides).alias("_s")).select("seq", "_s.*").where("hash is not null")
    copies = materialize(signed.groupBy("seq", "hash").agg(F.sum("sign").alias("copies")).where("copies <> 0"), "copies")
    by_change = spread_join(copies, tallies, ["hash"], ["seq"]).groupBy("seq", "rule").agg(F.sum(F.col("copies") * F.col("n")).alias("change"))
    by_change = materialize(by_change.where("change <> 0"), "rule-changes")

    files = changes.groupBy("seq").agg((F.count_if(F.col("kind") == ADDED) - F.count_if(F.col("kind") == DELETED)).alias("files_in_tree"))
    findings = by_change.groupBy("seq").agg(F.sum("change").alias("findings"))
    values = ["files_in_tree", "findings"]
    rows = log.join(files, "seq", "left").join(findings, "seq", "left")
    if failed is not None:
        bad = spread_join(copies, failed.select("hash"), ["hash"], ["seq"]).groupBy("seq").agg(F.sum("copies").alias("bad"))
        rows, values = rows.join(bad, "seq", "left"), [*values, "bad"]
    seen = F.col("checked_out") if "checked_out" in log.columns else F.lit(True)
    rows = rows.select("seq", "commit", seen.alias("seen"), *[F.coalesce(v, F.lit(0)).alias(v) for v in values])
    totals = running_totals(rows, "seq", values)
    ok = F.col("seen") if failed is None else F.col("seen") & (F.col("bad") == 0)
    known = F.when(F.col("seen"), F.col("files_in_tree")).alias("files_in_tree")
    commits = materialize(totals.select("seq", "commit", known, "findings", ok.alias("ok")), "commits")
    errors = None if failed is None else _commit_errors(log, trees, failed)
    return FullTreeRun(commits, by_change, errors)
