"""Repository summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from historymine.functions.scalars import has_suffix, rule_key, safe_ratio
from historymine.operators.reports import count_per_commit, is_header, tally_drop, tally_fallback
from historymine.session import materialize


def files_in_tree(commits: DataFrame, trees: DataFrame, suffix: str = ".java") -> DataFrame:
    """``(seq, n_files)``; a commit with an empty tree counts 0."""
    return count_per_commit(commits, trees.where(has_suffix("path", suffix)), "n_files", key="seq")


def files_changed(commits: DataFrame, files: DataFrame, compat_double_count: bool = False) -> DataFrame:
    """``(seq, n_files)`` of the analyzed changes.

    With ``compat_double_count`` every cache hit counts twice, as earlier tools
    reported it; this needs the column ``is_hit``.
    """
    weight = F.when(F.col("is_hit"), 2).otherwise(1) if compat_double_count else F.lit(1)
    counts = files.groupBy("seq").agg(F.sum(weight).alias("n_files"))
    return commits.select("seq").join(counts, "seq", "left").select("seq", F.coalesce("n_files", F.lit(0)).alias("n_files"))


# The field names of the summaries are those that earlier tools wrote.
def _stat_of_repository(**fields: Column) -> Column:
    return F.struct(*[value.alias(name) for name, value in fields.items()])


def _with_rule_map(stats: DataFrame, tally: DataFrame, location: str) -> DataFrame:
    """One row ``location, stat_of_repository, stat_of_warnings``; the map has an entry per rule."""
    entries = F.sort_array(F.collect_list(F.struct("rule", "n")))
    rules = tally.agg(F.map_from_entries(entries).alias("m")).scalar()
    return stats.select(F.lit(location).alias("location"), "stat_of_repository", rules.alias("stat_of_warnings"))


def parallel_stats(n_commits: str, n_files: str, n_findings: str) -> Column:
    return _stat_of_repository(
        number_of_commits=F.col(n_commits),
        avg_of_num_java_files=safe_ratio(n_files, n_commits),
        avg_of_num_warnings=safe_ratio(n_findings, n_commits),
    )


def summarize_findings(commits: DataFrame, findings: DataFrame, location: str) -> DataFrame:
    """Summary over commits and long-form findings, without building documents."""
    per_file = materialize(tally_fallback(findings, "commit", "path"), "per-file")  # the one pass over the findings
    n_files = per_file.select("commit", "path").distinct().agg(F.count(F.lit(1)).alias("n")).scalar()
    n_findings = per_file.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).scalar()
    stats = commits.agg(F.count(F.lit(1)).alias("c")).select("c", n_files.alias("f"), n_findings.alias("w"))
    tally = per_file.groupBy("rule").agg(F.sum("n").alias("n"))
    return _with_rule_map(stats.select(parallel_stats("c", "f", "w").alias("stat_of_repository")), tally, location)


def summarize_reports(reports: DataFrame, location: str) -> DataFrame:
    """Summary over the documents of ``commit_reports``, placeholders included; whole documents go through ``split_documents`` first.

    The documents are parsed once; what follows reads a tally per commit and file.
    """
    rules = F.transform("violations", lambda v: rule_key(v["rule"], v["ruleSet"]))
    slim = materialize(reports.select(is_header().alias("is_head"), rules.alias("rules")), "slim-reports")
    stats = slim.agg(F.count_if("is_head").alias("c"), F.count_if(~F.col("is_head")).alias("f"), F.coalesce(F.sum(F.size(F.coalesce("rules", F.array()))), F.lit(0)).alias("w"))
    tally = slim.select(F.explode("rules").alias("rule")).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))
    return _with_rule_map(stats.select(parallel_stats("c", "f", "w").alias("stat_of_repository")), tally, location)


def sequential_stats(outcomes: DataFrame, findings: DataFrame) -> DataFrame:
    """One row of means with their own denominators: files over commits checked out, findings over
    commits analyzed; all 0 if none was analyzed.

    ``outcomes`` has ``commit, ok, checked_out, n_files``.
    """
    counted = findings.groupBy("commit").agg(F.count(F.lit(1)).alias("n_findings"))
    sums = outcomes.join(counted, "commit", "left").agg(
        F.count_if("ok").alias("analyzed"),
        F.count(F.lit(1)).alias("total"),
        F.count_if("checked_out").alias("seen"),
        F.sum(F.when(F.col("checked_out"), F.col("n_files"))).alias("files"),
        F.sum(F.when(F.col("ok"), F.col("n_findings"))).alias("findings"),
    )
    any_ok = F.col("analyzed") > 0
    return sums.select(
        F.col("analyzed").alias("number_of_commits_analyzed"),
        F.col("total").alias("total_commits_in_repo"),
        F.when(any_ok, F.round(safe_ratio("files", "seen"), 2)).otherwise(0.0).alias("avg_of_num_java_files"),
        F.when(any_ok, F.round(safe_ratio("findings", "analyzed"), 2)).otherwise(0.0).alias("avg_of_num_warnings"),
    )


def sequential_tally(outcomes: DataFrame, findings: DataFrame) -> DataFrame:
    """Findings per named rule over the analyzed commits.

    Tallied per commit before the join, which then has one row per commit and rule.
    """
    per_commit = tally_drop(findings, "commit")
    kept = per_commit.join(outcomes.where("ok").select("commit"), "commit", "left_semi")
    return kept.groupBy("rule").agg(F.sum("n").alias("n"))


def summarize_sequential(outcomes: DataFrame, findings: DataFrame, location: str) -> DataFrame:
    stats = sequential_stats(outcomes, findings)
    return _with_rule_map(
        stats.select(F.struct(*stats.columns).alias("stat_of_repository")), sequential_tally(outcomes, findings), location
    )
