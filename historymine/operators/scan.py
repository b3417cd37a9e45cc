"""Rules over file contents."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from historymine.functions.scalars import rule_key
from historymine.functions.skew import pick_rows
from historymine.operators.content import content_index
from historymine.session import materialize
from historymine.sources.rules import Rule, check_rules


RULES_PER_ARRAY = 200


def _finding(rule: Rule, line: Column) -> Column:
    return F.struct(
        F.lit(rule.rule).alias("rule"),
        F.lit(rule.ruleset).alias("ruleset"),
        line.cast("int").alias("line"),
        F.lit(rule.message).cast("string").alias("message"),
    )


def _condition(rule: Rule) -> Column:
    matches = _matches(rule)
    return matches if rule.lang is None else (F.col("_lang") == rule.lang) & matches


def _matches(rule: Rule) -> Column:
    text = F.col("_text")
    if rule.kind == "line_regex":
        match = text.rlike(rule.pattern)
        return match if rule.needle is None else text.contains(rule.needle) & match
    if rule.kind == "line_length":
        return F.length(text) > rule.threshold
    if rule.kind == "duplicate_line":
        return (F.trim(text) != "") & (text == F.col("_same"))
    return (F.col("_pos") == 0) & F.expr(rule.pattern).cast("boolean")


def rule_scan(
    files: DataFrame, rules: Iterable[Rule], keys: Sequence[str] = ("hash",), content: str = "content"
) -> DataFrame:
    """One row per match: ``(keys, rule, ruleset, line, message)``; whole-file rules have no line.

    A single pass without a shuffle. The rules are literals of the plan, so each
    pattern is compiled once per task; contents are dropped when their lines are
    unfolded. To find repeated lines the lines of a file are sorted inside its
    row, so that equal ones are neighbours.
    """
    rules = check_rules(files.sparkSession, rules)
    if not rules:
        raise ValueError("no rules to scan for")
    out = list(keys)
    if any(rule.lang is not None for rule in rules):
        if "lang" not in files.columns:
            raise ValueError("rules for one language need a column lang")
        files, keys = files.withColumn("_lang", F.col("lang")), [*keys, "_lang"]
    if any(rule.kind == "duplicate_line" for rule in rules):
        # (text, position) sorted, next to the text before it in that order
        lines = F.sort_array(F.transform(F.col("_lines"), lambda text, i: F.struct(text.alias("text"), i.alias("pos"))))
        before = F.concat(F.array(F.lit(None).cast("string")), F.transform("_sorted", lambda x: x["text"]))
        unfolded = (
            files.select(*keys, F.length(content).alias("n_chars"), F.split(content, "\n").alias("_lines"))
            .select(*keys, "n_chars", F.size("_lines").alias("n_lines"), lines.alias("_sorted"))
            .select(*keys, "n_chars", "n_lines", F.explode(F.arrays_zip("_sorted", before.alias("_same"))).alias("_z"))
            .where(F.col("_z._sorted").isNotNull())
            .select(
                *keys,
                "n_chars",
                "n_lines",
                F.col("_z._sorted.pos").alias("_pos"),
                F.col("_z._sorted.text").alias("_text"),
                F.col("_z._same").alias("_same"),
            )
        )
    else:
        unfolded = files.select(*keys, F.length(content).alias("n_chars"), F.split(content, "\n").alias("_lines")).select(
            *keys, "n_chars", F.size("_lines").alias("n_lines"), F.posexplode("_lines").alias("_pos", "_text")
        )
    line = F.col("_pos") + 1
    matches = [
        F.when(_condition(rule), _finding(rule, F.lit(None) if rule.kind == "file_metric" else line)) for rule in rules
    ]
    # A generated method holds about this many patterns; more rules are evaluated in several arrays of the same pass.
    groups = [F.array_compact(F.array(*matches[i : i + RULES_PER_ARRAY])) for i in range(0, len(matches), RULES_PER_ARRAY)]
    found = unfolded.select(*out, F.explode(groups[0] if len(groups) == 1 else F.concat(*groups)).alias("_f"))
    return found.select(*out, "_f.rule", "_f.ruleset", "_f.line", "_f.message")


def scan_contents(files: DataFrame, rules: Iterable[Rule], wanted: DataFrame | None = None) -> DataFrame:
    """Findings of each distinct content once: ``(hash, rule, ruleset, line, message)``.

    ``files`` has ``(seq, path, hash, content)``. Only the first occurrence of a
    content reaches the rules, however often it is copied: copies are left out
    by ``(seq, path)`` before any pattern is matched. ``wanted`` (``seq, path`` of
    first occurrences, a stored table) restricts the scan further; without it,
    all first occurrences are found in a pass over the hashes.
    """
    if wanted is None:
        wanted = materialize(content_index(files).select("seq", "path"), "firsts")
    return rule_scan(pick_rows(files, wanted, ["seq", "path"]), rules)


def rule_tally(findings: DataFrame, keys: Sequence[str] = ("hash",)) -> DataFrame:
    """``(keys, rule, n)`` under the fallback naming of rules."""
    return findings.groupBy(*keys, rule_key().alias("rule")).agg(F.count(F.lit(1)).alias("n"))
