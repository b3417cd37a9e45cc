"""User-supplied rules, checked before any job starts."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable
from dataclasses import asdict, dataclass

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, functions as F

KINDS = ("line_regex", "line_length", "file_metric", "duplicate_line")


@dataclass(frozen=True)
class Rule:
    """One rule.

    ``line_regex``      a finding per line that matches ``pattern`` (and contains ``needle``, if given)
    ``line_length``     a finding per line longer than ``threshold`` characters
    ``file_metric``     a finding where the SQL condition ``pattern`` over ``n_lines`` and ``n_chars`` holds
    ``duplicate_line``  a finding per non-blank line that repeats an earlier line of its file

    ``needle`` is a literal text that every match contains. It is looked for
    first, which spares most lines a slow pattern. A rule with ``lang`` looks at files
    of that language only; the scanned table then needs a column ``lang``.
    """

    rule: str
    ruleset: str
    kind: str
    pattern: str | None = None
    threshold: float | None = None
    message: str | None = None
    needle: str | None = None
    lang: str | None = None


def ruleset_id(rules: Iterable[Rule]) -> str:
    """Identity of a rule list: results cached under another one are not reused."""
    ordered = sorted(json.dumps(asdict(rule), sort_keys=True) for rule in rules)
    return hashlib.sha1("\n".join(ordered).encode()).hexdigest()


def check_rules(spark: SparkSession, rules: Iterable[Rule]) -> list[Rule]:
    """Return the rules as a list, or raise ValueError naming what is wrong with one."""
    rules = list(rules)
    if len({rule.rule for rule in rules}) != len(rules):
        raise ValueError("rule names must be unique")
    for rule in rules:
        if not rule.rule:
            raise ValueError("a rule needs a name")
        if rule.kind not in KINDS:
            raise ValueError(f"rule {rule.rule}: unknown kind {rule.kind!r}")
        if rule.kind in ("line_regex", "file_metric") and not rule.pattern:
            raise ValueError(f"rule {rule.rule}: {rule.kind} needs a pattern")
        if rule.kind == "line_length" and rule.threshold is None:
            raise ValueError(f"rule {rule.rule}: line_length needs a threshold")
    # a literal row: the driver evaluates it while planning, no job is started
    probe = spark.sql("SELECT * FROM VALUES ('', 0, 0) AS t(text, n_lines, n_chars)")
    try:
        probe.select(
            F.lit(True),
            *[F.col("text").rlike(r.pattern) for r in rules if r.kind == "line_regex"],
            *[F.expr(r.pattern).cast("boolean") for r in rules if r.kind == "file_metric"],
        ).collect()
    except PySparkException as error:
        raise ValueError(f"bad pattern in rules: {error}") from error
    return rules


def load_rules(rules: DataFrame) -> list[Rule]:
    """Rules from a user's table: written by people, so it fits the driver like the plan that it becomes a part of."""
    rows = rules.select("rule", "ruleset", "kind", "pattern", "threshold", "message", "needle", "lang").collect()
    return check_rules(rules.sparkSession, [Rule(**row.asDict()) for row in rows])
