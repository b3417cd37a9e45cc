"""Column expressions; all of them stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

UNKNOWN_RULE = "UNKNOWN"  # fixed value: the key of findings that name no rule at all


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def content_hash(content: str | Column) -> Column:
    """SHA-1 of the raw bytes, 40 lower-case hex digits."""
    return F.sha1(_col(content).cast("binary"))


def short_hash(commit: str | Column) -> Column:
    return F.substring(_col(commit), 1, 8)


def has_suffix(path: str | Column, suffix: str = ".java") -> Column:
    """Case-sensitive: ``A.JAVA`` does not end in ``.java``."""
    return _col(path).endswith(suffix)


def absolute_path(root: str, path: str | Column) -> Column:
    """Join a path to a root; a path that is absolute already stays as it is."""
    path = _col(path)
    return F.when(path.startswith("/"), path).otherwise(F.concat_ws("/", F.lit(root.rstrip("/")), path))


def relative_path(root: str, path: str | Column) -> Column:
    """Strip the root; paths outside of it stay as they are (``/wx/a`` is not under ``/w``)."""
    path, prefix = _col(path), root.rstrip("/") + "/"
    return F.when(path.startswith(prefix), F.substring(path, len(prefix) + 1, 2**31 - 1)).otherwise(path)


def first_present(*values: str | Column) -> Column:
    """The first value that is neither null nor the empty string."""
    return F.coalesce(*[F.nullif(_col(v), F.lit("")) for v in values])


def rule_key(rule: str | Column = "rule", ruleset: str | Column = "ruleset") -> Column:
    """Name under which a finding is tallied: rule, else rule set, else UNKNOWN."""
    return F.coalesce(first_present(rule, ruleset), F.lit(UNKNOWN_RULE))


def safe_ratio(total: str | Column, count: str | Column) -> Column:
    """``total / count`` as double, 0 where there is nothing to divide by."""
    return F.coalesce(F.try_divide(_col(total).cast("double"), _col(count).cast("double")), F.lit(0.0))


def non_blank_lines(text: str | Column) -> Column:
    return F.filter(F.split(_col(text), "\n"), lambda line: line != "")


def run_stamp(ts: str | Column) -> Column:
    return F.date_format(_col(ts), "yyyyMMdd_HHmmss")
