"""Per-commit reports: counts, rule maps and nested documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from historymine.functions.scalars import rule_key
from historymine.functions.skew import ROWS_PER_SLICE, spread_join

_VIOLATION = "STRUCT<rule: STRING, ruleSet: STRING, line: INT, message: STRING>"


def count_per_commit(commits: DataFrame, rows: DataFrame, name: str, key: str = "commit") -> DataFrame:
    """``(key, name)`` with a row, possibly 0, for every commit."""
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias(name))
    return commits.select(key).join(counts, key, "left").select(key, F.coalesce(name, F.lit(0)).alias(name))


def findings_by_file(
    files: DataFrame, findings: DataFrame, commit: str = "seq", rows_per_slice: int = ROWS_PER_SLICE, within: DataFrame | None = None
) -> DataFrame:
    """Carry content-level findings to every file that has the content: ``(commit, path, rule, ...)``; ``within`` as in ``spread_join``."""
    keys = [commit, "path"]
    joined = spread_join(files.select(*keys, "hash"), findings, ["hash"], keys, rows_per_slice=rows_per_slice, within=within)
    return joined.select(*keys, "rule", "ruleset", "line", "message")


def fan_counts(files: DataFrame, tallies: DataFrame, rows_per_slice: int = ROWS_PER_SLICE, within: DataFrame | None = None) -> DataFrame:
    """``(seq, rule, findings, fresh, files, fresh_files)`` from file rows and content-level tallies.

    Files are counted by commit and content first, so the join moves numbers
    only; a content brings its tallies along as one array, bounded by the rule
    set. ``files`` and ``fresh_files`` count each file with findings at one of
    its rules, so that their sum over the rules of a commit is right. ``within`` is as in ``spread_join``.
    """
    copies = files.groupBy("seq", "hash").agg(
        F.count(F.lit(1)).alias("copies"), F.count_if(~F.col("is_hit")).alias("fresh_copies")
    )
    by_content = tallies.groupBy("hash").agg(F.sort_array(F.collect_list(F.struct("rule", "n"))).alias("tallies"))
    joined = spread_join(copies, by_content, ["hash"], ["seq"], rows_per_slice=rows_per_slice, within=within)
    long = joined.select("seq", "copies", "fresh_copies", F.posexplode("tallies").alias("i", "t"))
    return long.groupBy("seq", F.col("t.rule").alias("rule")).agg(
        F.sum(F.col("copies") * F.col("t.n")).alias("findings"),
        F.sum(F.col("fresh_copies") * F.col("t.n")).alias("fresh"),
        F.sum(F.when(F.col("i") == 0, F.col("copies")).otherwise(0)).alias("files"),
        F.sum(F.when(F.col("i") == 0, F.col("fresh_copies")).otherwise(0)).alias("fresh_files"),
    )


def merge_maps(rows: DataFrame, keys: Sequence[str], counts: str) -> DataFrame:
    """Add up maps of counts key by key; long form ``(keys, rule, n)``."""
    return rows.select(*keys, F.explode(counts).alias("rule", "n")).groupBy(*keys, "rule").agg(F.sum("n").alias("n"))


def count_maps(tallies: DataFrame, keys: Sequence[str], name: str = "warnings_by_rule") -> DataFrame:
    """Fold ``(keys, rule, n)`` into one map per key; as many entries as there are rules."""
    entries = F.sort_array(F.collect_list(F.struct("rule", "n")))
    return tallies.groupBy(*keys).agg(F.map_from_entries(entries).alias(name))


def flatten_findings(files: str | Column = "files", top_level: str | Column | None = None) -> Column:
    """All findings of a report; a top-level list, where present, wins over those of the files."""
    files = F.col(files) if isinstance(files, str) else files
    empty = F.array().cast(f"ARRAY<{_VIOLATION}>")
    flat = F.flatten(F.transform(F.coalesce(files, F.array()), lambda f: F.coalesce(f["violations"], empty)))
    if top_level is None:
        return flat
    return F.coalesce(F.col(top_level) if isinstance(top_level, str) else top_level, flat)


def flatten_rows(documents: DataFrame, own: DataFrame) -> DataFrame:
    """``(commit, rule, ruleSet, line, message)`` by rows: the lists ``(commit, warnings)`` of ``own``, and the findings of ``documents``.

    ``documents`` holds files of commits without a list of their own; no row ever holds more than one file.
    """
    lists = own.select("commit", F.explode("warnings").alias("v"))
    return lists.unionByName(documents.select("commit", F.explode("violations").alias("v"))).select("commit", "v.*")


def nest_reports(findings: DataFrame) -> DataFrame:
    """``(commit, filename, violations)``: the findings of each file of each commit as one document.

    A file's findings come from a text that fits one row, so documents are
    bounded whatever the size of the commit; nothing gathers a whole commit.
    """
    violation = F.struct("rule", F.col("ruleset").alias("ruleSet"), "line", "message").cast(_VIOLATION)
    return findings.groupBy("commit", F.col("path").alias("filename")).agg(F.sort_array(F.collect_list(violation)).alias("violations"))


def commit_reports(headers: DataFrame, findings: DataFrame, metadata: Sequence[str] = ()) -> DataFrame:
    """A header document per commit and a document per file with findings, in one shape at any size.

    ``headers`` has a row per commit: ``commit, num_java_files, warnings_by_rule``
    and the ``metadata`` columns; these are null in the documents of files, as
    ``filename`` and ``violations`` are in headers. A commit without findings has
    its header alone.
    """
    head = headers.select("commit", "num_java_files", "warnings_by_rule", *metadata)
    return head.unionByName(nest_reports(findings), allowMissingColumns=True)


def is_header() -> Column:
    return F.col("violations").isNull()


def split_documents(whole: DataFrame) -> DataFrame:
    """Whole commit documents, as other tools leave them, in the shape of ``commit_reports``; ``files`` and ``warnings`` go."""
    own = [c for c in whole.columns if c not in ("files", "warnings", "filename", "violations")]
    files = whole.select("commit", F.explode("files").alias("_f")).select(
        "commit", "_f.filename", F.coalesce("_f.violations", F.array().cast(f"ARRAY<{_VIOLATION}>")).alias("violations")
    )
    return whole.select(*own).unionByName(files, allowMissingColumns=True)


def assemble_documents(documents: DataFrame) -> DataFrame:
    """One whole document per commit: the header with ``files`` and ``warnings``.

    This is for readers that want single commits: filter ``documents`` first, for a
    whole document is one row and has to fit one.
    """
    carried = [c for c in documents.columns if c not in ("commit", "filename", "violations")]
    files = F.sort_array(F.collect_list(F.when(~is_header(), F.struct("filename", "violations"))))
    head = [F.first(c, ignorenulls=True).alias(c) for c in carried]  # the header is the one document that has them
    whole = documents.groupBy("commit").agg(*head, files.alias("files"))
    return whole.select("commit", *carried, flatten_findings("files").alias("warnings"), "files")


def report_headers(commits: DataFrame, changed: DataFrame, tallies: DataFrame) -> DataFrame:
    """``commit, num_java_files, warnings_by_rule`` for every commit.

    ``changed`` has ``commit`` once per file, ``tallies`` is ``(commit, rule, n)``.
    """
    files = count_per_commit(commits, changed, "num_java_files")
    return files.join(count_maps(tallies, ["commit"]), "commit", "left").select(
        "commit",
        "num_java_files",
        F.coalesce("warnings_by_rule", F.create_map().cast("MAP<STRING,BIGINT>")).alias("warnings_by_rule"),
    )


def placeholder_reports(commits: DataFrame, changed: DataFrame) -> DataFrame:
    """Documents of the commits in which no analyzed file changed."""
    empty = F.array().cast(f"ARRAY<{_VIOLATION}>")
    return commits.select("commit").join(changed.select("commit").distinct(), "commit", "left_anti").select(
        "commit", F.lit(0).cast("bigint").alias("num_java_files"), empty.alias("warnings")
    )


def tally_fallback(findings: DataFrame, *keys: str) -> DataFrame:
    """Findings per rule; a finding without rule counts for its rule set, or as UNKNOWN."""
    return findings.groupBy(*keys, rule_key().alias("rule")).agg(F.count(F.lit(1)).alias("n"))


def tally_drop(findings: DataFrame, *keys: str) -> DataFrame:
    """Findings per rule; a finding without rule is left out here (it still counts in totals)."""
    named = findings.where(F.col("rule") != "")
    return named.groupBy(*keys, "rule").agg(F.count(F.lit(1)).alias("n"))
