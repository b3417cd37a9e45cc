"""Summaries and reports on hand-computed cases."""

import pytest
from pyspark.sql import functions as F

from historymine import schema as S
from historymine.bindings import queries
from historymine.operators import reports, summary


@pytest.fixture
def findings(spark):
    return spark.createDataFrame(
        [
            ("c1", "f1", "R1", None, 1, None),
            ("c1", "f1", "R1", None, 2, None),
            ("c1", "f1", "", "S1", 3, None),
            ("c1", "f2", None, None, 1, None),
        ],
        S.FINDINGS,
    )


@pytest.fixture
def log(spark):
    return spark.createDataFrame([("c1",), ("c2",), ("c4",)], "commit STRING")


def _documents(spark):
    """c1 with four findings in two files, c2 a placeholder, c4 with a clean file."""
    v = lambda rule, ruleset: {"rule": rule, "ruleSet": ruleset, "line": None, "message": None}
    files = {
        "c1": [
            {"filename": "f1", "violations": [v("R1", None), v("R1", None), v("", "S1")]},
            {"filename": "f2", "violations": [v(None, None)]},
        ],
        "c2": None,
        "c4": [{"filename": "f1", "violations": []}],
    }
    whole = spark.createDataFrame([(c, 0, {}, [], f, None, None, None, None) for c, f in files.items()], S.WHOLE_REPORT_JSON)
    return reports.split_documents(whole)


def test_parallel_summary_of_documents(spark):
    row = summary.summarize_reports(_documents(spark), "here").first()
    assert row.location == "here"
    assert row.stat_of_repository.number_of_commits == 3
    assert row.stat_of_repository.avg_of_num_java_files == 1.0
    assert row.stat_of_repository.avg_of_num_warnings == pytest.approx(4 / 3)
    assert row.stat_of_warnings == {"R1": 2, "S1": 1, "UNKNOWN": 1}


def test_parallel_summary_of_findings(log, findings):
    row = summary.summarize_findings(log, findings, "here").first()
    assert row.stat_of_repository.number_of_commits == 3
    assert row.stat_of_repository.avg_of_num_java_files == pytest.approx(2 / 3)
    assert row.stat_of_warnings == {"R1": 2, "S1": 1, "UNKNOWN": 1}


def test_summary_without_commits(spark, log, findings):
    row = summary.summarize_findings(log.limit(0), findings.limit(0), "x").first()
    assert tuple(row.stat_of_repository) == (0, 0.0, 0.0)
    assert row.stat_of_warnings == {}


def _outcomes(spark, ok):
    rows = [(c, o, True, n) for c, o, n in zip(["c1", "c2", "c3", "c4"], ok, [5, 5, 5, 7])]
    return spark.createDataFrame(rows, "commit STRING, ok BOOLEAN, checked_out BOOLEAN, n_files BIGINT")


def test_sequential_summary(spark, findings):
    row = summary.summarize_sequential(_outcomes(spark, [True, True, False, True]), findings, "r").first()
    assert tuple(row.stat_of_repository) == (3, 4, 5.5, 1.33)
    assert row.stat_of_warnings == {"R1": 2}


def test_sequential_summary_when_all_failed(spark, findings):
    row = summary.summarize_sequential(_outcomes(spark, [False] * 4), findings, "r").first()
    assert tuple(row.stat_of_repository) == (0, 4, 0.0, 0.0)
    assert row.stat_of_warnings == {}


def test_tallies(findings, rows):
    assert rows(reports.tally_fallback(findings)) == [("R1", 2), ("S1", 1), ("UNKNOWN", 1)]
    assert rows(reports.tally_drop(findings)) == [("R1", 2)]


def test_findings_per_commit_keeps_zeros(log, findings, rows):
    assert rows(reports.count_per_commit(log, findings, "n")) == [("c1", 4), ("c2", 0), ("c4", 0)]


def _headers(log, findings):
    return reports.report_headers(
        log, findings.select("commit", "path").distinct(), reports.tally_fallback(findings, "commit")
    )


def test_commit_reports(log, findings):
    documents = reports.commit_reports(_headers(log, findings), findings)
    whole = {r.commit: r for r in reports.assemble_documents(documents).collect()}
    assert set(whole) == {"c1", "c2", "c4"}
    first = whole["c1"]
    assert first.num_java_files == 2
    assert first.warnings_by_rule == {"R1": 2, "S1": 1, "UNKNOWN": 1}
    assert [(f.filename, len(f.violations)) for f in first.files] == [("f1", 3), ("f2", 1)]
    assert len(first.warnings) == 4
    assert whole["c2"].files == [] and whole["c2"].num_java_files == 0
    again = reports.split_documents(reports.assemble_documents(documents))
    assert sorted(map(str, again.select(*documents.columns).collect())) == sorted(map(str, documents.collect()))


def test_one_shape_at_any_size(spark, log):
    """A commit of 130,000 findings, some without file name, has the documents that a small one has."""
    big = spark.range(130_000).select(
        F.lit("c1").alias("commit"),
        F.when(F.col("id") % 1000 > 0, F.concat(F.lit("f"), F.col("id") % 1000)).alias("path"),
        F.lit("R").alias("rule"),
        F.lit("S").alias("ruleset"),
        (F.col("id") % 500).cast("int").alias("line"),
        F.lit(None).cast("string").alias("message"),
    )
    findings = big.unionByName(spark.createDataFrame([("c2", "f1", "R", "S", 1, None)], S.FINDINGS))
    documents = reports.commit_reports(_headers(log, findings), findings).cache()
    assert documents.where(reports.is_header()).count() == 3
    files = documents.where(~reports.is_header() & (F.col("commit") == "c1"))
    assert files.count() == 1000 and files.agg(F.sum(F.size("violations"))).first()[0] == 130_000
    assert documents.where(reports.is_header() & (F.col("commit") == "c1")).first().warnings_by_rule == {"R": 130_000}
    row = summary.summarize_reports(documents, "x").first()
    assert row.stat_of_warnings == {"R": 130_001} and row.stat_of_repository.avg_of_num_java_files == pytest.approx(1001 / 3)


def test_top_level_violations_win(spark):
    violation = "STRUCT<rule: STRING, ruleSet: STRING, line: INT, message: STRING>"
    df = spark.createDataFrame(
        [
            ([("f", [("A", None, 1, None)])], [("T", None, 1, None), ("T", None, 2, None)]),
            ([("f", [("A", None, 1, None)]), ("g", None)], None),
            (None, None),
        ],
        f"files ARRAY<STRUCT<filename: STRING, violations: ARRAY<{violation}>>>, violations ARRAY<{violation}>",
    )
    flat = df.select(F.transform(reports.flatten_findings("files", "violations"), lambda v: v["rule"]).alias("r"))
    assert [r.r for r in flat.collect()] == [["T", "T"], ["A"], []]


def test_flatten_query_gathers_no_whole_commit(spark, monkeypatch):
    """A commit with most findings, as rows: its documents are never put into one."""

    def refused(*_):
        raise AssertionError("a whole commit in one row")

    found = [("1", f"f{i:04}", f"r{i % 7}", "s", 1, None) for i in range(3000)] + [("3", "b", "r2", "s", 1, None), ("3", "a", "r9", "s", 2, None), ("3", "a", "", "s", 3, None)]
    df = spark.createDataFrame(found, "commit string, path string, rule string, ruleset string, line int, message string")
    monkeypatch.setattr(queries.reports, "assemble_documents", refused)
    monkeypatch.setattr(queries.V, "findings", lambda *_: df)
    monkeypatch.setattr(queries.V, "order_commits", lambda *_: df.select("commit").distinct())
    got = sorted(map(tuple, queries.flatten_findings(spark, "").collect()))
    assert got == [("1", 3000, "r0", "r6"), ("3", 1, "s", "s")]
