"""Rules, scanning and Python analyzers."""

import os
import signal
import time
from collections import Counter

import pytest

from pyspark.sql import functions as F

from historymine import schema as S
from historymine.bindings import views as V
from historymine.functions import pick_rows
from historymine.operators import analyzers, content, scan
from historymine.plans import mine_history
from historymine.session import materialize
from historymine.sources import Rule, load_rules


def _files(spark, *texts):
    return spark.createDataFrame([(i, f"f{i}", f"h{i}", t) for i, t in enumerate(texts)], "seq BIGINT, path STRING, hash STRING, content STRING")


def test_rule_kinds(spark, rows):
    files = _files(spark, "abc\n  \nabc\n12345\n\n\nabc", "", "ß" * 6)
    rules = [
        Rule("Number", "s", "line_regex", "[0-9]+"),
        Rule("Long", "s", "line_length", threshold=5),
        Rule("Again", "s", "duplicate_line"),
        Rule("Tall", "s", "file_metric", "n_lines > 6 AND n_chars > 3"),
    ]
    assert rows(scan.rule_scan(files, rules), "hash", "rule", "line") == [
        ("h0", "Again", 3), ("h0", "Again", 7), ("h0", "Number", 4), ("h0", "Tall", None), ("h2", "Long", 1),
    ]
    without = scan.rule_scan(files, rules[:2])
    assert rows(without, "hash", "rule", "line") == [("h0", "Number", 4), ("h2", "Long", 1)]


def test_fixture_counts(spark):
    """Known numbers of findings per rule, each content of the documents once."""
    found = scan.scan_contents(V.snapshots(spark, "/root/testdata/sf0.01"), V.RULES)
    assert Counter(r.rule for r in found.select("rule").collect()) == {
        "LongNumber": 69, "LongLine": 5112, "LicenseText": 37, "MailAddress": 12, "RepeatedLine": 337, "LongFile": 5,
    }


def test_wanted_contents(spark, rows):
    files = _files(spark, "1", "1 2", "a")
    files = files.union(spark.createDataFrame([(9, "copy", "h1", "1 2")], files.schema))
    wanted = materialize(content.content_index(files).where("hash <> 'h0'"), "wanted")
    found = scan.scan_contents(files, [Rule("N", "s", "line_regex", "[0-9]")], wanted)
    assert rows(found, "hash", "rule", "line") == [("h1", "N", 1)]


@pytest.mark.parametrize(
    "rules, message",
    [
        ([Rule("X", "s", "line_regex", "[")], "bad pattern"),
        ([Rule("X", "s", "file_metric", "n_words > 3")], "bad pattern"),
        ([Rule("X", "s", "magic", "a")], "unknown kind"),
        ([Rule("X", "s", "line_length")], "threshold"),
        ([Rule("", "s", "duplicate_line")], "name"),
        ([Rule("X", "s", "duplicate_line")] * 2, "unique"),
        ([], "no rules"),
    ],
)
def test_bad_rules_fail_before_the_job(spark, rules, message):
    with pytest.raises(ValueError, match=message):
        scan.rule_scan(_files(spark, "x"), rules)


def test_rules_from_a_table(spark):
    table = spark.createDataFrame([("N", "s", "line_regex", "[0-9]", None, "m", None, None), ("L", "s", "line_length", None, 3.0, None, None, "en")], S.RULES)
    assert load_rules(table) == [Rule("N", "s", "line_regex", "[0-9]", None, "m"), Rule("L", "s", "line_length", None, 3.0, lang="en")]
    many = spark.range(450).selectExpr(
        "concat('R', id) AS rule", "'s' AS ruleset", "'line_length' AS kind", "CAST(NULL AS STRING) AS pattern",
        "CAST(id AS DOUBLE) AS threshold", "CAST(NULL AS STRING) AS message",
        "CAST(NULL AS STRING) AS needle", "CAST(NULL AS STRING) AS lang",
    )
    found = scan.rule_scan(_files(spark, "x" * 440), load_rules(many))
    assert found.count() == found.select("rule").distinct().count() == 440


@pytest.mark.parametrize("threshold", ["-1", "10m"])
def test_each_content_is_scanned_once(spark, rows, threshold):
    """A history that repeats its tree: the rules see as many files as there are contents."""
    trees = spark.range(40).select(
        F.col("id").alias("seq"), F.explode(F.expr("transform(sequence(0, 24), i -> struct('f' || i AS path, repeat(CAST(i % 10 AS STRING), 3) AS content))")).alias("f")
    )
    files = materialize(trees.select("seq", "f.path", "f.content", F.sha1("f.content").alias("hash")), "repeating")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        found = scan.scan_contents(files, [Rule("N", "s", "line_regex", "[0-9]")])
        found.write.format("noop").mode("overwrite").save()
        assert found.count() == 10
        wanted = materialize(content.content_index(files).select("seq", "path"), "wanted")
        picked = pick_rows(files, wanted, ["seq", "path"])
        assert picked.count() == 10 and rows(picked.select("hash").distinct()) == rows(files.select("hash").distinct())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")



def test_analyzer_isolates_bad_files(spark, rows):
    files = _files(spark, *[f"{i:03d}\nBAD" if i % 40 == 7 else f"{i:03d}" for i in range(100)])
    factory = analyzers.line_pattern_analyzer("[0-9]{3}", "N", "s", fail_on="BAD")
    outcome = analyzers.analyze(files, factory).cache()
    assert rows(analyzers.analyzer_errors(outcome), "hash") == [("h47",), ("h7",), ("h87",)]
    assert analyzers.analyzer_findings(outcome).count() == 97


def test_analyzer_that_crashes_or_hangs(spark, rows):
    """Each file that ends the process, kills it or never returns costs one error; no other file is touched."""
    words = {13: "exit", 14: "kill", 40: "hang", 41: "hang", 77: "raise", 99: "exit"}
    files = _files(spark, *[f"{i:03d} {words.get(i, 'fine')}" for i in range(100)]).coalesce(2)

    def factory():
        def analyzer(batch):
            text = " ".join(batch["content"])
            if "exit" in text:
                os._exit(3)
            if "kill" in text:
                os.kill(os.getpid(), signal.SIGKILL)
            if "raise" in text:
                raise ValueError("not this one")
            while "hang" in text:
                time.sleep(0.1)
            return batch[["hash"]].assign(rule="R", ruleset="S", line=1, message=None)

        return analyzer

    outcome = analyzers.analyze(files, factory, seconds=0.7).cache()
    assert rows(analyzers.analyzer_errors(outcome)) == [
        ("h13", "the analyzer ended with exit code 3"), ("h14", "the analyzer was ended by signal 9"), ("h40", "the analyzer took longer than 0.7 seconds"),
        ("h41", "the analyzer took longer than 0.7 seconds"), ("h77", "not this one"), ("h99", "the analyzer ended with exit code 3"),
    ]
    assert analyzers.analyzer_findings(outcome).count() == 94


def test_analyzer_that_cannot_start(spark, rows):
    def factory():
        os._exit(5)

    outcome = analyzers.analyze(_files(spark, "a", "b"), factory, seconds=1.0)
    assert rows(analyzers.analyzer_errors(outcome)) == [("h0", "the analyzer ended with exit code 5"), ("h1", "the analyzer ended with exit code 5")]


def test_supervised_run(spark, rows):
    """A commit with a file on which the analyzer hangs fails alone, and the run goes on."""
    log = spark.createDataFrame([(0, "c0"), (1, "c1"), (2, "c2")], "seq BIGINT, commit STRING")
    trees = spark.createDataFrame([(0, "a.java", "123"), (1, "a.java", "123 hang"), (2, "a.java", "456")], "seq BIGINT, path STRING, content STRING")
    plain = analyzers.line_pattern_analyzer("[0-9]{3}", "N", "s")

    def factory():
        analyzer = plain()

        def slow(batch):
            while batch["content"].str.contains("hang").any():
                time.sleep(0.1)
            return analyzer(batch)

        return slow

    run = mine_history(log, trees, analyzer=factory, analyzer_id="n", analyzer_seconds=0.7)
    assert rows(run.errors, "commit", "error") == [("c1", "a.java: the analyzer took longer than 0.7 seconds")]
    assert rows(run.commits, "commit", "findings") == [("c0", 1), ("c2", 1)]


def test_analyzer_agrees_with_rule(spark, rows):
    files = _files(spark, "a1\nb\n2", "none", "3\n3")
    by_rule = scan.rule_scan(files, [Rule("N", "s", "line_regex", "[0-9]")])
    by_udf = analyzers.analyze(files, analyzers.line_pattern_analyzer("[0-9]", "N", "s"))
    assert rows(by_udf, "hash", "rule", "line") == rows(by_rule, "hash", "rule", "line")


def test_analyzer_results_are_checked(spark, rows):
    """Wrong types, missing keys and unknown files are errors of the file, not of the job."""
    bad = {"line": lambda f: f.assign(line="four"), "key": lambda f: f.drop(columns="hash"), "other": lambda f: f.assign(hash="zz"), "rule": lambda f: f.assign(rule=7)}

    def factory():
        def analyzer(batch):
            found = batch[["hash"]].assign(rule="R", ruleset="S", line=1, message=None)
            for word, spoil in bad.items():
                if batch["content"].str.contains(word).any():
                    return spoil(found)
            return found

        return analyzer

    outcome = analyzers.analyze(_files(spark, "fine", *bad, "good"), factory)
    assert rows(analyzers.analyzer_findings(outcome), "hash", "line") == [("h0", 1), ("h5", 1)]
    assert rows(analyzers.analyzer_errors(outcome), "hash") == [("h1",), ("h2",), ("h3",), ("h4",)]


def test_rules_for_one_language(spark, rows):
    rules = [Rule("N", "s", "line_regex", "[0-9]", lang="en"), Rule("L", "s", "line_length", None, 1.0)]
    files = _files(spark, "12", "12").withColumn("lang", F.when(F.col("seq") == 0, "en"))
    assert rows(scan.rule_scan(files, rules), "hash", "rule") == [("h0", "L"), ("h0", "N"), ("h1", "L")]
    with pytest.raises(ValueError, match="lang"):
        scan.rule_scan(_files(spark, "1"), rules)


def test_calls_that_hang_wait_side_by_side(spark, rows):
    """One task, thirty files that hang for a second each, beside crashes and a long computation: right, and in much less than thirty seconds."""
    words = {**dict.fromkeys(range(3, 123, 4), "hang"), 50: "exit", 70: "busy"}
    files = _files(spark, *[f"{words.get(i, 'fine')} {100 + i}" for i in range(124)]).coalesce(1)

    def factory():
        plain = analyzers.line_pattern_analyzer("[0-9]{3,}", "N", "S")()

        def analyzer(batch):
            text = "".join(batch["content"])
            if "exit" in text:
                os._exit(3)
            while "hang" in text:
                time.sleep(0.2)
            until = time.process_time() + (0.4 if "busy" in text else 0)
            while time.process_time() < until:
                pass
            return plain(batch)

        return analyzer

    began = time.monotonic()
    outcome = analyzers.analyze(files, factory, seconds=1.0).cache()
    errors = rows(analyzers.analyzer_errors(outcome))
    assert time.monotonic() - began < 20
    slow = [(f"h{i}", "the analyzer took longer than 1 seconds") for i in range(3, 123, 4)]
    assert errors == sorted([*slow, ("h50", "the analyzer ended with exit code 3")])
    assert rows(analyzers.analyzer_findings(outcome), "hash") == sorted((f"h{i}",) for i in range(124) if words.get(i, "busy") == "busy")
