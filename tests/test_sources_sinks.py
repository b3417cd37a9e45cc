"""Real directories: reports, errors, trees, caches, summaries."""

import hashlib
import json

from pyspark.sql import functions as F

from historymine import schema as S, sinks, sources
from historymine.operators import cache


def test_report_directory(spark, tmp_path, rows):
    put = lambda name, text: (tmp_path / name).write_text(text)
    put("c1.json", json.dumps({"formatVersion": 0, "pmdVersion": "7", "files": [
        {"filename": "a.java", "violations": [{"rule": "R", "ruleset": "low", "beginline": 3, "extra": {"x": 1}}, {"rule": "", "ruleSet": "S"}]},
        {"violations": [{"rule": "lost"}]},
    ]}, indent=2))
    put("c2.json", json.dumps({"fileReports": [{"file": "b.java", "violations": [{}]}, {"file": "c.java"}]}))
    put("c3.json", '{"files": [')
    put("c4.json", "{}")
    put("c5.json", "")
    put("c6.error.json", json.dumps({"commit": "c6", "error": "checkout"}))
    put("notes.txt", "no report")
    parsed = sources.read_reports(spark, str(tmp_path))
    adapted = sources.adapt_reports(parsed).cache()
    status = dict(rows(sources.parse_status(adapted), "file_name", "status"))
    assert {k: v for k, v in status.items() if k != "c5.json"} == {
        "c1.json": "ok", "c2.json": "ok", "c3.json": "failed", "c4.json": "ok",
    }
    assert status.get("c5.json", "ok") == "ok"
    found = sources.explode_findings(adapted, "file_name").where("path IS NOT NULL")
    assert rows(found, "file_name", "path", "rule", "ruleset", "line") == [
        ("c1.json", "a.java", "", "S", None), ("c1.json", "a.java", "R", "low", 3), ("c2.json", "b.java", None, None, None),
    ]
    assert rows(sources.bad_entries(adapted, "file_name")) == [("c1.json", "report entry without file name")]
    meta = sources.report_metadata(parsed, "file_name").where("file_name = 'c1.json'")
    assert rows(meta) == [("c1.json", 0, "7", None, None)]
    errors = sources.parse_errors(sources.read_documents(spark, str(tmp_path)))
    assert rows(errors, "commit", "error") == [("c6", "checkout")]


def test_trees(spark, tmp_path, rows):
    raw = "café\n".encode()
    for name in ("c1/A.java", "c1/deep/er/B.java", "c2/A.java", "c2/note.txt", "c2/A.JAVA"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(raw)
    trees = sources.read_trees(spark, str(tmp_path))
    assert rows(trees, "commit", "path") == [("c1", "A.java"), ("c1", "deep/er/B.java"), ("c2", "A.java")]
    first = trees.first()
    assert first.hash == hashlib.sha1(raw).hexdigest() and first.content == "café\n" and first.n_bytes == 6


def test_cache_versions(spark, tmp_path, rows):
    assert sources.read_cache(spark, str(tmp_path / "none")).count() == 0
    entries = spark.createDataFrame([("h", "r", {"R": 2}, 1, 0), ("g", "r", {}, 1, 0)], S.CACHE)
    first = sinks.save_cache(entries, str(tmp_path))
    again = sinks.save_cache(cache.cache_merge(sources.read_cache(spark, first)), str(tmp_path))
    assert first != again
    assert rows(sources.read_cache(spark, again), "hash") == [("g",), ("h",)]


def test_cache_json(spark, rows):
    text = json.dumps({"h": {"warnings_by_rule": {"R": 2}, "num_java_files": 1}, "g": {"warnings_by_rule": {}, "num_java_files": 1}})
    documents = spark.createDataFrame([(text,), ("{broken",)], "text STRING")
    loaded = sources.cache_from_json(documents, "r")
    assert rows(loaded.select("hash", F.size("warnings_by_rule"))) == [("g", 0), ("h", 1)]
    assert loaded.schema.simpleString() == sources.empty_cache(spark).schema.simpleString()


def test_written_documents(spark, tmp_path, rows):
    one = spark.createDataFrame([("here", (3, 1.0, 2.5), {"R": 1})], S.SUMMARY_JSON)
    sinks.write_summary(one, str(tmp_path / "summary"))
    files = list((tmp_path / "summary").glob("part-*"))
    assert len(files) == 1
    assert json.loads(files[0].read_text()) == {
        "location": "here",
        "stat_of_repository": {"number_of_commits": 3, "avg_of_num_java_files": 1.0, "avg_of_num_warnings": 2.5},
        "stat_of_warnings": {"R": 1},
    }
    report = spark.createDataFrame([("c", 0, {}, None, "7", None, None, None, None)], S.COMMIT_REPORT_JSON)
    sinks.write_reports(report, str(tmp_path / "reports"))
    line = "".join(p.read_text() for p in (tmp_path / "reports").glob("part-*"))
    assert json.loads(line) == {
        "commit": "c", "num_java_files": 0, "warnings_by_rule": {}, "pmdVersion": "7",
    }
    sinks.write_errors(spark.createDataFrame([(1, "c", "bad")], "seq INT, commit STRING, error STRING"), str(tmp_path / "errors"))
    assert rows(spark.read.schema(S.ERROR_JSON).json(str(tmp_path / "errors"))) == [("c", "bad")]


def test_trees_of_any_root_and_encoding(spark, tmp_path, rows, monkeypatch):
    tree = tmp_path / "trees" / "c0" / "src"
    tree.mkdir(parents=True)
    (tree / "A.java").write_bytes("caf\xe9 1\n".encode("latin-1"))
    (tree / "B.java").write_text("é")
    for root in (f"{tmp_path}/trees", f"{tmp_path}/trees/", f"file://{tmp_path}/trees", f"file:{tmp_path}/trees"):
        found = sources.read_trees(spark, root)
        assert rows(found, "commit", "path", "content") == [("c0", "src/A.java", "caf\ufffd 1\n"), ("c0", "src/B.java", "é")]
    raw = hashlib.sha1((tree / "A.java").read_bytes()).hexdigest()
    assert raw in {r.hash for r in sources.read_trees(spark, str(tmp_path / "trees")).collect()}


def test_reports_are_written_small(spark, rows, tmp_path):
    """Documents repeat their field names and rules in every line; on disk that costs a fraction of the text."""
    violation = F.array(F.struct(F.lit("R").alias("rule"), F.lit("S").alias("ruleSet"), F.lit(1).alias("line"), F.lit("a message").alias("message")))
    documents = spark.range(2000).select(F.concat(F.lit("c"), "id").alias("commit"), F.lit("f.java").alias("filename"), violation.alias("violations"))
    sinks.write_reports(documents, str(tmp_path / "reports"), compression="gzip")
    text = documents.select(F.sum(F.length(F.to_json(F.struct("*"))) + 1)).first()[0]
    assert sum(f.stat().st_size for f in (tmp_path / "reports").iterdir()) < text / 4
    assert rows(spark.read.schema(documents.schema).json(str(tmp_path / "reports"))) == rows(documents)
