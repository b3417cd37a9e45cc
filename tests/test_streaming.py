"""Streams end with what a batch computes, also over several runs and files."""

from pyspark.sql import functions as F

from historymine.bindings import views as V
from historymine.operators import scan
from historymine.sources import Rule
from historymine.streaming import dedup_contents, ingest_reports, running_tally
from historymine.streaming.jobs import latest_tally, run_available

SCHEMA = "commit STRING, seq BIGINT"


def _deliver(spark, inbox, rows, schema=SCHEMA):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(inbox)


def test_ingest_adds_each_commit_once(spark, tmp_path, rows):
    inbox, table, checkpoint = (str(tmp_path / n) for n in ("inbox", "table", "checkpoint"))
    arrivals = [[("a", 1), ("b", 2), ("a", 3)], [("b", 9), ("c", 4)], [("a", 0)]]
    for batch in arrivals:
        _deliver(spark, inbox, batch)
        ingest_reports(spark.readStream.schema(SCHEMA).parquet(inbox), table, checkpoint)
    assert rows(spark.read.parquet(table), "commit", "seq") == [("a", 1), ("b", 2), ("c", 4)]


def _forget_last_commit(checkpoint):
    """Leave the checkpoint as it is after a crash in the last batch: begun, not finished."""
    done = sorted((p for p in (checkpoint / "commits").iterdir() if p.name.isdigit()), key=lambda p: int(p.name))
    for side in (done[-1], done[-1].with_name(f".{done[-1].name}.crc")):
        side.unlink(missing_ok=True)


def test_replayed_batch_changes_nothing(spark, tmp_path, rows):
    inbox, table, checkpoint = str(tmp_path / "inbox"), str(tmp_path / "table"), tmp_path / "checkpoint"
    wanted = [("a", 1), ("b", 2), ("c", 3)]
    for batch in ([("a", 1), ("b", 2)], [("b", 5), ("c", 3)]):
        _deliver(spark, inbox, batch)
        ingest_reports(spark.readStream.schema(SCHEMA).parquet(inbox), table, str(checkpoint))
    assert rows(spark.read.parquet(table), "commit", "seq") == wanted
    _forget_last_commit(checkpoint)
    _deliver(spark, inbox, [("c", 0), ("d", 4), ("a", 0)])
    ingest_reports(spark.readStream.schema(SCHEMA).parquet(inbox), table, str(checkpoint))
    assert rows(spark.read.parquet(table), "commit", "seq") == [*wanted, ("d", 4)]


def test_batch_reads_nothing_of_its_own_table(spark, tmp_path, rows):
    """What the query wrote before is in its state: files of its own are not opened again, so they may be gone."""
    inbox, table, checkpoint = (str(tmp_path / n) for n in ("inbox", "table", "checkpoint"))
    _deliver(spark, inbox, [("a", 1), ("b", 2)])
    ingest_reports(spark.readStream.schema(SCHEMA).parquet(inbox), table, checkpoint)
    for part in (tmp_path / "table").rglob("*.parquet"):
        part.write_bytes(b"no parquet")
    _deliver(spark, inbox, [("b", 0), ("c", 3)])
    ingest_reports(spark.readStream.schema(SCHEMA).parquet(inbox), table, checkpoint)
    added = spark.read.schema(SCHEMA).parquet(*map(str, (tmp_path / "table").glob("stream=*/batch_id=1")))
    assert rows(added) == [("c", 3)]


def test_second_source_and_second_checkpoint(spark, tmp_path, rows):
    """Another source adds to the table; the first source under a fresh checkpoint brings nothing twice."""
    table = str(tmp_path / "table")
    _deliver(spark, str(tmp_path / "one"), [("a", 1), ("b", 2)])
    _deliver(spark, str(tmp_path / "two"), [("b", 7), ("c", 3)])
    for n, inbox in enumerate(("one", "two", "one")):
        ingest_reports(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / inbox)), table, str(tmp_path / f"checkpoint{n}"))
    assert rows(spark.read.parquet(table), "commit", "seq") == [("a", 1), ("b", 2), ("c", 3)]


def test_tally_under_a_fresh_checkpoint(spark, tmp_path, rows):
    inbox, table = str(tmp_path / "inbox"), str(tmp_path / "table")
    schema = "hash STRING, content STRING"
    rules = [Rule("Number", "s", "line_regex", "[0-9]")]
    for n, batch in enumerate(([("h", "1")], [("g", "2")], [("f", "3")])):
        _deliver(spark, inbox, batch, schema)
        stream = spark.readStream.schema(schema).parquet(inbox)
        running_tally(stream, rules, table, str(tmp_path / ("old" if n < 2 else "fresh")))
    assert rows(latest_tally(spark, table)) == [("Number", 3)]


def test_old_tally_written_again_does_not_replace_the_latest(spark, tmp_path, rows):
    table, schema = str(tmp_path / "table"), "hash STRING, content STRING"
    rules = [Rule("Number", "s", "line_regex", "[0-9]")]
    for inbox, batch in (("one", [("h", "1")]), ("one", [("g", "2")]), ("two", [("f", "3"), ("e", "4"), ("d", "5")])):
        _deliver(spark, str(tmp_path / inbox), batch, schema)
        running_tally(spark.readStream.schema(schema).parquet(str(tmp_path / inbox)), rules, table, str(tmp_path / f"{inbox}-checkpoint"))
    _forget_last_commit(tmp_path / "one-checkpoint")
    running_tally(spark.readStream.schema(schema).parquet(str(tmp_path / "one")), rules, table, str(tmp_path / "one-checkpoint"))
    assert rows(latest_tally(spark, table)) == [("Number", 3)]


def test_contents_once_per_rule_set(spark, tmp_path, rows):
    inbox, table, checkpoint = (str(tmp_path / n) for n in ("inbox", "table", "checkpoint"))
    schema = "hash STRING, ruleset_id STRING"
    for batch in ([("h", "r")] * 50 + [("g", "r")], [("h", "r"), ("h", "s")]):
        _deliver(spark, inbox, batch, schema)
        dedup_contents(spark.readStream.schema(schema).parquet(inbox), table, checkpoint)
    assert rows(spark.read.parquet(table), "hash", "ruleset_id") == [("g", "r"), ("h", "r"), ("h", "s")]


def test_running_tally_equals_batch(spark, tmp_path, rows):
    inbox, table, checkpoint = (str(tmp_path / n) for n in ("inbox", "table", "checkpoint"))
    schema = "hash STRING, content STRING"
    rules = [Rule("Number", "s", "line_regex", "[0-9]"), Rule("Again", "s", "duplicate_line")]
    for batch in ([("h", "1\n2\n1")], [("g", "x\nx\nx"), ("f", "7")]):
        _deliver(spark, inbox, batch, schema)
        running_tally(spark.readStream.schema(schema).parquet(inbox), rules, table, checkpoint)
    every = scan.rule_scan(spark.read.schema(schema).parquet(inbox), rules)
    assert rows(latest_tally(spark, table), "rule", "n") == rows(every.groupBy("rule").agg(F.count(F.lit(1)).alias("n")))


def test_deliveries_grow_in_files_not_in_size(spark, tmp_path):
    """A table of many partitions arrives in four micro-batches as ever, each of several files."""
    seen = []
    arriving = V.deliveries(spark.range(0, 600, 1, 22).toDF("n"))
    run_available(arriving().withColumn("file", F.input_file_name()), lambda batch, _: seen.append(batch.agg(F.count_distinct("file"), F.count("n"), F.sum("n")).first()), str(tmp_path / "c"))
    assert [r[0] for r in seen] == [6, 6, 6, 6]
    assert (sum(r[1] for r in seen), sum(r[2] for r in seen)) == (600, 600 * 599 // 2)
