"""Views that read the test tables as commits, trees, findings, run logs and reports."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from historymine.functions.scalars import content_hash
from historymine.functions.skew import spread_join
from historymine.session import scratch_path
from historymine.sources.rules import Rule
from historymine.sources.snapshots import spread_scan

FILES_PER_COMMIT = 20
FIRST_DAY = "2024-01-01"

RULES = [
    Rule("LongNumber", "numbers", "line_regex", "[0-9]{3,}", message="long number"),
    Rule("LongLine", "layout", "line_length", threshold=120.0, message="line too long"),
    Rule("LicenseText", "legal", "line_regex", "(?i)licen[sc]e|copyright", message="license text"),
    Rule("MailAddress", "privacy", "line_regex", "[a-zA-Z0-9_.]+@[a-zA-Z0-9_.]+", message="mail address", needle="@"),
    Rule("RepeatedLine", "layout", "duplicate_line", message="line repeated"),
    Rule("LongFile", "layout", "file_metric", "n_lines > 60", message="file too long"),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _sha_of(number: str):
    return F.sha1(F.col(number).cast("string").cast("binary"))


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each run of 20 documents is the tree of one commit."""
    seqs = table(spark, sf_dir, "documents").select(F.expr(f"doc_id div {FILES_PER_COMMIT}").alias("seq")).distinct()
    return seqs.select("seq", _sha_of("seq").alias("commit"))


def _document_files(documents: DataFrame) -> DataFrame:
    """Documents as files; the position in the commit is part of the name, so paths are unique in a tree."""
    ext = (
        F.when(F.col("lang") == "en", ".java")
        .when(F.col("lang") == "de", ".JAVA")
        .when(F.col("lang") == "fr", ".py")
        .otherwise(".txt")
    )
    return documents.select(
        F.expr(f"doc_id div {FILES_PER_COMMIT}").alias("seq"),
        F.concat("source", F.lit("/File"), (F.col("doc_id") % FILES_PER_COMMIT).cast("string"), ext).alias("path"),
        F.col("text").alias("content"),
        content_hash("text").alias("hash"),
        "lang",
    )


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(seq, path, content, hash, lang)`` from documents."""
    return _document_files(table(spark, sf_dir, "documents"))


def contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, spread over all cores where the table is read by fewer tasks; for scans."""
    return _document_files(spread_scan(table(spark, sf_dir, "documents")))


def deliveries(rows: DataFrame, batches: int = 4) -> Callable[[], DataFrame]:
    """Write ``rows`` as several files; each call gives a stream that takes them in ``batches`` micro-batches.

    There are at least as many files as the scan of ``rows`` has partitions, so none grows with the table.
    """
    path = scratch_path(rows.sparkSession, "deliveries")
    files = -(-rows.rdd.getNumPartitions() // batches)  # per batch
    rows.repartition(batches * files).write.parquet(path)
    return lambda: rows.sparkSession.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(path)


def daily_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(seq, path, hash)`` from events: a file per user, its content the user's last event of the day."""
    return (
        table(spark, sf_dir, "events")
        .groupBy(
            F.date_diff(F.to_date("ts"), F.to_date(F.lit(FIRST_DAY))).cast("bigint").alias("seq"),
            F.concat(F.lit("f"), F.col("user_id").cast("string"), F.lit(".java")).alias("path"),
        )
        .agg(F.max(F.struct("ts", "event_id", "event_type")).alias("last"))
        .select("seq", "path", content_hash("last.event_type").alias("hash"))
    )


def daily_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    seqs = table(spark, sf_dir, "events").select(
        F.date_diff(F.to_date("ts"), F.to_date(F.lit(FIRST_DAY))).cast("bigint").alias("seq")
    ).distinct()
    return seqs.select("seq", _sha_of("seq").alias("commit"))


def order_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(commit)``: every order is a commit, for the findings below."""
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("commit"))


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings in long form from lineitem and part; some name no rule, some not even a rule set."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_size", "p_brand", "p_type")
    joined = spread_join(lines, parts, ["l_partkey"], ["l_orderkey", "l_linenumber"])
    return joined.select(
        F.col("l_orderkey").cast("string").alias("commit"),
        F.col("l_partkey").cast("string").alias("path"),
        F.when(F.col("p_size") <= 5, "").when(F.col("p_size") > 8, F.col("p_brand")).alias("rule"),
        F.when(F.col("p_size") == 1, "").otherwise(F.col("p_type")).alias("ruleset"),
        F.col("l_linenumber").alias("line"),
        F.lit(None).cast("string").alias("message"),
    )


def run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(commit, ok, code, duration_ms)`` from orders; commits keep their numeric key."""
    ok = F.col("o_orderstatus") != "O"
    code = F.when(ok, 0).when(F.col("o_orderkey") % 2 == 0, -1).otherwise((F.col("o_orderkey") % 5).cast("int"))
    duration = F.expr("cast(round(o_totalprice * 100) as bigint) div 20000")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("commit"),
        ok.alias("ok"),
        code.cast("int").alias("code"),
        F.when(F.col("o_orderstatus") == "P", F.lit(0).cast("bigint")).otherwise(duration).alias("duration_ms"),
    )


def report_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(event_id, file_name, text)``: a JSON report per event.

    Some are empty, some cut short; they name their file and their list in
    different ways, some not at all, and some carry a time.
    """
    id_, text = F.col("event_id"), F.lit
    name_field = F.when(id_ % 13 == 0, "other").when(id_ % 2 == 0, "filename").otherwise("file")
    list_field = F.when(id_ % 3 == 0, "fileReports").otherwise("files")
    stamp = F.when(id_ % 5 == 0, F.concat(text('"timestamp":"'), F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), text('",')))
    tool = F.when(id_ % 4 == 0, F.concat(text('"formatVersion":'), (id_ % 3).cast("string"), text(',"pmdVersion":"7.'), (id_ % 9).cast("string"), text('","metrics":"m'), F.col("event_type"), text('",')))
    whole = F.concat(
        text("{"), F.coalesce(stamp, text("")), F.coalesce(tool, text("")), text('"'), list_field, text('":[{"'), name_field, text('":"f'),
        F.col("user_id").cast("string"), text('.java","violations":[{"rule":"'), F.col("event_type"),
        text('","beginline":'), F.get_json_object("props", "$.k"), text("}]}]}"),
    )
    cut = (id_ % 11 != 0) & (id_ % 7 == 0)
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.concat(id_.cast("string"), F.when(cut, ".error.json").otherwise(".json")).alias("file_name"),
        F.when(id_ % 11 == 0, "").when(cut, F.substring(whole, F.lit(1), F.length(whole) - 3)).otherwise(whole).alias("text"),
    )


def error_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(event_id, file_name, text)``: error records for the events that failed, reports for the others."""
    failed = F.col("event_type") == "error"
    record = F.to_json(F.struct(_sha_of("event_id").alias("commit"), F.concat(F.lit("k="), F.get_json_object("props", "$.k")).alias("error")))
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.concat(F.col("event_id").cast("string"), F.when(failed, ".error.json").otherwise(".json")).alias("file_name"),
        F.when(failed, record).otherwise("{}").alias("text"),
    )
