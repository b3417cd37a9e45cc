"""Analyzer reports and error records as JSON documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from historymine import schema as S
from historymine.functions.scalars import first_present

_CORRUPT = "_corrupt"


def read_documents(spark: SparkSession, path: str, pattern: str = "*.json") -> DataFrame:
    """``(file_name, text)``, one row per JSON file; an empty file has empty text."""
    files = spark.read.text(path, wholetext=True, pathGlobFilter=pattern)
    return files.select(F.col("_metadata.file_name").alias("file_name"), F.col("value").alias("text"))


def is_error_file(file_name: str = "file_name") -> Column:
    return F.col(file_name).endswith(".error.json")


def parse_reports(documents: DataFrame, text: str = "text", schema: str = S.RAW_REPORT_JSON) -> DataFrame:
    """Parse JSON text into the column ``report``; unreadable text leaves it null and sets ``corrupt``."""
    parsed = F.from_json(text, f"{schema}, {_CORRUPT} STRING", {"columnNameOfCorruptRecord": _CORRUPT})
    broken = (F.trim(text) != "") & F.col(f"_parsed.{_CORRUPT}").isNotNull()
    # unfolding an array of one keeps the parse from being repeated for every field taken from it
    return (
        documents.select("*", F.explode(F.array(parsed)).alias("_parsed"))
        .withColumn("corrupt", F.coalesce(broken, F.lit(False)))
        .withColumn("report", F.when(~F.col("corrupt"), F.col("_parsed").dropFields(_CORRUPT)))
        .drop("_parsed")
    )


def parse_status(parsed: DataFrame) -> DataFrame:
    """``ok`` or ``failed``: absent, empty and finding-free reports are fine, corrupt ones are not."""
    return parsed.withColumn("status", F.when(F.col("corrupt"), "failed").otherwise("ok"))


def corrupt_reports(parsed: DataFrame, *keys: str) -> DataFrame:
    """``(keys, error)``: an error row for every report that could not be read."""
    return parsed.where("corrupt").select(*keys, F.lit("unreadable report").alias("error"))


def status_of_log(log: DataFrame, adapted: DataFrame, key: str) -> DataFrame:
    """``(key, status, n_findings)`` for every row of the log: a commit without a report is fine and has none."""
    n = F.aggregate("files", F.lit(0).cast("bigint"), lambda acc, f: acc + F.size(f["violations"]))
    found = parse_status(adapted).select(key, "status", n.alias("n_findings"))
    return log.select(key).join(found, key, "left").select(key, F.coalesce("status", F.lit("ok")).alias("status"), F.coalesce("n_findings", F.lit(0)).alias("n_findings"))


def parse_errors(documents: DataFrame, text: str = "text") -> DataFrame:
    """``(commit, error)`` of the documents that are error records."""
    record = F.from_json(text, S.ERROR_JSON)
    kept = [c for c in documents.columns if c != text]
    return documents.where(is_error_file()).select(*kept, record.alias("_e")).select(*kept, "_e.commit", "_e.error")


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """All commit reports below ``path`` parsed, error records left out."""
    return parse_reports(read_documents(spark, path).where(~is_error_file()))


def adapt_findings(violations: str | Column) -> Column:
    """Findings in our shape; analyzers differ in how they spell rule set, line and message."""
    array = F.col(violations) if isinstance(violations, str) else violations
    return F.transform(
        array,
        lambda v: F.struct(
            v["rule"].alias("rule"),
            F.coalesce(v["ruleSet"], v["ruleset"]).alias("ruleSet"),
            F.coalesce(v["line"], v["beginline"]).try_cast("int").alias("line"),
            F.coalesce(v["message"], v["description"]).alias("message"),
        ),
    )


def adapt_reports(parsed: DataFrame, report: str = "report") -> DataFrame:
    """Add ``files``: the file entries under one name, with one spelling of their fields."""
    empty = F.array().cast(f"ARRAY<{S.FILE_REPORT_JSON}>")
    entries = F.coalesce(F.col(f"{report}.fileReports"), F.col(f"{report}.files"), empty)
    files = F.transform(
        entries,
        lambda f: F.struct(
            F.coalesce(f["file"], f["filename"]).alias("filename"),
            adapt_findings(F.coalesce(f["violations"], F.array().cast(f"ARRAY<{S.FINDING_JSON}>"))).alias("violations"),
        ),
    )
    return parsed.withColumn("files", files)


def bad_entries(adapted: DataFrame, *keys: str) -> DataFrame:
    """Report entries that name no file, as ``(keys, error)`` rows."""
    entry = adapted.select(*keys, F.explode("files").alias("_f"))
    return entry.where(first_present("_f.filename").isNull()).select(*keys, F.lit("report entry without file name").alias("error"))


def explode_findings(adapted: DataFrame, *keys: str) -> DataFrame:
    """Long form: one row per finding; files without findings give none, entries without file name are ``bad_entries``."""
    files = adapted.select(*keys, F.explode("files").alias("_f")).where(first_present("_f.filename").isNotNull())
    findings = files.select(*keys, F.col("_f.filename").alias("path"), F.explode("_f.violations").alias("_v"))
    return findings.select(
        *keys,
        "path",
        F.col("_v.rule").alias("rule"),
        F.col("_v.ruleSet").alias("ruleset"),
        F.col("_v.line").alias("line"),
        F.col("_v.message").alias("message"),
    )


def report_metadata(parsed: DataFrame, *keys: str, report: str = "report") -> DataFrame:
    """The four optional metadata fields, null where a report does not carry them."""
    return parsed.select(*keys, *[F.col(f"{report}.{name}").alias(name) for name in S.METADATA_FIELDS])
