"""Explicit schemas of the tables and documents; nothing is inferred."""

from __future__ import annotations

FINDINGS = "commit STRING, path STRING, rule STRING, ruleset STRING, line INT, message STRING"
FINDINGS_BY_CONTENT = "hash STRING, rule STRING, ruleset STRING, line INT, message STRING"
CACHE = "hash STRING, ruleset_id STRING, warnings_by_rule MAP<STRING,BIGINT>, num_files BIGINT, version BIGINT"
RUN_LOG = "commit STRING, ok BOOLEAN, code INT, duration_ms BIGINT"
RUN_COMMITS = (
    "seq BIGINT, commit STRING, files_in_tree BIGINT, files_changed BIGINT, cache_hits BIGINT, cache_misses BIGINT, "
    "files_reported BIGINT, files_fresh BIGINT, findings BIGINT, findings_fresh BIGINT, findings_cached BIGINT"
)
RUN_BY_RULE = "seq BIGINT, rule STRING, findings BIGINT, fresh BIGINT, files BIGINT, fresh_files BIGINT"
RUN_ERRORS = "seq BIGINT, commit STRING, error STRING"
MANIFEST = "run STRING, position BIGINT, kind STRING, identity STRING, location STRING"
RULES = "rule STRING, ruleset STRING, kind STRING, pattern STRING, threshold DOUBLE, message STRING, needle STRING, lang STRING"

# Field names of the JSON documents that analyzers and earlier
# runs leave behind. They have to be spelled exactly like this.
# A finding is read as a map: its keys differ between analyzers, also only in case.
FINDING_JSON = "MAP<STRING,STRING>"
FILE_REPORT_JSON = f"STRUCT<file: STRING, filename: STRING, violations: ARRAY<{FINDING_JSON}>>"
RAW_REPORT_JSON = (
    "formatVersion BIGINT, pmdVersion STRING, timestamp STRING, metrics STRING, "
    f"fileReports ARRAY<{FILE_REPORT_JSON}>, files ARRAY<{FILE_REPORT_JSON}>, "
    f"violations ARRAY<{FINDING_JSON}>"
)
METADATA_FIELDS = ("formatVersion", "pmdVersion", "timestamp", "metrics")
ERROR_JSON = "commit STRING, error STRING"
CACHE_JSON = "MAP<STRING, STRUCT<warnings_by_rule: MAP<STRING,BIGINT>, num_java_files: BIGINT>>"
COMMIT_REPORT_JSON = (
    "commit STRING, num_java_files BIGINT, warnings_by_rule MAP<STRING,BIGINT>, "
    "formatVersion BIGINT, pmdVersion STRING, timestamp STRING, metrics STRING, "
    "filename STRING, violations ARRAY<STRUCT<rule: STRING, ruleSet: STRING, line: INT, message: STRING>>"
)
WHOLE_REPORT_JSON = (
    "commit STRING, num_java_files BIGINT, warnings_by_rule MAP<STRING,BIGINT>, "
    "warnings ARRAY<STRUCT<rule: STRING, ruleSet: STRING, line: INT, message: STRING>>, "
    "files ARRAY<STRUCT<filename: STRING, "
    "violations: ARRAY<STRUCT<rule: STRING, ruleSet: STRING, line: INT, message: STRING>>>>, "
    "formatVersion BIGINT, pmdVersion STRING, timestamp STRING, metrics STRING"
)
SUMMARY_JSON = (
    "location STRING, "
    "stat_of_repository STRUCT<number_of_commits: BIGINT, avg_of_num_java_files: DOUBLE, avg_of_num_warnings: DOUBLE>, "
    "stat_of_warnings MAP<STRING,BIGINT>"
)
