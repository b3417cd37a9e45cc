from historymine.sources.cache import cache_from_json, empty_cache, read_cache
from historymine.sources.commits import order_commits, read_commit_log
from historymine.sources.reports import (
    adapt_findings,
    adapt_reports,
    bad_entries,
    corrupt_reports,
    explode_findings,
    is_error_file,
    parse_errors,
    parse_reports,
    parse_status,
    read_documents,
    read_reports,
    report_metadata,
    status_of_log,
)
from historymine.sources.rules import Rule, load_rules, ruleset_id
from historymine.sources.snapshots import read_trees, with_hash

__all__ = [
    "Rule",
    "adapt_findings",
    "adapt_reports",
    "bad_entries",
    "cache_from_json",
    "corrupt_reports",
    "empty_cache",
    "explode_findings",
    "is_error_file",
    "load_rules",
    "order_commits",
    "parse_errors",
    "parse_reports",
    "parse_status",
    "read_cache",
    "read_commit_log",
    "read_documents",
    "read_reports",
    "read_trees",
    "report_metadata",
    "ruleset_id",
    "status_of_log",
    "with_hash",
]
