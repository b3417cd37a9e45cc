"""SQL equivalents of the registered queries, for a second engine on the same tables."""

from __future__ import annotations

# --- common table expressions -------------------------------------------------

COMMITS = """
commits AS (
  SELECT DISTINCT doc_id // 20 AS seq, sha1(CAST(doc_id // 20 AS VARCHAR)) AS commit FROM documents)"""

SNAPS = """
snaps AS (
  SELECT doc_id // 20 AS seq,
         source || '/File' || doc_id % 20 || CASE lang WHEN 'en' THEN '.java' WHEN 'de' THEN '.JAVA'
                                        WHEN 'fr' THEN '.py' ELSE '.txt' END AS path,
         text AS content, sha1(text) AS hash, lang
  FROM documents)"""

DAYS = """
days AS (
  SELECT CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS BIGINT) AS seq,
         'f' || user_id || '.java' AS path, sha1(event_type) AS hash
  FROM events
  QUALIFY row_number() OVER (PARTITION BY CAST(ts AS DATE), user_id ORDER BY ts DESC, event_id DESC) = 1),
day_log AS (SELECT DISTINCT CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS BIGINT) AS seq FROM events)"""


def _diff(trees: str, log: str) -> str:
    return f"""
diff AS (
  SELECT coalesce(c.seq, p.seq + 1) AS seq, coalesce(c.path, p.path) AS path,
         CASE WHEN p.path IS NULL THEN 'A' WHEN c.path IS NULL THEN 'D'
              WHEN c.hash <> p.hash THEN 'M' ELSE 'U' END AS kind,
         c.hash AS hash, p.hash AS prev_hash
  FROM {trees} c FULL OUTER JOIN {trees} p ON c.seq = p.seq + 1 AND c.path = p.path
  WHERE c.seq IS NOT NULL OR p.seq < (SELECT max(seq) FROM {log}))"""


RENAMES = """
moved AS (
  SELECT seq, coalesce(hash, prev_hash) AS hash, kind, path,
         row_number() OVER (PARTITION BY seq, coalesce(hash, prev_hash), kind ORDER BY path) AS n
  FROM diff WHERE kind IN ('A', 'D')),
renames AS (
  SELECT d.seq, d.path AS old_path, a.path AS new_path, a.hash
  FROM moved d JOIN moved a ON d.seq = a.seq AND d.hash = a.hash AND d.n = a.n AND d.kind = 'D' AND a.kind = 'A')"""

SELECTED = """
selected AS (
  SELECT seq, path, hash FROM diff d
  WHERE kind IN ('A', 'M') AND path LIKE '%.java'
    AND NOT EXISTS (SELECT 1 FROM renames r WHERE r.seq = d.seq AND r.new_path = d.path))"""

MARKED = """
marked AS (
  SELECT seq, path, hash, row_number() OVER (PARTITION BY hash ORDER BY seq, path) > 1 AS is_hit FROM selected)"""

# every distinct content once, and the findings of each
SCAN = """
contents AS (SELECT hash, any_value(content) AS content FROM snaps GROUP BY hash),
lines AS (
  SELECT hash, unnest(l) AS txt, CAST(generate_subscripts(l, 1) AS INTEGER) AS line
  FROM (SELECT hash, string_split(content, chr(10)) AS l FROM contents)),
found AS (
  SELECT hash, 'LongNumber' AS rule, 'numbers' AS ruleset, line FROM lines WHERE regexp_matches(txt, '[0-9]{3,}')
  UNION ALL SELECT hash, 'LongLine', 'layout', line FROM lines WHERE length(txt) > 120
  UNION ALL SELECT hash, 'LicenseText', 'legal', line FROM lines WHERE regexp_matches(txt, '(?i)licen[sc]e|copyright')
  UNION ALL SELECT hash, 'MailAddress', 'privacy', line FROM lines
            WHERE regexp_matches(txt, '[a-zA-Z0-9_.]+@[a-zA-Z0-9_.]+')
  UNION ALL SELECT hash, 'RepeatedLine', 'layout', line FROM (
              SELECT hash, line, row_number() OVER (PARTITION BY hash, txt ORDER BY line) AS k
              FROM lines WHERE trim(txt) <> '') WHERE k > 1
  UNION ALL SELECT hash, 'LongFile', 'layout', CAST(NULL AS INTEGER) FROM lines GROUP BY hash HAVING count(*) > 60),
tally AS (SELECT hash, rule, count(*) AS n FROM found GROUP BY ALL)"""

FINDINGS = """
findings AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS commit, CAST(l_partkey AS VARCHAR) AS path,
         CASE WHEN p_size <= 5 THEN '' WHEN p_size > 8 THEN p_brand END AS rule,
         CASE WHEN p_size = 1 THEN '' ELSE p_type END AS ruleset, l_linenumber AS line
  FROM lineitem JOIN part ON l_partkey = p_partkey),
keyed AS (
  SELECT *, coalesce(nullif(rule, ''), nullif(ruleset, ''), 'UNKNOWN') AS rule_key FROM findings),
log AS (SELECT CAST(o_orderkey AS VARCHAR) AS commit FROM orders)"""

RUN_LOG = """
run_log AS (
  SELECT commit, ok, code, duration_ms,
         CASE WHEN ok AND duration_ms = 0 THEN 'skipped' WHEN ok THEN 'success'
              WHEN code = -1 THEN 'git_failed' ELSE 'analyzer_failed' END AS outcome
  FROM (SELECT o_orderkey AS commit, o_orderstatus <> 'O' AS ok,
               CAST(CASE WHEN o_orderstatus <> 'O' THEN 0 WHEN o_orderkey % 2 = 0 THEN -1
                         ELSE o_orderkey % 5 END AS INTEGER) AS code,
               CASE WHEN o_orderstatus = 'P' THEN 0
                    ELSE CAST(round(o_totalprice * 100) AS BIGINT) // 20000 END AS duration_ms
        FROM orders))"""

REPORTS = """
whole AS (
  SELECT event_id, ts,
    '{' || CASE WHEN event_id % 5 = 0 THEN '"timestamp":"' || strftime(ts, '%Y-%m-%d %H:%M:%S') || '",' ELSE '' END
    || CASE WHEN event_id % 4 = 0 THEN '"formatVersion":' || event_id % 3 || ',"pmdVersion":"7.' || event_id % 9
              || '","metrics":"m' || event_type || '",' ELSE '' END
    || '"' || CASE WHEN event_id % 3 = 0 THEN 'fileReports' ELSE 'files' END || '":[{"'
    || CASE WHEN event_id % 13 = 0 THEN 'other' WHEN event_id % 2 = 0 THEN 'filename' ELSE 'file' END
    || '":"f' || user_id || '.java","violations":[{"rule":"' || event_type
    || '","beginline":' || json_extract_string(props, '$.k') || '}]}]}' AS doc
  FROM events),
docs AS (
  SELECT event_id,
    event_id || CASE WHEN event_id % 11 <> 0 AND event_id % 7 = 0 THEN '.error.json' ELSE '.json' END AS file_name,
    CASE WHEN event_id % 11 = 0 THEN '' WHEN event_id % 7 = 0 THEN doc[:length(doc) - 3] ELSE doc END AS text
  FROM whole),
parsed AS (
  SELECT event_id, file_name,
    coalesce(json_extract(text, '$.fileReports[0]'), json_extract(text, '$.files[0]')) AS f,
    json_extract_string(text, '$.timestamp') AS stamp, CAST(json_extract(text, '$.formatVersion') AS BIGINT) AS format_version,
    json_extract_string(text, '$.pmdVersion') AS tool_version, json_extract_string(text, '$.metrics') AS metrics
  FROM docs WHERE json_valid(text))"""


def _with(*ctes: str, body: str) -> str:
    return "WITH " + ",".join(ctes) + "\n" + body.strip()


DOC_DIFF = _diff("snaps", "commits")
DAY_DIFF = _diff("days", "day_log")
MINED = (COMMITS, SNAPS, DOC_DIFF, RENAMES, SELECTED, MARKED, SCAN)
PER_COMMIT = """
totals AS (SELECT hash, sum(n) AS n FROM tally GROUP BY hash),
tree AS (SELECT seq, count(*) FILTER (WHERE path LIKE '%.java') AS files_in_tree FROM snaps GROUP BY seq),
per_commit AS (
  SELECT seq, count(*) AS files_changed, count(*) FILTER (WHERE is_hit) AS cache_hits,
         count(*) FILTER (WHERE NOT is_hit) AS cache_misses, count(n) AS files_reported,
         count(n) FILTER (WHERE NOT is_hit) AS files_fresh, CAST(coalesce(sum(n), 0) AS BIGINT) AS findings,
         CAST(coalesce(sum(n) FILTER (WHERE NOT is_hit), 0) AS BIGINT) AS findings_fresh
  FROM marked LEFT JOIN totals USING (hash) GROUP BY seq)"""

ORACLE: dict[str, str] = {
    # --- commit log and trees
    "commit_log": _with(COMMITS, body="SELECT seq, commit FROM commits WHERE commit <> ''"),
    "commit_ordinal": """
SELECT row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS seq, CAST(o_orderkey AS VARCHAR) AS commit FROM orders""",
    "commit_pairs": _with(COMMITS, body="SELECT seq, commit, lag(commit) OVER (ORDER BY seq) AS prev_commit FROM commits"),
    "short_hash": _with(COMMITS, body="SELECT seq, left(commit, 8) AS short FROM commits"),
    "snapshot_scan": _with(SNAPS, body="SELECT seq, path, CAST(strlen(content) AS INTEGER) AS n_bytes, hash FROM snaps"),
    "ext_filter": _with(SNAPS, body="SELECT seq, path FROM snaps WHERE path LIKE '%.java'"),
    "path_relativize": _with(
        SNAPS,
        body="""
SELECT seq, '/w/' || path AS absolute, path AS relative,
       CASE WHEN starts_with(path, 'src1/') THEN substr(path, 6) ELSE '/w/' || path END AS under_src1,
       '/w/' || path AS unchanged
FROM snaps""",
    ),
    "content_hash": "SELECT doc_id, sha1(text) AS hash FROM documents",
    "split_lines": _with(
        SNAPS,
        body="SELECT seq, path, len(list_filter(string_split(content, chr(10)), lambda x: x <> '')) AS n_lines FROM snaps",
    ),
    "files_in_tree": _with(
        SNAPS, body="SELECT seq, count(*) FILTER (WHERE path LIKE '%.java') AS n_files FROM snaps GROUP BY seq"
    ),
    # --- history
    "snapshot_diff": _with(DAYS, DAY_DIFF, body="SELECT seq, path, kind, hash, prev_hash FROM diff"),
    "first_commit_full": _with(SNAPS, body="SELECT path, 'A' AS kind FROM snaps WHERE seq = 0 AND path LIKE '%.java'"),
    "change_kind_filter": _with(DAYS, DAY_DIFF, body="SELECT seq, path, kind FROM diff WHERE kind IN ('A', 'C', 'M')"),
    "rename_exact": _with(DAYS, DAY_DIFF, RENAMES, body="SELECT seq, old_path, new_path, hash FROM renames"),
    "existing_files": _with(
        DAYS, DAY_DIFF, body="SELECT seq, path, kind FROM diff WHERE (seq, path) IN (SELECT (seq, path) FROM days)"
    ),
    "missing_files": _with(
        DAYS, DAY_DIFF, body="SELECT seq, path FROM diff WHERE (seq, path) NOT IN (SELECT (seq, path) FROM days)"
    ),
    "files_changed": _with(
        DAYS,
        DAY_DIFF,
        RENAMES,
        SELECTED,
        body="""
SELECT l.seq, count(s.path) AS n_files FROM day_log l LEFT JOIN selected s ON l.seq = s.seq GROUP BY l.seq""",
    ),
    "files_changed_compat": _with(
        DAYS,
        DAY_DIFF,
        RENAMES,
        SELECTED,
        MARKED,
        body="""
SELECT l.seq, count(m.path) + count(m.path) FILTER (WHERE m.is_hit) AS n_files
FROM day_log l LEFT JOIN marked m ON l.seq = m.seq GROUP BY l.seq""",
    ),
    "placeholder_reports": """
SELECT CAST(o_orderkey AS VARCHAR) AS commit, CAST(0 AS BIGINT) AS num_java_files, CAST(0 AS BIGINT) AS n_warnings
FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)""",
    # --- contents and cache
    "first_seen": _with(
        SNAPS,
        body="""
SELECT hash, seq, path, n_copies FROM (
  SELECT *, row_number() OVER (PARTITION BY hash ORDER BY seq, path) AS k, count(*) OVER (PARTITION BY hash) AS n_copies
  FROM snaps) WHERE k = 1""",
    ),
    "dedup_stats": _with(
        SNAPS,
        body="""
SELECT count(*) AS n_files, count(DISTINCT hash) AS n_contents, count(*) - count(DISTINCT hash) AS n_repeats,
       (count(*) - count(DISTINCT hash)) / count(*) AS hit_ratio
FROM snaps""",
    ),
    "cache_hits": _with(
        COMMITS, SNAPS, DOC_DIFF, RENAMES, SELECTED, MARKED,
        body="""
SELECT seq, path, hash FROM marked WHERE is_hit OR hash IN (SELECT hash FROM marked WHERE seq % 2 = 0)""",
    ),
    "cache_misses": _with(
        COMMITS, SNAPS, DOC_DIFF, RENAMES, SELECTED, MARKED,
        body="""
SELECT seq, path, hash FROM marked WHERE NOT is_hit AND hash NOT IN (SELECT hash FROM marked WHERE seq % 2 = 0)""",
    ),
    "cache_backfill": _with(SNAPS, SCAN, body="SELECT hash, rule, n FROM tally"),
    "cache_load": _with(
        SNAPS,
        SCAN,
        body="SELECT hash, CAST(1 AS BIGINT) AS num_files, rule, n FROM contents LEFT JOIN tally USING (hash)",
    ),
    "cache_save": _with(SNAPS, SCAN, body="SELECT hash, rule, n FROM tally"),
    "cache_merge": _with(
        SNAPS,
        body="SELECT hash, max(seq) AS version, 'chars' AS rule, max(length(content) + seq) AS n FROM snaps GROUP BY hash",
    ),
    # --- scans
    "rule_scan": _with(SNAPS, SCAN, body="SELECT hash, rule, ruleset, line FROM found"),
    "rule_scan_table": _with(
        SNAPS,
        SCAN,
        body="""
SELECT seq, path, rule, line, message FROM snaps JOIN found USING (hash)
JOIN (VALUES ('LongNumber', 'long number'), ('LongLine', 'line too long'), ('LicenseText', 'license text'),
             ('MailAddress', 'mail address'), ('RepeatedLine', 'line repeated'), ('LongFile', 'file too long')) r(rule, message) USING (rule)
WHERE rule <> 'LongLine' OR lang = 'en'""",
    ),
    "rule_tally_file": _with(SNAPS, SCAN, body="SELECT hash, rule, n FROM tally"),
    "findings_by_commit": _with(SNAPS, SCAN, body="SELECT seq, path, rule, line FROM snaps JOIN found USING (hash)"),
    "analyzer_udf": _with(
        SNAPS, SCAN, body="SELECT hash, rule, ruleset, line FROM found WHERE rule = 'LongNumber'"
    ),
    "analyzer_errors": _with(
        SNAPS, body="SELECT DISTINCT hash, 'cannot analyze a file with @' AS error FROM snaps WHERE content LIKE '%@%'"
    ),
    "analyzer_supervised": _with(
        SNAPS,
        SCAN,
        body="""
, marked AS (SELECT DISTINCT hash, CASE WHEN length(content) % 2 = 1 THEN 'hang' ELSE 'crash' END AS failure FROM snaps WHERE content LIKE '%@%')
SELECT hash, rule, line, NULL AS failure FROM found WHERE rule = 'LongNumber' AND hash NOT IN (SELECT hash FROM marked)
UNION ALL SELECT hash, NULL, NULL, failure FROM marked""",
    ),
    # --- findings and reports
    "rule_key_fallback": _with(FINDINGS, body="SELECT rule_key AS rule, count(*) AS n FROM keyed GROUP BY ALL"),
    "rule_key_drop": _with(FINDINGS, body="SELECT rule, count(*) AS n FROM keyed WHERE rule <> '' GROUP BY ALL"),
    "rule_tally_global": _with(
        SNAPS, SCAN, body="SELECT rule, count(*) AS n FROM snaps JOIN found USING (hash) GROUP BY rule"
    ),
    "findings_per_commit": _with(
        FINDINGS,
        body="SELECT l.commit, count(f.commit) AS n_findings FROM log l LEFT JOIN keyed f USING (commit) GROUP BY l.commit",
    ),
    "map_merge_sum": _with(
        FINDINGS, body="SELECT commit, rule_key AS rule, count(*) AS n FROM keyed GROUP BY ALL"
    ),
    "nest_reports": _with(FINDINGS, body="SELECT commit, path, rule, ruleset, line FROM findings"),
    "flatten_findings": _with(
        FINDINGS,
        body="""
, placed AS (
  SELECT *, row_number() OVER (PARTITION BY commit ORDER BY path, rule NULLS FIRST, ruleset NULLS FIRST, line) AS k FROM keyed)
SELECT commit, count(*) AS n_warnings, min(rule_key) AS first_rule, max(rule_key) AS last_rule
FROM placed WHERE k = 1 OR CAST(commit AS BIGINT) % 3 <> 0 GROUP BY commit""",
    ),
    "commit_reports": _with(
        FINDINGS,
        body="""
, heads AS (
  SELECT l.commit, count(DISTINCT path) AS num_java_files, count(DISTINCT rule_key) AS n_rules, count(f.commit) AS n_warnings
  FROM log l LEFT JOIN keyed f USING (commit) GROUP BY l.commit)
SELECT h.commit, num_java_files, n_rules, n_warnings, path, rule, ruleset, line FROM heads h LEFT JOIN findings f ON f.commit = h.commit""",
    ),
    "sink_errors": _with(
        RUN_LOG,
        body="SELECT CAST(commit AS VARCHAR) AS commit, 'checkout failed' AS error FROM run_log WHERE outcome = 'git_failed'",
    ),
    # --- report documents
    "report_scan": _with(
        REPORTS,
        body="""
SELECT event_id, file_name, coalesce(json_extract_string(f, '$.file'), json_extract_string(f, '$.filename')) AS path,
       json_extract_string(f, '$.violations[0].rule') AS rule,
       CAST(json_extract(f, '$.violations[0].beginline') AS INTEGER) AS line
FROM parsed WHERE coalesce(json_extract_string(f, '$.file'), json_extract_string(f, '$.filename')) IS NOT NULL""",
    ),
    "report_parse_status": _with(
        REPORTS,
        body="""
SELECT event_id, CASE WHEN text <> '' AND NOT json_valid(text) THEN 'failed' ELSE 'ok' END AS status,
       CAST(CASE WHEN text <> '' AND json_valid(text) THEN 1 ELSE 0 END AS BIGINT) AS n_findings
FROM (SELECT event_id FROM events UNION SELECT o_orderkey FROM orders) LEFT JOIN docs USING (event_id)""",
    ),
    "report_errors": _with(
        REPORTS, body="SELECT event_id, 'unreadable report' AS error FROM docs WHERE text <> '' AND NOT json_valid(text)"
    ),
    "report_metadata": _with(
        REPORTS,
        body="""
SELECT event_id, stamp AS timestamp, format_version AS "formatVersion", tool_version AS "pmdVersion", metrics
FROM parsed WHERE stamp IS NOT NULL OR tool_version IS NOT NULL""",
    ),
    "report_bad_entries": _with(
        REPORTS,
        body="""
SELECT event_id, 'report entry without file name' AS error FROM parsed
WHERE json_extract_string(f, '$.file') IS NULL AND json_extract_string(f, '$.filename') IS NULL""",
    ),
    "field_fallback": _with(
        REPORTS,
        body="""
SELECT event_id, coalesce(json_extract_string(f, '$.file'), json_extract_string(f, '$.filename')) AS path FROM parsed""",
    ),
    "exclude_errors": _with(
        REPORTS, body="SELECT event_id, file_name FROM docs WHERE NOT suffix(file_name, '.error.json')"
    ),
    "error_scan": """
SELECT event_id || '.error.json' AS file_name, sha1(CAST(event_id AS VARCHAR)) AS commit,
       'k=' || json_extract_string(props, '$.k') AS error
FROM events WHERE event_type = 'error'""",
    "json_parse": "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events",
    # --- summaries
    "summary_parallel": _with(
        FINDINGS,
        body="""
SELECT (SELECT count(*) FROM log) AS number_of_commits,
       (SELECT count(*) FROM (SELECT DISTINCT commit, path FROM keyed)) / (SELECT count(*) FROM log) AS avg_files,
       (SELECT count(*) FROM keyed) / (SELECT count(*) FROM log) AS avg_warnings,
       rule_key AS rule, count(*) AS n
FROM keyed GROUP BY rule_key""",
    ),
    "summary_sequential": _with(
        FINDINGS,
        RUN_LOG,
        body="""
, sizes AS (
  SELECT r.commit, r.ok, r.code <> -1 AS seen, count(DISTINCT k.path) AS files, count(k.path) AS found
  FROM run_log r LEFT JOIN keyed k ON CAST(r.commit AS VARCHAR) = k.commit GROUP BY ALL)
SELECT count(*) FILTER (WHERE ok) AS number_of_commits_analyzed, count(*) AS total_commits_in_repo,
       round(sum(files) FILTER (WHERE seen) / count(*) FILTER (WHERE seen), 2) AS avg_of_num_java_files,
       round(sum(found) FILTER (WHERE ok) / count(*) FILTER (WHERE ok), 2) AS avg_of_num_warnings
FROM sizes""",
    ),
    "summary_sequential_tally": _with(
        FINDINGS,
        RUN_LOG,
        body="""
SELECT rule, count(*) AS n FROM keyed
WHERE rule <> '' AND commit IN (SELECT CAST(commit AS VARCHAR) FROM run_log WHERE ok) GROUP BY rule""",
    ),
    "round_means": """
SELECT o_orderstatus, o_orderpriority, round(sum(CAST(round(o_totalprice * 100) AS BIGINT)) / count(*), 2) AS mean_cents
FROM orders GROUP BY ALL""",
    "safe_ratio": _with(
        FINDINGS,
        body="""
SELECT l.commit, coalesce(count(f.commit) FILTER (WHERE f.rule <> '') / nullif(count(f.commit), 0), 0) AS named_share
FROM log l LEFT JOIN keyed f USING (commit) GROUP BY l.commit""",
    ),
    "run_stamp": "SELECT o_orderkey, strftime(o_orderdate, '%Y%m%d_%H%M%S') AS stamp FROM orders",
    # --- run log
    "exit_ok": _with(RUN_LOG, body="SELECT commit, code FROM run_log WHERE code IN (0, 4)"),
    "slow_commits": _with(RUN_LOG, body="SELECT commit, duration_ms FROM run_log WHERE duration_ms > 1000"),
    "outcome_counts": _with(RUN_LOG, body="SELECT outcome, count(*) AS n FROM run_log GROUP BY outcome"),
    "error_codes": _with(
        RUN_LOG, body="SELECT code, count(*) AS n FROM run_log WHERE outcome = 'analyzer_failed' GROUP BY code"
    ),
    "run_stats": _with(
        RUN_LOG,
        body="""
SELECT count(*) AS attempted, count(*) FILTER (WHERE outcome = 'success') AS succeeded,
       CAST(sum(duration_ms) FILTER (WHERE outcome = 'success') AS BIGINT) AS success_ms,
       sum(duration_ms) FILTER (WHERE outcome = 'success') / count(*) FILTER (WHERE outcome = 'success') AS ms_per_success,
       sum(duration_ms) / count(*) AS ms_per_attempt, sum(duration_ms) / count(*) <= 1000 AS target_met
FROM run_log""",
    ),
    "progress_checkpoints": _with(
        RUN_LOG,
        body="""
, numbered AS (
  SELECT row_number() OVER w AS processed, count(*) OVER () AS total,
         count(*) FILTER (WHERE outcome = 'skipped') OVER w AS skipped,
         count(*) FILTER (WHERE outcome = 'success') OVER w AS success,
         count(*) FILTER (WHERE outcome = 'analyzer_failed') OVER w AS analyzer_failed,
         count(*) FILTER (WHERE outcome = 'git_failed') OVER w AS git_failed
  FROM run_log WINDOW w AS (ORDER BY commit))
SELECT processed, skipped, success, analyzer_failed, git_failed FROM numbered
WHERE processed % 200 = 0 OR processed = total""",
    ),
    "done_commits": _with(RUN_LOG, body="SELECT DISTINCT commit FROM run_log WHERE ok OR code = -1"),
    "resume_pending": _with(RUN_LOG, body="SELECT commit, code FROM run_log WHERE NOT ok AND code <> -1"),
    # --- streams: what they end with is what a batch computes
    "stream_ingest": "SELECT DISTINCT sha1(text) AS commit, length(text) AS n_chars FROM documents",
    "stream_rule_tally": _with(
        SNAPS, SCAN, body="SELECT rule, count(*) AS n FROM snaps JOIN found USING (hash) GROUP BY rule"
    ),
    "stream_dedup": "SELECT DISTINCT sha1(text) AS hash FROM documents",
    # --- whole runs
    "mine_history": _with(
        *MINED,
        PER_COMMIT,
        body="""
SELECT c.seq, c.commit, files_in_tree, coalesce(files_changed, 0) AS files_changed, coalesce(cache_hits, 0) AS cache_hits,
       coalesce(cache_misses, 0) AS cache_misses, coalesce(files_reported, 0) AS files_reported,
       coalesce(files_fresh, 0) AS files_fresh, coalesce(findings, 0) AS findings,
       coalesce(findings_fresh, 0) AS findings_fresh, coalesce(findings - findings_fresh, 0) AS findings_cached
FROM commits c JOIN tree USING (seq) LEFT JOIN per_commit USING (seq)""",
    ),
    "mine_history_by_rule": _with(
        *MINED,
        body="""
SELECT seq, rule, CAST(sum(n) AS BIGINT) AS findings,
       CAST(coalesce(sum(n) FILTER (WHERE NOT is_hit), 0) AS BIGINT) AS fresh
FROM marked JOIN tally USING (hash) GROUP BY seq, rule""",
    ),
    "mine_history_summary": _with(
        COMMITS,
        SNAPS,
        DOC_DIFF,
        """
selected AS (SELECT seq, path, hash FROM diff WHERE kind IN ('A', 'M') AND path LIKE '%.java')""",
        MARKED,
        SCAN,
        PER_COMMIT,
        body="""
SELECT (SELECT count(*) FROM commits) AS number_of_commits,
       (SELECT sum(files_reported) FROM per_commit) / (SELECT count(*) FROM commits) AS avg_files,
       (SELECT sum(findings) FROM per_commit) / (SELECT count(*) FROM commits) AS avg_warnings,
       rule, CAST(sum(n) AS BIGINT) AS n,
       (SELECT sum(files_changed) FROM per_commit) / (SELECT count(*) FROM commits) AS avg_files_changed,
       (SELECT sum(files_in_tree) FROM tree) / (SELECT count(*) FROM commits) AS avg_files_in_tree
FROM marked JOIN tally USING (hash) GROUP BY rule""",
    ),
    "mine_history_reports": _with(
        *MINED,
        PER_COMMIT,
        body="""
, rules AS (SELECT seq, count(DISTINCT rule) AS n_rules FROM marked JOIN tally USING (hash) GROUP BY seq),
rows AS (SELECT seq, path, rule, ruleset, line FROM marked JOIN found USING (hash))
SELECT c.commit, coalesce(files_changed, 0) AS num_java_files, coalesce(n_rules, 0) AS n_rules, coalesce(findings, 0) AS n_warnings,
       path, rule, ruleset, line
FROM commits c LEFT JOIN per_commit USING (seq) LEFT JOIN rules USING (seq) LEFT JOIN rows USING (seq)""",
    ),
    "mine_history_analyzer": _with(
        *MINED,
        body="""
, failed AS (
  SELECT seq, min(path) || ': cannot analyze a file with @' AS error
  FROM marked JOIN contents USING (hash) WHERE content LIKE '%@%' GROUP BY seq),
numbers AS (
  SELECT seq, CAST(sum(n) AS BIGINT) AS n
  FROM marked JOIN tally USING (hash) WHERE rule = 'LongNumber' GROUP BY seq)
SELECT commit, CASE WHEN error IS NULL THEN coalesce(n, 0) END AS findings, error
FROM commits LEFT JOIN failed USING (seq) LEFT JOIN numbers USING (seq)""",
    ),
    "mine_full_tree_by_rule": _with(
        SNAPS,
        SCAN,
        body="""
SELECT seq, rule, count(*) AS findings FROM snaps JOIN found USING (hash) WHERE path LIKE '%.java' GROUP BY seq, rule""",
    ),
    "mine_full_tree_summary": _with(
        COMMITS,
        SNAPS,
        SCAN,
        body="""
, java AS (SELECT hash FROM snaps WHERE path LIKE '%.java'), java_found AS (SELECT rule FROM java JOIN found USING (hash))
SELECT (SELECT count(*) FROM commits) AS n_commits,
       round((SELECT count(*) FROM java) / (SELECT count(*) FROM commits), 2) AS avg_files,
       round((SELECT count(*) FROM java_found) / (SELECT count(*) FROM commits), 2) AS avg_warnings,
       rule, count(*) AS n
FROM java_found GROUP BY rule""",
    ),
    "mine_full_tree": _with(
        COMMITS,
        SNAPS,
        SCAN,
        body="""
SELECT c.seq, c.commit, count(DISTINCT s.path) AS files_in_tree, count(f.hash) AS findings
FROM commits c LEFT JOIN snaps s ON c.seq = s.seq AND s.path LIKE '%.java' LEFT JOIN found f ON f.hash = s.hash
GROUP BY c.seq, c.commit""",
    ),
}
ORACLE["summary_json"] = ORACLE["summary_parallel"]
ORACLE["mine_history_outcomes"] = _with(
    *MINED,
    body="""
, failed AS (SELECT DISTINCT seq FROM marked JOIN contents USING (hash) WHERE content LIKE '%@%')
SELECT seq, commit, CASE WHEN seq IN (SELECT seq FROM failed) THEN 'analyzer_failed'
                         WHEN seq IN (SELECT seq FROM marked) THEN 'success' ELSE 'skipped' END AS outcome
FROM commits""",
)
ORACLE["sink_reports"] = ORACLE["commit_reports"]
ORACLE["mine_history_warm"] = ORACLE["mine_history_reports"]
ORACLE["mine_history_resumed"] = ORACLE["mine_history_killed"] = ORACLE["mine_history"]
ORACLE["mine_history_killed_reports"] = ORACLE["mine_history_reports"]
ORACLE["mine_history_resumed_summary"] = _with(
    *MINED,
    PER_COMMIT,
    body="""
SELECT (SELECT count(*) FROM commits) AS number_of_commits,
       (SELECT sum(files_reported) FROM per_commit) / (SELECT count(*) FROM commits) AS avg_files,
       (SELECT sum(findings) FROM per_commit) / (SELECT count(*) FROM commits) AS avg_warnings,
       rule, CAST(sum(n) AS BIGINT) AS n
FROM marked JOIN tally USING (hash) GROUP BY rule""",
)
ORACLE["mine_history_repeated"] = ORACLE["mine_history_resumed_summary"]
ORACLE["mine_full_tree_failures"] = _with(
    COMMITS,
    SNAPS,
    SCAN,
    body="""
, listed AS (SELECT seq, seq % 7 <> 3 AS seen FROM commits WHERE seq < (SELECT max(seq) FROM commits)),
java AS (SELECT seq, path, hash, content FROM snaps JOIN listed USING (seq) WHERE seen AND path LIKE '%.java'),
bad AS (SELECT seq, min(path) || ': cannot analyze a file with @' AS error FROM java WHERE content LIKE '%@%' GROUP BY seq),
ok AS (SELECT seq FROM listed WHERE seen AND seq NOT IN (SELECT seq FROM bad)),
numbers AS (SELECT count(*) AS n FROM java JOIN found USING (hash) WHERE rule = 'LongNumber' AND seq IN (SELECT seq FROM ok))
SELECT l.seq, CASE WHEN seen THEN (SELECT count(*) FROM java j WHERE j.seq = l.seq) END AS files_in_tree, error,
       (SELECT count(*) FROM ok) AS number_of_commits_analyzed, (SELECT count(*) FROM listed) AS total_commits_in_repo,
       round((SELECT count(*) FROM java) / (SELECT count(*) FROM listed WHERE seen), 2) AS avg_of_num_java_files,
       round((SELECT n FROM numbers) / (SELECT count(*) FROM ok), 2) AS avg_of_num_warnings, (SELECT n FROM numbers) AS long_numbers
FROM listed l LEFT JOIN bad USING (seq) WHERE l.seq NOT IN (SELECT seq FROM ok)""",
)
ORACLE["report_scan_nested"] = """
SELECT CAST(l_orderkey AS VARCHAR) AS commit, CAST(l_partkey AS VARCHAR) AS path,
       CASE WHEN p_size <= 5 THEN '' WHEN p_size > 8 THEN p_brand END AS rule,
       CASE WHEN p_size = 1 THEN '' ELSE p_type END AS ruleset, l_linenumber AS line
FROM lineitem JOIN part ON l_partkey = p_partkey"""
ORACLE["mine_history_metadata"] = _with(
    *MINED,
    PER_COMMIT,
    body="""
SELECT c.commit, coalesce(files_changed, 0) AS num_java_files,
       CASE WHEN seq % 3 <> 0 THEN seq % 5 END AS "formatVersion", CASE WHEN seq % 3 <> 0 THEN '7.' || seq END AS "pmdVersion",
       CASE WHEN seq % 3 <> 0 THEN 't' || seq END AS timestamp, CAST(NULL AS VARCHAR) AS metrics
FROM commits c LEFT JOIN per_commit USING (seq)""",
)
ORACLE["tree_intervals"] = _with(
    DAYS,
    body="""
, begun AS (
  SELECT *, CASE WHEN lag(hash) OVER life = hash AND lag(seq) OVER life = seq - 1 THEN 0 ELSE 1 END AS begins
  FROM days WINDOW life AS (PARTITION BY path ORDER BY seq)),
runs AS (SELECT *, sum(begins) OVER (PARTITION BY path ORDER BY seq) AS run FROM begun)
SELECT path, hash, min(seq) AS first_seq, max(seq) AS last_seq FROM runs GROUP BY path, hash, run""",
)
ORACLE["interval_diff"] = _with(DAYS, DAY_DIFF, body="SELECT seq, path, kind, hash, prev_hash FROM diff WHERE kind <> 'U'")
ORACLE["interval_files_in_tree"] = _with(DAYS, body="SELECT seq, count(*) AS n_files FROM days GROUP BY seq")
ORACLE["interval_existing_files"] = _with(DAYS, DAY_DIFF, body="SELECT seq, path, hash IS NOT NULL AS present FROM diff")
