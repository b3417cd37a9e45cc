from historymine.streaming.jobs import dedup_contents, ingest_reports, run_available, running_tally

__all__ = ["dedup_contents", "ingest_reports", "run_available", "running_tally"]
