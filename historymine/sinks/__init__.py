from historymine.sinks.writers import save_cache, summary_json, write_errors, write_reports, write_summary

__all__ = ["save_cache", "summary_json", "write_errors", "write_reports", "write_summary"]
