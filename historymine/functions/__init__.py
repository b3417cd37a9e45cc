from historymine.functions.ordinals import number_rows, running_totals
from historymine.functions.scalars import (
    absolute_path,
    content_hash,
    first_present,
    has_suffix,
    non_blank_lines,
    relative_path,
    rule_key,
    run_stamp,
    safe_ratio,
    short_hash,
)
from historymine.functions.skew import pick_rows, spread_join

__all__ = [
    "absolute_path",
    "content_hash",
    "first_present",
    "has_suffix",
    "non_blank_lines",
    "number_rows",
    "pick_rows",
    "relative_path",
    "rule_key",
    "run_stamp",
    "running_totals",
    "safe_ratio",
    "short_hash",
    "spread_join",
]
