"""DataFrame operators over the text functions."""

from .audit import changed_lines, compare_forms, normalization_audit, quick_check_report
from .matching import collision_groups, dedup_by_key, match_join, search, with_match_key
from .spoofing import first_hit, registrable, spoof_join, taken

__all__ = [
    "changed_lines", "collision_groups", "compare_forms", "dedup_by_key", "first_hit", "match_join", "normalization_audit", "quick_check_report", "registrable", "search", "spoof_join",
    "taken", "with_match_key",
]
