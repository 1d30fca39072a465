"""Column functions for Unicode text; see ``lexiloom.functions.text``."""

from .sql import register
from .text import (
    are_confusable,
    casefold,
    is_nfc,
    is_nfd,
    is_nfkc,
    is_nfkd,
    is_normalized,
    match_key,
    match_key_utf16,
    matches,
    nfc,
    nfd,
    nfkc,
    nfkd,
    normalize,
    normalize_to,
    quick_check,
    skeleton,
    utf16_to_text,
)

__all__ = [
    "are_confusable", "casefold", "is_nfc", "is_nfd", "is_nfkc", "is_nfkd", "is_normalized", "match_key", "match_key_utf16", "matches", "nfc", "nfd",
    "nfkc", "nfkd", "normalize", "normalize_to", "quick_check", "register", "skeleton", "utf16_to_text",
]
