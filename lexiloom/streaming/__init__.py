"""The same functions on streams: they are stateless, so plans are those of batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import match_key
from ..operators import changed_lines, spoof_join


def normalize_stream(lines: DataFrame, text: str, form: str = "NFC") -> DataFrame:
    """``lines`` with ``normalized`` and ``was_normalized``."""
    return changed_lines(lines, text, form)


def spoof_stream(incoming: DataFrame, trusted: DataFrame, text: str, trusted_text: str) -> DataFrame:
    """A stream joined to a static table of trusted identifiers: verdict and hit for each row."""
    return spoof_join(incoming, trusted, text, trusted_text)


def dedup_stream(rows: DataFrame, text: str, time: str, delay: str = "1 hour") -> DataFrame:
    """The first row of each matching key within the watermark's delay; state is dropped behind it."""
    return rows.withColumn("match_key", match_key(text)).withWatermark(time, delay).dropDuplicatesWithinWatermark(["match_key"])


def audit_stream(rows: DataFrame, text: str, time: str, form: str = "NFC", window: str = "5 minutes", delay: str = "10 minutes") -> DataFrame:
    """Counts of processed and changed rows per event-time window."""
    flagged = normalize_stream(rows, text, form).withWatermark(time, delay)
    return flagged.groupBy(F.window(time, window)).agg(F.count(F.lit(1)).alias("processed"), F.count_if(~F.col("was_normalized")).alias("changed"))
