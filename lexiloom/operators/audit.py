"""What normalising a table of texts would change."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import is_normalized, normalize, normalize_to, quick_check
from ..functions.text import FORMS
from .names import free


def changed_lines(df: DataFrame, text: str, form: str = "NFC") -> DataFrame:
    """``df`` with ``normalized`` and ``was_normalized``."""
    (done,) = free(df, names=("done",))
    return df.withColumn(done, normalize_to(text, form)).withColumns({"normalized": F.col(done)["text"], "was_normalized": F.col(done)["was_normalized"]}).drop(done)


def normalization_audit(df: DataFrame, text: str, form: str = "NFC", by: list[str | Column] = (), rollup: bool = False) -> DataFrame:
    """Per group of ``by`` (or over all): processed, already and changed; null texts count as processed only.

    One pass with partial sums; ``rollup`` adds subtotals.
    """
    (was,) = free(df, names=("was",))
    flagged = df.withColumn(was, is_normalized(text, form))
    groups = flagged.rollup(*by) if rollup else flagged.groupBy(*by)
    return groups.agg(F.count(F.lit(1)).alias("processed"), F.count_if(was).alias("already"), F.count_if(~F.col(was)).alias("changed"))


def compare_forms(df: DataFrame, text: str) -> DataFrame:
    """``df`` with a column for each form: nfc, nfd, nfkc, nfkd."""
    return df.withColumns({form.lower(): normalize(text, form) for form in FORMS})


def quick_check_report(df: DataFrame, text: str) -> DataFrame:
    """form, verdict, is_normalized and n: how the quick check and the definitive answer meet, for each form."""
    each = F.array(*(F.struct(F.lit(f).alias("form"), quick_check(text, f).alias("verdict"), is_normalized(text, f).alias("is_normalized")) for f in FORMS))
    return df.select(F.inline(each)).groupBy("form", "verdict", "is_normalized").agg(F.count(F.lit(1)).alias("n"))
