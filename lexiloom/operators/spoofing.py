"""Identifiers that look alike: joins on skeletons, never on pairs of texts. Columns of the inputs keep their names and values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import skeleton
from .names import free

EXACT, SPOOF, SAFE = "exact", "spoof", "safe"


def first_hit(incoming: DataFrame, trusted: DataFrame, text: str, trusted_text: str) -> DataFrame:
    """``incoming`` with ``hit``: the trusted text that it equals, else the smallest that it looks like, else null.

    Trusted texts are reduced to one row per skeleton before the join, which
    Catalyst broadcasts where it is small; an incoming row stays one row.
    """
    own, key, known, first, same = free(incoming, names=("skeleton", "key", "trusted", "first", "same"))
    by = trusted.select(F.col(trusted_text).alias(known)).where(F.col(known).isNotNull()).withColumn(key, skeleton(known))
    looks = by.groupBy(key).agg(F.min(known).alias(first))
    equal = by.select(F.col(known).alias(same)).distinct()
    joined = incoming.withColumn(own, skeleton(text)).join(looks, F.col(own) == F.col(key), "left").join(equal, F.col(text) == F.col(same), "left")
    return joined.withColumn("hit", F.coalesce(same, first)).drop(own, key, first, same)


def spoof_join(incoming: DataFrame, trusted: DataFrame, text: str, trusted_text: str) -> DataFrame:
    """``first_hit`` with ``verdict``: exact, spoof or safe; null texts are safe."""
    hit = first_hit(incoming, trusted, text, trusted_text)
    return hit.withColumn("verdict", F.when(F.col("hit") == F.col(text), EXACT).when(F.col("hit").isNotNull(), SPOOF).otherwise(SAFE))


def _by_skeleton(wanted: DataFrame, names: DataFrame, text: str, name: str, how: str) -> DataFrame:
    own, key = free(wanted, names=("skeleton", "key"))
    return wanted.withColumn(own, skeleton(text)).join(names.select(skeleton(name).alias(key)), F.col(own) == F.col(key), how).drop(own)


def taken(wanted: DataFrame, names: DataFrame, text: str, name: str) -> DataFrame:
    """Rows of ``wanted`` that look like an existing name: a semi join."""
    return _by_skeleton(wanted, names, text, name, "left_semi")


def registrable(wanted: DataFrame, names: DataFrame, text: str, name: str) -> DataFrame:
    """Rows of ``wanted`` that look like no existing name: an anti join; null texts stay."""
    return _by_skeleton(wanted, names, text, name, "left_anti")
