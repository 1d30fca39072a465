"""Texts that match after normalisation, folding and confusable mapping: equi-joins and groups on the matching key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import match_key
from .names import free


def with_match_key(df: DataFrame, text: str, key: str = "match_key", mode: str = "standard") -> DataFrame:
    """``df`` with its matching key; write it once and index, bucket or join by it."""
    return df.withColumn(key, match_key(text, mode))


def search(index: DataFrame, query: str, key: str = "match_key", mode: str = "standard") -> DataFrame:
    """Rows of a keyed table whose key is the query's."""
    (wanted,) = free(index, names=("wanted",))
    one = index.sparkSession.range(1).select(match_key(F.lit(query), mode).alias(wanted))
    return index.join(F.broadcast(one), F.col(key) == F.col(wanted), "left_semi")


def match_join(left: DataFrame, right: DataFrame, left_text: str, right_text: str, how: str = "inner", mode: str = "standard") -> DataFrame:
    """Join of two tables where their texts match."""
    own, other = free(left, right, names=("left_key", "right_key"))
    a, b = left.withColumn(own, match_key(left_text, mode)), right.withColumn(other, match_key(right_text, mode))
    return a.join(b, F.col(own) == F.col(other), how).drop(own, other)


def _digest(text: Column) -> Column:
    """What stands for a text in a shuffle: 256 bits, however long it is."""
    return F.unhex(F.sha2(text, 256))


def collision_groups(df: DataFrame, text: str, id_col: str, mode: str = "standard", members: bool = False) -> DataFrame:
    """Keys that more than one row has: match_key, n, first_id, n_texts; ``members`` adds the sorted ids.

    Digests of keys and texts are grouped, texts before keys, so a key that a third of
    all rows has costs no more than another. A key itself takes part in the shuffles only if the result's
    ``match_key`` is used.
    """
    rows = df.where(F.col(text).isNotNull()).select(F.col(id_col).alias("id"), match_key(text, mode).alias("key"), _digest(F.col(text)).alias("t"))
    rows = rows.withColumn("k", _digest(F.col("key")))
    ids = [F.collect_list("id").alias("ids")] if members else []
    texts = rows.groupBy("k", "t").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"), F.any_value("key").alias("match_key"), *ids)
    ids = [F.sort_array(F.flatten(F.collect_list("ids"))).alias("ids")] if members else []
    groups = texts.groupBy("k").agg(F.any_value("match_key").alias("match_key"), F.sum("n").alias("n"), F.min("first_id").alias("first_id"), F.count(F.lit(1)).alias("n_texts"), *ids)
    return groups.where("n > 1").drop("k")


def dedup_by_key(df: DataFrame, text: str, order: str, mode: str = "standard") -> DataFrame:
    """One row per matching key, that with the smallest ``order``; rows without a text stay.

    Grouped by the key's digest. ``min_by`` aggregates before the shuffle, so of each task one row a key
    moves; a window would gather all rows of a key.
    """
    keyed = df.where(F.col(text).isNotNull()).select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"), F.col(order).alias("place"), _digest(match_key(text, mode)).alias("k"))
    best = keyed.groupBy("k").agg(F.min_by("row", "place").alias("row"))
    return best.select("row.*").unionByName(df.where(F.col(text).isNull()))
