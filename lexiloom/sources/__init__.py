"""Text sources and sinks: thin over Spark's readers and writers, batch and streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_lines(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """Lines of text files as ``line``, invalid UTF-8 made valid; ``stream`` follows a folder."""
    reader = spark.readStream if stream else spark.read
    return reader.text(path).select(F.make_valid_utf8("value").alias("line"))


def read_table(spark: SparkSession, path: str, text: str = "text") -> DataFrame:
    """A Parquet table whose text column is made valid UTF-8."""
    return spark.read.parquet(path).withColumn(text, F.make_valid_utf8(text))


def write_lines(df: DataFrame, column: str, path: str, mode: str = "error") -> None:
    """One text column as lines; nulls become empty lines."""
    df.select(F.coalesce(F.col(column), F.lit("")).alias("value")).write.mode(mode).text(path)


def write_keyed(df: DataFrame, key: str, path: str, partitions: int, mode: str = "error") -> None:
    """A keyed table for lookups: rows of near keys share files, so readers skip the others by their statistics."""
    df.repartitionByRange(partitions, key).sortWithinPartitions(key).write.mode(mode).parquet(path)
