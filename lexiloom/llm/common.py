"""Shared plumbing: tables, staged results in the cluster's shared folder, row identity."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The word pattern that all contracts share: maximal runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the corpus tables; read by Spark only, so any store that Spark reads will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``.

    Where it is unset, a local one for a session within one machine's JVM (tests); on a cluster that is an
    error, as executors would write to folders of their own.
    """
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="lexiloom-"))
        found = sc.getCheckpointDir()
    return found.rstrip("/")


def stage_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the application ends."""
    path = f"{shared_dir(spark)}/lexiloom/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def stage(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    This cuts the lineage: a lost executor costs only tasks of the stage that is
    running, and what several branches read is computed once. Empty frames and
    any column types that Parquet knows are fine.
    """
    spark = df.sparkSession
    path = stage_path(spark, name)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _file_place(df: DataFrame) -> tuple[Column, Column] | None:
    """File and place of a frame's rows; None if it was not read from files that tell. A column named ``_metadata`` does not matter."""
    try:
        hidden = df.metadataColumn("_metadata")
        place = F.xxhash64(hidden.getField("file_path")), hidden.getField("row_index")
        df.select(*place)  # analysis finds a field that the format lacks
    except AnalysisException as e:
        if (e.getCondition() or "").split(".")[0] not in ("UNRESOLVED_COLUMN", "FIELD_NOT_FOUND"):
            raise
        return None
    return place


def with_row_key(df: DataFrame, file: str = "_r_file", row: str = "_r_row", read: bool = False) -> DataFrame:
    """Add two longs that name a row, equal in every read of the same files.

    Frames that were read from files use the file and the row's place in it.
    Others get Spark's increasing ids, which hold within one evaluation (stage
    the result before using it in two branches), or, with ``read``, are refused.
    """
    place = _file_place(df)
    if place is None:
        if read:
            raise ValueError("rows can be found again only in a frame that was read from files; write it and read it back")
        place = F.lit(0).cast("long"), F.monotonically_increasing_id()
    return df.withColumns({file: place[0], row: place[1]})


def join_rows(docs: DataFrame, rows: DataFrame, how: str, *carry: str) -> tuple[DataFrame, list[str]]:
    """``docs`` (read from files) joined to ``rows`` by their row keys, and the names that the columns ``carry`` of ``rows`` have there.

    Columns of ``docs`` keep their values, whatever their names: added ones get names that it does not use.
    """
    used = {c.lower() for c in docs.columns}
    new = []
    for c in ("_r_file", "_r_row", *carry):
        while c.lower() in used:
            c += "_"
        used.add(c.lower())
        new.append(c)
    file, row, *carried = new
    rows = rows.select(F.col("_r_file").alias(file), F.col("_r_row").alias(row), *(F.col(c).alias(n) for c, n in zip(carry, carried, strict=True)))
    return with_row_key(docs, file, row, read=True).join(rows, [file, row], how), carried


def text_of(column: str) -> Column:
    """Null text counts as empty."""
    return F.coalesce(F.col(column), F.lit(""))
