"""Exact dedup by a tree merge of sorted digest runs, with DataFrame operations only.

Every input partition is a *run*: its rows, reduced to one row per digest
(smallest identifier, row count) by a sorted aggregation. Runs then meet in
binomial rounds: in round k the runs whose numbers agree above the lowest
``k * log2(fan_in)`` bits merge, digest by digest, and keep the verified smallest
identifier and the summed count. Work in each round is dealt by (run, digest), so
no task holds a whole run, and a digest that a third of all rows share arrives as
one row per run at most. Answers travel down the same tree: winners join the
leaves by digest (one row per run), leaves join the documents by (run, digest).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, join_rows, stage, table, text_of, with_row_key

#: Runs that meet in one round: 16 are four binomial steps done by one multiway merge.
FAN_IN = 16


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: identity, code points of the text, digest of the normalised text, its check and its run."""
    normal = F.regexp_replace(text_of(text_col), SPACE, "")
    return with_row_key(docs, "_r_file", "_r_row").select(
        F.col(id_col).alias("id"),
        "_r_file",
        "_r_row",
        F.char_length(text_of(text_col)).cast("long").alias("n_chars"),
        F.unhex(F.sha2(normal, 256)).alias("digest"),
        # Verifies a digest: rows count as equal only if a second hash and the length agree too.
        F.struct(F.octet_length(normal).alias("n"), F.xxhash64(normal).alias("h")).alias("check"),
        F.spark_partition_id().alias("run"),
    )


def merge_runs(rows: DataFrame, fan_in: int = FAN_IN) -> tuple[DataFrame, DataFrame]:
    """(leaves, winners) of the tree over staged ``digests`` rows.

    leaves: a row per run and digest. winners: a row per digest with ``best``
    (the row that stays) and ``size``.
    """
    leaf = rows.groupBy("run", "digest", "check").agg(F.min(_order()).alias("best"), F.count("*").alias("size"))
    top = rows.agg(F.max("run")).first()[0] or 0
    level, width = leaf, top + 1
    while width > 1:
        level = (
            level.withColumn("run", F.floor(F.col("run") / fan_in).cast("int"))
            .groupBy("run", "digest", "check")
            .agg(F.min("best").alias("best"), F.sum("size").alias("size"))
        )
        width = -(-width // fan_in)
    return leaf, level.drop("run")


def _order():
    """Most code points first, then the smallest id (null ids last), then the row's place: a total order."""
    return F.struct((-F.col("n_chars")).alias("n"), F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("_r_file").alias("file"), F.col("_r_row").alias("row"))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fan_in: int = FAN_IN) -> DataFrame:
    """Every row of ``docs`` with its group of equal texts.

    Columns: id, _r_file, _r_row (see ``with_row_key``), keep_id, group_size,
    kept, text_sha256. Texts are equal when they are identical without ASCII
    white space; null counts as empty. Repeated rows are members like any other:
    exactly one row of a group is kept. Null ids lose ties. Other columns of
    ``docs`` are ignored, whatever their names. An empty table gives no rows.
    """
    rows = stage(digests(docs, id_col, text_col), "digests")
    leaf, winners = merge_runs(rows, fan_in)
    many = winners.where("size > 1")
    down = leaf.select("run", "digest", "check").join(many, ["digest", "check"])
    best = F.coalesce("best", _order())
    return rows.join(down, ["run", "digest", "check"], "left").select(
        "id",
        "_r_file",
        "_r_row",
        best["id"].alias("keep_id"),
        F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
        ((best["file"] == F.col("_r_file")) & (best["row"] == F.col("_r_row"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` (read from files) without the rows that ``exact_groups`` does not keep; all columns stay."""
    gone = exact_groups(docs, id_col, text_col).where(~F.col("kept")).select("_r_file", "_r_row")
    return join_rows(docs, gone, "left_anti")[0].select(*docs.columns)


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256"
    )


OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER w = 1 AS kept,
       text_sha256
FROM d
WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id NULLS LAST)
"""

QUERIES = {"op9_exact_dedup": op9_exact_dedup}
ORACLES = {"op9_exact_dedup": OP9_SQL}
