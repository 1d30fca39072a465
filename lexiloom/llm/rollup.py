"""Token counts by source, language and tokenizer version, maintained by signed deltas.

A rollup is a folder. Each committed batch adds two tables: the entries of the
documents that it changes, and the signed sums that follow, one row per group.
Totals are sums of sums, so they never read a document again. A revised or deleted
document takes back exactly what its last entries added.

Commits are optimistic. An attempt writes to a folder of its own and then renames a
small record, which names that folder, to the next number of the log; the rename fails if the number is
taken. A writer that loses looks at the log again: if its batch is there, it is done, else it starts
over on the new state. So a repeated delivery, a job that ran twice, a crash before the record and two
writers at once leave each batch in the totals exactly once, and what is committed is never written again.

Entries lie in buckets of ids. A batch reads the buckets that it touches, from the last
snapshot on; ``compact`` writes one, and every ``COMPACT`` commits do so by themselves.
The file system must rename without replacing, atomically, as those that hold streaming checkpoints do.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, stage_path, table, text_of
from .packing import default_tokenizer, encoder

GROUP = ["source", "lang", "tokenizer"]
_ENTRY = "id long, tokenizer string, source string, lang string, n_tokens long, n long, version long, bucket int"
_DELTA = "source string, lang string, tokenizer string, n_docs long, n_tokens long"

#: Buckets of ids; a rollup keeps the number that it was made with.
BUCKETS = 64
#: Commits after which a snapshot is written.
COMPACT = 16

#: Tokenizer versions that are counted by built-in functions: white-space words, and runs without white space and ASCII punctuation.
TOKENIZERS = {"words-1": WORD, "words-2": r"[^\x00-\x20\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"}
#: The version that is counted by a tokenizer file.
BPE = "byte_bpe_50k"


def inserts(docs: DataFrame, version: str, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", tokenizer: str | None = None) -> DataFrame:
    """Changes that add or revise the documents' counts under one tokenizer version; null texts have no token.

    ``version`` is one of ``TOKENIZERS``, or names the tokenizer file ``tokenizer``
    (``BPE`` by default), whose ids of the whole text are counted.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(source_col).alias("source"), F.col(lang_col).alias("lang"), text_of(text_col).alias("text"))
    if version in TOKENIZERS:
        counted = rows.withColumn("n_tokens", F.regexp_count("text", F.lit(TOKENIZERS[version])).cast("long"))
    elif version == BPE or tokenizer:
        path = tokenizer or default_tokenizer()

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            encode = encoder(path)
            for batch in batches:
                n = [sum(map(len, encode(t.as_py()))) for t in batch.column(3)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(n, pa.int64())], ["id", "source", "lang", "n_tokens"])

        counted = rows.mapInArrow(count, "id long, source string, lang string, n_tokens long")
    else:
        raise ValueError(f"tokenizer version {version!r} has no pattern and no file")
    return counted.select("id", F.lit(version).alias("tokenizer"), "source", "lang", "n_tokens", F.lit(True).alias("live"))


def deletes(ids: DataFrame, version: str, id_col: str = "doc_id") -> DataFrame:
    """Changes that take documents out under one tokenizer version; ids without an entry change nothing."""
    none = F.lit(None).cast("string")
    return ids.select(
        F.col(id_col).cast("long").alias("id"), F.lit(version).alias("tokenizer"), none.alias("source"), none.alias("lang"), F.lit(0).cast("long").alias("n_tokens"), F.lit(False).alias("live")
    )


class Rollup:
    """A rollup in ``path``, any folder that Spark's file systems reach; any number of writers."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS, compact_every: int = COMPACT):
        self.spark, self.path, self.buckets, self.compact_every = spark, path, buckets, compact_every
        self._jvm = spark.sparkContext._jvm
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._at("").getFileSystem(conf)
        self._files = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.makeQualified(self._at("")).toUri(), conf)

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def log(self) -> list[dict]:
        """The committed records, in order: batch number or null, attempt, buckets, and whether it is a snapshot of all before."""
        at = self._at("log")
        names = sorted(x.getPath().getName() for x in self._fs.listStatus(at)) if self._fs.exists(at) else []
        found = [json.loads(self._text(f"log/{n}")) for n in names if n.isdigit()]
        if found:
            self.buckets = found[0]["buckets"]
        return found

    def _text(self, name: str) -> str:
        stream = self._fs.open(self._at(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _commit(self, number: int, record: dict) -> bool:
        """Make ``record`` number ``number`` of the log; False if the number is taken."""
        draft = self._at(f"drafts/{uuid.uuid4().hex}")
        out = self._fs.create(draft, False)
        out.write(bytearray(json.dumps(record).encode()))
        out.close()
        self._fs.mkdirs(self._at("log"))
        kind = self._jvm.org.apache.hadoop.fs.Options.Rename
        options = self.spark.sparkContext._gateway.new_array(kind, 1)
        options[0] = kind.NONE
        try:
            self._files.rename(draft, self._at(f"log/{number:012d}"), options)
        except Exception as e:  # py4j wraps what the file system throws
            if "FileAlreadyExistsException" not in str(e):
                raise
            self._fs.delete(draft, False)
            return False
        return True

    def batches(self) -> list[int]:
        """Numbers of the committed batches."""
        return sorted(r["batch"] for r in self.log() if r["batch"] is not None)

    def _state(self, log: list[dict], kind: str, schema: str) -> DataFrame:
        """The tables ``kind`` of the last snapshot and of all after it."""
        last = max((k for k, r in enumerate(log) if r["snapshot"]), default=0)
        paths = [f"{self.path}/{kind}/{r['attempt']}" for r in log[last:]]
        if not paths:
            return self.spark.createDataFrame([], schema)
        # A folder by itself each, so that its buckets are read as a column; empty ones hold no bucket.
        frames = [self.spark.read.schema(schema).parquet(p) for p in paths]
        out = frames[0]
        for f in frames[1:]:
            out = out.unionByName(f)
        return out

    def _write(self, entries: DataFrame, attempt: str) -> None:
        # Rows of a bucket meet in few tasks, large ones in several.
        entries.hint("rebalance", "bucket").write.partitionBy("bucket").parquet(f"{self.path}/entries/{attempt}")

    def _read(self, attempt: str) -> DataFrame:
        return self.spark.read.schema(_ENTRY).parquet(f"{self.path}/entries/{attempt}")

    def commit(self, batch: int, changes: DataFrame) -> bool:
        """Apply ``changes`` (id, tokenizer, source, lang, n_tokens, live) as batch number ``batch``; False if it is committed already.

        Batches apply in the order of their numbers. All rows of a batch that share an
        id and tokenizer count, repeated rows too, and together replace what earlier
        batches said of it; a deletion in the same batch gives way. Null ids name no document: their rows
        add, and nothing takes them back. Null sources and languages are groups. Other columns
        are ignored. An empty batch is committed as such.
        """
        while True:
            log = self.log()
            done = [r["batch"] for r in log if r["batch"] is not None]
            if batch in done:
                return False
            if done and batch < done[-1]:
                raise ValueError(f"batch {batch} comes after {done[-1]}")
            attempt = f"{batch}-{uuid.uuid4().hex}"
            self._attempt(log, attempt, changes)
            if self._commit(len(log), {"batch": batch, "attempt": attempt, "buckets": self.buckets, "snapshot": False}):
                break
            self.discard(attempt)
        if (len(log) + 1) % self.compact_every == 0:
            self.compact()
        return True

    def _attempt(self, log: list[dict], attempt: str, changes: DataFrame) -> None:
        bucket = F.pmod(F.xxhash64("id"), F.lit(self.buckets)).cast("int")
        # A deletion is an entry of no document; sums before the shuffle keep a hot id small.
        rows = changes.groupBy("id", "tokenizer", "source", "lang", "n_tokens").agg(F.count_if("live").alias("n"))
        rows = rows.withColumns({"version": F.lit(len(log)).cast("long"), "bucket": bucket})
        self._write(rows.select(*(x.split()[0] for x in _ENTRY.split(", "))), attempt)
        new = self._read(attempt)
        touched = sorted(r["bucket"] for r in new.where("id is not null").select("bucket").distinct().collect())  # at most one row a bucket
        old = self._state(log, "entries", _ENTRY).where(F.col("bucket").isin(touched))
        old = self._latest(old.join(new.select("bucket", "id", "tokenizer"), ["bucket", "id", "tokenizer"], "left_semi"))
        sign = lambda df, s: df.where("n > 0").select(*GROUP, "n_tokens", (F.col("n") * s).alias("n"))
        self._sums(sign(new, 1).unionByName(sign(old, -1))).write.parquet(f"{self.path}/deltas/{attempt}")

    @staticmethod
    def _latest(entries: DataFrame) -> DataFrame:
        """Of each id and tokenizer the entries of the last version. Joined, not gathered: an id may have very many."""
        key = ["bucket", "id", "tokenizer"]
        last = entries.groupBy(*key).agg(F.max("version").alias("version"))
        return entries.join(last, [*key, "version"], "left_semi")

    @staticmethod
    def _sums(rows: DataFrame) -> DataFrame:
        return rows.groupBy(*GROUP).agg(F.sum("n").alias("n_docs"), F.sum(F.col("n") * F.col("n_tokens")).alias("n_tokens"))

    def compact(self) -> bool:
        """Write a snapshot of the current entries and totals, from which later batches read; False if another writer was first."""
        log = self.log()
        if not log:
            return False
        attempt = f"snapshot-{uuid.uuid4().hex}"
        entries = self._state(log, "entries", _ENTRY)
        # Rows without an id are never taken back, so nothing will ask for them.
        self._write(self._latest(entries.where("id is not null")).where("n > 0"), attempt)
        self.totals(log).select(*(x.split()[0] for x in _DELTA.split(", "))).write.parquet(f"{self.path}/deltas/{attempt}")
        if self._commit(len(log), {"batch": None, "attempt": attempt, "buckets": self.buckets, "snapshot": True}):
            return True
        self.discard(attempt)
        return False

    def discard(self, attempt: str) -> None:
        """Remove the folders of an attempt that is not in the log."""
        for kind in ("entries", "deltas"):
            self._fs.delete(self._at(f"{kind}/{attempt}"), True)

    def totals(self, log: list[dict] | None = None) -> DataFrame:
        """source, lang, tokenizer, n_docs, n_tokens of the groups that have documents."""
        sums = self._state(self.log() if log is None else log, "deltas", _DELTA).groupBy(*GROUP).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        return sums.where("n_docs <> 0")


def estimates(docs: DataFrame, version: str) -> DataFrame:
    """Changes with a quarter of the characters as the count, for documents that no tokenizer has seen yet."""
    return docs.select(
        F.col("doc_id").cast("long").alias("id"), F.lit(version).alias("tokenizer"), "source", "lang", F.ceil(F.char_length(text_of("text")) / 4).cast("long").alias("n_tokens"), F.lit(True).alias("live")
    )


def _rolled(spark: SparkSession, sf_dir: str, first: str, *versions: str) -> DataFrame:
    """Totals after the table came in, was counted, was delivered twice and lost its toxic documents.

    Batch 1 has estimates under ``first``; batch 2 revises them all and adds the other versions; batch 3 takes toxic documents out.
    """
    docs, toxic = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").where("toxic = 1")
    rollup = Rollup(spark, stage_path(spark, "rollup"))
    rollup.commit(1, estimates(docs, first))
    counted, gone = inserts(docs, first), deletes(toxic, first)
    for v in versions:
        counted, gone = counted.unionByName(inserts(docs, v)), gone.unionByName(deletes(toxic, v))
    rollup.commit(2, counted)
    rollup.commit(3, gone)
    rollup.commit(2, counted)
    return rollup.totals()


def op1_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both word versions of all documents that are not labelled toxic, through estimates, revisions and takedowns."""
    return _rolled(spark, sf_dir, *TOKENIZERS)


def token_rollup_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same under the version that a tokenizer file counts."""
    return _rolled(spark, sf_dir, BPE)


OP1_SQL = r"""
WITH d AS (SELECT * FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.toxic = 1))
SELECT source, lang, 'words-1' AS tokenizer, count(*) AS n_docs, CAST(sum(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))) AS BIGINT) AS n_tokens
FROM d GROUP BY source, lang
UNION ALL
SELECT source, lang, 'words-2', count(*),
       CAST(sum(len(regexp_extract_all(coalesce(text, ''), '[^\x00-\x20\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))) AS BIGINT)
FROM d GROUP BY source, lang
"""

QUERIES = {"op1_token_rollup": op1_token_rollup, "token_rollup_bpe": token_rollup_bpe}
ORACLES = {"op1_token_rollup": OP1_SQL}
