"""Mixing sources to target weights by cube-method balanced sampling.

A source's target over its size is how often each of its documents is taken: a
whole number of times plus a fraction. The fractions are inclusion probabilities
of a balanced sample: the flight phase takes three undecided documents at a
time and moves their probabilities along the null space of the constraints (their
count and their tokens) until one of them is 0 or 1, so both totals stay as they
are. What a group of documents leaves, two at most, goes up a tree of groups of the
same source. ``RESERVE`` documents of each source wait for the end, and land with
the last two: of all roundings of these few, the one that changes the tokens least. Groups are parts of one source with a bounded number of documents, so a
source with a third of all rows is many groups, and many small sources share a
task and are moved together.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, join_rows, stage, table, text_of, with_row_key

SHARE = 1.5
MOST = 2.0
WEIGHTS = (5.0, 2.0, 1.0)
SEED = 7
#: Documents of a group on average, and groups that meet in one.
GROUP = 4_000
FAN_IN = 16
#: Sources up to this number are broadcast to the documents (about 100 bytes each); more are joined by a shuffle.
BROADCAST = 20_000
#: Documents of a source that are decided last, so that its tokens come out within a few words.
RESERVE = 10
EPS = 1e-9


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """id, row key, source, size (words; null text: 0) and the random number that orders documents."""
    size = F.regexp_count(text_of(text_col), F.lit(WORD)).cast("long")
    return with_row_key(docs).select(
        F.col(id_col).alias("id"), "_r_file", "_r_row", F.col(source_col).alias("source"), size.alias("size")
    ).withColumn("u", F.xxhash64(F.lit(SEED), "id", "size"))


def targets(rows: DataFrame, share: float = SHARE, most: float = MOST, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """A row per source: source, source_size, n_docs, target.

    Sources by code point, null last, take ``weights`` in turn and share ``share``
    of all sizes by weight. No target passes ``most`` times its source's size; the
    excess is shared again by weight until none is above. Sources stay distributed:
    the driver sees two sums for each round of sharing, and a count per partition.
    """
    each = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs")).orderBy(F.asc_nulls_last("source"))
    each = stage(each.withColumn("place", F.monotonically_increasing_id()), "sources")
    part, spark = F.shiftright("place", 33).alias("part"), rows.sparkSession
    before, parts = 0, []
    for p, n in sorted(each.groupBy(part).count().collect()):
        parts.append((p, before))
        before += n
    if not parts:
        return each.select("source", "source_size", "n_docs", F.lit(0.0).alias("target"))
    ranks = spark.createDataFrame(parts, "part long, before long")
    rank = F.col("before") + F.col("place").bitwiseAND(F.lit((1 << 33) - 1))
    weight = F.array(*map(F.lit, weights))[F.pmod(rank, F.lit(len(weights))).cast("int")]
    each = stage(each.withColumn("part", part).join(F.broadcast(ranks), "part").select("source", "source_size", "n_docs", weight.alias("weight")), "source-weights")
    cap = most * F.col("source_size")
    total = share * (each.agg(F.sum("source_size")).first()[0] or 0)
    unit = 0.0
    while True:
        above = F.col("weight") * unit > cap
        capped, free = each.agg(F.sum(F.when(above, cap).otherwise(0.0)), F.sum(F.when(above, 0.0).otherwise(F.col("weight")))).first()
        new = (total - capped) / free if free else unit
        if not new > unit:
            break
        unit = new
    return each.select("source", "source_size", "n_docs", F.least(F.col("weight") * unit, cap).alias("target"))


def uniform(u: np.ndarray, k: int) -> np.ndarray:
    """A number in [0, 1) for each 64-bit seed and round."""
    x = u.view(np.uint64) ^ np.uint64((k + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return (x ^ (x >> np.uint64(31))).astype(np.float64) / 2.0**64


def flight(group: np.ndarray, size: np.ndarray, p: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Move the probabilities of each group (sorted) until fewer than three of it are undecided.

    Each round moves all full triples of neighbours along the null vector of
    (1, 1, 1) and their sizes, which decides one of each at least.
    """
    p = p.copy()
    for k in itertools.count():
        open_ = np.flatnonzero((p > EPS) & (p < 1 - EPS))
        g = group[open_]
        first = np.concatenate(([True], g[1:] != g[:-1])) if len(g) else np.zeros(0, bool)
        start = np.flatnonzero(first)
        length = np.diff(np.append(start, len(g)))
        place = np.arange(len(g)) - np.repeat(start, length)
        whole = place < np.repeat(length // 3 * 3, length)
        three = open_[whole].reshape(-1, 3)
        if not len(three):
            return np.where(p <= EPS, 0.0, np.where(p >= 1 - EPS, 1.0, p))
        a, b, c = size[three].astype(np.float64).T
        v = np.stack([c - b, a - c, b - a], axis=1)
        v[(v == 0).all(axis=1)] = (1.0, -1.0, 0.0)
        v /= np.abs(v).max(axis=1, keepdims=True)
        q = p[three]
        with np.errstate(divide="ignore", invalid="ignore"):
            ahead = np.where(v > 0, (1 - q) / v, np.where(v < 0, -q / v, np.inf)).min(axis=1)
            back = np.where(v > 0, q / v, np.where(v < 0, (q - 1) / v, np.inf)).min(axis=1)
        forth = uniform(u[three[:, 0]], k) * (ahead + back) < back
        moved = np.clip(q + v * np.where(forth, ahead, -back)[:, None], 0.0, 1.0)
        moved[moved < EPS] = 0.0
        moved[moved > 1 - EPS] = 1.0
        p[three] = moved


def land(group: np.ndarray, size: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Round the last undecided of each group (sorted; two and the reserve) so that tokens change least, and then the count: a document weighs as a tenth of the mean size."""
    p = p.copy()
    open_ = np.flatnonzero((p > 0) & (p < 1))
    g = group[open_]
    for rows in np.split(open_, np.flatnonzero(g[1:] != g[:-1]) + 1) if len(open_) else []:
        choices = np.array(list(itertools.product((0.0, 1.0), repeat=len(rows))))
        off = choices - p[rows]
        p[rows] = choices[np.argmin(np.abs(off @ size[rows]) + 0.1 * size[rows].mean() * np.abs(off.sum(axis=1)))]
    return p


def moved(rows: DataFrame, last: bool) -> DataFrame:
    """``rows`` (source, salt, size, p, u and others) with p moved by ``flight`` in each (source, salt), and landed if ``last``."""
    names = rows.columns
    at = {c: names.index(c) for c in ("group", "size", "p", "u", "salt")}

    def work(held: pa.Table) -> pa.Table:
        size, p, u = (held.column(at[c]).to_numpy().copy() for c in ("size", "p", "u"))
        group = held.column(at["group"]).to_numpy()
        first = np.concatenate(([True], group[1:] != group[:-1]))
        place = np.arange(len(group)) - np.maximum.accumulate(np.where(first, np.arange(len(group)), 0))
        # The first documents of a source by u, which its groups with salt 0 hold at each level.
        moves = (held.column(at["salt"]).to_numpy() > 0) | (place >= RESERVE)
        p[moves] = flight(group[moves], size[moves], p[moves], u[moves])
        return held.set_column(at["p"], "p", pa.array(land(group, size, p) if last else p))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            if not len(batch):
                continue
            held.append(batch)
            size += len(batch)
            key = batch.column(at["group"])
            if size >= GROUP and key[-1] != held[0].column(at["group"])[0]:
                whole = pa.Table.from_batches(held)
                g = whole.column(at["group"]).to_numpy()
                cut = int(np.searchsorted(g, g[-1], "left"))  # the last group may go on
                yield from work(whole.slice(0, cut)).to_batches()
                held = whole.slice(cut).to_batches()
                size = len(whole) - cut
        if held:
            yield from work(pa.Table.from_batches(held)).to_batches()

    return rows.repartition("group").sortWithinPartitions("group", "u", "id", "size", "_r_file", "_r_row").mapInArrow(run, rows.schema)


def mix(docs: DataFrame, share: float = SHARE, most: float = MOST, weights: tuple[float, ...] = WEIGHTS, group: int = GROUP, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Every row of ``docs`` with how often the mix takes it.

    Columns: id, _r_file, _r_row, source, size, source_size, target, copies,
    taken (copies times size). A source's taken words differ from its target by
    less than a document. Null texts have size 0, a null source is a source;
    repeated rows are documents of their own, interchangeable in the draw; a
    source without a word takes none; an empty table gives no rows. Reruns agree,
    as the draw depends on ids, sizes and ``SEED`` only.
    """
    rows = stage(sized(docs, id_col, text_col, source_col), "sizes")
    each = stage(targets(rows, share, most, weights), "targets")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    each = each.select(
        F.col("source").alias("of"), "source_size", "target", F.floor(ratio + EPS).cast("int").alias("whole"),
        F.greatest(ratio - F.floor(ratio + EPS), F.lit(0.0)).alias("p"), F.ceil(F.col("n_docs") / group).cast("long").alias("salts"),
    )
    n, deepest = each.agg(F.count("*"), F.max("salts")).first()
    joined = rows.join(F.broadcast(each) if n <= BROADCAST else each, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    joined = joined.withColumn("salt", F.pmod(F.xxhash64(F.lit(SEED + 1), "u"), F.col("salts")))
    joined = joined.withColumn("group", F.xxhash64("source", F.col("source").isNull(), "salt"))
    done = []
    levels = 1 + math.ceil(math.log(max(1, deepest or 1), FAN_IN) - 1e-9)
    undecided = joined
    for level in range(levels):
        last = level == levels - 1
        decided = stage(moved(undecided, last), f"cube-{level}")
        done.append(decided if last else decided.where("p = 0 or p = 1"))
        if not last:
            undecided = decided.where("p > 0 and p < 1").withColumn("salt", F.floor(F.col("salt") / FAN_IN))
            undecided = undecided.withColumn("group", F.xxhash64("source", F.col("source").isNull(), "salt"))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    copies = F.col("whole") + F.round("p").cast("int")
    return out.select("id", "_r_file", "_r_row", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def mixed_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``docs`` (read from files) with each row as often as ``mix`` takes it; all columns stay."""
    taken = mix(docs, id_col=id_col, text_col=text_col, source_col=source_col).where("copies > 0")
    both, (copies,) = join_rows(docs, taken, "inner", "copies")
    return both.withColumn(copies, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*docs.columns)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", "copies")


QUERIES = {"op2_mixing": op2_mixing}
ORACLES: dict[str, str] = {}
