"""Quality rules with an isolation forest over rule statistics.

Base rules fail texts that are short or repeat themselves. The others are judged
by an isolation forest: random splits of random statistics isolate unusual
documents after few steps, and the mean number of steps over the trees gives a
score. All rows that pass the base rules are dealt to the trees, and all of them
that have labels set the threshold.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stage, table, with_row_key

TREES = 200
#: A tree's steps are those of a tree over this many of its rows, however many it has.
SUBSAMPLE = 128
SEED = 11
MIN_WORDS = 50
MOST_REPEATED = 50
HARMLESS = 0.35

_SPACE = b" \t\n\x0b\x0c\r"
_SYMBOLS = b"#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_distinct", "n_lines", "n_digits")


def repeat_words(ids: np.ndarray) -> int:
    """Words that lie in a window of three found twice or more."""
    if len(ids) < 4:
        return 0
    top = int(ids.max()) + 1
    pair = ids[:-2] * top + ids[1:-1]
    if top > 2_000_000:  # else the key of three fits 63 bits
        pair = np.unique(pair, return_inverse=True)[1].astype(np.int64)
    key = pair * top + ids[2:]
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    if not same.any():
        return 0
    at = np.concatenate((order[1:][same], order[:-1][same]))
    hit = np.zeros(len(ids), bool)
    for k in range(3):
        hit[at + k] = True
    return int(np.count_nonzero(hit))


def counts(text: str | None) -> tuple[int, ...]:
    """``COUNTS`` of a whole text; null counts as empty."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    lines = [x for x in text.split("\n") if x.strip(" \t\x0b\x0c\r")]
    return (
        len(words),
        len(text) - (len(raw) - len(raw.translate(None, _SPACE))),
        len(raw) - len(raw.translate(None, _SYMBOLS)),
        len(lines) - len(set(lines)),
        repeat_words(ids),
        len(seen),
        len(lines),
        len(raw) - len(raw.translate(None, b"0123456789")),
    )


def rule_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, row key and ``COUNTS`` of every whole text."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.array([counts(t.as_py()) for t in batch.column(3)], np.int64).reshape(-1, len(COUNTS))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *(pa.array(c) for c in rows.T)], ["id", "_r_file", "_r_row", *COUNTS])

    kind = dict(docs.dtypes)[id_col]
    return with_row_key(docs).select(F.col(id_col).alias("id"), "_r_file", "_r_row", F.col(text_col)).mapInArrow(make, f"id {kind}, _r_file long, _r_row long, " + ", ".join(f"{c} long" for c in COUNTS))


def base_failed():
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def statistics(c: pd.DataFrame) -> np.ndarray:
    """What the forest splits: rates that do not depend on a text's length.

    Rates of repetition count from ``HARMLESS`` up: a passage that is repeated once
    is rare, but no fault, and a forest takes all that is rare for unusual.
    """
    n, lines = np.maximum(1, c["n_words"].to_numpy()), np.maximum(1, c["n_lines"].to_numpy())
    return np.column_stack([
        np.clip(c["word_chars"] / n, 2.0, 12.0),
        np.minimum(c["n_symbols"] / n, 3.0),
        c["n_symbols"] > 0.05 * n,
        np.maximum(c["n_dup_lines"] / lines, HARMLESS),
        np.maximum(c["n_repeat_words"] / n, HARMLESS),
        # Distinct words fall with length as a power of it; this takes the length out.
        np.log(np.maximum(1, c["n_distinct"].to_numpy())) / np.log(np.maximum(3, n)),
    ]).astype(np.float64)


def mean_steps(n: np.ndarray | int) -> np.ndarray:
    """Mean path length of an unsuccessful search in a binary tree of n rows; on a line between whole numbers."""

    def whole(n: np.ndarray) -> np.ndarray:
        return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))

    low = np.floor(np.asarray(n, np.float64))
    return whole(low) + (n - low) * (whole(low + 1) - whole(low))


def ranges(x: np.ndarray, weight: np.ndarray, m: float) -> tuple[np.ndarray, np.ndarray]:
    """Per column the least and the largest value that m rows drawn from these would have, by their mean ranks; a row counts ``weight`` times."""
    n = int(weight.sum())
    beyond = int((n - m) / (m + 1))
    order = np.argsort(x, axis=0, kind="stable")
    upto, column = np.cumsum(weight[order], axis=0), np.arange(x.shape[1])
    low, high = (x[order[(upto <= rank).sum(axis=0), column], column] for rank in (beyond, n - 1 - beyond))
    return low, high


@dataclass
class Forest:
    feature: np.ndarray  # (trees, nodes); -1: leaf
    at: np.ndarray
    steps: np.ndarray  # of a leaf: its depth, and what its rows would still need
    subsample: int
    threshold: float = math.inf

    @classmethod
    def grow(cls, x: np.ndarray, trees: int = TREES, subsample: int = SUBSAMPLE, seed: int | tuple[int, ...] = SEED, weight: np.ndarray | None = None) -> Forest:
        """Trees over all rows of ``x``, which count ``weight`` times.

        A tree of many rows isolates badly: its ranges reach to the rarest rows, and unusual rows hide each other.
        So ranges and steps are what ``subsample`` of the rows would have on average; with no more rows than
        that, they are the rows' own.
        """
        rng = np.random.default_rng(seed)
        weight = np.ones(len(x), np.int64) if weight is None else weight
        total = int(weight.sum())
        share = min(1.0, subsample / max(1, total))
        depth = max(1, math.ceil(math.log2(max(2, subsample))))
        shape = (trees, 2 ** (depth + 1) - 1)
        out = cls(np.full(shape, -1), np.zeros(shape), np.zeros(shape), min(subsample, total))
        for t in range(trees):
            todo = [(0, 0, np.arange(len(x)))]
            while todo:
                node, level, rows = todo.pop()
                m = share * int(weight[rows].sum())
                low, high = ranges(x[rows], weight[rows], m) if level < depth and m >= 2 else (np.zeros(1), np.zeros(1))
                varied = np.flatnonzero(high > low)
                if not len(varied):
                    out.steps[t, node] = level + mean_steps(m)
                    continue
                f = int(rng.choice(varied))
                cut = rng.uniform(low[f], high[f])
                out.feature[t, node], out.at[t, node] = f, cut
                left = x[rows, f] <= cut
                todo += [(2 * node + 1, level + 1, rows[left]), (2 * node + 2, level + 1, rows[~left])]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        """0 to 1; higher: more unusual."""
        steps = np.zeros(len(x))
        rows = np.arange(len(x))
        for t in range(len(self.feature)):
            node = np.zeros(len(x), np.int64)
            while True:
                f = self.feature[t, node]
                inner = f >= 0
                if not inner.any():
                    break
                node = np.where(inner, 2 * node + 1 + (x[rows, np.maximum(f, 0)] > self.at[t, node]), node)
            steps += self.steps[t, node]
        return 2.0 ** (-steps / len(self.feature) / max(float(mean_steps(self.subsample)), 1e-9))


def labelled(labels: DataFrame, column: str, id_col: str = "doc_id", where: Column | None = None) -> DataFrame:
    """(of, label) of every labelled id; an id with several labels has the largest."""
    rows = labels.where(F.col(id_col).isNotNull() & F.col(column).isNotNull())
    rows = rows if where is None else rows.where(where)
    return rows.groupBy(F.col(id_col).alias("of")).agg(F.max(column).alias("label"))


def labelled_sample(labels: DataFrame, column: str, most: int, id_col: str = "doc_id", where: Column | None = None) -> DataFrame:
    """``labelled``, but at most ``most`` ids, the first by a hash."""
    return labelled(labels, column, id_col, where).orderBy(F.xxhash64("of"), "of").limit(most)


def deal(passed: DataFrame, n: int, trees: int = TREES, subsample: int = SUBSAMPLE) -> DataFrame:
    """tree, ``COUNTS`` and weight: each of the n rows in one tree at least.

    A round deals all rows to as many trees as get ``subsample`` rows each; few rows take several rounds, so
    that all trees get that many. Equal rows of a tree are one row with a weight.
    """
    width = min(trees, max(1, n // subsample))
    rounds = F.explode(F.sequence(F.lit(0), F.lit(math.ceil(trees / width) - 1)))
    tree = F.col("round") * width + F.pmod(F.xxhash64("id", *COUNTS, "round"), F.lit(width))
    dealt = passed.select("id", *COUNTS, rounds.alias("round")).select(tree.cast("int").alias("tree"), *COUNTS)
    return dealt.where(F.col("tree") < trees).groupBy("tree", *COUNTS).agg(F.count("*").alias("weight"))


def grow_all(passed: DataFrame) -> Forest:
    """The forest of all rows; a task holds the rows of one tree, a 200th of them where there are many."""
    n = passed.count()
    subsample = max(1, min(SUBSAMPLE, n))

    def make(rows: pa.Table) -> pa.Table:
        c = rows.to_pandas()
        tree = int(c["tree"].iloc[0])
        one = Forest.grow(statistics(c), 1, subsample, (SEED, tree), c["weight"].to_numpy())
        return pa.table({"tree": pa.array([tree], pa.int32()), "feature": [one.feature[0]], "at": [one.at[0]], "steps": [one.steps[0]]})

    rows = deal(passed, n).groupBy("tree").applyInArrow(make, "tree int, feature array<long>, at array<double>, steps array<double>").collect()
    rows.sort(key=lambda r: r["tree"])
    return Forest(*(np.array([r[c] for r in rows]) for c in ("feature", "at", "steps")), subsample)


def calibrate(scored: DataFrame, good_total: int, bad_total: int) -> float:
    """The threshold with the largest sum of true positive and true negative rates, in the middle of its gap.

    ``scored`` has score, good and bad (numbers of rows), each score once. It is sorted over the cluster; a
    partition gives its best place, which does not depend on those before it, and its sums.
    """

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        good = bad = 0
        first = top = after = None
        for batch in batches:
            if not batch.num_rows:
                continue
            s, g, b = (c.to_numpy() for c in batch.columns)
            first = s[0] if first is None else first
            after = s[0] if after is None else after  # the best place was the last
            g, b = good + np.cumsum(g), bad + np.cumsum(b)
            gain = g.astype(object) * bad_total - b.astype(object) * good_total
            k = int(np.argmax(gain))
            if top is None or gain[k] > top[0]:
                top, after = (gain[k], g[k], b[k], s[k]), s[k + 1] if k + 1 < len(s) else None
            good, bad = int(g[-1]), int(b[-1])
        if top is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((good, bad, *top[1:3], first, top[3], after), types, strict=True)], names)

    names, types = ["good", "bad", "top_good", "top_bad", "first", "top", "after"], [pa.int64()] * 4 + [pa.float64()] * 3
    parts = scored.select("score", "good", "bad").orderBy("score").mapInArrow(best, ", ".join(f"{c} {t}" for c, t in zip(names, ["long"] * 4 + ["double"] * 3, strict=True))).collect()
    parts.sort(key=lambda p: p["first"])
    good = bad = 0
    most, found = -math.inf, math.inf
    for k, p in enumerate(parts):
        gain = (good + p["top_good"]) * bad_total - (bad + p["top_bad"]) * good_total
        if gain > most:
            after = p["after"] if p["after"] is not None else parts[k + 1]["first"] if k + 1 < len(parts) else math.inf
            middle = (p["top"] + after) / 2
            most, found = gain, middle if middle < after or after == math.inf else p["top"]
        good, bad = good + p["good"], bad + p["bad"]
    return found


def fit(counted: DataFrame, labels: DataFrame) -> Forest | None:
    """Forest of all rows that pass the base rules, threshold from all of them that have labels; None without any of either label."""
    passed = counted.where(~base_failed())
    good, bad = (F.sum(kind.cast("long")).alias(name) for name, kind in (("good", F.col("label") > 0), ("bad", F.col("label") <= 0)))
    marked = passed.join(labelled(labels, "quality"), F.col("id") == F.col("of")).groupBy(*COUNTS).agg(good, bad)
    marked = stage(marked, "labelled-counts")
    totals = marked.agg(F.sum("good"), F.sum("bad")).first()
    if not all(totals):
        return None
    forest = grow_all(passed)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(forest.score(statistics(batch.to_pandas()))), *batch.columns[-2:]], ["score", "good", "bad"])

    scored = marked.mapInArrow(make, "score double, good long, bad long")
    forest.threshold = calibrate(scored.groupBy("score").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")), *totals)
    return forest


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row of ``docs`` with its counts, base_failed, anomaly (0 to 1) and kept.

    Null and empty texts have no words and fail the base rules. Null ids stay
    null, repeated rows are judged each for itself, other columns are ignored, an
    empty table gives no rows. Without labels of both kinds the base rules alone
    decide and anomaly is 0.
    """
    counted = stage(rule_counts(docs, id_col, text_col), "rule-counts")
    forest = fit(counted, labels)
    names = ["id", "_r_file", "_r_row", *COUNTS, "base_failed", "anomaly", "kept"]

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = batch.to_pandas()
            failed = batch.column(len(names) - 3).to_numpy(zero_copy_only=False)
            anomaly = forest.score(statistics(c)) if forest else np.zeros(len(c))
            kept = ~failed & (anomaly <= forest.threshold if forest else True)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(anomaly), pa.array(kept)], names)

    counted = counted.withColumn("base_failed", base_failed())
    return counted.mapInArrow(make, ", ".join(f"{c} {t}" for c, t in counted.dtypes) + ", anomaly double, kept boolean")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select(F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "anomaly")


def quality_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base columns of ``op5_quality``, which SQL can express."""
    return op5_quality(spark, sf_dir).drop("kept", "anomaly")


COUNTS_SQL = r"""
with texts as (select row_number() over () as row, doc_id, coalesce(text, '') as text from documents),
split as (
  select row, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as words,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines
  from texts),
windows as (select row, i, words[i] as a, words[i + 1] as b, words[i + 2] as c from (select row, words, unnest(range(1, len(words) - 1)) as i from split)),
often as (select row, i from (select row, i, count(*) over (partition by row, a, b, c) as n from windows) where n > 1),
repeated as (select row, count(distinct i) as n from (select row, unnest([i, i + 1, i + 2]) as i from often) group by row),
counted as (
  select doc_id, len(words) as n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) as word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]')) as n_symbols, len(lines) - len(list_distinct(lines)) as n_dup_lines, coalesce(n, 0) as n_repeat_words
  from split left join repeated using (row))
select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from counted
"""

QUERIES = {"op5_quality": op5_quality, "quality_counts": quality_counts}
ORACLES: dict[str, str] = {"quality_counts": COUNTS_SQL}
