"""The forest and its threshold come from all rows, not from a sample of them."""

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from lexiloom.llm import quality


def counted(spark, n):
    """Counts of n texts that pass the base rules; unusual ones are of both labels."""
    h = lambda k, most: F.pmod(F.xxhash64("id", F.lit(k)), F.lit(most))
    columns = {"n_words": 100 + h(1, 400), "n_dup_lines": h(2, 5), "n_repeat_words": h(3, 20), "n_lines": 5 + h(4, 20), "n_digits": F.lit(0)}
    rows = spark.range(n).withColumns({c: v.cast("long") for c, v in columns.items()})
    rows = rows.withColumns({"word_chars": F.col("n_words") * (4 + h(5, 5)), "n_symbols": h(6, 50), "n_distinct": F.greatest(F.lit(2), F.col("n_words") - h(7, 90))})
    return rows.withColumns({c: F.col(c).cast("long") for c in quality.COUNTS} | {"_r_file": F.lit(0).cast("long"), "_r_row": F.col("id")})


def slow_threshold(scores, good):
    """Every place between two scores, one by one."""
    order = sorted(set(scores))
    below = {s: [0, 0] for s in order}
    for s, g in zip(scores, good, strict=True):
        below[s][0 if g else 1] += 1
    kept, most, at = [0, 0], -math.inf, math.inf
    total = int(good.sum()), int((~good).sum())
    for k, s in enumerate(order):
        kept = [kept[0] + below[s][0], kept[1] + below[s][1]]
        gain = kept[0] * total[1] - kept[1] * total[0]
        if gain > most:
            most, at = gain, (s + order[k + 1]) / 2 if k + 1 < len(order) else math.inf
    return at


def test_threshold_of_more_labels_than_20_000(spark):
    rows = counted(spark, 30_000)
    labels = rows.select(F.col("id").alias("doc_id"), (F.pmod(F.xxhash64("id", F.lit(8)), F.lit(50)) > F.col("n_symbols")).cast("int").alias("quality"))
    forest = quality.fit(rows, labels)
    local = rows.join(labels, F.col("id") == F.col("doc_id")).toPandas()
    assert len(local) == 30_000
    assert forest.threshold == slow_threshold(forest.score(quality.statistics(local)), local["quality"].to_numpy() > 0)


def test_calibrate_over_partitions(spark):
    rng = np.random.default_rng(2)
    for most in (3, 40, 5000):  # many ties to none
        good = rng.random(3000) < 0.8
        scores = np.round(rng.integers(0, most, 3000) / most + ~good / 3, 9)
        rows = spark.createDataFrame(pd.DataFrame({"score": scores, "good": good.astype(int), "bad": (~good).astype(int)}))
        rows = rows.groupBy("score").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
        assert quality.calibrate(rows, int(good.sum()), int((~good).sum())) == slow_threshold(scores, good)


def test_every_row_is_in_a_tree(spark):
    for n, trees in ((50, 8), (1000, 8), (1500, 8), (5000, 8)):
        dealt = quality.deal(counted(spark, n), n, trees, 128).toPandas()
        assert dealt.tree.between(0, trees - 1).all() and dealt.tree.nunique() == trees
        width = min(trees, max(1, n // 128))
        assert dealt[dealt.tree < width].weight.sum() == n  # the first round
        assert dealt.groupby("tree").weight.sum().min() > min(n, 128) / 2


def test_weights_are_repeated_rows():
    rng = np.random.default_rng(3)
    x, weight = np.round(rng.normal(0, 1, (200, 3)), 1), rng.integers(1, 6, 200)
    one, many = quality.Forest.grow(x, 10, 64, weight=weight), quality.Forest.grow(np.repeat(x, weight, axis=0), 10, 64)
    assert (one.feature == many.feature).all() and (one.at == many.at).all() and (one.steps == many.steps).all()


def test_ranges_are_those_of_drawn_rows():
    rng = np.random.default_rng(4)
    x = np.arange(1000.0)[:, None]
    low, high = quality.ranges(x, np.ones(1000, int), 100)
    drawn = [rng.choice(1000, 100, replace=False) for _ in range(2000)]
    assert abs(low[0] - np.mean([d.min() for d in drawn])) < 1.5 and abs(high[0] - np.mean([d.max() for d in drawn])) < 1.5
    assert quality.ranges(x, np.ones(1000, int), 1000) == ([0.0], [999.0])
