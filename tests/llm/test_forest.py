"""Isolation forest: path lengths by brute force, accuracy on rows that it was not fitted on."""

import math

import numpy as np
from pyspark.sql import functions as F

from lexiloom.llm import quality
from lexiloom.llm.common import table

SF = "/root/testdata/sf0.1"


def steps(forest, tree, row, node=0):
    """The path of one row, node by node."""
    f = forest.feature[tree, node]
    if f < 0:
        return forest.steps[tree, node]
    return steps(forest, tree, row, 2 * node + (1 if row[f] <= forest.at[tree, node] else 2))


def test_scores_against_paths():
    rng = np.random.default_rng(1)
    x = np.round(rng.normal(0, 1, (300, 4)), 1)  # with ties
    forest = quality.Forest.grow(x, trees=20, subsample=64)
    own = quality.mean_steps(64)
    for row, got in zip(x[:60], forest.score(x)[:60], strict=True):
        mean = sum(steps(forest, t, row) for t in range(20)) / 20
        assert math.isclose(got, 2 ** (-mean / own))


def test_leaves_count_their_rows():
    """A leaf's steps are its depth and the mean path that its rows of the subsample would still need."""
    x = np.array([[0.0], [0.0], [0.0], [5.0]])
    forest = quality.Forest.grow(x, trees=1, subsample=4)
    assert forest.feature[0, 0] == 0 and {float(forest.steps[0, 1]), float(forest.steps[0, 2])} == {1.0, 1 + float(quality.mean_steps(3))}
    harmonic = lambda n: sum(1 / k for k in range(1, n + 1))
    for n in (10, 128, 1000):
        assert abs(quality.mean_steps(n) - (2 * harmonic(n - 1) - 2 * (n - 1) / n)) < 0.15


def test_held_out_labels(spark):
    """Fitted on one half of the labelled ids, judged on the other."""
    labels = table(spark, SF, "labels")
    half = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    judged = quality.judge(table(spark, SF, "documents"), labels.where(half))
    rest = judged.join(labels.where(~half), F.col("id") == F.col("doc_id")).where(~F.col("base_failed"))
    got = {r.quality: (r.kept, r.n) for r in rest.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept"), F.count("*").alias("n")).collect()}
    assert got[1][1] > 500 and got[1][0] > 0.97 and got[0][1] > 50 and got[0][0] < 0.1
