"""Near-dedup of the pipeline at its similarity: what share of pairs at exactly 0.8 it finds, and that none below is linked."""

import random

from lexiloom.llm import simhash


def pairs(n, words, seed):
    """Texts of distinct words, and each with one word in the middle changed: 5 of ``words - 4`` shingles differ on either side."""
    rng = random.Random(seed)
    out = []
    for k in range(n):
        own = [f"w{seed}x{k}x{j}" for j in range(words)]
        other = list(own)
        other[rng.randint(5, words - 6)] = f"changed{seed}x{k}"
        out += [(2 * k, " ".join(own)), (2 * k + 1, " ".join(other))]
    return out


def left(spark, rows, path):
    spark.createDataFrame(rows, "doc_id long, text string").repartition(4).write.parquet(path)
    return simhash.drop_near_copies(spark.read.parquet(path)).count()


def test_recall_at_the_threshold(spark, tmp_path):
    n = 600
    at = pairs(n, 49, 1)  # 40 of 50 shingles: 0.8
    assert n <= left(spark, at, str(tmp_path / "at")) <= 1.01 * n  # 0.4 % of pairs are expected to meet in no band


def test_recall_above_the_threshold(spark, tmp_path):
    n = 300
    above = pairs(n, 104, 2)  # 95 of 105: 0.905
    assert left(spark, above, str(tmp_path / "above")) == n


def test_nothing_below_is_linked(spark, tmp_path):
    n = 600
    below = pairs(n, 48, 3)  # 39 of 49: 0.796
    assert left(spark, below, str(tmp_path / "below")) == 2 * n
