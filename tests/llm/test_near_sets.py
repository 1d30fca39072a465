"""Near copies by Jaccard similarity against brute force: short texts, repeated passages, neighbours below the similarity."""

import random

import numpy as np

from lexiloom.llm import simhash
from lexiloom.llm.bktree import Forest


def shingles(text):
    own = (text or "").lower().split()
    return {tuple(own[k : k + 5]) for k in range(max(1, len(own) - 4))} if own else set()


def brute(texts):
    sets, comp = [shingles(t) for t in texts], list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if not sets[i] | sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = comp[i], comp[j]
                comp = [min(a, b) if c in (a, b) else c for c in comp]
    return comp


def make_texts():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    texts = ["", None, " ", "one", "One"]
    for n in [*range(8, 21), 104]:
        for _ in range(12):
            base = [word() for _ in range(n)]
            texts += [" ".join(base), " ".join([*base, word()]), " ".join([*base, word(), word(), word()])]
            texts.append(" ".join([*base[:-2], word(), word()]))
        texts.append(" ".join(base[:14] * 5 + base[14:] if n > 20 else base))
    return texts


def test_short_texts_and_repeats(spark, tmp_path):
    texts = make_texts()
    want = brute(texts)
    path = str(tmp_path / "short.parquet")
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3).write.parquet(path)
    left = {r.doc_id for r in simhash.drop_near_copies(spark.read.parquet(path)).collect()}
    firsts = set(want)
    assert firsts <= left  # nothing goes that has no near copy
    assert len(left - firsts) <= 0.01 * (len(texts) - len(firsts))


def test_null_ids_are_not_copies(spark, tmp_path):
    path = str(tmp_path / "nulls.parquet")
    spark.createDataFrame([(None, "a b c d e f"), (None, "g h i j k l"), (None, "a b c d e f")], "doc_id long, text string").write.parquet(path)
    assert sorted(r.text for r in simhash.drop_near_copies(spark.read.parquet(path)).collect()) == ["a b c d e f", "g h i j k l"]


def test_forest_with_a_test_of_pairs():
    rng = np.random.default_rng(1)
    prints = rng.integers(0, 2**63, 8).astype(np.uint64)[rng.integers(0, 8, 120)] ^ (np.uint64(1) << rng.integers(0, 64, 120).astype(np.uint64))
    prints = np.unique(prints)
    color = rng.integers(0, 2, len(prints))
    got = Forest(np.zeros(len(prints), np.int64), prints).components(2, lambda a, b: color[a] == color[b])
    comp = list(range(len(prints)))
    for i in range(len(prints)):
        for j in range(i):
            if color[i] == color[j] and int(prints[i] ^ prints[j]).bit_count() <= 2:
                a, b = comp[i], comp[j]
                comp = [min(a, b) if c in (a, b) else c for c in comp]
    assert got.tolist() == comp


def test_similarities_are_exact():
    sets = [np.arange(4), np.arange(5), np.arange(6), np.arange(20), np.arange(1, 21)]
    s = simhash.Sets(np.concatenate(sets).astype(np.uint64), np.cumsum([len(x) for x in sets]), 0.8)
    a, b = np.array([0, 1, 0, 3, 2]), np.array([1, 2, 2, 4, 3])
    assert s.similar(a, b).tolist() == [True, True, False, True, False]
