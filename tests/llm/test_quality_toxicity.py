import re
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from lexiloom.llm import quality, toxicity
from lexiloom.llm.common import table

SF = "/root/testdata/sf0.01"


def slow_counts(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    grams = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
    n, rep, seen, dup = Counter(grams), set(), set(), 0
    for k, g in enumerate(grams):
        if n[g] > 1:
            rep |= {k, k + 1, k + 2}
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(rep)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab#|\n\t \x0b\x1c é", max_size=60))
def test_counts(t):
    assert quality.counts(t)[:5] == slow_counts(t)


def test_judge(docs, rows, labels, empty):
    got = quality.judge(docs, labels).collect()
    assert len(got) == len(rows)
    by = {r[0]: r[1] for r in rows}
    for r in got:
        n, *_, rep = slow_counts(by[r.id] or "") if r.id is not None else (r.n_words, r.n_repeat_words)
        assert r.n_words == n and r.base_failed == (n < 50 or 100 * rep > 50 * n) and (not r.kept or not r.base_failed)
    assert quality.judge(empty, labels).count() == 0
    none = quality.judge(docs, labels.limit(0)).collect()
    assert all(r.kept == (not r.base_failed) for r in none)


def test_forest_isolates_what_is_rare():
    rng = np.random.default_rng(0)
    x = np.vstack([rng.normal(0, 1, (500, 3)), [[9, 9, 9]]])
    s = quality.Forest.grow(x).score(x)
    assert s.argmax() == 500 and ((s > 0) & (s < 1)).all()


def test_quality_on_labelled_rows(spark):
    judged = quality.judge(table(spark, SF, "documents"), table(spark, SF, "labels")).toPandas()
    m = judged.merge(table(spark, SF, "labels").toPandas(), left_on="id", right_on="doc_id")
    m = m[~m.base_failed]
    assert m[m.quality == 1].kept.mean() > 0.97 and m[m.quality == 0].kept.mean() < 0.1


def edits(a, b):
    d = {(i, j): i + j for i in range(len(a) + 1) for j in range(len(b) + 1) if i * j == 0}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


STEMS = ["idiot", "moron", "worthless", "veq*", "scum"]


@settings(max_examples=300, deadline=None)
@given(st.sampled_from(STEMS), st.lists(st.tuples(st.integers(0, 9), st.sampled_from("abiorstw")), max_size=3))
def test_automata(stem, changes):
    word = stem.rstrip("*")
    for at, c in changes:
        word = word[:at] + c + word[at + 1 :]
    got = toxicity.Lexicon(STEMS).match(word)
    off = {}
    for s in STEMS:
        own, k = s.rstrip("*"), 0 if s.endswith("*") else toxicity.allowed(len(s))
        d = min(edits(own, word[:j]) for j in range(1, len(word) + 1))
        if word[:1] == own[:1] and (d == 0 or d <= k and len(own) - d <= len(word) <= 2 * len(own)):
            off[s] = d
    assert got == min(off.values(), default=-1)


def test_hits():
    h = toxicity.Hits(toxicity.Lexicon(["idiot", "moron"]))
    assert toxicity.hits("you idiot, you MORON!!", h)[:3] == (2, 0, 0)
    assert toxicity.hits("an id1ot and a moorn", h)[:3] == (0, 2, 0)
    assert toxicity.hits('he said "idiot" twice', h)[:3] == (0, 0, 1)
    assert toxicity.hits(None, h) == (0, 0, 0, 0) and toxicity.hits("fine words", h)[:3] == (0, 0, 0)


def test_scores(docs, rows, labels, empty):
    model = toxicity.fit(docs, labels)
    got = toxicity.score(docs, model).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert toxicity.score(empty, model).count() == 0
    left = toxicity.drop_toxic(docs, labels)
    assert left.columns == docs.columns and left.count() == sum(r.score < toxicity.THRESHOLD for r in got)
    assert (toxicity.fit(docs, labels.limit(0)).weights == toxicity.DEFAULT).all()


def test_toxicity_on_held_out_rows(spark):
    got = toxicity.op3_toxicity(spark, SF).toPandas().merge(table(spark, SF, "labels").toPandas(), on="doc_id")
    m = got[got.held_out & (got.quality == 1)]
    assert m[m.toxic == 0].predicted.mean() < 0.05 and m[m.toxic == 1].predicted.mean() > 0.5
