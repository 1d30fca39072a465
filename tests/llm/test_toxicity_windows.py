"""Windows, rigid stems and scores against brute force, and accuracy on held-out rows."""

import random

import numpy as np
from test_quality_toxicity import edits

from lexiloom.llm import toxicity
from lexiloom.llm.common import table

STEMS, KNOWN, RIGID = ["idiot", "moron", "worthless", "clown"], ["oron"], ["clown"]


def kind(word):
    """0 nothing, 1 a stem, 2 a misspelled one: every beginning against every stem."""
    plain = word.strip(".,!?;:\"“”«»").lower()
    off = []
    for s in STEMS:
        d = min((edits(s, plain[:j]) for j in range(1, len(plain) + 1)), default=9)
        if d == 0 or s not in RIGID and plain not in KNOWN and d <= toxicity.allowed(len(s)) and len(s) - d <= len(plain) <= 2 * len(s):
            off.append(d)
    return 0 if not off else 1 if min(off) == 0 else 2


def slow_hits(text):
    """Pairs of quotation marks are found first, each an opening one and the next closing one with no mark between."""
    words = text.split()
    marks = []
    for k, w in enumerate(words):
        if w.startswith(("“", "«", '"')):
            marks.append((k, "open"))
        if w.rstrip(".,;:!?").endswith(("”", "»", '"')):
            marks.append((k, "close"))
    pairs = [(a, b) for (a, x), (b, y) in zip(marks, marks[1:]) if x == "open" and y == "close"]
    out = [0, 0, 0, len(words)]
    for i, w in enumerate(words):
        if k := kind(w):
            own = [(a, b) for a, b in pairs if a <= i <= b and i - a <= toxicity.WINDOW and b - i <= toxicity.WINDOW]
            cited = any(x.rstrip(".,;:!?").lower() in toxicity.REPORTING for a, _ in own for x in words[max(0, a - toxicity.WINDOW) : a])
            out[2 if cited else k - 1] += 1
    return tuple(out)


def test_windows_against_brute_force():
    rng = random.Random(2)
    found = toxicity.Hits(toxicity.Lexicon(STEMS, KNOWN, free=True, rigid=RIGID))
    words = ["you", "idiot", "ddiot", "MORON!", "oron", "clowns", "cloown", "worthlss", "said", "he", "dijo", "wort,", "fine", "day.", "“idiot”", '"moron', 'fool"', "«so", "moronic»", "“an", "idiot.”"]
    seen = set()
    for _ in range(3000):
        text = " ".join(rng.choice(words) for _ in range(rng.randint(0, 14)))
        got = toxicity.hits(text, found)
        assert got == slow_hits(text), text
        seen |= {k for k in range(3) if got[k]}
    assert seen == {0, 1, 2}


def test_plain_abuse_is_no_quotation():
    h = toxicity.Hits(toxicity.Lexicon(["idiot"]))
    assert toxicity.hits("I said you are an idiot", h)[:3] == (1, 0, 0)
    assert toxicity.hits('the word “a” and idiot or “b” too', h)[:3] == (1, 0, 0)
    assert toxicity.hits("il dit « idiot » hier".replace("« ", "«").replace(" »", "»"), h)[:3] == (0, 0, 1)


def test_score_by_hand():
    model = toxicity.Model([], np.array([-4.0, 2.0, 4.0, 1.0, 0.3]))
    x = np.array([[2, 1, 1, 10], [0, 0, 0, 0]])
    own = 2 + 0.9
    z = -4 + 2 * np.log1p(own) + 4 * 1 + 1 * 1 + 0.3 * np.log1p(1)
    assert np.allclose(model.score(x), [1 / (1 + np.exp(-z)), 1 / (1 + np.exp(4))])


def test_rigid_stems(spark):
    """A stem made of what clean words are made of is not looked for misspelled; another one is."""
    rng = random.Random(4)
    clean = ["grenat" + x for x in ("on", "er", "ly", "ing")] + ["brenath", "gronath", "grenuth", "drenath", "grenatt"]
    rows = [(1, f"w{k} grenath zyxwqrt you") for k in range(30)] + [(0, f"w{k} {rng.choice(clean)} {rng.choice(clean)} fine") for k in range(90)]
    assert toxicity.learn_near(spark.createDataFrame(rows, "label int, text string"), ["grenath", "zyxwqrt"])[1] == ["grenath"]


def test_accuracy_on_all_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    got = toxicity.op3_toxicity(spark, sf).toPandas().merge(table(spark, sf, "labels").toPandas(), on="doc_id")
    m = got[got.held_out]
    assert m[m.toxic == 1].predicted.mean() >= 0.85 and m[m.toxic == 0].predicted.mean() < 0.01
