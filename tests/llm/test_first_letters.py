"""Misspellings anywhere in a stem, the first letter and inflected stems included."""

import pytest
from test_quality_toxicity import edits

from lexiloom.llm import toxicity

STEMS = ["idiot", "moron", "worthless*", "scum"]


@pytest.mark.parametrize("word", ["ddiot", "diot", "diiot", "roron", "oron", "omron", "xmoron", "orthless", "worthlss", "owrthless", "scun", "tidy", "i", ""])
def test_match_against_brute_force(word):
    off = []
    for s in STEMS:
        own = s.rstrip("*")
        d = min((edits(own, word[:j]) for j in range(1, len(word) + 1)), default=9)
        if d == 0 or d <= toxicity.allowed(len(own)) and len(own) - d <= len(word) <= 2 * len(own):
            off.append(d)
    assert toxicity.Lexicon(STEMS, free=True).match(word) == min(off, default=-1)


def test_known_words_match_to_the_letter():
    lexicon = toxicity.Lexicon(["moron"], known=["oron", "moron"], free=True)
    assert lexicon.match("oron") == -1 and lexicon.match("noron") == 1 and lexicon.match("moron") == 0


def test_evidence_of_labelled_rows(spark):
    rows = [(1, f"w{i} moron you") for i in range(20)] + [(1, "roron")] + [(0, f"w{i} oron fine") for i in range(20)]
    docs = spark.createDataFrame(rows, "label int, text string")
    assert toxicity.learn_known(docs, ["moron"]) == ["oron"]
