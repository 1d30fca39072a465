"""Toxicity: Levenshtein automata over a lexicon trie, and scores of the context windows of what they find.

The lexicon is learned from labelled rows: stems (word beginnings) that toxic
texts have and others lack; a short general list goes with it. Each distinct word
is run once through the trie, one automaton row per trie node, so misspelled
forms are found within an edit distance that depends on the stem's length. Hits
are then looked at in their window: quotation marks and words of reporting
make a hit a quotation, which counts for little. A logistic model over the hits
of a text gives its score.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stage, table, with_row_key
from .quality import labelled_sample

#: Labelled rows that lexicon and model may see. Candidates for stems lie in ``LEAST_TEXTS`` of them each at least, which bounds those too.
SAMPLE = 20_000
SHORTEST, LONGEST = 3, 16
#: A stem is in this many toxic texts of the sample at least, and in so many times fewer others.
LEAST_TEXTS = 8
PURITY = 20
#: Near words that a stem may have by chance and still be looked for misspelled.
FEW = 3
THRESHOLD = 0.7
#: Words on either side of a hit that are its context.
WINDOW = 5
#: Distinct words whose hits a worker keeps.
CACHE = 300_000
#: Depth in the trie that few words are followed to.
DEEP = 4

# General insults, words of reporting, and characters that stand for letters.
INSULTS = ("asshole", "bastard", "bitch", "cretin", "dumbass", "garbage", "idiot", "imbecile", "loser", "moron", "pathetic", "retard", "scum", "stupid", "trash", "worthless")
REPORTING = frozenset(
    "say says said saying call calls called quote quotes quoted write writes wrote written word words term terms phrase insult insults reads titled cited "
    "dit dire dis disait appelle appelé appelait mot mots terme termes écrit écrivait cite cité insulte insultes "
    "sagt sagte sagen gesagt nennt nannte genannt wort worte wörter schreibt schrieb geschrieben zitat zitiert begriff beleidigung "
    "dice dijo decir dicho llama llamó llamado palabra palabras término escribe escribió escrito cita citó insulto insultos frase".split()
)
LOOKALIKES = str.maketrans("0134578@$!", "oieastbasi")

_RUN = re.compile(r"[^\W_]+(?:[@$!*][^\W_]+)*")
_LETTERS = re.compile(r"[^\W\d_]+")


def allowed(length: int) -> int:
    """Edits that a stem of this length may be off."""
    return 0 if length < 5 else 1 if length < 9 else 2


@dataclass
class Node:
    children: dict[str, Node] = field(default_factory=dict)
    #: Length of the stem that ends here, 0 for none, the edits that it may be off, and the most that any stem below may be.
    stem: int = 0
    edits: int = 0
    most: int = 0


class Lexicon:
    """A trie of stems, searched by Levenshtein automata.

    ``known`` are words that look like misspelled stems but are words of their
    own, as labelled rows show; they match to the letter only, and so do the stems ``rigid``,
    whose neighbours are no sign of anything. With ``free`` an
    edit may be anywhere; else a word keeps its stem's first letter, and a stem that
    ends in ``*`` (seen with various endings) has to match to the letter.
    """

    def __init__(self, stems, known=(), free: bool = False, rigid=()):
        self.stems, self.known, self.free = sorted(set(stems)), frozenset(known), free
        #: Beginnings of words that no automaton follows to depth ``DEEP``; its rows so far look at no other letters.
        self.dead: set[str] = set()
        self.root = Node()
        self.longest = max((len(s.rstrip("*")) for s in self.stems), default=0)
        for s in self.stems:
            own = s.rstrip("*")
            edits = allowed(len(own)) if (free or own == s) and s not in rigid else 0
            node, path = self.root, [self.root]
            for ch in own:
                node = node.children.setdefault(ch, Node())
                path.append(node)
            node.stem, node.edits = len(own), max(node.edits, edits)
            for x in path:
                x.most = max(x.most, edits)

    def match(self, word: str) -> int:
        """Edits between the word's beginning and the nearest stem within its allowance; -1 for none.

        The automaton of the word runs along the trie. Its state at a node is a set of places in the word
        for each number of edits, as the bits of an integer: bit j is set if the word's first j letters are so many edits
        or fewer from the node's string. A node is left as
        soon as no place is within the largest allowance below it. An edited
        word is at most as much longer than the stem as the stem itself is long.
        """
        full = len(word)
        if word in self.known:
            return self._exact(word)
        word = word[: self.longest + 3]  # beyond the longest stem and its edits, no letter changes the result
        n = len(word)
        begin = word[: DEEP + 2]
        if begin in self.dead:
            return -1
        at: dict[str, int] = {}
        bit = 2
        for ch in word:
            at[ch] = at.get(ch, 0) | bit
            bit <<= 1
        every, best, deep = bit - 1, -1, n < DEEP + 2
        # Node, its letter, places at 0, 1 and 2 edits, the same at 0 and 1 for the node above, and its depth.
        todo = [(self.root, "", 1, 3 & every, 7 & every, 0, 0, 0)]
        while todo:
            node, ch, r0, r1, r2, p0, p1, depth = todo.pop()
            deep = deep or depth >= DEEP or node.stem > 0
            if node.stem:
                off = 0 if r0 > 1 else 1 if r1 > 1 else 2 if r2 > 1 else 9
                if off == 0:
                    return 0
                if off <= node.edits and node.stem - off <= full <= 2 * node.stem:
                    best = off if best < 0 else min(best, off)
            if self.free or depth:
                below = node.children.items()
            else:
                below = [(word[0], node.children[word[0]])] if word[:1] in node.children else []
            up = at.get(ch, 0)
            for c, child in below:
                m = at.get(c, 0)
                n0 = (r0 << 1) & m
                if not child.most:
                    if n0:
                        todo.append((child, c, n0, 0, 0, 0, 0, depth + 1))
                    continue
                swapped = (m << 1) & up  # two letters in the other order
                n1 = (((r1 << 1) & m) | r0 | (r0 << 1) | (n0 << 1) | ((p0 << 2) & swapped)) & every
                if child.most == 1:
                    if n1:
                        todo.append((child, c, n0, n1, 0, r0, r1, depth + 1))
                    continue
                n2 = (((r2 << 1) & m) | r1 | (r1 << 1) | (n1 << 1) | ((p1 << 2) & swapped)) & every
                if n2:
                    todo.append((child, c, n0, n1, n2, r0, r1, depth + 1))
        if not deep:
            if len(self.dead) > CACHE:
                self.dead.clear()
            self.dead.add(begin)
        return best

    def _exact(self, word: str) -> int:
        """0 if the word begins with a stem, else -1."""
        node = self.root
        for ch in word:
            if (node := node.children.get(ch)) is None:
                return -1
            if node.stem:
                return 0
        return -1


class Hits(dict):
    """What a word, as it stands between white space, has: 0 nothing, 1 a stem, 2 a misspelled stem."""

    def __init__(self, lexicon: Lexicon):
        super().__init__()
        self.lexicon = lexicon

    def __missing__(self, token: str) -> int:
        if len(self) > CACHE:
            self.clear()
        kinds = set()
        for run in _RUN.findall(token.lower()):
            plain = run if run.isalpha() else run.translate(LOOKALIKES)
            if len(plain) >= SHORTEST:
                edits = self.lexicon.match(plain)
                kinds.add(0 if edits < 0 else 1 if edits == 0 and plain == run else 2)
        self[token] = kind = 1 if 1 in kinds else 2 if 2 in kinds else 0
        return kind


#: Of a text: stems and misspelled stems outside quotations, hits in quotations, and words.
FEATURES = ("n_stems", "n_misspelled", "n_quoted", "n_all")


_OPENING, _CLOSING = tuple("\"“„«‹»‘'"), tuple("\"”“»›«’'")


def quoted(words: list[str], i: int) -> bool:
    """Whether a word of a pair of quotation marks, within ``WINDOW`` words on either side, that a word of reporting leads up to.

    The pair has to be the word's own: an end of another quotation before it, or a beginning after it,
    stands between.
    """
    bare = lambda w: w.rstrip(".,;:!?")
    opens = None
    for k in range(i, max(-1, i - WINDOW - 1), -1):
        if k < i and bare(words[k]).endswith(_CLOSING):
            return False
        if words[k].startswith(_OPENING):
            opens = k
            break
    if opens is None:
        return False
    for k in range(i, min(len(words), i + WINDOW + 1)):
        if k > i and words[k].startswith(_OPENING):
            return False
        if bare(words[k]).endswith(_CLOSING):
            return any(bare(w).lower() in REPORTING for w in words[max(0, opens - WINDOW) : opens])
    return False


def hits(text: str | None, found: Hits) -> tuple[int, int, int, int]:
    """``FEATURES`` of a whole text; null counts as empty."""
    words = (text or "").split()
    kinds = list(map(found.__getitem__, words))
    if not any(kinds):
        return 0, 0, 0, len(words)
    out = [0, 0, 0, len(words)]
    for i, kind in enumerate(kinds):
        if kind:
            out[2 if quoted(words, i) else kind - 1] += 1
    return tuple(out)


def inputs(x: np.ndarray) -> np.ndarray:
    """What the model weighs. A misspelled stem counts as ``MISSPELLED`` of one: labelled rows have too few to tell."""
    stems, bad, cited, n = x.astype(np.float64).T
    own = stems + MISSPELLED * bad
    return np.column_stack([np.ones(len(x)), np.log1p(own), np.minimum(own, 2) / 2, np.minimum(1, 20 * own / np.maximum(n, 1)), np.log1p(cited)])


MISSPELLED = 0.9
#: Used where labels cannot teach a model.
DEFAULT = np.array([-4.0, 2.0, 4.0, 1.0, 0.3])


@dataclass
class Model:
    stems: list[str]
    weights: np.ndarray
    known: list[str] = field(default_factory=list)
    rigid: list[str] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(inputs(x) @ self.weights, -30, 30)))


def regress(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, rounds: int = 60) -> np.ndarray:
    """Logistic regression by Newton steps; a small ridge around ``DEFAULT`` keeps separable data finite."""
    a, w = inputs(x), DEFAULT.copy()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + ridge * np.eye(len(w)), a.T @ (p - y) + ridge * (w - DEFAULT))
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return w


def held_out(id_col: str) -> Column:
    """Rows that no lexicon or model may learn from: crc32 of the id as text leaves 1 by 3; null ids too."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(True))


def training_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Staged (label, text) of at most ``sample`` labelled ids, without near copies.

    A text that was copied a thousand times would make each of its words look
    toxic, so of texts that share one of three minima over their shingles one is used.
    """
    picked = labelled_sample(labels, "toxic", sample, id_col, ~held_out(id_col))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(picked), F.col("id") == F.col("of"))

    def minima(texts: pd.Series) -> pd.Series:
        def of(text: str) -> list[int]:
            words = text.encode("utf-8", "surrogatepass").split()
            own = [b" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))]
            return [min(xxhash.xxh64_intdigest(s, k) for s in own) >> 1 for k in range(3)]

        return texts.map(of)

    rows = stage(rows.select("label", "text", F.pandas_udf(minima, "array<long>")(F.coalesce("text", F.lit(""))).alias("least")), "toxic-sample")
    for k in range(3):
        rows = rows.groupBy(F.col("least")[k]).agg(F.min_by(F.struct("label", "text", "least"), F.xxhash64("text", "label")).alias("x")).select("x.*")
    return stage(rows.select("label", "text"), "toxic-rows")


def learn_stems(rows: DataFrame) -> list[str]:
    """Word beginnings that set toxic texts apart; of nested ones the shortest, lengthened while it loses next to no text."""
    total = {r["label"] > 0: r["n"] for r in rows.groupBy((F.col("label") > 0).cast("int").alias("label")).agg(F.count("*").alias("n")).collect()}
    if len(total) < 2:
        return []

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = (Counter(), Counter())
        for batch in batches:
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = set(_LETTERS.findall((text or "").lower()))
                of[label > 0].update({w[:k] for w in words for k in range(SHORTEST, min(len(w), LONGEST) + 1)} | {f"{w}$" for w in words if SHORTEST <= len(w) <= LONGEST})
        names = list(of[0].keys() | of[1].keys())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([of[1][s] for s in names], pa.int64()), pa.array([of[0][s] for s in names], pa.int64())], ["s", "bad", "good"])

    ratio = total[False] / total[True]
    counted = rows.mapInArrow(begin, "s string, bad long, good long").groupBy("s").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    pure = counted.where((F.col("bad") >= LEAST_TEXTS) & (F.col("good") * PURITY <= F.col("bad") * ratio))
    bad = {r["s"]: r["bad"] for r in pure.orderBy("s").collect()}
    whole = {s[:-1]: bad.pop(s) for s in [s for s in bad if s.endswith("$")]}
    children: dict[str, list[str]] = {}
    for s in bad:
        children.setdefault(s[:-1], []).append(s)
    stems: dict[str, str] = {}
    for s in sorted(bad, key=len):
        if s[:-1] in bad or any(s[:k] in stems for k in range(SHORTEST, len(s) + 1)):
            continue
        while longer := max(children.get(s, ()), key=bad.get, default=None):
            if bad[longer] < 0.97 * bad[s]:
                break
            s = longer
        stems[s] = s if whole.get(s, 0) > 0.5 * bad[s] else f"{s}*"
    return list(stems.values())


def learn_known(rows: DataFrame, stems: list[str]) -> list[str]:
    """The known words of ``learn_near``."""
    return learn_near(rows, stems)[0]


def learn_near(rows: DataFrame, stems: list[str]) -> tuple[list[str], list[str]]:
    """(known, rigid): words near a stem that toxic texts have no more often than others, and stems whose near words, all together, are so.

    Known words are neighbours by chance, such as 'oron' of 'moron'. A rigid stem is made of what other words are made of,
    so that words that no labelled row has will be near it too; general insults are never so.
    """
    total = {r["toxic"]: r["n"] for r in rows.groupBy((F.col("label") > 0).alias("toxic")).agg(F.count("*").alias("n")).collect()}
    if len(total) < 2:
        return [], []

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, of, edits = Lexicon(stems, free=True), (Counter(), Counter()), {}
        for batch in batches:
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = {run if run.isalpha() else run.translate(LOOKALIKES) for run in set(_RUN.findall((text or "").lower()))}
                for w in words:
                    if w not in edits:
                        edits[w] = len(w) >= SHORTEST and lexicon.match(w) > 0
                of[label > 0].update(w for w in words if edits[w])
        names = list(of[0].keys() | of[1].keys())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([of[1][s] for s in names], pa.int64()), pa.array([of[0][s] for s in names], pa.int64())], ["s", "bad", "good"])

    counted = rows.mapInArrow(near, "s string, bad long, good long").groupBy("s").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    ratio = total[False] / total[True]
    common = lambda bad, good: good > 0 and good * PURITY > bad * ratio
    found = sorted((r["s"], r["bad"], r["good"]) for r in counted.collect())  # bounded, as the sample is
    rigid = []
    for s in sorted(set(stems) - set(INSULTS)):
        own = Lexicon([s], free=True)
        around = [(bad, good) for w, bad, good in found if own.match(w) > 0]
        if common(sum(bad for bad, _ in around), sum(good for _, good in around)) and len(around) > FEW:
            rigid.append(s)
    return [w for w, bad, good in found if common(bad, good)], rigid


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Lexicon and weights from at most ``sample`` labelled rows that are not held out."""
    rows = training_rows(docs, labels, sample, id_col, text_col)
    stems = sorted({*learn_stems(rows), *INSULTS})
    known, rigid = learn_near(rows, stems)
    seen = rows.mapInArrow(_features(stems, 1, ["label"], known=known, rigid=rigid), "label int, " + ", ".join(f"{c} long" for c in FEATURES)).toPandas()
    if seen["label"].nunique() < 2:
        return Model(stems, DEFAULT, known, rigid)
    seen = seen.sort_values(list(seen.columns))
    return Model(stems, regress(seen[list(FEATURES)].to_numpy(), (seen["label"] > 0).to_numpy().astype(float)), known, rigid)


def _features(stems: list[str], keep: int, names: list[str], weights: np.ndarray | None = None, known: list[str] = (), rigid: list[str] = ()):
    """A function for mapInArrow: the first ``keep`` columns, the features of the text after them, and the score where there are weights."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Hits(Lexicon(stems, known, free=True, rigid=rigid))
        for batch in batches:
            x = np.array([hits(t.as_py(), found) for t in batch.column(keep)], np.int64).reshape(-1, len(FEATURES))
            more = [] if weights is None else [pa.array(Model(stems, weights).score(x))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:keep], *(pa.array(c) for c in x.T), *more], [*names, *FEATURES, *["score"] * len(more)])

    return make


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row of ``docs`` with its score.

    Columns: id, _r_file, _r_row, ``FEATURES``, score (0 to 1). Null and empty
    texts score as texts without a hit. Null ids stay null, repeated rows score
    alike, other columns are ignored, an empty table gives no rows.
    """
    kind = dict(docs.dtypes)[id_col]
    rows = with_row_key(docs).select(F.col(id_col).alias("id"), "_r_file", "_r_row", F.col(text_col))
    schema = f"id {kind}, _r_file long, _r_row long, " + ", ".join(f"{c} long" for c in FEATURES) + ", score double"
    return rows.mapInArrow(_features(model.stems, 3, ["id", "_r_file", "_r_row"], model.weights, model.known, model.rigid), schema)


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that score ``threshold`` or more; all columns stay. Texts are scored where they lie, so nothing is shuffled."""
    model = fit(docs, labels, sample, id_col, text_col)
    stems, weights, known, rigid = model.stems, model.weights, model.known, model.rigid

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Hits(Lexicon(stems, known, free=True, rigid=rigid))
        for batch in batches:
            x = np.array([hits(t.as_py(), found) for t in batch.column(text_col)], np.int64).reshape(-1, len(FEATURES))
            yield batch.filter(pa.array(Model(stems, weights).score(x) < threshold))

    return docs.mapInArrow(clean, docs.schema)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select(
        F.col("id").alias("doc_id"), held_out("id").alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), *FEATURES
    )


QUERIES = {"op3_toxicity": op3_toxicity}
ORACLES: dict[str, str] = {}
