"""Skeletons and matching keys as tables for ``translate``, and which texts these tables are enough for.

A text goes by tables if it holds no mark of its own and each of its characters, decomposed, is
one mark at most after characters that either are their own skeleton or have one of one character.
Then mapping each character by itself gives the fixed point: no marks change places, and
decomposing composes nothing.
"""

from __future__ import annotations

from typing import NamedTuple

from . import reference as R
from .tables import TURKISH_FOLDS, Tables

#: ASCII characters whose prototypes are longer, in skeletons and in keys.
REPLACED = {"m": "rn", '"': "''", "%": "º/₀"}
KEY_REPLACED = {"m": "rn", '"': "''", "%": "o/o"}
#: Marks, what the JVM does not know, and Hangul syllables, whose letters have prototypes of several characters.
MARKS = r"[\p{M}\p{Cn}\x{AC00}-\x{D7A3}]"


class Plan(NamedTuple):
    #: What the characters of the decomposed text become.
    table: dict[int, str]
    #: Characters that the table is not enough for.
    others: str
    #: A pattern of texts below U+0300 without such characters.
    plain: str


_plans: dict[str, Plan] = {}


def skeleton_plan(t: Tables) -> Plan:
    """The plan of ``skeleton``; its table is for the text in NFD."""
    if "skeleton" not in _plans:
        table, hard = {}, set()
        for c in t.prototypes:
            own = R.skeleton(chr(c), t)
            if chr(c) in REPLACED or c in t.canonical or own == chr(c):
                continue
            if len(own) == 1 and (c in t.combining) == (ord(own) in t.combining):
                table[c] = own
            else:
                hard.add(chr(c))
        _plans["skeleton"] = _plan(t, table, hard, lambda x: x, {*t.canonical})
    return _plans["skeleton"]


def key_plan(t: Tables, mode: str) -> Plan:
    """The plan of ``match_key``; its table is for the text in NFKC, folded, in NFD.

    One round has to be the fixed point, so characters that another round would change,
    by themselves or where they compose, are not for the table.
    """
    if mode not in _plans:
        first, fold = skeleton_plan(t).table, lambda x: R.casefold(x, t, mode)
        step = lambda x: fold(R.skeleton(fold(R.normalize(x, "NFKC", t)), t))
        asked = {*t.compat, *t.canonical, *t.folds, *t.prototypes, *TURKISH_FOLDS} - set(map(ord, KEY_REPLACED))
        table, hard = {}, set()
        for c in asked:
            own = fold(first.get(c, chr(c)))
            if len(own) != 1 or step(own) != own or c in t.prototypes and c not in first and R.skeleton(chr(c), t) != chr(c):
                hard.add(chr(c))
            elif own != chr(c):
                table[c] = own
        for c, parts in t.canonical.items():  # composed again in the next round, these must come apart as they were
            if len(parts) > 1 and not any(x in hard or ord(x) in table or x in KEY_REPLACED for x in parts) and R.skeleton(fold(chr(c)), t) != parts:
                hard.update(parts[1:])
        _plans[mode] = _plan(t, table, hard, lambda x: fold(R.normalize(x, "NFKC", t)), asked)
    return _plans[mode]


def _plan(t: Tables, table: dict[int, str], hard: set[str], before, asked: set[int]) -> Plan:
    """``hard``: characters of the decomposed text that the table has no answer for; ``before``: what comes before decomposing."""

    def enough(c: int) -> bool:
        apart = R.normalize(before(chr(c)), "NFD", t)
        return not hard.intersection(apart) and sum(ord(x) in t.combining for x in apart) < 2

    others = {c for c in asked | {ord(x) for x in hard} if not enough(c)}
    good = [c for c in range(0x300) if c not in others]
    cuts = [k for k in range(len(good)) if not k or good[k] != good[k - 1] + 1]
    pattern = "".join(rf"\x{{{good[a]:X}}}-\x{{{good[b - 1]:X}}}" for a, b in zip(cuts, [*cuts[1:], len(good)], strict=True))
    return Plan(table, "".join(map(chr, sorted(others))), f"^[{pattern}]*$")
