"""The functions on one Python string, straight from the standards' definitions.

Column functions use these only for texts that built-in expressions cannot
handle; tests hold the built-in paths against them.
"""

from __future__ import annotations

import unicodedata

from .tables import TURKISH_FOLDS, Tables

S, L, V, T = 0xAC00, 0x1100, 0x1161, 0x11A7
FORMS = ("NFC", "NFD", "NFKC", "NFKD")
YES, NO, MAYBE = "YES", "NO", "MAYBE"


def decompose(text: str, t: Tables, compat: bool) -> str:
    """Full decomposition in canonical order."""
    mapping, out = t.compat if compat else t.canonical, []
    for x in text:
        c = ord(x)
        if c < 0xC0 and not compat:
            out.append(x)
        elif S <= c < S + 11172:
            i = c - S
            out += [chr(L + i // 588), chr(V + i % 588 // 28)] + ([chr(T + i % 28)] if i % 28 else [])
        else:
            out += mapping.get(c, x)
    return "".join(_ordered(out, t.combining))


def _ordered(out: list[str], combining: dict[int, int]) -> list[str]:
    k = 0
    while k < len(out):
        if not combining.get(ord(out[k])):
            k += 1
            continue
        end = k
        while end < len(out) and combining.get(ord(out[end])):
            end += 1
        out[k:end] = sorted(out[k:end], key=lambda x: combining[ord(x)])  # stable
        k = end
    return out


def pair(a: str, b: str, t: Tables) -> str | None:
    """The character that two compose to."""
    i, j = ord(a), ord(b)
    if L <= i < L + 19 and V <= j < V + 21:
        return chr(S + (i - L) * 588 + (j - V) * 28)
    if S <= i < S + 11172 and (i - S) % 28 == 0 and T < j < T + 28:
        return chr(i + j - T)
    return t.pairs.get((a, b))


def compose(text: str, t: Tables, compat: bool) -> str:
    out: list[str] = []
    starter, last = -1, -1
    for x in decompose(text, t, compat):
        k = t.combining.get(ord(x), 0)
        if starter >= 0 and (last < k or last == -1) and (new := pair(out[starter], x, t)):
            out[starter] = new
            continue
        if k == 0:
            starter, last = len(out), -1
        else:
            last = k
        out.append(x)
    return "".join(out)


def normalize(text: str, form: str, t: Tables) -> str:
    """The text in a form; by Python's own tables where they are new enough for all of its characters."""
    if text.isascii():
        return text
    return pure(text, form, t) if t.newer.search(text) else unicodedata.normalize(form, text)


def pure(text: str, form: str, t: Tables) -> str:
    return (compose if form in ("NFC", "NFKC") else decompose)(text, t, "K" in form)


def quick_check(text: str, form: str, t: Tables) -> str:
    """YES, NO or MAYBE: marks out of order and characters that never occur in the form say NO, those that may compose MAYBE."""
    seen, last, verdict = _verdicts(form, t), 0, YES
    for x in text:
        c = ord(x)
        k = t.combining.get(c, 0)
        if k and last > k:
            return NO
        v = seen.get(c, YES)
        if v == NO or form in ("NFD", "NFKD") and S <= c < S + 11172:
            return NO
        if v == MAYBE:
            verdict = MAYBE
        last = k
    return verdict


_qc: dict[str, dict[int, str]] = {}


def _verdicts(form: str, t: Tables) -> dict[int, str]:
    if form not in _qc:
        mapping = t.compat if "K" in form else t.canonical
        if form in ("NFD", "NFKD"):
            _qc[form] = dict.fromkeys(mapping, NO)
        else:
            out = {c: MAYBE for c in [*range(V, V + 21), *range(T + 1, T + 28), *(ord(b) for _, b in t.pairs)]}
            out |= {c: NO for c in mapping if normalize(chr(c), form, t) != chr(c)}
            _qc[form] = out
    return _qc[form]


def casefold(text: str, t: Tables, mode: str = "standard") -> str:
    if mode == "turkish":
        text = text.translate(TURKISH_FOLDS)
    return text.translate(t.folds)


def skeleton(text: str, t: Tables) -> str:
    """Decompose, then replace by prototypes and decompose until nothing changes, eight times at most."""
    now = normalize(text, "NFD", t)
    for _ in range(8):
        new = normalize(now.translate(t.prototypes), "NFD", t)
        if new == now:
            break
        now = new
    return now


def match_key(text: str, t: Tables, mode: str = "standard") -> str:
    """NFKC, fold, skeleton, fold, until nothing changes, four times at most."""
    now = text
    for k in range(4):
        new = casefold(skeleton(casefold(normalize(now, "NFKC", t), t, mode), t), t, mode)
        if k and new == now:
            break
        now = new
    return now
