"""The functions as SQL functions of a session: ``CREATE TEMPORARY FUNCTION`` over the same expressions.

Python runs behind the same gates as in ``lexiloom.functions.text``: for texts that no
table maps, and for quick checks beyond the characters that need none.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from . import reference as R
from .confusables import KEY_REPLACED, MARKS, REPLACED, Plan, key_plan, skeleton_plan
from .tables import ICU_LACKS, NEW_COMPAT, STAND_INS, ranges, tables
from .text import KNOWN, MODES, _class, _folds, _python

FORMS = R.FORMS


def _lit(text: str) -> str:
    """A string literal that needs no quoting."""
    return f"CAST(X'{text.encode('utf-8', 'surrogatepass').hex()}' AS STRING)"


def _ascii(x: str) -> str:
    return f"octet_length({x}) = char_length({x})"


def _has(x: str, pattern: str) -> str:
    return f"{x} RLIKE {_lit(pattern)}"


def _translate(x: str, frm: str, to: str) -> str:
    return f"translate({x}, {_lit(frm)}, {_lit(to)})"


def _mapped(x: str, table: dict[int, str]) -> str:
    return _translate(x, "".join(map(chr, table)), "".join(table.values()))


def _replaced(x: str, pairs: dict[str, str]) -> str:
    for a, b in pairs.items():
        x = f"replace({x}, {_lit(a)}, {_lit(b)})"
    return x


def _form(x: str, form: str) -> str:
    """SQL of the normal form of ``x``, a name."""
    method, compat = "compose" if form in ("NFC", "NFKC") else "decompose", "true" if "K" in form else "false"
    icu = lambda y: f"reflect('com.ibm.icu.text.Normalizer', '{method}', {y}, {compat})"
    y = x
    if "K" in form:
        for k, v in NEW_COMPAT.items():
            y = f"replace({y}, {_lit(chr(k))}, {_lit(v)})"
    new = "".join(chr(c) for k in ICU_LACKS for c in ranges(ICU_LACKS[k]))

    def through(stand_ins: dict[int, str]) -> str:
        other = "".join(chr(c) for k in ICU_LACKS for c in ranges(stand_ins[k])[: len(ranges(ICU_LACKS[k]))])
        return _translate(icu(_translate(y, new, other)), other, new)

    first, second = STAND_INS
    return (
        f"CASE WHEN {x} IS NULL THEN NULL WHEN {_ascii(x)} THEN {x} WHEN {_has(y, KNOWN)} OR NOT {_has(y, _class(*ICU_LACKS.values()))} THEN {icu(y)} "
        f"WHEN NOT {_has(y, _class(*first.values()))} THEN {through(first)} WHEN NOT {_has(y, _class(*second.values()))} THEN {through(second)} ELSE {icu(y)} END"
    )


def _by(name: str, of: str, cases: dict[str, str], lower: bool) -> str:
    """``cases`` by the value of an argument; an unknown value is an error, as in Python."""
    value = f"lower({of})" if lower else f"upper({of})"
    each = " ".join(f"WHEN {value} = '{k}' THEN {x}" for k, x in cases.items())
    return f"CASE WHEN {of} IS NULL THEN NULL {each} ELSE raise_error(concat('{name}: one of {', '.join(cases)}, not ', {of})) END"


def register(spark: SparkSession, prefix: str = "") -> list[str]:
    """Register the functions with the session's SQL, their names after ``prefix``; returns the names.

    nfc, nfd, nfkc, nfkd, is_nfc, is_nfd, is_nfkc, is_nfkd (text); normalize, is_normalized,
    quick_check (text, form); normalize_to (text, form, prefix, '' by default: a struct of text and
    was_normalized); skeleton (text); are_confusable (a, b); casefold, match_key,
    match_key_utf16 (text, mode) and matches (a, b, mode), with the mode 'standard' by default; fold_case is
    casefold. Nulls give nulls, an unknown form or mode is an error.
    """
    t, names = tables(spark), []
    slow = {"skeleton": lambda x, own: R.skeleton(x, own), **{f"match_key_{m}": (lambda x, own, m=m: R.match_key(x, own, m)) for m in MODES}}
    quick = {f"quick_check_{f.lower()}": (lambda x, own, f=f: R.quick_check(x, f, own)) for f in ("NFC", "NFKC")}
    for name, function in (slow | quick).items():
        spark.udf.register(f"{prefix}_{name}_python", _python(function, by_word=name in slow))

    def define(name: str, arguments: str, returns: str, body: str) -> None:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}({arguments}) RETURNS {returns} RETURN {body}")
        names.append(f"{prefix}{name}")

    def own(name: str, *arguments: str) -> str:
        return f"{prefix}{name}({', '.join(arguments)})"

    text, form, mode = "t STRING", "form STRING", "mode STRING DEFAULT 'standard'"
    for f in FORMS:
        define(f.lower(), text, "STRING", _form("t", f))
        define(f"is_{f.lower()}", text, "BOOLEAN", f"{own(f.lower(), 't')} = t")
    define("normalize", f"{text}, {form}", "STRING", _by("form", "form", {f: own(f.lower(), "t") for f in FORMS}, False))
    define("is_normalized", f"{text}, {form}", "BOOLEAN", _by("form", "form", {f: own(f"is_{f.lower()}", "t") for f in FORMS}, False))
    done = own("normalize", "t", "form")
    define("normalize_to", f"{text}, {form}, before STRING DEFAULT ''", "STRUCT<text: STRING, was_normalized: BOOLEAN>", f"named_struct('text', concat(before, {done}), 'was_normalized', {done} = t)")

    def checked(f: str) -> str:
        if f in ("NFD", "NFKD"):
            return f"CASE WHEN {own(f'is_{f.lower()}', 't')} THEN 'YES' WHEN t IS NOT NULL THEN 'NO' END"
        plain = _has("t", r"^[\x{0}-\x{9F}]*$" if f == "NFKC" else r"^[\x{0}-\x{2FF}]*$")
        return f"CASE WHEN {plain} THEN 'YES' ELSE {prefix}_quick_check_{f.lower()}_python(CASE WHEN NOT {plain} THEN t END) END"

    define("quick_check", f"{text}, {form}", "STRING", _by("form", "form", {f: checked(f) for f in FORMS}, False))
    folds = {m: {k: chr(v) for k, v in _folds(m).items()} for m in MODES}
    for name in ("casefold", "fold_case"):
        define(name, f"{text}, {mode}", "STRING", _by("mode", "mode", {m: _mapped("t", folds[m]) for m in MODES}, True))

    def let(value: str, name: str, use: str) -> str:
        return f"transform(array({value}), {name} -> {use})[0]"

    def by_tables(name: str, ascii_: str, easy: str, apart: str, plan: Plan, pairs: dict[str, str]) -> None:
        far = f"NOT ({ascii_}) AND NOT {_has('t', plan.plain)} AND ({_has('t', MARKS)} OR {_translate('t', plan.others, '')} <> t)"
        slow = f"{prefix}_{name}_python(CASE WHEN {far} THEN t END)"
        define(f"_{name}", text, "STRING", f"CASE WHEN {ascii_} THEN {easy} WHEN {slow} IS NOT NULL THEN {slow} ELSE {_replaced(_mapped(apart, plan.table), pairs)} END")

    by_tables("skeleton", _ascii("t"), _replaced(_translate("t", "01I|`", "Olll'"), REPLACED), own("nfd", "t"), skeleton_plan(t), REPLACED)
    define("skeleton", text, "STRING", own("_skeleton", "t"))
    define("are_confusable", "a STRING, b STRING", "BOOLEAN", f"{own('skeleton', 'a')} = {own('skeleton', 'b')}")
    for m in MODES:
        ascii_ = _ascii("t") + (" AND NOT contains(t, 'I')" if m == "turkish" else "")
        apart = let(_mapped(own("nfkc", "t"), folds[m]), "f", _form("f", "NFD"))
        by_tables(f"match_key_{m}", ascii_, _replaced(_translate("lower(t)", "01|`", "oll'"), KEY_REPLACED), apart, key_plan(t, m), KEY_REPLACED)
    define("match_key", f"{text}, {mode}", "STRING", _by("mode", "mode", {m: own(f"_match_key_{m}", "t") for m in MODES}, True))
    units = f"regexp_extract_all(hex(encode({own('match_key', 't', 'mode')}, 'UTF-16BE')), '(....)', 1)"
    define("match_key_utf16", f"{text}, {mode}", "ARRAY<INT>", f"transform({units}, u -> CAST(conv(u, 16, 10) AS INT))")
    define("matches", f"a STRING, b STRING, {mode}", "BOOLEAN", f"a = b OR {own('match_key', 'a', 'mode')} = {own('match_key', 'b', 'mode')}")
    return [n for n in names if not n.startswith(f"{prefix}_")]
