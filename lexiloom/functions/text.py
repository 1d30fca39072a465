"""Unicode normalisation, case folding, confusable skeletons and matching keys as Column functions.

Null gives null, the empty text gives itself. Forms run in the JVM (ICU, called
from Catalyst), folding is ``translate``. Skeletons and matching keys are a form,
``translate`` and a few replacements, in the JVM too, for texts whose characters have prototypes of one
character (see ``confusables``). The others go to Python in Arrow batches, and
rows that need not go are sent as nulls. ``lexiloom.functions.sql`` has the same for SQL.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from .confusables import KEY_REPLACED, MARKS, REPLACED, Plan, key_plan, skeleton_plan
from .reference import FORMS, NO, YES
from .reference import match_key as _match_key
from .reference import quick_check as _quick_check
from .reference import skeleton as _skeleton
from .tables import ICU_LACKS, NEW_COMPAT, STAND_INS, TURKISH_FOLDS, folds, ranges, tables

MODES = ("standard", "turkish")


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _spark() -> SparkSession:
    return SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()


def _icu(c: Column, method: str, compat: bool) -> Column:
    """A deterministic static call of ICU's Normalizer; ``reflect`` where the session hides Catalyst."""
    spark = _spark()
    try:
        jvm = spark.sparkContext._jvm
        call = getattr(jvm, "org.apache.spark.sql.catalyst.expressions.objects.StaticInvoke")
        invoke = getattr(jvm, "org.apache.spark.sql.catalyst.expressions.objects.Invoke")
        column = jvm.org.apache.spark.sql.classic.ExpressionUtils
        types, seq = jvm.org.apache.spark.sql.types, lambda *x: spark.sparkContext._jvm.PythonUtils.toSeq(list(x))
        name = jvm.java.lang.Class.forName
        loader = jvm.java.lang.Thread.currentThread().getContextClassLoader()
        klass = lambda n: name(n, True, loader)
        string = getattr(getattr(jvm, "org.apache.spark.sql.types.StringType$"), "MODULE$")
        java_string = types.ObjectType(klass("java.lang.String"))
        none = seq()
        text = invoke(column.expression(c._jc), "toString", java_string, none, none, True, True, True)
        flag = column.expression(F.lit(compat)._jc)
        done = call(klass("com.ibm.icu.text.Normalizer"), java_string, method, seq(text, flag), none, True, True, True, getattr(jvm, "scala.Option").empty())
        back = call(klass("org.apache.spark.unsafe.types.UTF8String"), string, "fromString", seq(done), none, True, True, True, getattr(jvm, "scala.Option").empty())
        return Column(column.column(back))
    except Exception:  # noqa: BLE001  internals differ between releases and sessions
        return F.when(c.isNotNull(), F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit(method), F.coalesce(c, F.lit("")), F.lit(compat)))


def _class(*parts: str) -> str:
    return "[" + "".join("-".join(rf"\x{{{x}}}" for x in p.split("-")) for part in parts for p in part.split()) + "]"


def is_ascii(c: Column) -> Column:
    """Whether the text has a byte for each character; much cheaper than a pattern."""
    return F.octet_length(c) == F.char_length(c)


#: All characters lie below the first that ICU does not know.
KNOWN = r"^[\x{0}-\x{1ACE}]*$"


def normalize(c: Column | str, form: str) -> Column:
    """The text in NFC, NFD, NFKC or NFKD of Unicode 17.

    Marks that the JVM's ICU does not know yet stand in for known marks of the
    same class while it works. A text that has such marks and also marks of both
    sets of stand-ins is the one kind that keeps ICU's own order.
    """
    c, form = _col(c), form.upper()
    if form not in FORMS:
        raise ValueError(f"form {form!r}; one of {', '.join(FORMS)}")
    method, compat = "compose" if form in ("NFC", "NFKC") else "decompose", "K" in form
    if compat:
        for k, v in NEW_COMPAT.items():
            c = F.replace(c, F.lit(chr(k)), F.lit(v))
    new = "".join(chr(x) for k in ICU_LACKS for x in ranges(ICU_LACKS[k]))

    def through(stand_ins: dict[int, str]) -> Column:
        other = "".join(chr(x) for k in ICU_LACKS for x in ranges(stand_ins[k])[: len(ranges(ICU_LACKS[k]))])
        return F.translate(_icu(F.translate(c, new, other), method, compat), other, new)

    first, second = STAND_INS
    return (
        F.when(is_ascii(c), c)
        .when(c.rlike(KNOWN) | ~c.rlike(_class(*ICU_LACKS.values())), _icu(c, method, compat))
        .when(~c.rlike(_class(*first.values())), through(first))
        .when(~c.rlike(_class(*second.values())), through(second))
        .otherwise(_icu(c, method, compat))
    )


def nfc(c: Column | str) -> Column:
    return normalize(c, "NFC")


def nfd(c: Column | str) -> Column:
    return normalize(c, "NFD")


def nfkc(c: Column | str) -> Column:
    return normalize(c, "NFKC")


def nfkd(c: Column | str) -> Column:
    return normalize(c, "NFKD")


def normalize_to(c: Column | str, form: str, prefix: Column | str | None = None) -> Column:
    """struct(text, was_normalized); ``prefix``, a column, comes before the text."""
    c = _col(c)
    done = normalize(c, form)
    return F.struct((done if prefix is None else F.concat(_col(prefix), done)).alias("text"), (done == c).alias("was_normalized"))


def is_normalized(c: Column | str, form: str) -> Column:
    """Whether the text is in the form, definitively."""
    c = _col(c)
    return normalize(c, form) == c


def is_nfc(c: Column | str) -> Column:
    return is_normalized(c, "NFC")


def is_nfd(c: Column | str) -> Column:
    return is_normalized(c, "NFD")


def is_nfkc(c: Column | str) -> Column:
    return is_normalized(c, "NFKC")


def is_nfkd(c: Column | str) -> Column:
    return is_normalized(c, "NFKD")


#: Words whose results a task keeps.
CACHE = 200_000


def _python(function, by_word: bool = False):
    """A pandas UDF of ``function(text, tables)`` that passes nulls by.

    ``by_word``: the function works on each side of a space by itself, as a space
    takes part in no composition and no reordering, so words are looked up.
    """
    t = tables(_spark())

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        kept: dict[str, str] = {}

        def words(text: str) -> str:
            parts = text.split(" ")
            out = list(map(kept.get, parts))
            if None in out:
                if len(kept) > CACHE:
                    kept.clear()
                for k, x in enumerate(out):
                    if x is None:
                        out[k] = kept[parts[k]] = function(parts[k], t)
            return " ".join(out)

        of = words if by_word else lambda x: function(x, t)
        for texts in batches:
            yield texts.map(lambda x: None if x is None else of(x))

    return F.pandas_udf(run, "string")


def quick_check(c: Column | str, form: str) -> Column:
    """YES, NO or MAYBE from character properties alone, as UAX #15 defines it. Decomposed forms never give MAYBE."""
    c, form = _col(c), form.upper()
    if form in ("NFD", "NFKD"):
        done = normalize(c, form) == c
        return F.when(done, YES).when(~done, NO)
    # Below U+00A0, nothing composes, decomposes or is a mark; below U+0300 for NFC, but for what has a composed form already.
    plain = c.rlike(r"^[\x{0}-\x{9F}]*$" if form == "NFKC" else r"^[\x{0}-\x{2FF}]*$")
    slow = _python(lambda x, t: _quick_check(x, form, t))(F.when(~plain, c))
    return F.when(plain, YES).otherwise(slow)


def casefold(c: Column | str, mode: str = "standard") -> Column:
    """Simple case folding; ``turkish`` folds I to dotless i and dotted I to i. The number of characters stays."""
    table = _folds(mode)
    return F.translate(_col(c), "".join(map(chr, table)), "".join(map(chr, table.values())))


def _folds(mode: str) -> dict[int, int]:
    if mode not in MODES:
        raise ValueError(f"mode {mode!r}; one of {', '.join(MODES)}")
    return folds() if mode == "standard" else folds() | TURKISH_FOLDS


def _replaced(c: Column, pairs: dict[str, str]) -> Column:
    for a, b in pairs.items():
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def _mapped(c: Column, table: dict[int, str]) -> Column:
    return F.translate(c, "".join(map(chr, table)), "".join(table.values()))


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def _far(c: Column, plan: Plan) -> Column:
    """Whether the tables are not enough for a text."""
    return ~c.rlike(plan.plain) & (c.rlike(MARKS) | (F.translate(c, plan.others, "") != c))


def skeleton(c: Column | str) -> Column:
    """The confusable skeleton of UTS #39, iterated to a fixed point; case counts."""
    c = _col(c)
    plan = skeleton_plan(tables(_spark()))
    ascii_ = is_ascii(c)
    easy = _replaced(F.translate(c, "01I|`", "Olll'"), REPLACED)
    far = ~ascii_ & _far(c, plan)
    slow = _python(_skeleton, by_word=True)(F.when(far, c))
    return F.when(ascii_, easy).when(slow.isNotNull(), slow).otherwise(_replaced(_mapped(normalize(c, "NFD"), plan.table), REPLACED))


def are_confusable(a: Column | str, b: Column | str) -> Column:
    return skeleton(a) == skeleton(b)


def match_key(c: Column | str, mode: str = "standard") -> Column:
    """The matching key: NFKC, fold, skeleton and fold to a fixed point."""
    c = _col(c)
    folded = {k: chr(v) for k, v in _folds(mode).items()}
    plan = key_plan(tables(_spark()), mode)
    ascii_ = is_ascii(c)
    easy = _replaced(F.translate(F.lower(c), "01|`", "oll'"), KEY_REPLACED)
    if mode == "turkish":  # I folds to dotless i, which looks like i
        ascii_ = ascii_ & ~F.contains(c, F.lit("I"))
    far = ~ascii_ & _far(c, plan)
    slow = _python(lambda x, t: _match_key(x, t, mode), by_word=True)(F.when(far, c))
    apart = _let(_mapped(normalize(c, "NFKC"), folded), lambda x: normalize(x, "NFD"))
    return F.when(ascii_, easy).when(slow.isNotNull(), slow).otherwise(_replaced(_mapped(apart, plan.table), KEY_REPLACED))


def match_key_utf16(c: Column | str, mode: str = "standard") -> Column:
    """The matching key as UTF-16 code units."""
    units = F.regexp_extract_all(F.hex(F.encode(match_key(c, mode), "UTF-16BE")), F.lit("(....)"), F.lit(1))
    return F.transform(units, lambda u: F.conv(u, 16, 10).cast("int"))


def utf16_to_text(units: Column | str) -> Column:
    """The text of an array of UTF-16 code units."""
    return F.decode(F.unhex(F.array_join(F.transform(_col(units), lambda u: F.lpad(F.hex(u.cast("long")), 4, "0")), "")), "UTF-16BE")


def matches(a: Column | str, b: Column | str, mode: str = "standard") -> Column:
    """Whether two texts are equal or have the same matching key. Across rows, join on ``match_key`` instead."""
    a, b = _col(a), _col(b)
    return (a == b) | (match_key(a, mode) == match_key(b, mode))
