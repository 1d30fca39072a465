"""Unicode property data, built from rules over what Python and the JVM carry, brought to Unicode 17.

Python knows an older version of Unicode and the ICU library in Spark's JVM knows
16; the differences are fixed values below. Everything else is derived.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

# Fixed values of Unicode 17 (code points in hexadecimal).
#: Simple case folds that Python's tables lack: code point > fold, or first-last > first fold.
NEW_FOLDS = "1C89>1C8A 1FD3>390 1FE3>3B0 A7CB>264 A7CC>A7CD A7CE>A7CF A7D2>A7D3 A7D4>A7D5 A7DA>A7DB A7DC>19B FB05>FB06 10D50-10D65>10D70 16EA0-16EB8>16EBB"
#: Turkish overrides: dotless and dotted i.
TURKISH_FOLDS = {0x49: 0x131, 0x130: 0x69}
#: Combining classes that Python's tables lack.
NEW_CLASSES = (
    "897:230 1ACF-1ADC:230 1ADD:220 1AE0-1AE5:230 1AE6:220 1AE7-1AEA:230 1AEB:234 10D69-10D6D:230 10EFA-10EFB:220 "
    "113CE-113D0:9 1612F:9 1E5EE:230 1E5EF:220 1E6E3:230 1E6E6:230 1E6EE-1E6EF:230 1E6F5:230"
)
#: Of these, those that ICU 16 lacks too, by class, and the one compatibility mapping that it lacks.
ICU_LACKS = {230: "1ACF-1ADC 1AE0-1AE5 1AE7-1AEA 1E6E3 1E6E6 1E6EE-1E6EF 1E6F5", 220: "1ADD 1AE6 10EFA-10EFB", 234: "1AEB"}
NEW_COMPAT = {0xA7F1: "S"}
#: Marks of the same classes that neither compose nor decompose: two sets of stand-ins.
STAND_INS = ({230: "2DE0-2DFC", 220: "1E8D0-1E8D3", 234: "1DCD"}, {230: "1E008-1E018 1E01B-1E021 1E026-1E02A", 220: "1D17B-1D17E", 234: "360"})
#: Confusable characters whose prototype differs from ICU 16: code point > prototype.
NEW_CONFUSABLES = """
FE>70 | 14B>6E 329 | 192>66 | 295>A7CE | 31A>1AE9 | 348>10EFA | 3E4>427 | 3E5>447 | 3EC>36 | 3ED>6F | 448>77 | 45F>75 329 | 4CF>6C | 572>6E 329
582>69 | 67A>62A | 68F>62F 6DB | 752>649 6DB | 88F>649 30A | 8BE>649 6DB 306 | 8BF>62A 306 | 8C0>649 615 306 | 8C1>686 306 | 8C2>643 306 | 93B>93E 93A
93F>9BF | 945>306 | 947>11B64 | 949>93E 306 | 956>11B62 | 957>11B63 | 969>33 | 972>905 306 | 973>905 93A | 974>905 93E 93A | 975>905 94F | 9E6>6F
9F0>9B0 | A15>935 | A1C>924 94D 924 | A1F>91F | A20>920 | A24>909 | A27>92A | A2B>922 | A2E>92D | A35>939 | A38>92E | A3F>9BF | A41>11B62 | A42>11B63
A47>11B64 | A48>948 | A72>92A 94D 91F | AAA>447 | AB0>968 | AEB>447 | B66>6F | BB8>BB6 | C16>C96 323 | C90>C10 | C97>C17 | C9D>C1D | C9F>C1F | CA6>C26
CA8>C28 | CB0>C30 | CB3>C33 | CBF>C3F | CC1>C41 | CC3>C43 | CDC>C5C | CE6>4F | D10>BC6 D0E | D16>BB5 | D1F>73 | D25>BAE | D46>BC6 | D47>BC7
D7A>BA3 D4D | D7D>D32 D4D | D7E>D33 D4D | D8D>DC3 DD8 | D92>D91 DCA | D93>D91 DD9 | DB5>D91 | DB6>D9B | DB9>D94 | DC0>DA0 | DC4>DB7 | F7B>F7A F7A
F7D>F7C F7C | 1002>D30 | 1004>63 | 1023>D30 102C 1039 D30 102C | 1031>B47 | 105A>63 | 1061>101B 103E | 10D7>6F 102C | 10D8>D30 | 178F>178A | 17E0>6F
1AD9>1AC6 | 1AE2>304 | 1AE7>1AE5 | 1AE8>304 304 | 1DE8>1ADA | 20C1>631 649 6C 644 | 21C4>1F8D0 | 21CC>1F8D1 | 256A>1C2 | 2657>1FA55 | 265D>1FA57
28FF>1CEE0 | 29B5>1CEF0 | 2B96>3D 1AB2 | 2C82>42 | 2C83>299 | 2C8B>3C2 | 2C8C>2C6B | 2C8D>2C6C | 2C8F>29C | 2C90>4F 335 | 2C91>6F 335 | 2C93>69
2C97>28C | 2C99>28D | 2C9B>274 | 2C9C>33 | 2C9D>293 | 2CA1>3C0 | 2CA7>1D1B | 2CA9>79 | 2CAF>3C8 | 2CB0>A64C | 2CB2>2D 307 | 2CB3>2D 307 | 2CB5>3C B7
2CB6>39E | 2CB7>2261 | 2CBB>2D | 2CC0>554 | 2CC1>3FC | 2CC4>33 | 2CC5>21D | 2CC7>2F | 2CCB>39 | 2CCE>50 | 2CCF>70 | 2CD3>36 | 2CDD>1E9F | 2CE0>278
2CE1>278 | 2CE8>554 | 2DEE>1ADB | 3164>1160 | 4695>278AE | 4E15>110C 1169 | 4E1B>1109 1109 30FC | 4E8E>1B122 | 4ECA>1109 30FC 1100 | 5152>16FF3
535F>1106 1161 | 5408>1109 30FC 1106 | 6138>2B73F | 723F>1102 116E 4E28 | 9577>1110 30FC 1102 110C | A7CF>A7CE | A7D2>A7D3 | A7D4>A7D5 | A7F1>18F5
10EC6>646 | 10EC7>680 | 10ED0>B0 332 | 114D0>6F | 11B60>93A | 11B66>306 | 11DD9>3A | 11DDA>6C | 11DE0>4F | 11DE1>6C | 16EA6>3A0 | 16EAA>6C | 16EB6>62
16EC1>3C0 | 16ED1>185 | 16FF2>513F | 1CCFB>1F6F8 | 1CEEF>2D42 | 1E6E9>2B | 1E6EE>1AC8 | 1F333>1CEBC | 1F34E>1CEBD | 1F34F>1CEBD | 1F352>1CEBE
1F353>1CEBF | 1F377>1CEBA | 1F3E2>1CEBB | 1F40D>1CCFA | 1F443>1CCFC | 1F514>1FBFA | 20674>51F5 | 21533>58F7 | 21587>591A | 216A7>216A8 | 22505>5F9A
23D40>6D85 | 248FD>73A5 | 2511A>25119 | 25AD4>8D1B | 2659D>265A8 | 26D06>26C36 | 2AEC5>24814 | 2B73A>5CC0 | 2B73E>2335F | 2D161>5351 | 31E7C>7DC7
"""


def ranges(text: str) -> list[int]:
    """Code points of "A-B C" in hexadecimal."""
    return [c for part in text.split() for a, _, b in [part.partition("-")] for c in range(int(a, 16), int(b or a, 16) + 1)]


#: Beyond these, characters have none of the properties below.
SCALARS = [c for c in range(0x32000) if not 0xD800 <= c < 0xE000 and not 0x2FA20 <= c < 0x30000]


@functools.cache
def folds() -> dict[int, int]:
    """Simple case folding. The full fold where it is one character, else the lower case where that is one."""
    out = {}
    for c in SCALARS:
        x = chr(c)
        folded = x.casefold()
        if len(folded) > 1:
            folded = x.lower() if len(x.lower()) == 1 else x
        if folded != x:
            out[c] = ord(folded)
    for part in NEW_FOLDS.split():
        source, _, to = part.partition(">")
        out |= {c: int(to, 16) + k for k, c in enumerate(ranges(source))}
    return out


@functools.cache
def classes() -> dict[int, int]:
    """Non-zero canonical combining classes."""
    out = {c: k for c in SCALARS if (k := unicodedata.combining(chr(c)))}
    for part in NEW_CLASSES.split():
        source, _, k = part.partition(":")
        out |= dict.fromkeys(ranges(source), int(k))
    return out


@dataclass(frozen=True)
class Tables:
    """Decompositions (full, by code point), compositions (pairs), confusable prototypes, combining classes and folds."""

    canonical: dict[int, str]
    compat: dict[int, str]
    pairs: dict[tuple[str, str], str]
    prototypes: dict[int, str]
    combining: dict[int, int]
    folds: dict[int, int]
    #: A pattern of the characters whose forms Python's own tables get wrong.
    newer: re.Pattern


_found: list[Tables] = []


def tables(spark: SparkSession) -> Tables:
    """Built once per process, from ICU in the driver's JVM; a few megabytes, the same for any data."""
    if not _found:
        _found.append(_build(spark))
    return _found[0]


def _build(spark: SparkSession) -> Tables:
    icu = spark.sparkContext._jvm.com.ibm.icu.text
    mark = "\n"  # stands between characters: it is its own form and prototype
    hangul = range(0xAC00, 0xD7A4)
    asked = [c for c in SCALARS if c != 10 and c not in hangul]

    def each(function, items: list[str]) -> list[str]:
        out = []
        for k in range(0, len(items), 200_000):
            out += function(mark.join(items[k : k + 200_000])).split(mark)
        return out

    characters = list(map(chr, asked))
    nfd = each(lambda s: icu.Normalizer.decompose(s, False), characters)
    nfkd = each(lambda s: icu.Normalizer.decompose(s, True), characters)
    canonical = {c: d for c, x, d in zip(asked, characters, nfd, strict=True) if d != x}
    compat = {c: d for c, x, d in zip(asked, characters, nfkd, strict=True) if d != x} | NEW_COMPAT
    changed = list(canonical)
    whole = each(lambda s: icu.Normalizer.compose(s, False), list(canonical.values()))
    heads = each(lambda s: icu.Normalizer.compose(s, False), [canonical[c][:-1] or "-" for c in changed])
    pairs = {(h, canonical[c][-1]): chr(c) for c, w, h in zip(changed, whole, heads, strict=True) if w == chr(c) and len(h) == 1 and len(canonical[c]) > 1}
    checker = icu.SpoofChecker.Builder().build()
    seen = each(checker.getSkeleton, characters)
    # What ICU leaves out altogether (ignorable characters) keeps its place here.
    prototypes = {c: s for c, x, d, s in zip(asked, characters, nfd, seen, strict=True) if s != d and d == x and s}
    for part in NEW_CONFUSABLES.replace("\n", " | ").split(" | "):
        if part.strip():
            c, _, to = part.partition(">")
            prototypes[int(c, 16)] = "".join(chr(int(x, 16)) for x in to.split())
    own = unicodedata.normalize
    newer = {c for c in asked if classes().get(c, 0) != unicodedata.combining(chr(c)) or own("NFD", chr(c)) != canonical.get(c, chr(c)) or own("NFKD", chr(c)) != compat.get(c, chr(c))}
    newer |= {ord(b) for (a, b), c in pairs.items() if own("NFC", a + b) != c}
    return Tables(canonical, compat, pairs, prototypes, classes(), folds(), re.compile(f"[{''.join(map(chr, sorted(newer)))}]"))


def frames(spark: SparkSession) -> dict[str, DataFrame]:
    """The property data as DataFrames keyed by code point.

    ``confusable`` has the prototypes of characters in decomposed text, and the skeletons of those that
    decompose to one other character. Others that decompose have none of their own: their parts have.
    """
    from .reference import skeleton

    t = tables(spark)
    single = {c: skeleton(d, t) for c, d in t.canonical.items() if len(d) == 1}
    points = lambda d: [(c, list(map(ord, s))) for c, s in sorted(d.items())]
    return {
        "decomp_canonical": spark.createDataFrame(points(t.canonical), "cp int, mapping array<int>"),
        "decomp_compat": spark.createDataFrame(points(t.compat), "cp int, mapping array<int>"),
        "ccc": spark.createDataFrame(sorted(classes().items()), "cp int, ccc int"),
        "composition": spark.createDataFrame(sorted((ord(a), ord(b), ord(c)) for (a, b), c in t.pairs.items()), "first int, second int, composed int"),
        "casefold_simple": spark.createDataFrame(sorted(folds().items()), "cp int, folded int"),
        "casefold_turkish": spark.createDataFrame(sorted(TURKISH_FOLDS.items()), "cp int, folded int"),
        "confusable": spark.createDataFrame(points(single | t.prototypes), "cp int, mapping array<int>"),
    }


#: Text that every form leaves as it is.
ASCII = r"^[\x00-\x7F]*$"
