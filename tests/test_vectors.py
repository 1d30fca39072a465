"""Known values, and twins that share no code or table with the library: Python's own Unicode tables and ICU's spoof checker."""

import unicodedata

import pytest
from test_text import strings

from lexiloom import functions as X
from lexiloom import operators as ops
from lexiloom.functions import tables as T

#: input, NFC, NFD, NFKC, NFKD, in hexadecimal.
FORMS = """
212B|C5|41 30A|C5|41 30A
1E9B 323|1E9B 323|17F 323 307|1E69|73 323 307
FB01|FB01|FB01|66 69|66 69
344|308 301|308 301|308 301|308 301
958|915 93C|915 93C|915 93C|915 93C
9C7 9BE|9CB|9C7 9BE|9CB|9C7 9BE
AC01|AC01|1100 1161 11A8|AC01|1100 1161 11A8
1100 1161 11A8|AC01|1100 1161 11A8|AC01|1100 1161 11A8
AC00 11A7|AC00 11A7|1100 1161 11A7|AC00 11A7|1100 1161 11A7
301 61|301 61|301 61|301 61|301 61
61 301 323|1EA1 301|61 323 301|1EA1 301|61 323 301
61 315 300 5AE 62|E0 5AE 315 62|61 5AE 300 315 62|E0 5AE 315 62|61 5AE 300 315 62
1D15E|1D157 1D165|1D157 1D165|1D157 1D165|1D157 1D165
F71 F72|F71 F72|F71 F72|F71 F72|F71 F72
F73|F71 F72|F71 F72|F71 F72|F71 F72
FF21 3000 2460|FF21 3000 2460|FF21 3000 2460|41 20 31|41 20 31
1F82|1F82|3B1 313 300 345|1F82|3B1 313 300 345
5E9 5BC 5C1|5E9 5BC 5C1|5E9 5BC 5C1|5E9 5BC 5C1|5E9 5BC 5C1
FB2C|5E9 5BC 5C1|5E9 5BC 5C1|5E9 5BC 5C1|5E9 5BC 5C1
64B 651 650|64B 650 651|64B 650 651|64B 650 651|64B 650 651
1EC7|1EC7|65 323 302|1EC7|65 323 302
F900|8C48|8C48|8C48|8C48
"""
NAMES = ("NFC", "NFD", "NFKC", "NFKD")


def text(points):
    return "".join(chr(int(x, 16)) for x in points.split())


def test_forms(spark):
    rows = [[text(x) for x in line.split("|")] for line in FORMS.strip().split("\n")]
    got = spark.createDataFrame(rows, "source string, " + ", ".join(f"w{f} string" for f in NAMES)).select("*", *(X.normalize("source", f).alias(f) for f in NAMES)).collect()
    for r in got:
        assert [r[f] for f in NAMES] == [r[f"w{f}"] for f in NAMES], r


@pytest.mark.parametrize("n", [50, 60, 100])
def test_long_runs_of_marks(spark, n):
    marks = ["́", "̣", "̧", "ְ", "ً"]
    source = "a" + "".join(marks[k % 5] for k in range(n))
    want = "a" + "".join(sorted(source[1:], key=unicodedata.combining))
    r = spark.createDataFrame([(source,)], "x string").select(X.nfd("x").alias("d"), X.quick_check("x", "NFD").alias("q"), X.is_nfc(X.nfc("x")).alias("c")).first()
    assert r.d == want and r.q == "NO" and r.c


QUICK = [("NFC", "́", "MAYBE"), ("NFC", "é", "MAYBE"), ("NFC", "\xe9", "YES"), ("NFC", "̈́", "NO"), ("NFC", "̣́", "NO"), ("NFC", "ᅡ", "MAYBE"), ("NFKC", "ﬁ", "NO"), ("NFKC", "à", "MAYBE"), ("NFKC", "각", "YES"), ("NFD", "각", "NO"), ("NFD", "é", "YES"), ("NFKD", "①", "NO"), ("NFC", "", "YES"), ("NFC", "क़", "NO"), ("NFC", "া", "MAYBE")]


def test_quick_checks(spark):
    df = spark.createDataFrame(QUICK, "form string, x string, want string")
    for f in NAMES:
        assert all(r.q == r.want for r in df.where(f"form = '{f}'").select("*", X.quick_check("x", f).alias("q")).collect())


def known(x):
    """Whether Python's older tables know all characters."""
    return all(unicodedata.category(c) != "Cn" or ord(c) & 0xFFFE == 0xFFFE for c in x)


def twin_of_quick_check():
    """Verdicts of single characters from Python's decompositions alone."""
    seconds = {0x1161 + k for k in range(21)} | {0x11A8 + k for k in range(27)}
    for c in range(0x110000):
        parts = unicodedata.decomposition(chr(c)).split()
        if len(parts) == 2 and not parts[0].startswith("<") and unicodedata.normalize("NFC", unicodedata.normalize("NFD", chr(c))) == chr(c):
            seconds.add(int(parts[1], 16))

    def check(x, form):
        verdict, last = "YES", 0
        for ch in x:
            k = unicodedata.combining(ch)
            if k and k < last or unicodedata.normalize(form, ch) != ch:
                return "NO"
            if form in ("NFC", "NFKC") and ord(ch) in seconds:
                verdict = "MAYBE"
            last = k
        return verdict

    return check


def test_quick_check_against_its_twin(spark):
    check = twin_of_quick_check()
    texts = [x for x in strings(1500, 3) if known(x)]
    rows = spark.createDataFrame([(x,) for x in texts], "x string").select("x", *(X.quick_check("x", f).alias(f) for f in NAMES)).collect()
    assert len(rows) > 300
    for r in rows:
        assert {f: r[f] for f in NAMES} == {f: check(r.x, f) for f in NAMES}, ascii(r.x)


def test_skeletons_and_keys_against_their_twins(spark):
    """ICU's spoof checker on whole texts, and keys from Python's NFKC and folds around it."""
    checker = spark.sparkContext._jvm.com.ibm.icu.text.SpoofChecker.Builder().build()
    new = {int(p.partition(">")[0], 16) for p in T.NEW_CONFUSABLES.replace("\n", " | ").split(" | ") if p.strip()}

    def skeleton(x):
        for _ in range(8):
            x, before = checker.getSkeleton(x), x
            if x == before:
                break
        return x

    def usual(x):  # characters that both know alike, and that ICU does not leave out
        return known(x) and not any(ord(c) in new or unicodedata.category(c) == "Cf" or c in "͏ᅟᅠ឴឵ㅤﾠ" for c in unicodedata.normalize("NFKD", x) + x + x.lower())

    def key(x):
        fold = lambda s: "".join(c.casefold() if len(c.casefold()) == 1 else c.lower() if len(c.lower()) == 1 else c for c in s)
        for k in range(4):
            new_ = fold(skeleton(fold(unicodedata.normalize("NFKC", x))))
            if k and new_ == x:
                break
            x = new_
        return x

    texts = [x for x in strings(700, 5) if usual(x)] + ["paypal", "раураl", "Ünïcödé Straße", "日本語 text", "ΑΒΓ αβγ", "𝒜𝒷𝒸", "ﬁle"]
    rows = spark.createDataFrame([(x,) for x in texts], "x string").select("x", X.skeleton("x").alias("s"), X.match_key("x").alias("k")).collect()
    assert len(rows) > 100
    for r in rows:
        if not usual(skeleton(r.x)):  # what ICU 16 maps to has another prototype since
            continue
        assert r.s == skeleton(r.x), ascii(r.x)
        if all(usual(unicodedata.normalize("NFKC", y)) for y in (r.x, r.s, key(r.x))):
            assert r.k == key(r.x), ascii(r.x)


def test_utf16_units(spark):
    rows = [("", []), ("A", [0x61]), ("\U00010400", [0xD801, 0xDC28]), ("é", [0x65, 0x301]), ("m", [0x72, 0x6E]), ("￿", [0xFFFF])]
    for r in spark.createDataFrame(rows, "x string, want array<int>").select("*", X.match_key_utf16("x").alias("u")).collect():
        assert r.u == r.want


def test_accented_latin_goes_by_tables(spark):
    """Texts of the tables' alphabet reach no Python function: the rows that go there are nulls."""
    from lexiloom.functions.confusables import key_plan, skeleton_plan
    from lexiloom.functions.text import _far

    t = T.tables(spark)
    df = spark.createDataFrame([("Façade, Écoß 100 % ÜÑí œ",), ("ñÇÓ äöü 日本 привет ΑΒΓ",)], "x string")
    for plan in (skeleton_plan(t), key_plan(t, "standard"), key_plan(t, "turkish")):
        assert [r[0] for r in df.where("x like 'F%' or x like 'ñ%'").select(_far(df.x, plan)).collect()][1:] == [False]


def test_sql_plans_are_native(spark):
    X.register(spark, "lv_")
    df = spark.sql("select lv_nfc(t), lv_nfkd(t), lv_normalize_to(t, 'NFKC', '> '), lv_is_nfd(t), lv_casefold(t, 'turkish') from values ('é') as v(t)")
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()
    assert spark.sql("select lv_nfc(cast(null as string)), lv_match_key(null), lv_quick_check(null, 'NFC'), lv_skeleton('')").first() == (None, None, None, "")
    with pytest.raises(Exception, match="one of NFC"):
        spark.sql("select lv_normalize(t, 'nfx') from values ('é') as v(t)").collect()


def test_sql_agrees_with_columns(spark):
    X.register(spark, "lv_")
    df = spark.createDataFrame([(x,) for x in strings(400, 11)] + [(None,)], "t string")
    df.createOrReplaceTempView("lv_rows")
    columns = [*(X.normalize("t", f) for f in NAMES), *(X.quick_check("t", f) for f in NAMES), X.skeleton("t"), X.match_key("t"), X.match_key("t", "turkish"), X.casefold("t", "turkish"), X.match_key_utf16("t"), X.normalize_to("t", "NFKD").getField("was_normalized")]
    sql = [*(f"lv_{f.lower()}(t)" for f in NAMES), *(f"lv_quick_check(t, '{f}')" for f in NAMES), "lv_skeleton(t)", "lv_match_key(t)", "lv_match_key(t, 'turkish')", "lv_fold_case(t, 'turkish')", "lv_match_key_utf16(t)", "lv_normalize_to(t, 'NFKD').was_normalized"]
    assert sorted(map(str, map(tuple, df.select("t", *columns).collect()))) == sorted(map(str, map(tuple, spark.sql(f"select t, {', '.join(sql)} from lv_rows").collect())))


def test_working_names_clash_with_nothing(spark):
    rows = [(1, "раураl", 7, 7, 7), (2, "x", 8, 8, 8), (3, None, 9, 9, 9)]
    df = spark.createDataFrame(rows, "first int, skeleton string, key int, Same int, done int")
    names = spark.createDataFrame([("paypal", 1)], "key string, skeleton int")
    assert {tuple(r)[:5] for r in ops.spoof_join(df, names, "skeleton", "key").collect()} == set(rows)
    assert [tuple(r) for r in ops.taken(df, names, "skeleton", "key").collect()] == rows[:1]
    assert sorted(tuple(r) for r in ops.registrable(df, names, "skeleton", "key").collect()) == rows[1:]
    assert {tuple(r)[:5] for r in ops.changed_lines(df, "skeleton").collect()} == set(rows)
    clash = df.withColumnsRenamed({"key": "left_key", "Same": "wanted", "done": "k"})
    assert ops.match_join(clash, names, "skeleton", "key").count() == 1
    assert ops.search(clash.withColumn("m", X.match_key("skeleton")), "PayPal", "m").count() == 1
    assert sorted(tuple(r) for r in ops.dedup_by_key(clash, "skeleton", "first").collect()) == rows


def test_groups_move_digests(spark):
    df = spark.createDataFrame([(1, "a"), (2, "A")], "id int, t string")
    plan = ops.collision_groups(df, "t", "id").select("n", "first_id", "n_texts")._jdf.queryExecution().executedPlan().toString()
    assert "sha2" in plan and "any_value" not in plan and not any("hashpartitioning(match_key" in x for x in plan.split("\n"))


def test_confusable_frame(spark):
    got = {r.cp: r.mapping for r in T.frames(spark)["confusable"].collect()}
    assert len(got) == 6517 and got[0x212A] == [0x4B] and got[0xF900] == [0x8C48] and got[0x6D] == [0x72, 0x6E]
