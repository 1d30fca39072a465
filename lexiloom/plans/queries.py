"""Queries over whole tables, and the same in SQL.

The tables hold ASCII and 21 accented letters, all composed. Inputs that are
interesting are derived in both: letters decomposed, ASCII made full-width, Latin letters
replaced by Cyrillic ones that look alike.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import functions as X
from .. import operators as ops

#: The accented letters of the test tables.
LETTERS = "èéêçÉÈÊöäüÄÖóíñÇÓÑÍÜ"
#: Latin letters and Cyrillic ones that look alike.
LATIN, CYRILLIC = "aeopcxyABEKMHOPCTX", "аеорсхуАВЕКМНОРСТХ"
WIDE = {chr(c): chr(c + 0xFEE0) for c in range(0x21, 0x7F)}


#: Rows whose incoming names are changed.
SOME_PARTS, SOME_CUSTOMERS = "p_brand < 'Brand#3'", "c_mktsegment = 'BUILDING'"


def _replace_sql(x: str, pairs) -> str:
    for a, b in pairs:
        x = f"replace({x}, {_q(a)}, {_q(b)})"
    return x


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


SPLIT = [(c, unicodedata.normalize("NFD", c)) for c in LETTERS]
#: The cedilla looks like a comma below.
LOOKS = [("̧", "̦"), ("0", "O"), ("1", "l"), ("I", "l"), ("|", "l"), ("`", "'"), ("m", "rn"), ('"', "''"), ("%", "º/₀")]
KEYS = [("̧", "̦"), ("0", "o"), ("1", "l"), ("|", "l"), ("`", "'"), ("m", "rn"), ('"', "''"), ("%", "o/o")]
SQL_NFD = _replace_sql("text", SPLIT)
SQL_SKELETON = _replace_sql(SQL_NFD, LOOKS)
SQL_KEY = _replace_sql(_replace_sql("lower(text)", SPLIT), KEYS)


def _decomposed(c: str = "text") -> Column:
    out = F.col(c)
    for a, b in SPLIT:
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet")


def _table(name: str):
    return lambda spark, d: spark.read.parquet(f"{d}/{name}.parquet")


def _md5(name: str, c: Column) -> Column:
    return F.md5(c).alias(name)


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """How many documents of each language and source NFD would change, with subtotals."""
    return ops.normalization_audit(_docs(spark, d), "text", "NFD", ["lang", "source"], rollup=True)


def _changed(c: str, where: str) -> Column:
    """Names, some of them changed so that they look like no other, in Cyrillic letters that look alike."""
    return F.translate(F.when(F.expr(where), F.concat(c, F.lit(" new"))).otherwise(F.col(c)), LATIN, CYRILLIC)


def _spoofs_whole(spark: SparkSession, d: str) -> DataFrame:
    """``spoof_join`` against all names of the part table."""
    part = _table("part")(spark, d)
    return ops.spoof_join(part.select("p_partkey", _changed("p_name", SOME_PARTS).alias("incoming")), part, "incoming", "p_name").select("p_partkey", "hit", "verdict")


def _semi_whole(anti: bool):
    """``taken`` and ``registrable`` against all names of the customer table."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        names = _table("customer")(spark, d)
        return (ops.registrable if anti else ops.taken)(names.select("c_custkey", _changed("c_name", SOME_CUSTOMERS).alias("wanted")), names, "wanted", "c_name").select("c_custkey")

    return run


def _match_whole(spark: SparkSession, d: str) -> DataFrame:
    """``match_join`` of all customers."""
    names = _table("customer")(spark, d)
    other = names.select(F.col("c_custkey").alias("other"), F.translate(F.lower("c_name"), LATIN, CYRILLIC).alias("b"))
    return ops.match_join(names.select("c_custkey", F.upper("c_name").alias("a")), other, "a", "b").select("c_custkey", "other")


def _code_point(c: Column) -> Column:
    """The character of a code point below U+10000."""
    return F.decode(F.unhex(F.lpad(F.hex(c.cast("long")), 4, "0")), "UTF-16BE")


def _hangul(spark: SparkSession, d: str) -> DataFrame:
    """A syllable for each order, taken apart, composed again and quick-checked."""
    rows = _table("orders")(spark, d).select("o_orderkey", _code_point(0xAC00 + F.col("o_orderkey") % 11172).alias("s"))
    apart = rows.withColumn("nfd", X.nfd("s"))
    return apart.select("o_orderkey", "nfd", X.nfc("nfd").alias("nfc"), X.nfkd("s").alias("nfkd"), X.nfkc("nfd").alias("nfkc"), X.is_nfd("s").alias("was_nfd"), X.quick_check("nfd", "NFC").alias("checked"))


#: Marks of classes 230, 220 and 202, in the wrong order; and in the right one.
MIXED, SORTED = "\u0301\u0323\u0327", "\u0327\u0323\u0301"
#: A pair of starters and what it composes to; a character that no form composes, taken apart and as one.
PAIR, PAIRED, APART, EXCLUDED = "\u09c7\u09be", "\u09cb", "\u0915\u093c", "\u0958"


def _marks(spark: SparkSession, d: str) -> DataFrame:
    """Several marks after a name, in the order of their classes; a mark without a base; starters that compose and that never do."""
    names = _table("part")(spark, d)
    several = F.concat("p_name", F.lit(" x" + MIXED))
    others = F.concat(F.lit("\u0301"), "p_name", F.lit(PAIR + EXCLUDED))
    return names.select("p_partkey", X.nfd(several).alias("sorted"), X.is_nfd(several).alias("was"), X.quick_check(several, "NFD").alias("checked"), X.nfc(others).alias("composed"), X.nfd(F.concat("p_name", F.lit(PAIRED + EXCLUDED))).alias("apart"))


def _wide(c: str = "text") -> Column:
    return F.translate(c, "".join(WIDE), "".join(WIDE.values()))


def _normalize_to_all(spark: SparkSession, d: str) -> DataFrame:
    """``normalize_to`` of the other three forms, after a prefix."""
    done = {"nfc": X.normalize_to(_decomposed(), "NFC", F.lit("> ")), "nfkc": X.normalize_to(_wide(), "NFKC", F.lit("> ")), "nfkd": X.normalize_to(_wide(), "NFKD", F.lit("> "))}
    rows = _docs(spark, d).select("doc_id", *(c.alias(k) for k, c in done.items()))
    return rows.select("doc_id", *(_md5(k, F.col(f"{k}.text")) for k in done), *(F.col(f"{k}.was_normalized").alias(f"was_{k}") for k in done))


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    """``are_confusable`` and ``matches`` of each name and what was made of it."""
    other = _changed("c_name", SOME_CUSTOMERS)
    return _table("customer")(spark, d).select("c_custkey", X.are_confusable("c_name", other).alias("alike"), X.matches(F.upper("c_name"), other).alias("same"), X.matches("c_name", F.upper("c_name"), "turkish").alias("turkish"))


def _sql(spark: SparkSession, d: str) -> DataFrame:
    """The functions by their SQL names."""
    X.register(spark, "lx_")
    _docs(spark, d).createOrReplaceTempView("lx_documents")
    return spark.sql("""
SELECT doc_id, md5(lx_nfd(text)) AS nfd, md5(lx_normalize(text, 'nfkc')) AS nfkc, lx_is_normalized(text, 'NFD') AS was, lx_quick_check(text, 'NFC') AS checked, md5(lx_normalize_to(text, 'NFKD', '> ').text) AS after,
  md5(lx_casefold(text)) AS folded, md5(lx_casefold(concat('I', text), 'turkish')) AS turkish, md5(lx_skeleton(text)) AS skeleton, md5(lx_match_key(text)) AS match_key, size(lx_match_key_utf16(text)) AS n_units
FROM lx_documents""")


def _utf16(spark: SparkSession, d: str) -> DataFrame:
    units = _docs(spark, d).select("doc_id", X.match_key_utf16("text").alias("u"))
    return units.select("doc_id", F.size("u").cast("long").alias("n_units"), F.md5(X.utf16_to_text("u")).alias("key_md5"))


def _turkish(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", _md5("folded", X.casefold(F.concat(F.lit("I"), "text"), "turkish")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "audit_nfd_rollup": flagship,
    "nfd": lambda s, d: _docs(s, d).select("doc_id", _md5("out", X.nfd("text")), X.is_nfd("text").alias("was")),
    "nfkd": lambda s, d: _docs(s, d).select("doc_id", _md5("out", X.nfkd("text")), X.is_nfkd("text").alias("was")),
    "nfc": lambda s, d: _docs(s, d).select("doc_id", _md5("out", X.nfc(_decomposed())), X.is_nfc(_decomposed()).alias("was")),
    "nfkc_wide": lambda s, d: _docs(s, d).select("doc_id", _md5("out", X.nfkc(F.translate("text", "".join(WIDE), "".join(WIDE.values()))))),
    "normalize_to": lambda s, d: _docs(s, d).select("doc_id", X.normalize_to("text", "NFD", F.lit("> ")).alias("r")).select("doc_id", _md5("out", F.col("r.text")), F.col("r.was_normalized").alias("was")),
    "quick_check": lambda s, d: ops.quick_check_report(_docs(s, d), "text"),
    "compare_forms": lambda s, d: ops.compare_forms(_docs(s, d), "text").select("doc_id", *(_md5(f, F.col(f)) for f in ("nfc", "nfd", "nfkc", "nfkd"))),
    "casefold": lambda s, d: _docs(s, d).select("doc_id", _md5("folded", X.casefold("text"))),
    "casefold_turkish": _turkish,
    "casefold_equal": lambda s, d: _table("customer")(s, d).where(X.casefold("c_mktsegment") == X.casefold(F.lit("building"))).groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n")),
    "skeleton": lambda s, d: _docs(s, d).select("doc_id", _md5("out", X.skeleton("text"))),
    "match_key": lambda s, d: _docs(s, d).select("doc_id", _md5("out", X.match_key("text"))),
    "match_key_utf16": _utf16,
    "collision_groups": lambda s, d: ops.collision_groups(_docs(s, d), "text", "doc_id").select("n", "first_id", "n_texts"),
    "dedup_by_key": lambda s, d: ops.dedup_by_key(_docs(s, d), "text", "doc_id").select("doc_id", "lang", "source"),
    "spoof_join_whole": _spoofs_whole,
    "taken_whole": _semi_whole(False),
    "registrable_whole": _semi_whole(True),
    "match_join_whole": _match_whole,
    "hangul": _hangul,
    "mark_order": _marks,
    "normalize_to_all": _normalize_to_all,
    "quick_check_maybe": lambda s, d: ops.quick_check_report(_docs(s, d).select(_decomposed().alias("text")), "text"),
    "pairs": _pairs,
    "match_key_turkish": lambda s, d: _docs(s, d).select("doc_id", _md5("out", X.match_key(F.concat(F.lit("I"), "text"), "turkish"))),
    "sql_functions": _sql,
    "search": lambda s, d: ops.search(ops.with_match_key(_table("part")(s, d), "p_brand"), "BRAND#12").select("p_partkey"),
    "changed_lines": lambda s, d: ops.changed_lines(_table("conversations")(s, d), "text", "NFD").groupBy("role").agg(F.count_if("was_normalized").alias("already"), F.sum(F.length("normalized")).alias("n_chars")),
}

_LOOKS_WANTED = "EXISTS (SELECT 1 FROM customer n WHERE {0} = {1})".format(_replace_sql("n.c_name", LOOKS), _replace_sql(f"(CASE WHEN c.{SOME_CUSTOMERS} THEN c.c_name || ' new' ELSE c.c_name END)", LOOKS))
_HAS = f"regexp_matches(text, '[{LETTERS}]')"
ORACLES: dict[str, str] = {
    "audit_nfd_rollup": f"SELECT lang, source, count(*) AS processed, count(*) FILTER (NOT {_HAS}) AS already, count(*) FILTER ({_HAS}) AS changed FROM documents GROUP BY ROLLUP (lang, source)",
    "nfd": f"SELECT doc_id, md5({SQL_NFD}) AS out, NOT {_HAS} AS was FROM documents",
    "nfkd": f"SELECT doc_id, md5({SQL_NFD}) AS out, NOT {_HAS} AS was FROM documents",
    "nfc": f"SELECT doc_id, md5(text) AS out, NOT {_HAS} AS was FROM documents",
    "nfkc_wide": "SELECT doc_id, md5(text) AS out FROM documents",
    "normalize_to": f"SELECT doc_id, md5('> ' || {SQL_NFD}) AS out, NOT {_HAS} AS was FROM documents",
    "quick_check": f"""
SELECT form, CASE WHEN form LIKE '%D' AND h THEN 'NO' ELSE 'YES' END AS verdict, NOT (form LIKE '%D' AND h) AS is_normalized, count(*) AS n
FROM (SELECT {_HAS} AS h FROM documents), (VALUES ('NFC'), ('NFD'), ('NFKC'), ('NFKD')) f(form) GROUP BY ALL""",
    "compare_forms": f"SELECT doc_id, md5(text) AS nfc, md5({SQL_NFD}) AS nfd, md5(text) AS nfkc, md5({SQL_NFD}) AS nfkd FROM documents",
    "casefold": "SELECT doc_id, md5(lower(text)) AS folded FROM documents",
    "casefold_turkish": "SELECT doc_id, md5(lower(replace('I' || text, 'I', 'ı'))) AS folded FROM documents",
    "casefold_equal": "SELECT c_nationkey, count(*) AS n FROM customer WHERE lower(c_mktsegment) = 'building' GROUP BY c_nationkey",
    "skeleton": f"SELECT doc_id, md5({SQL_SKELETON}) AS out FROM documents",
    "match_key": f"SELECT doc_id, md5({SQL_KEY}) AS out FROM documents",
    "match_key_utf16": f"SELECT doc_id, length({SQL_KEY}) AS n_units, md5({SQL_KEY}) AS key_md5 FROM documents",
    "collision_groups": f"SELECT count(*) AS n, min(doc_id) AS first_id, count(DISTINCT text) AS n_texts FROM documents GROUP BY {SQL_KEY} HAVING count(*) > 1",
    "dedup_by_key": f"SELECT arg_min(doc_id, doc_id) AS doc_id, arg_min(lang, doc_id) AS lang, arg_min(source, doc_id) AS source FROM documents GROUP BY {SQL_KEY}",
    "spoof_join_whole": f"""
WITH p AS (SELECT p_partkey, CASE WHEN {SOME_PARTS} THEN p_name || ' new' ELSE p_name END AS latin FROM part),
  i AS (SELECT p_partkey, {_replace_sql("latin", LOOKS)} AS k, translate(latin, '{LATIN}', '{CYRILLIC}') AS incoming FROM p),
  t AS (SELECT {_replace_sql("p_name", LOOKS)} AS k, min(p_name) AS looks FROM part GROUP BY 1),
  h AS (SELECT p_partkey, incoming, CASE WHEN incoming IN (SELECT p_name FROM part) THEN incoming ELSE looks END AS hit FROM i LEFT JOIN t USING (k))
SELECT p_partkey, hit, CASE WHEN hit IS NULL THEN 'safe' WHEN hit = incoming THEN 'exact' ELSE 'spoof' END AS verdict FROM h""",
    "taken_whole": f"SELECT c_custkey FROM customer c WHERE {_LOOKS_WANTED}",
    "registrable_whole": f"SELECT c_custkey FROM customer c WHERE NOT {_LOOKS_WANTED}",
    "match_join_whole": "SELECT a.c_custkey, b.c_custkey AS other FROM customer a JOIN customer b ON lower(a.c_name) = lower(b.c_name)",
    "hangul": """
WITH s AS (SELECT o_orderkey, CAST(o_orderkey % 11172 AS INT) AS k FROM orders),
  j AS (SELECT o_orderkey, chr(44032 + k) AS s, chr(4352 + k // 588) || chr(4449 + k % 588 // 28) || CASE WHEN k % 28 > 0 THEN chr(4519 + k % 28) ELSE '' END AS j FROM s)
SELECT o_orderkey, j AS nfd, s AS nfc, j AS nfkd, s AS nfkc, false AS was_nfd, 'MAYBE' AS checked FROM j""",
    "mark_order": f"""
SELECT p_partkey, p_name || ' x{SORTED}' AS sorted, false AS was, 'NO' AS checked, '\u0301' || p_name || '{PAIRED}{APART}' AS composed, p_name || '{PAIR}{APART}' AS apart FROM part""",
    "normalize_to_all": f"""
SELECT doc_id, md5('> ' || text) AS nfc, md5('> ' || text) AS nfkc, md5('> ' || {SQL_NFD}) AS nfkd, NOT {_HAS} AS was_nfc, NOT regexp_matches(text, '[!-~]') AS was_nfkc, NOT regexp_matches(text, '[!-~{LETTERS}]') AS was_nfkd FROM documents""",
    "quick_check_maybe": f"""
SELECT form, CASE WHEN form LIKE '%C' AND h THEN 'MAYBE' ELSE 'YES' END AS verdict, NOT (form LIKE '%C' AND h) AS is_normalized, count(*) AS n
FROM (SELECT {_HAS} AS h FROM documents), (VALUES ('NFC'), ('NFD'), ('NFKC'), ('NFKD')) f(form) GROUP BY ALL""",
    "pairs": f"SELECT c_custkey, NOT ({SOME_CUSTOMERS}) AS alike, NOT ({SOME_CUSTOMERS}) AS same, true AS turkish FROM customer",
    "match_key_turkish": f"SELECT doc_id, md5({_replace_sql(_replace_sql("lower('I' || text)", SPLIT), KEYS)}) AS out FROM documents",
    "sql_functions": f"""
SELECT doc_id, md5({SQL_NFD}) AS nfd, md5(text) AS nfkc, NOT {_HAS} AS was, 'YES' AS checked, md5('> ' || {SQL_NFD}) AS after, md5(lower(text)) AS folded, md5(lower(replace('I' || text, 'I', 'ı'))) AS turkish,
  md5({SQL_SKELETON}) AS skeleton, md5({SQL_KEY}) AS match_key, CAST(length({SQL_KEY}) AS INT) AS n_units FROM documents""",
    "search": "SELECT p_partkey FROM part WHERE lower(p_brand) = 'brand#12'",
    "changed_lines": f"SELECT role, count(*) FILTER (NOT {_HAS}) AS already, CAST(sum(length({SQL_NFD})) AS BIGINT) AS n_chars FROM conversations GROUP BY role",
}
