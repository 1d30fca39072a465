"""Secret scan with multipart credential linking, DataFrame operations only.

Strong spans (``BASE``) stand alone. Weak parts (secret-like strings, client or
user identifiers, service endpoints) mean little by themselves; an interval join
looks for complementary parts within ``SCOPE`` code points of each other in the
same text and reports weak parts only where they meet:

* a secret-like string needs an access identifier, strong or weak, in its scope;
* a weak identifier needs a secret, strong or weak, in its scope;
* an endpoint needs both.

Texts are read once, by regular expressions in the JVM. What is joined are spans
(three numbers), dealt by row and block of text; the joins are semi joins, so
no pairs are made however dense the credentials of one text are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stage, table, text_of, with_row_key

#: Names of span kinds; a kind's number is its place, which also breaks ties in sorting.
KINDS = ("assign", "access", "hex", "secret", "ident", "endpoint")
ASSIGN, ACCESS, HEX, SECRET, IDENT, ENDPOINT = range(6)
#: Two parts are in one scope when one begins within so many code points of the other.
SCOPE = 200

ASSIGN_PATTERN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_HINT = r"(?i:passw(?:or)?d|secret|token|api_?key)"
ASSIGN_LEAST = 6
#: Whole runs of the class that are long enough; the same spans as leftmost runs with the short ones dropped.
ACCESS_PATTERN = r"AKIA[A-Z0-9]{16,}"
HEX_PATTERN = r"[0-9a-f]{24,}"
#: 32 to 88 characters of base64 with a digit and letters of both cases.
SECRET_PATTERN = r"(?<![A-Za-z0-9+/=_-])(?=[A-Za-z+/]*[0-9])(?=[A-Z0-9+/]*[a-z])(?=[a-z0-9+/]*[A-Z])[A-Za-z0-9+/]{32,88}={0,2}(?![A-Za-z0-9+/=_-])"
IDENT_PATTERN = r"(?:ASIA[A-Z0-9]{16,}|(?i:client_?id|access_?key_?id|user(?:name)?|login)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9@._-]{4,})"
#: A host name has 253 characters at most and starts where its run of host characters does, so a long run is looked at once.
ENDPOINT_PATTERN = r"(?:(?:https?|jdbc:[a-z]++|postgres(?:ql)?|mysql|mongodb|redis|amqp|s3)://[A-Za-z0-9._~:/?#@!$&()*+,;=%-]++|(?<![a-z0-9.-])[a-z0-9-][a-z0-9.-]{0,238}?\.amazonaws\.com(?![a-z0-9-]))"
WEAK_HINT = r"AKIA[A-Z0-9]{16}|ASIA[A-Z0-9]{16}|(?i:client_?id|access_?key_?id|user(?:name)?|login)[\"']?\x20*[:=]"

SPAN = "array<struct<start:int,kind:int,end:int>>"
#: Lengths that are summed up at once. An array grows by copies, so n sums cost n * BLOCK + (n / BLOCK)^2 / 2 of them.
BLOCK = 64


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, which an expression used inside a lambda would not be."""
    return F.transform(F.array(value), use)[0]


def _before(lengths: Column, first: Column) -> Column:
    """For each of an array of integers, ``first`` and the sum of those before it."""
    grown = lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.array_append(acc["out"], acc["at"]).alias("out"))
    return F.aggregate(lengths, F.struct(first.alias("at"), F.array().cast("array<int>").alias("out")), grown, lambda acc: acc["out"])


def before(lengths: Column) -> Column:
    """For each of an array of integers the sum of those before it: sums of blocks first, then within each block."""
    total = lambda own: F.aggregate(own, F.lit(0), lambda n, x: n + x)
    numbers = lambda all_: F.sequence(F.lit(0), F.floor(F.greatest(F.size(all_) - 1, F.lit(0)) / BLOCK).cast("int"))
    cut = _let(lengths, lambda all_: F.transform(numbers(all_), lambda k: F.slice(all_, k * BLOCK + 1, F.lit(BLOCK))))
    return _let(cut, lambda blocks: F.flatten(F.zip_with(blocks, _before(F.transform(blocks, total), F.lit(0)), _before)))


def spans_of(text: Column, pattern: str, kind: int, keep=None) -> Column:
    """Spans of the leftmost matches of ``pattern`` that do not overlap, counted in code points.

    The pieces between matches and the matches themselves give the lengths, one pass
    of Java's matcher each, and sums of lengths the places; ``keep`` filters matches by their text.
    """
    none = F.array().cast(SPAN)
    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.char_length(g))
    hits = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda h: F.struct(F.char_length(h).alias("n"), (keep(h) if keep else F.lit(True)).alias("kept")))
    # The last gap has no match behind it.
    pairs = F.zip_with(gaps, hits, lambda g, h: F.struct(g.alias("gap"), F.coalesce(h["n"], F.lit(0)).alias("hit"), F.coalesce(h["kept"], F.lit(False)).alias("kept")))
    span = lambda x, at: F.when(x["kept"], F.struct((at + x["gap"]).alias("start"), F.lit(kind).alias("kind"), (at + x["gap"] + x["hit"]).alias("end")))
    found = _let(pairs, lambda all_: F.array_compact(F.zip_with(all_, before(F.transform(all_, lambda x: x["gap"] + x["hit"])), span)))
    return F.when(text.rlike(pattern), found.cast(SPAN)).otherwise(none)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, row key, strong spans (``base``) and unlinked weak parts (``weak``) of every whole text."""
    text = text_of(text_col)
    none = F.array().cast(SPAN)
    long_enough = lambda m: F.char_length(F.regexp_extract(m, ASSIGN_PATTERN, 2)) >= ASSIGN_LEAST
    base = F.concat(
        F.when(text.rlike(ASSIGN_HINT), spans_of(text, ASSIGN_PATTERN, ASSIGN, long_enough)).otherwise(none),
        F.when(text.contains("AKIA"), spans_of(text, ACCESS_PATTERN, ACCESS)).otherwise(none),
        spans_of(text, HEX_PATTERN, HEX),
    )
    weak = F.when(
        text.rlike(WEAK_HINT),
        F.concat(*(spans_of(text, p, k) for p, k in ((SECRET_PATTERN, SECRET), (IDENT_PATTERN, IDENT), (ENDPOINT_PATTERN, ENDPOINT)))),
    ).otherwise(none)
    return with_row_key(docs).select(F.col(id_col).alias("id"), "_r_file", "_r_row", F.array_sort(base).alias("base"), weak.alias("weak"))


def near(left: DataFrame, right: DataFrame, scope: int = SCOPE) -> DataFrame:
    """Rows of ``left`` whose start lies within ``scope`` of a span of ``right`` in the same text: an interval semi join.

    Both sides have _r_file, _r_row, start, end. Starts fall in blocks of
    ``scope``; a right span is copied to the blocks that its scope meets.
    """
    blocks = right.select(
        "_r_file",
        "_r_row",
        (F.col("start") - scope).alias("low"),
        (F.col("end") + scope).alias("high"),
        F.explode(F.sequence(F.floor((F.col("start") - scope) / scope), F.floor((F.col("end") + scope) / scope))).alias("block"),
    )
    left = left.withColumn("block", F.floor(F.col("start") / scope))
    on = [left[c] == blocks[c] for c in ("_r_file", "_r_row", "block")] + [left["start"] >= blocks["low"], left["start"] <= blocks["high"]]
    return left.join(blocks, on, "left_semi").drop("block")


def apart(spans: DataFrame, others: DataFrame, block: int = SCOPE) -> DataFrame:
    """Rows of ``spans`` that overlap none of ``others`` in the same text: both are copied to the blocks that they meet."""
    key = ["_r_file", "_r_row"]
    dealt = lambda df: df.withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("end") - 1) / block))))
    right = dealt(others).select(*key, "block", F.col("start").alias("low"), F.col("end").alias("high"))
    left = dealt(spans)
    on = [left[c] == right[c] for c in (*key, "block")] + [left["start"] < right["high"], right["low"] < left["end"]]
    hit = left.join(right, on, "left_semi").select(*key, "kind", "start").distinct()
    return spans.join(hit, [*key, "kind", "start"], "left_anti")


def link(scanned: DataFrame, scope: int = SCOPE) -> DataFrame:
    """Weak parts of staged ``scan`` rows that meet their complements: _r_file, _r_row, linked (spans)."""
    key = ["_r_file", "_r_row"]
    some = scanned.where(F.size("weak") > 0)
    strong = some.select(*key, F.inline("base"))
    # A weak part that overlaps a strong span says nothing new.
    weak = stage(apart(some.select(*key, F.inline("weak")), strong).select(*key, "start", "kind", "end"), "weak-parts")
    of = lambda df, *kinds: df.where(F.col("kind").isin(*kinds))
    idents = of(strong, ACCESS).unionByName(of(weak, IDENT))
    secrets = of(strong, ASSIGN, HEX).unionByName(of(weak, SECRET))
    linked = near(of(weak, SECRET), idents, scope).unionByName(near(of(weak, IDENT), secrets, scope)).unionByName(near(near(of(weak, ENDPOINT), idents, scope), secrets, scope))
    return linked.groupBy(*key).agg(F.collect_list(F.struct("start", "kind", "end")).alias("linked"))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """Every row of ``docs`` with its strong spans (``base``) and all spans (``spans``), sorted by start and kind.

    Columns: id, _r_file, _r_row, base, spans; a span is (start, kind, end) in
    code points, end exclusive, kind a place in ``KINDS``. Null texts count as
    empty and have no spans; null ids stay null; repeated rows are scanned each
    for itself; other columns are ignored; an empty table gives no rows.
    """
    scanned = stage(scan(docs, id_col, text_col), "secrets")
    return scanned.join(link(scanned, scope), ["_r_file", "_r_row"], "left").select(
        "id", "_r_file", "_r_row", "base", F.array_sort(F.concat("base", F.coalesce("linked", F.array().cast(SPAN)))).alias("spans")
    )


def written(spans: str) -> Column:
    """Spans as kind:start:end, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"], s["end"])), ",")


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return find_secrets(table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"),
        count(ASSIGN).alias("n_assign"),
        count(ACCESS).alias("n_access"),
        count(HEX).alias("n_hex"),
        F.sha2(written("base"), 256).alias("base_sha256"),
        written("spans").alias("spans"),
    )


def secret_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts of ``op10_secrets``, which SQL can express."""
    return op10_secrets(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex")


COUNTS_SQL = rf"""
with texts as (select doc_id, coalesce(text, '') as text from documents)
select doc_id,
  len(list_filter(regexp_extract_all(text, '{ASSIGN_PATTERN.replace("'", "''")}', 2), lambda x: length(x) >= {ASSIGN_LEAST})) as n_assign,
  len(list_filter(regexp_extract_all(text, 'AKIA[A-Z0-9]+'), lambda x: length(x) >= 20)) as n_access,
  len(list_filter(regexp_extract_all(text, '[0-9a-f]+'), lambda x: length(x) >= 24)) as n_hex
from texts
"""

QUERIES = {"op10_secrets": op10_secrets, "secret_counts": secret_counts}
ORACLES: dict[str, str] = {"secret_counts": COUNTS_SQL}
