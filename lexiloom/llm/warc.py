"""WARC archives written and read by Spark, and an index merged from sorted capture runs.

``write`` makes a record per page; records with equal payloads are revisits of the
one with the smallest id. Every record is a gzip member of its own, so an index
entry (file, offset, length) is enough to read one record. Files are bounded in
bytes and written by Spark's text writer, which ends each row with a separator: here a zero
byte, the last one of a gzip member of less than 16 MB, which the rows are therefore written without.
So they are plain archives in any store that Spark reaches. ``read`` walks their members.

``merged_index`` orders captures by URL key and time: every archive file gives a
locally sorted run; runs are cut at common range bounds, and what meets in a range is merged by a
loser tree that reads ahead no further than it must (see ``merge_blocks``).
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import itertools
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stage, stage_path, table

#: Payloads of fewer bytes are always responses.
LEAST_BYTES = 0
#: Compressed bytes after which a writing task begins another file; a file is longer by its last record at most.
FILE_BYTES = 64 << 20
#: 2000-01-01; a page's capture time is so many seconds later as its id says, where the table has no time.
EPOCH = 946_684_800
#: Bits of the two bitmaps that say which payloads may occur twice; 2 MB each, whatever the table's size.
BITS = 1 << 24
#: Rows of a run that travel together, and rows of a range that the merge takes in at once.
BLOCK, TAKE = 4_096, 1 << 15
TO_BASE32 = str.maketrans("0123456789abcdefghijklmnopqrstuv", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of SHA-1, from built-in functions: five hex digits are four of base 32."""
    digest = F.sha1(payload)
    parts = [F.lpad(F.lower(F.conv(F.substring(digest, 5 * k + 1, 5), 16, 32)), 4, "0") for k in range(8)]
    frm = "0123456789abcdefghijklmnopqrstuv"
    return F.translate(F.concat(*parts), frm, frm.translate(TO_BASE32))


def payloads(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", time_col: str | None = None) -> DataFrame:
    """id, url, time, body, its size and digest; null html is an empty payload, null urls are empty, null times follow the id."""
    body = F.coalesce(F.encode(F.col(html_col), "UTF-8"), F.lit(b""))
    time = F.timestamp_seconds(F.lit(EPOCH) + F.coalesce(F.col(id_col).cast("long"), F.lit(0)) % 1_000_000_000)
    time = time if time_col is None else F.coalesce(F.col(time_col).cast("timestamp"), time)
    return pages.select(
        F.col(id_col).alias("id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"), F.date_format(F.to_utc_timestamp(time, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("time"),
        body.alias("body"), F.octet_length(body).cast("long").alias("bytes"), base32_sha1(body).alias("digest"),
    )


def first_of(bodies: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """(digest, size, first id) of payloads that occur more than once; counts are pre-aggregated, so a hot payload is a few rows."""
    groups = bodies.where(F.col("bytes") >= least_bytes).groupBy("digest", "bytes").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    return groups.where("n > 1").select("digest", "bytes", "first")


def _marked(rows: DataFrame, wanted: DataFrame, of: tuple[str, ...], by: tuple[str, ...], name: str) -> DataFrame:
    """``rows`` with ``name``: false only where no row of ``wanted`` has these values. A bitmap of ``BITS`` bits, broadcast in pieces of 4 kB."""
    place = lambda columns: F.pmod(F.xxhash64(*columns), F.lit(BITS))
    bits = wanted.select(place(of).alias("at")).groupBy(F.shiftright("at", 15).alias("piece")).agg(F.bitmap_construct_agg(F.col("at") % 32768).alias("bits"))
    at = place(by)
    joined = rows.withColumns({"at": at, "piece": F.shiftright(at, 15)}).join(F.broadcast(bits), "piece", "left")
    byte = F.conv(F.hex(F.expr("substring(bits, cast((at % 32768) div 8 as int) + 1, 1)")), 16, 10).cast("int")
    return joined.withColumn(name, F.coalesce(F.bit_get(byte, (F.col("at") % 8).cast("int")) == 1, F.lit(False))).drop("at", "piece", "bits")


def record_heads(bodies: DataFrame, firsts: DataFrame) -> DataFrame:
    """``bodies`` with record_type and refers_to. Of a repeated row with the first id all are responses.

    Only rows of payloads that may be repeated are shuffled, and of them only those
    that may be responses take their bodies along. ``firsts`` is staged.
    """
    rows = _marked(bodies, firsts, ("digest", "bytes"), ("digest", "bytes"), "many")
    alone = rows.where(~F.col("many")).drop("many").withColumns({"record_type": F.lit("response"), "refers_to": F.lit(None).cast(bodies.schema["id"].dataType)})
    some = _marked(rows.where("many").drop("many"), firsts, ("digest", "bytes", "first"), ("digest", "bytes", "id"), "may_be_first")
    # Null ids are responses where they are the first, and nothing else.
    slim = some.withColumn("body", F.when(F.col("may_be_first") | F.col("id").isNull(), F.col("body"))).drop("may_be_first")
    joined = slim.join(firsts, ["digest", "bytes"], "left")
    revisit = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("id"))
    shared = joined.withColumns({"record_type": F.when(revisit, "revisit").otherwise("response"), "refers_to": F.when(revisit, F.col("first"))}).drop("first")
    return alone.unionByName(shared)


#: URLs that a header line holds as they are; others are percent-encoded there and stated in full, in base 64, beside it.
_PLAIN = re.compile(r"(?:[^\x00-\x20\x7f](?:[^\x00-\x1f\x7f]*[^\x00-\x20\x7f])?)?")
_OWN_URL = "Lexiloom-Target-URI-Base64"


def record(page_id, url: str, time: str, body: bytes, size: int, digest: str, kind: str, refers_to) -> bytes:
    """A whole WARC record. A revisit has the HTTP headers of its response and no body."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + body if kind == "response" else http
    name = lambda x: f"<urn:lexiloom:page:{'null' if x is None else x}>"
    target = [f"WARC-Target-URI: {url}"]
    if not _PLAIN.fullmatch(url):
        shown = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
        target = [f"WARC-Target-URI: {shown}", f"{_OWN_URL}: {base64.b64encode(url.encode('utf-8', 'surrogatepass')).decode()}"]
    revisit = ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {name(refers_to)}"] if kind == "revisit" else []
    lines = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {name(page_id)}", f"WARC-Date: {time}", *target, f"WARC-Payload-Digest: sha1:{digest}", *revisit,
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", "",
    ]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


_NOTHING = gzip.compress(b"", mtime=0)


def member(data: bytes) -> bytes:
    """``data`` as gzip without its last byte, which is zero: of 16 MB and more an empty member follows, to end in one."""
    out = gzip.compress(data, 6, mtime=0)
    return out[:-1] if not out[-1] else out + _NOTHING[:-1]


_RECORD = ("id", "url", "time", "body", "bytes", "digest", "record_type", "refers_to")


def write(pages: DataFrame, path: str, least_bytes: int = LEAST_BYTES, file_bytes: int = FILE_BYTES, **columns: str) -> None:
    """Write WARC files with a gzip member per row of ``pages``."""
    bodies = payloads(pages, **columns)
    firsts = stage(first_of(bodies, least_bytes), "repeated-payloads")

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, size = 0, 0
        for whole in batches:
            for batch in (whole.slice(k, 64) for k in range(0, len(whole), 64)):
                made, parts = [], []
                for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    made.append(member(record(*row)))
                    if size and size + len(made[-1]) > file_bytes:
                        part, size = part + 1, 0
                    size += len(made[-1]) + 1
                    parts.append(part)
                yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary()), pa.array(parts, pa.int32())], ["value", "part"])

    rows = record_heads(bodies, firsts).select(*_RECORD).mapInArrow(members, "value binary, part int")
    rows.select(F.col("value").cast("string").alias("value"), "part").write.partitionBy("part").option("lineSep", "\0").option("compression", "none").text(path)


_ID = re.compile(r"<urn:lexiloom:page:(-?\d+)>")


def members_of(data: bytes | memoryview, step: int = 1 << 16) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, content) of each gzip member; empty ones belong to the member before."""
    view, at, held = memoryview(data), 0, None
    while at < len(view):
        engine, fed, out = zlib.decompressobj(31), at, []
        while not engine.eof:
            if fed >= len(view):
                raise ValueError(f"the gzip member at {at} does not end")
            out.append(engine.decompress(view[fed : fed + step]))
            fed += min(step, len(view) - fed)
        end, content = fed - len(engine.unused_data), b"".join(out)
        if content or held is None:
            if held is not None:
                yield held
            held = (at, end - at, content)
        else:
            held = (held[0], end - held[0], held[2])
        at = end
    if held is not None:
        yield held


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """(headers in lower case, block) of a WARC record."""
    end = data.index(b"\r\n\r\n")
    head = data[:end].decode("utf-8", "surrogatepass").split("\r\n")
    if not head[0].startswith("WARC/"):
        raise ValueError("no WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head[1:])}
    block = data[end + 4 : end + 4 + int(fields["content-length"])]
    if len(block) != int(fields["content-length"]):
        raise ValueError("the WARC record is cut short")
    return fields, block


def url_key(url: str) -> str:
    """Sort-friendly form of a URL: host labels reversed, without scheme, ``www`` and fragment; lower case."""
    rest = re.sub(r"^[a-z][a-z0-9+.-]*://", "", url.strip().lower()).partition("#")[0]
    host, slash, path = rest.partition("/")
    host = re.sub(r"^www\d*\.", "", host.rpartition("@")[2].partition(":")[0])
    return ",".join(reversed(host.split("."))) + ")" + (slash + path or "/")


INDEX = "url_key string, time string, id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, file string, at long, length long"
#: Of a row in its run: the place, and the first row of its block.
RUN = f"{INDEX}, place long, head_key string, head_time string, head_id long, head_at long"
_HEAD = ("head_key", "head_time", "head_id", "head_at")


def entry(fields: dict[str, str], block: bytes) -> tuple:
    """The first eight columns of ``INDEX``. A response's payload is hashed again and must have the digest that its record states."""
    http, _, body = block.partition(b"\r\n\r\n")
    own, of = (_ID.match(fields.get(k, "")) for k in ("warc-record-id", "warc-refers-to"))
    digest = fields["warc-payload-digest"].removeprefix("sha1:")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])  # of a revisit, which has no body
    if fields["warc-type"] == "response" and (len(body) != size or base64.b32encode(hashlib.sha1(body).digest()).decode() != digest):
        raise ValueError("the payload is not what its record states")
    coded = fields.get(_OWN_URL.lower())
    url = fields["warc-target-uri"] if coded is None else base64.b64decode(coded).decode("utf-8", "surrogatepass")
    return url_key(url), fields["warc-date"], int(own[1]) if own else None, url, fields["warc-type"], int(of[1]) if of else None, digest, size


def order(row: tuple) -> tuple:
    """URL key, time, id (none first), file and offset of an ``INDEX`` row."""
    return row[0], row[1], row[2] is not None, row[2] or 0, row[8], row[9]


def _batches(rows: list[tuple], schema: pa.Schema, size: int = 10_000) -> Iterator[pa.RecordBatch]:
    for k in range(0, len(rows), size):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[k : k + size], strict=True), schema, strict=True)], schema=schema)


def _schema(text: str) -> pa.Schema:
    return pa.schema([(n, pa.int64() if t == "long" else pa.string()) for n, t in (x.split() for x in text.split(", "))])


def read(spark: SparkSession, path: str, block: int = BLOCK) -> DataFrame:
    """Rows (``RUN``) of the WARC files under ``path``: each file's are a run sorted by URL key, time and id, in blocks of ``block``."""
    schema = _schema(RUN)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                run = []
                for at, length, data in members_of(content.as_buffer()):
                    run.append((*entry(*parse(data)), file, at, length))
                run.sort(key=order)
                heads = [run[k - k % block] for k in range(len(run))]
                yield from _batches([(*row, k, h[0], h[1], h[2], h[9]) for k, (row, h) in enumerate(zip(run, heads, strict=True))], schema)

    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content").mapInArrow(rows, RUN)


class LoserTree:
    """k sorted iterators as one: each inner node keeps the loser of its match, so a step costs one path."""

    def __init__(self, runs: list[Iterator[tuple]], key):
        self.runs, self.key = list(map(iter, runs)), key
        self.k = max(1, len(runs))
        self.heads = [self._next(i) for i in range(len(runs))]
        self.losers = [-1] * self.k
        self.winner = self._build(1) if runs else -1

    def _next(self, i: int):
        row = next(self.runs[i], None)
        return None if row is None else (self.key(row), i, row)

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return x is not None and (y is None or x[:2] < y[:2])

    def _build(self, node: int) -> int:
        if node >= self.k:
            return node - self.k
        a, b = self._build(2 * node), self._build(2 * node + 1)
        win, lose = (a, b) if self._beats(a, b) else (b, a)
        self.losers[node] = lose
        return win

    def __iter__(self) -> Iterator[tuple]:
        return self.below(None)

    def below(self, limit) -> Iterator[tuple]:
        """Rows in order, up to the first whose key is not less than ``limit``."""
        while self.winner >= 0 and (head := self.heads[self.winner]) is not None and (limit is None or head[0] < limit):
            i = self.winner
            yield head[2]
            self.heads[i] = self._next(i)
            node = (i + self.k) // 2
            while node:
                if self._beats(self.losers[node], i):
                    i, self.losers[node] = self.losers[node], i
                node //= 2
            self.winner = i

    def rest(self) -> list:
        """What is left of each run that is not at its end; runs are ``Rows`` here."""
        left = [r for h, r in zip(self.heads, self.runs, strict=False) if h is not None]
        for r in left:
            r.at -= 1  # the head goes back
        return left


class Rows:
    """An iterator over a list that can step back."""

    def __init__(self, rows: list[tuple]):
        self.rows, self.at = rows, 0

    def __iter__(self):
        return self

    def __next__(self) -> tuple:
        if self.at >= len(self.rows):
            raise StopIteration
        self.at += 1
        return self.rows[self.at - 1]


def merge_blocks(blocks: Iterator[tuple[tuple, list[tuple]]], take: int = TAKE) -> Iterator[tuple]:
    """Rows in order, from sorted blocks (head, rows) that come by their heads; no row of a block comes before its head.

    Blocks enter the loser tree ``take`` rows at a time, and rows leave it while they come before
    the head of the next block, as nothing that is still to come can precede that. So of each run
    about one block is held, the one that the merge stands in, however long runs are.
    """
    runs: list[Rows] = []
    ahead = next(blocks, None)
    while ahead is not None:
        taken = 0
        while ahead is not None and taken < take:
            runs.append(Rows(ahead[1]))
            taken += len(ahead[1])
            ahead = next(blocks, None)
        tree = LoserTree(runs, order)
        yield from tree.below(None if ahead is None else ahead[0])
        runs = tree.rest()


def merged_index(runs: DataFrame, take: int = TAKE) -> DataFrame:
    """``INDEX`` rows in global order of URL key, time, id and place, from sorted runs (``RUN``; one per ``file``).

    Ranges are cut by the whole order, so a host or URL with very many captures,
    or one that repeats, spans several. In a range Spark's external sort hands over blocks by their first rows.
    """
    schema, n = _schema(INDEX), len(INDEX.split(", "))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def blocks() -> Iterator[tuple[tuple, list[tuple]]]:
            own, head = [], None
            for batch in batches:
                for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    key, time, i, at = row[n:]
                    if (of := (key, time, i is not None, i or 0, row[8], at)) != head:
                        if own:
                            yield head, own
                        own, head = [], of
                    own.append(row[:n])
            if own:
                yield head, own

        merged = merge_blocks(blocks(), take)
        while rows := list(itertools.islice(merged, 10_000)):
            yield from _batches(rows, schema)

    dealt = runs.repartitionByRange("url_key", "time", "id", "file", "at").sortWithinPartitions("head_key", "head_time", "head_id", "file", "head_at", "place")
    return dealt.select(*(f.name for f in schema), *_HEAD).mapInArrow(merge, INDEX)


def archive(pages: DataFrame, least_bytes: int = LEAST_BYTES, **columns: str) -> DataFrame:
    """Write ``pages`` to WARC files in the shared folder, read them back, and return the merged index (``INDEX``).

    Null html is an empty payload, null urls are empty and sort first, null ids
    are records without a number (null id again when read). Repeated rows are
    records of their own: all rows with the smallest id of a payload are
    responses. URLs come back as they were, whatever they hold; a column of capture times is
    ``time_col``. Other columns are ignored; an empty table gives no rows.
    """
    spark = pages.sparkSession
    path = stage_path(spark, "warc")
    write(pages, path, least_bytes, **columns)
    return merged_index(stage(read(spark, path), "capture-runs"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = archive(table(spark, sf_dir, "pages"))
    return merged.select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES = {"op4_warc": op4_warc}
OP4_SQL = r"""
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS h FROM pages),
q AS (SELECT page_id, n, h, min(page_id) OVER (PARTITION BY h, n) AS first FROM p)
SELECT page_id, n AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         1 + CAST((('0x' || substr(h, CAST(i // 4 * 5 + 1 AS INT), 5))::INT >> CAST(15 - 5 * (i % 4) AS INT)) & 31 AS INT), 1)), '') AS payload_digest,
       CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first = page_id THEN NULL ELSE first END AS refers_to
FROM q
"""

ORACLES = {"op4_warc": OP4_SQL}
