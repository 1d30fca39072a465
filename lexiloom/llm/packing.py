"""Hierarchical residual packing: best fit in partitions, then a tree merge of underfull bins.

Texts are tokenised once, where they are read; what moves afterwards is a few
numbers for each piece. Full pieces are sequences by themselves. The others are
dealt evenly to partitions and packed there by best fit, longest first. A bin
that is closed leaves with a sequence number. The emptiest bins of each
partition, a bounded number, go up as items to the next level, where partitions
are fewer by ``FAN_IN``, until one is left. Bounded means: after best fit at most
one bin of a partition is half full or less, and only such bins can take or join
others there, so a partition sends that bin and its ``HOSTS`` emptiest others.
"""

from __future__ import annotations

import itertools
import json
import os
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stage, table, text_of, with_row_key

SEQUENCE = 1024
END_ID = 2
#: Items that one partition packs at the first level.
ITEMS = 100_000
FAN_IN = 16
#: Bins that a partition sends up besides the one that is at most half full.
HOSTS = 63


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def ranks_of(path: str) -> dict[bytes, int] | None:
    """Ranks (bytes to id) of a plain byte-level BPE file whose ids follow its merges, else None.

    With those, a second library gives the same ids as the file's own in a fraction of the time.
    """
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    plain = model.get("type") == "BPE" and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space", True) and pre.get("use_regex", True)
    if not plain or spec.get("normalizer") or model.get("dropout") or model.get("ignore_merges") or model.get("end_of_word_suffix") or model.get("continuing_subword_prefix"):
        return None
    special = {t["content"] for t in spec.get("added_tokens", [])}
    # Byte-level files spell bytes that do not print by characters from 256 up.
    printed = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in printed} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in printed)}
    vocab = model["vocab"]
    merged = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
    if any(a >= b for a, b in itertools.pairwise(merged)):
        return None
    return {bytes(byte[c] for c in token): k for token, k in vocab.items() if token not in special}


#: How byte-level BPE cuts a text before it merges: a fixed value of the tokenizer family.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


#: Texts with a run of this many bytes without ASCII white space, or so many white-space characters, go to the file's own
#: library: the second one takes quadratic time for long words, and its pattern matcher overflows its stack on a million blanks.
LONG = 1_000
#: Characters of a text that are encoded at once, where it has a place to be cut.
CHUNK = 1 << 20
_BLANKS = re.compile(rf"\s{{{LONG}}}")
#: A blank between two letters: the text before it ends a word, and the blank begins the next, whatever else the text holds.
_CUT = re.compile(r"(?<=[^\W\d_]) (?=[^\W\d_])")


def long_runs(text: str) -> bool:
    """Whether the text has a run that the second library must not see; never misses one, as its classes lie within these."""
    if len(text) < LONG:
        return False
    if max(map(len, text.encode("utf-8", "surrogatepass").split()), default=0) > LONG:
        return True
    words = text.split()
    return len(text) - sum(map(len, words)) - len(words) >= LONG - 2 and _BLANKS.search(text) is not None


def chunks(text: str, size: int = CHUNK) -> Iterator[str]:
    """The text in parts whose ids, one after another, are its own. A part without a blank between letters stays whole."""
    at = 0
    while len(text) - at > size and (m := _CUT.search(text, at + size)):
        yield text[at : m.start()]
        at = m.start()
    yield text[at:]


def encoder(path: str) -> Callable[[str], Iterator[list[int]]]:
    """Text to lists of ids under a tokenizer file, special tokens neither added nor read.

    Texts of any length and with runs of any length have the file's own ids.
    """
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
    own = lambda text: tokenizer.encode(text, add_special_tokens=False).ids
    ranks = ranks_of(path)
    if ranks is None:
        return lambda text: iter([own(text)])
    import tiktoken

    fast = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    return lambda text: (own(part) if long_runs(part) else fast(part) for part in chunks(text))


def pieces(docs: DataFrame, tokenizer: str | None = None, length: int = SEQUENCE, end_id: int = END_ID, keep_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per piece of each document's ids and end id: id, row key, piece, start, length, ids_crc32 (and ids).

    Only documents longer than ``length`` are cut, so that all pieces but the
    first are full. Null and empty texts are the end id alone. Texts and runs of
    one character of any length are encoded whole.
    """
    path = tokenizer or default_tokenizer()

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallelism
        encode = encoder(path)
        for whole in batches:
            for batch in (whole.slice(k, 256) for k in range(0, len(whole), 256)):
                rows: list[tuple] = []
                for i, text in enumerate(batch.column(3)):
                    ids = b"".join(np.array(x, "<u4").tobytes() for x in (*encode(text.as_py()), [end_id]))
                    n = len(ids) // 4
                    cuts = [0, *range(n % length or min(n, length), n, length), n]
                    rows += [(i, k, a, b - a, zlib.crc32(ids[4 * a : 4 * b]), ids[4 * a : 4 * b] if keep_ids else None) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
                of, *numbers, ids = zip(*rows, strict=True)
                took = batch.take(pa.array(of, pa.int32()))
                columns = [*took.columns[:3], *(pa.array(x, kind) for x, kind in zip(numbers, (pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True))]
                names = ["id", "_r_file", "_r_row", "piece", "start", "length", "ids_crc32"]
                if keep_ids:
                    columns, names = [*columns, pa.array(ids, pa.binary())], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(columns, names)

    kind = dict(docs.dtypes)[id_col]
    schema = f"id {kind}, _r_file long, _r_row long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids
    return with_row_key(docs).select(F.col(id_col).alias("id"), "_r_file", "_r_row", text_of(text_col)).mapInArrow(make, schema)


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """(bin of each item, its offset there, fill of each bin): best fit, longest first, ties in the given order.

    Bins wait by the room that is left; a bit set of the rooms in use finds the
    least that suffices.
    """
    order = np.argsort(-sizes, kind="stable")
    waiting: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, fill = 0, []
    into, offset = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    for i, size in zip(order.tolist(), sizes[order].tolist(), strict=True):
        fits = rooms >> size
        if fits:
            room = (fits & -fits).bit_length() - 1 + size
            b = waiting[room].pop()
            if not waiting[room]:
                rooms ^= 1 << room
        else:
            room, b = capacity, len(fill)
            fill.append(0)
        into[i], offset[i] = b, fill[b]
        fill[b] += size
        if room := room - size:
            waiting[room].append(b)
            rooms |= 1 << room
    return into, offset, fill


def pack(items: DataFrame, capacity: int = SEQUENCE, per_partition: int = ITEMS, hosts: int = HOSTS, fan_in: int = FAN_IN) -> DataFrame:
    """(item, sequence_id, offset) for staged ``items`` (item: unique long, length: 1 to ``capacity``)."""
    if not (n := items.count()):
        return items.select("item", F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))

    def level_of(level: int, last: bool):
        def work(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(["length", "item"], ascending=[False, True], kind="stable")
            into, offset, fill = best_fit(pdf["length"].to_numpy(), capacity)
            fill = np.array(fill)
            up = np.zeros(len(fill), bool)
            if not last:
                order = np.argsort(fill, kind="stable")[: hosts + 1]
                up[order[fill[order] < capacity]] = True
            number = (np.int64(level) << 58) + (pdf["part"].to_numpy().astype(np.int64) << 24) + into
            return pd.DataFrame({"item": pdf["item"], "bin": number, "offset": offset, "up": up[into], "fill": fill[into]})

        return work

    done, parts, level = [], max(1, -(-n // per_partition)), 0
    here = items.select("item", "length", F.pmod(F.xxhash64("item"), F.lit(parts)).cast("int").alias("part"))
    chain = []
    while True:
        packed = stage(here.groupBy("part").applyInPandas(level_of(level, parts == 1), "item long, bin long, offset long, up boolean, fill long"), f"bins-{level}")
        chain.append(packed)
        if parts == 1:
            break
        parts, level = -(-parts // fan_in), level + 1
        # A bin's number holds its partition; neighbours meet.
        here = (
            packed.where("up").groupBy(F.col("bin").alias("item")).agg(F.first("fill").alias("length"))
            .withColumn("part", (F.shiftright(F.col("item"), 24).bitwiseAND(F.lit((1 << 34) - 1)) % F.lit(parts)).cast("int"))
        )
    # Down the tree: where the bins that went up have come to lie.
    found = chain.pop().select("item", F.col("bin").alias("sequence_id"), "offset")
    while chain:
        below = chain.pop()
        rest = below.where(~F.col("up")).select("item", F.col("bin").alias("sequence_id"), "offset")
        moved = below.where("up").join(found.select(F.col("item").alias("bin"), "sequence_id", F.col("offset").alias("base")), "bin")
        found = rest.unionByName(moved.select("item", "sequence_id", (F.col("offset") + F.col("base")).alias("offset")))
    return found


def pack_documents(docs: DataFrame, tokenizer: str | None = None, length: int = SEQUENCE, end_id: int = END_ID, keep_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every piece of every document with its place: ``pieces`` columns, sequence_id and offset.

    Offsets in a sequence leave no gaps and no sequence is longer than
    ``length``. Repeated rows are documents of their own; null ids stay null;
    other columns are ignored; an empty table gives no rows.
    """
    made = stage(pieces(docs, tokenizer, length, end_id, keep_ids, id_col, text_col).withColumn("item", F.monotonically_increasing_id()), "pieces")
    short = made.where(F.col("length") < length)
    places = pack(short.select("item", "length"), length)
    full = made.where(F.col("length") == length).withColumns({"sequence_id": F.col("item") + F.lit(1 << 62), "offset": F.lit(0).cast("long")})
    return full.unionByName(short.join(places, "item")).drop("item")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id").drop("_r_file", "_r_row")


QUERIES = {"op6_packing": op6_packing}
ORACLES: dict[str, str] = {}
