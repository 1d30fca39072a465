"""SimHash near-dedup over BK-trees.

A document's fingerprint has one bit for each bit of its shingles' hashes: 1 if it
is set in over half of them. Two ways of dealing fingerprints to shards:

* ``blocks`` (exact, small radius): the bits fall into ``radius + exact`` blocks, so two
  fingerprints within the radius agree in at least ``exact`` whole blocks; a
  shard is one choice of blocks with one content. No link is lost.
* ``minhash`` (a shingle similarity such as 0.8): shards are bands of minima over the
  document's shingles; what share of pairs meets is a formula of similarity, bands and
  rows. Here trees only find candidates: each distinct shingle counts once, the radius is
  wide, and a pair is linked after its Jaccard similarity is counted on the shingle sets.

A shard that outgrows a bound is split before it is shuffled, and no link is lost:
one of blocks by choices of blocks of its other bits, one of a band into cells that
hold two of its parts each. A shard's BK-tree is built where the shard's rows arrive,
and links found there leave as one star per component, not as pairs. Trees are not broadcast: all
shards together grow with the corpus, so no size bound could be proven for them.
"""

from __future__ import annotations

import functools
import itertools
import math
from collections.abc import Iterable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bktree import Forest
from .common import join_rows, stage, table, with_row_key
from .components import components

SEED = 42
#: Shingles hashed at once; bounds the memory that a very long text takes.
CHUNK = 1 << 17
#: Rows of shards that are put into one forest, and shingles where their sets come along.
FOREST = 1 << 18
SHINGLES = 1 << 22
#: A shard of blocks with more fingerprints is dealt again by further bits, while it has more free bits than ``FREE``; fingerprints are distinct, so 2**FREE is its bound.
SHARD, FREE = 1 << 18, 20
_MIX, _ALL = 0x9E3779B97F4A7C15, (1 << 64) - 1


def shingle_hashes(text: str | None, words: int) -> Iterator[np.ndarray]:
    """XXH64 of each run of ``words`` words, repeats included, in chunks; all words at once where there are fewer."""
    own = b" ".join((text or "").encode("utf-8", "surrogatepass").lower().split())
    if not own:
        return
    spaces = np.flatnonzero(np.frombuffer(own, np.uint8) == 32)
    n = len(spaces) + 1
    starts = np.concatenate(([0], spaces + 1))[: max(1, n - words + 1)].tolist()
    ends = np.append(spaces, len(own))[min(words, n) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    for k in range(0, len(starts), CHUNK):
        yield np.fromiter((digest(own[s:e], SEED) for s, e in zip(starts[k : k + CHUNK], ends[k : k + CHUNK], strict=True)), np.uint64)


def mixed(h: np.ndarray, k: int) -> np.ndarray:
    """The k-th hash of each shingle; the 0-th is XXH64 itself."""
    if k == 0:
        return h
    x = h ^ np.uint64(k * _MIX & _ALL)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def fingerprint(text: str | None, words: int, n_words: int = 1, minima: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(``n_words`` words of fingerprint, ``minima`` minima over the shingles); all zero without a word."""
    return majority(shingle_hashes(text, words), n_words, minima)


def majority(hashes: Iterable[np.ndarray], n_words: int, minima: int) -> tuple[np.ndarray, np.ndarray]:
    """``fingerprint`` of shingles that are hashed already."""
    ones, total = np.zeros((n_words, 64), np.int64), 0
    least = np.full(minima, np.iinfo(np.uint64).max, np.uint64)
    for h in hashes:
        total += len(h)
        for k in range(n_words):
            bits = np.unpackbits(mixed(h, k).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones[k] += bits.sum(axis=0, dtype=np.uint32)
        for k in range(minima):
            least[k] = min(least[k], mixed(h, 1000 + k).min())
    if not total:
        return np.zeros(n_words, np.uint64), np.zeros(minima, np.uint64)
    return np.packbits(ones * 2 > total, axis=1, bitorder="little").view(np.uint64).ravel(), least


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """The hashes of the text's distinct shingles, ascending."""
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *shingle_hashes(text, words)]))


def fingerprints(docs: DataFrame, words: int, n_words: int = 1, bands: int = 0, rows: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, row key, ``print`` (array of longs) and ``bands`` (a long per band of ``rows`` minima) of each whole text."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints, keys = [], []
            for text in batch.column(3):
                own, least = fingerprint(text.as_py(), words, n_words, bands * rows)
                prints.append(own.view(np.int64))
                keys.append([xxhash.xxh64_intdigest(least[i * rows : (i + 1) * rows].tobytes(), i) for i in range(bands)])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array([p.tolist() for p in prints], pa.list_(pa.int64())), pa.array(np.array(keys, np.uint64).astype(np.int64).tolist() if bands else [[] for _ in prints], pa.list_(pa.int64()))],
                ["id", "_r_file", "_r_row", "print", "bands"],
            )

    kind = dict(docs.dtypes)[id_col]
    return with_row_key(docs).select(F.col(id_col).alias("id"), "_r_file", "_r_row", F.col(text_col)).mapInArrow(make, f"id {kind}, _r_file long, _r_row long, print array<long>, bands array<long>")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def choices(bits: list[int], radius: int, exact: int) -> list[int]:
    """Masks of each choice of ``exact`` of ``radius + exact`` blocks of these bits."""
    n = radius + exact
    cuts = [round(i * len(bits) / n) for i in range(n + 1)]
    masks = [sum(1 << k for k in bits[a:b]) for a, b in itertools.pairwise(cuts)]
    return [_signed(sum(c)) for c in itertools.combinations(masks, exact)]


def block_shards(prints: DataFrame, radius: int, exact: int = 2, bits: int = 64) -> DataFrame:
    """(shard, mask, print) for one-word fingerprints: a row for each choice of ``exact`` of ``radius + exact`` blocks; a shard's fingerprints agree in the bits of its mask."""
    own = F.col("print")[0]
    keys = F.array(*(F.struct(F.xxhash64(F.lit(i), own.bitwiseAND(F.lit(m))).alias("shard"), F.lit(m).cast("long").alias("mask")) for i, m in enumerate(choices(list(range(bits)), radius, exact))))
    return prints.select(F.inline(keys), "print")


def split_shards(shards: DataFrame, radius: int, exact: int = 2, bits: int = 64, most: int = SHARD, free: int = FREE) -> DataFrame:
    """(shard, print) of ``block_shards`` in which no shard has more than ``most`` fingerprints, or else ``free`` free bits at most.

    Two fingerprints of a shard agree in its mask, so what they differ in lies in the
    free bits; those fall into blocks as all bits did, and again a pair within the radius
    agrees in ``exact`` of them. Hence every such pair of a shard that is split meets in a
    new one. Only shards are counted here; what goes to the driver are masks, choices of blocks.
    """
    spark = shards.sparkSession
    whole: list[DataFrame] = []
    while True:
        hot = stage(shards.groupBy("shard").agg(F.min("mask").alias("mask"), F.count("*").alias("n")).where(F.col("n") > most).select("shard", "mask"), "hot-shards")
        deal = []
        for (mask,) in hot.select("mask").distinct().collect():
            left = [k for k in range(bits) if not mask >> k & 1]
            if len(left) > max(free, radius + exact):
                deal += [(mask, sub) for sub in choices(left, radius, exact)]
        if not deal:
            break
        subs = spark.createDataFrame(deal, "mask long, sub long")
        hot = hot.join(F.broadcast(subs.select("mask").distinct()), "mask", "left_semi").select("shard")
        whole.append(shards.join(hot, "shard", "left_anti").select("shard", "print"))
        dealt = shards.join(hot, "shard", "left_semi").join(F.broadcast(subs), "mask")
        key = F.xxhash64("shard", "sub", F.col("print")[0].bitwiseAND(F.col("sub")))
        shards = stage(dealt.select(key.alias("shard"), F.col("mask").bitwiseOR(F.col("sub")).alias("mask"), "print"), "split-shards")
    return functools.reduce(DataFrame.unionByName, whole, shards.select("shard", "print"))


def band_shards(prints: DataFrame, most: int = SHARD) -> DataFrame:
    """(shard, print) of bands of minima, large shards in cells."""
    return in_cells(prints.select(F.posexplode("bands").alias("band", "key"), "print").select(F.xxhash64("band", "key").alias("shard"), "print").distinct(), "print", F.lit(1), most).select(F.explode("cells").alias("shard"), "print")


def in_cells(shards: DataFrame, name: str, weight: Column, most: int) -> DataFrame:
    """Rows of ``shards`` that share theirs with another, and ``cells``: the shards to send them to instead.

    A shard that weighs more than ``most`` goes into parts by a hash of ``name``, and each two parts
    into a cell that weighs about ``most``: any two rows of the shard meet in a cell, and no task
    holds more than that. A row of a shard of p parts goes to p - 1 cells.
    """
    parts = F.least(F.ceil(2 * F.sum(weight) / most), F.count("*")).cast("int")
    more = shards.groupBy("shard").agg(F.count("*").alias("rows"), parts.alias("parts")).where("rows > 1").select("shard", "parts")
    part = F.pmod(F.xxhash64(name, "shard"), F.col("parts")).cast("int")
    others = F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda k: k != part)
    cells = F.transform(others, lambda k: F.xxhash64("shard", F.least(part, k), F.greatest(part, k)))
    return shards.join(more, "shard").withColumn("cells", F.when(F.col("parts") < 3, F.array("shard")).otherwise(cells))


def shard_links(shards: DataFrame, radius: int, n_words: int = 1) -> DataFrame:
    """Links (a, b: fingerprints) that join each shard's components: a star for each, found in the shard's BK-tree."""

    def work(shard: np.ndarray, prints: np.ndarray) -> pa.RecordBatch:
        group = np.cumsum(np.concatenate(([0], shard[1:] != shard[:-1])))
        alone = np.bincount(group) == 1
        keep = ~alone[group]
        group, prints = group[keep], prints[keep]
        comp = Forest(group, prints.view(np.uint64)).components(radius) if len(prints) else np.zeros(0, np.int64)
        leaf = np.flatnonzero(comp != np.arange(len(comp)))
        pairs = np.unique(np.hstack([prints[leaf], prints[comp[leaf]]]), axis=0) if len(leaf) else np.zeros((0, 2 * n_words), np.int64)
        return pa.RecordBatch.from_arrays([_lists(pairs[:, :n_words]), _lists(pairs[:, n_words:])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        for batch in batches:
            if not len(batch):
                continue
            held.append((batch.column(0).to_numpy(), batch.column(1).flatten().to_numpy().reshape(-1, n_words)))
            size += len(batch)
            if size >= FOREST and held[-1][0][-1] != held[0][0][0]:
                shard, prints = np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held])
                cut = int(np.searchsorted(shard, shard[-1], "left"))  # the last shard may go on
                yield work(shard[:cut], prints[:cut])
                held, size = [(shard[cut:], prints[cut:])], len(shard) - cut
        if held:
            yield work(np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held]))

    return shards.repartition("shard").sortWithinPartitions("shard").mapInArrow(run, "a array<long>, b array<long>")


def _lists(rows: np.ndarray) -> pa.Array:
    n, k = rows.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * k, pa.int32()), pa.array(np.ascontiguousarray(rows).ravel(), pa.int64()))


def radius_for(similarity: float, bits: int, deviations: float = 1.5) -> int:
    """Bits in which fingerprints of texts with this shingle similarity (Jaccard) differ: the mean and so many standard deviations."""
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return math.floor(bits * p + deviations * math.sqrt(bits * p * (1 - p)))


def near_groups(docs: DataFrame, words: int = 5, n_words: int = 1, radius: int = 4, exact: int = 2, bands: int = 0, rows: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row of ``docs`` with its fingerprint and component.

    Columns: id, _r_file, _r_row, print (array of longs), component_id (the
    smallest id reachable over links of at most ``radius`` bits, its own
    included; null ids are passed over, and a component of null ids only has a null).
    ``bands`` 0 deals by blocks (exact, one word), else by ``bands`` bands of
    ``rows`` minima. Null and blank texts have the zero fingerprint, linked like
    any other. Repeated rows share a fingerprint. Other columns are ignored; an
    empty table gives no rows.
    """
    if not bands and n_words > 1:
        raise ValueError("blocks deal fingerprints of one word; give bands for longer ones")
    made = stage(fingerprints(docs, words, n_words, bands, rows, id_col, text_col), "fingerprints")
    prints = stage(made.groupBy("print").agg(F.min("id").alias("least")), "distinct-prints")
    shards = band_shards(made) if bands else split_shards(block_shards(prints, radius, exact), radius, exact)
    comps = components(shard_links(shards, radius, n_words))
    named = stage(comps.join(prints, comps["node"] == prints["print"]).groupBy("comp").agg(F.min("least").alias("first")), "component-names")
    of = comps.join(named, "comp").select(F.col("node").alias("print"), "first")
    # Written, so that the last join reads two tables and Spark can split a fingerprint that very many rows share.
    each = stage(prints.join(of, "print", "left").select("print", F.coalesce("first", "least").alias("component_id")), "print-components")
    return made.join(each, "print").select("id", "_r_file", "_r_row", "print", "component_id")


class Sets:
    """Shingle sets, one after another in ``flat`` and ending at ``ends``; counts Jaccard similarities of pairs."""

    def __init__(self, flat: np.ndarray, ends: np.ndarray, similarity: float):
        names, self.flat = np.unique(flat, return_inverse=True)
        self.mark = np.zeros(len(names), bool)
        self.start, self.ends = np.concatenate(([0], ends[:-1])), ends
        self.size = self.ends - self.start
        self.least = Fraction(str(similarity))

    def similar(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the sets a[i] and b[i] are as similar as asked; none of them is empty."""
        over, under = self.least.denominator, self.least.numerator
        out = np.minimum(self.size[a], self.size[b]) * over >= under * np.maximum(self.size[a], self.size[b])
        open_ = np.flatnonzero(out)
        if len(np.unique(a[open_])) > len(np.unique(b[open_])):
            a, b = b, a
        open_ = open_[np.argsort(a[open_], kind="stable")]
        cuts = np.flatnonzero(np.diff(a[open_])) + 1
        for own in np.split(open_, cuts) if len(open_) else []:
            x = a[own[0]]
            mine = self.flat[self.start[x] : self.ends[x]]
            self.mark[mine] = True
            low = 0
            while low < len(own):  # as many others at once as memory is meant for
                sizes = self.size[b[own[low:]]]
                high = low + max(1, int(np.searchsorted(np.cumsum(sizes), SHINGLES, "right")))
                part, sizes = own[low:high], sizes[: high - low]
                first = np.cumsum(sizes) - sizes
                at = np.arange(sizes.sum()) - np.repeat(first - self.start[b[part]], sizes)
                both = np.add.reduceat(self.mark[self.flat[at]], first, dtype=np.int64)
                out[part] = both * over >= under * (len(mine) + sizes - both)
                low = high
            self.mark[mine] = False
        return out


def shingle_sets(docs: DataFrame, words: int, n_words: int, bands: int, rows: int, id_col: str, text_col: str) -> DataFrame:
    """``fingerprints`` in which each distinct shingle counts once, with ``set``, a digest of the distinct shingles, and ``n``, their number."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets, sizes, prints, keys = [], [], [], []
            for text in batch.column(3):
                own = shingle_set(text.as_py(), words)
                bits, least = majority((own[k : k + CHUNK] for k in range(0, len(own), CHUNK)), n_words, bands * rows)
                sets.append(xxhash.xxh3_128_digest(own.tobytes()))
                sizes.append(len(own))
                prints.append(bits.view(np.int64))
                keys.append([xxhash.xxh64_intdigest(least[i * rows : (i + 1) * rows].tobytes(), i) for i in range(bands)])
            keys = np.array(keys, np.uint64).view(np.int64).reshape(-1, bands)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(sets, pa.binary()), pa.array(sizes, pa.int64()), _lists(np.array(prints, np.int64).reshape(-1, n_words)), _lists(keys)], ["id", "_r_file", "_r_row", "set", "n", "print", "bands"])

    kind = dict(docs.dtypes)[id_col]
    return with_row_key(docs).select(F.col(id_col).alias("id"), "_r_file", "_r_row", F.col(text_col)).mapInArrow(make, f"id {kind}, _r_file long, _r_row long, set binary, n long, print array<long>, bands array<long>")


def set_links(docs: DataFrame, sets: DataFrame, words: int, n_words: int, similarity: float, text_col: str, most: int = SHINGLES) -> DataFrame:
    """Links (a, b: digests of ``sets``) that join each shard's components under pairs of at least this Jaccard similarity.

    Shingles are read again, and sent along, only of texts that share a shard with another. A shard with more than
    ``most`` shingles is split into cells; a single text is never cut.
    """
    radius = wide_radius(similarity, 64 * n_words)
    shards = sets.select(F.posexplode("bands").alias("band", "key"), "set", "n", "print", "best").select(F.xxhash64("band", "key").alias("shard"), "set", "n", "print", "best")
    some = in_cells(shards, "set", F.col("n"), most)
    some = some.groupBy("set").agg(F.flatten(F.collect_list("cells")).alias("shards"), F.first("print").alias("print"), F.first("best").alias("best"))
    rows, names = join_rows(docs, some.select("best._r_file", "best._r_row", "set", "print", "shards"), "inner", "set", "print", "shards")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, len(batch), 256):
                part = batch.slice(k, 256)
                own = pa.array([shingle_set(t.as_py(), words).tobytes() for t in part.column(3)], pa.large_binary()).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns[:3], own], ["set", "print", "shards", "shingles"])

    def work(shard: np.ndarray, names: list[bytes], prints: np.ndarray, own: list[bytes]) -> pa.RecordBatch:
        group = np.cumsum(np.concatenate(([0], shard[1:] != shard[:-1])))
        sets_ = Sets(np.frombuffer(b"".join(own), np.uint64), np.cumsum([len(x) // 8 for x in own]), similarity)
        comp = Forest(group, prints.view(np.uint64)).components(radius, sets_.similar)
        leaf = np.flatnonzero(comp != np.arange(len(comp)))
        return pa.RecordBatch.from_arrays([pa.array([names[i] for i in leaf], pa.binary()), pa.array([names[i] for i in comp[leaf]], pa.binary())], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[list, list, list, list] = ([], [], [], [])
        size = 0

        def flush(n: int) -> pa.RecordBatch:
            shard, names, prints, own = (x[:n] for x in held)
            for x in held:
                del x[:n]
            return work(np.array(shard), names, np.array(prints, np.int64).reshape(-1, n_words), own)

        for batch in batches:
            for row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).flatten().to_numpy().reshape(-1, n_words), batch.column(3).to_pylist(), strict=True):
                if size >= SHINGLES and row[0] != held[0][-1]:
                    yield flush(len(held[0]))
                    size = 0
                for x, v in zip(held, row, strict=True):
                    x.append(v)
                size += len(row[3]) // 8 + 1
        if held[0]:
            yield flush(len(held[0]))

    sent = rows.select(*names, text_col).mapInArrow(read, "set binary, print array<long>, shards array<long>, shingles binary")
    sent = sent.select(F.explode("shards").alias("shard"), "set", "print", "shingles")
    return sent.repartition("shard").sortWithinPartitions("shard").mapInArrow(run, "a binary, b binary")


def wide_radius(similarity: float, bits: int, deviations: float = 6) -> int:
    """Bits within which fingerprints of sets with this Jaccard similarity or more lie, but for one pair in 10**8.

    The largest mean, and so many standard deviations: of long texts by the angle,
    of short ones, whose majorities have ties, by the binomials of all shapes up to 40 shared shingles.
    """
    half = lambda n: np.array([math.comb(n, k) for k in range(n + 1)]) / 2**n
    p, least = math.acos(2 * similarity / (1 + similarity)) / math.pi, Fraction(str(similarity))
    for shared in range(1, 41):
        s = np.arange(shared + 1)
        for a in range(int(shared * (1 / least - 1)) + 1):
            for b in range(a, int(shared * (1 / least - 1)) - a + 1):
                up = [(half(n) * (2 * (s[:, None] + np.arange(n + 1)) > shared + n)).sum(axis=1) for n in (a, b)]
                p = max(p, float((half(shared) * (up[0] + up[1] - 2 * up[0] * up[1])).sum()))
    return math.floor(bits * p + deviations * math.sqrt(bits * p * (1 - p)))


#: Near-dedup at a similarity of 0.8: 512 bits, and eight bands of three minima, in one of which at least 99.6 % of pairs at 0.8 meet.
NEAR = {"words": 5, "n_words": 8, "bands": 8, "rows": 3}
SIMILARITY = 0.8


def drop_near_copies(docs: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` (read from files) with one row of each group of near copies: that of the smallest id, then place.

    Groups are components under pairs whose sets of shingles have at least this
    Jaccard similarity. Texts without a word are copies of each other.
    """
    order = F.struct(F.col("id").isNull().alias("none"), "id", "_r_file", "_r_row")
    made = stage(shingle_sets(docs, id_col=id_col, text_col=text_col, **NEAR), "shingle-sets")
    sets = stage(made.groupBy("set").agg(F.min(order).alias("best"), F.first("n").alias("n"), F.first("print").alias("print"), F.first("bands").alias("bands")), "distinct-sets")
    comps = components(set_links(docs, sets, NEAR["words"], NEAR["n_words"], similarity, text_col))
    firsts = stage(comps.join(sets, comps["node"] == sets["set"]).groupBy("comp").agg(F.min("best").alias("first")), "component-firsts")
    of = comps.join(firsts, "comp").select(F.col("node").alias("set"), "first")
    # Written, so that the last join reads two tables and Spark can split a set that very many rows share.
    each = stage(sets.join(of, "set", "left").select("set", F.coalesce("first", "best").alias("first")), "set-firsts")
    gone = made.join(each, "set").where((F.col("first._r_file") != F.col("_r_file")) | (F.col("first._r_row") != F.col("_r_row")))
    return join_rows(docs, gone, "left_anti")[0].select(*docs.columns)


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = near_groups(table(spark, sf_dir, "documents"), words=4, radius=4)
    return groups.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex(F.col("print")[0]), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op8_simhash": op8_simhash}
ORACLES: dict[str, str] = {}
