"""Shards that outgrow their bound are split without losing a link: blocks by further bits, bands into cells of two parts."""

import numpy as np
from pyspark.sql import functions as F

from lexiloom.llm import simhash
from lexiloom.llm.bktree import Forest
from lexiloom.llm.components import components


def as_rows(spark, prints):
    return spark.createDataFrame([([int(p)],) for p in prints.view(np.int64)], "print array<long>")


def grouped(comps):
    out = {}
    for node, comp in comps:
        out.setdefault(comp, set()).add(node)
    return sorted(sorted(x) for x in out.values())


def test_blocks_split_by_further_bits(spark):
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**62, 12).astype(np.uint64)
    cluster = base[0] ^ (np.uint64(1) << rng.integers(30, 64, (400, 3)).astype(np.uint64)).sum(axis=1, dtype=np.uint64)
    some = base[rng.integers(0, 12, 300)]
    for _ in range(5):
        some = some ^ (np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64))
    prints = np.unique(np.concatenate([cluster, some, base, rng.integers(0, 2**62, 200).astype(np.uint64)]))
    want = Forest(np.zeros(len(prints), np.int64), prints).components(4)
    dealt = simhash.block_shards(as_rows(spark, prints), 4)
    assert dealt.groupBy("shard").count().agg(F.max("count")).first()[0] > 100
    split = simhash.split_shards(dealt, 4, most=25, free=8).cache()
    own = {int(p): k for k, p in enumerate(prints.view(np.int64))}
    got = components(simhash.shard_links(split, 4)).collect()
    found = grouped((own[r.node[0]], r.comp[0]) for r in got)
    assert found == [x for x in grouped(enumerate(want.tolist())) if len(x) > 1]
    sizes = split.groupBy("shard").count().agg(F.max("count")).first()[0]
    assert sizes <= 2**8
    # Nothing is dealt again below the bound.
    assert simhash.split_shards(dealt, 4).count() == dealt.count()
    assert simhash.split_shards(simhash.block_shards(as_rows(spark, prints[:0]), 4), 4).count() == 0


def test_split_stops_at_the_last_bits(spark):
    prints = np.arange(200, dtype=np.uint64)  # all in the lowest eight bits: no choice of blocks keeps these apart for good
    split = simhash.split_shards(simhash.block_shards(as_rows(spark, prints), 4), 4, most=10, free=12)
    got = components(simhash.shard_links(split, 4)).collect()
    assert len(got) == 200 and len({r.comp[0] for r in got}) == 1


def test_bands_split_into_cells(spark, tmp_path):
    rng = np.random.default_rng(6)
    texts, k = [], 0
    for _ in range(6):  # one long passage in common, so that many different texts share a band
        base = [f"p{i}" for i in range(100)]
        for _ in range(25):
            own = [f"q{k}x{i}" for i in range(rng.integers(1, 60))]
            texts += [" ".join(base + own), " ".join([*base, *own, f"r{k}"])]
            k += 1
    path = str(tmp_path / "hot.parquet")
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3).write.parquet(path)
    docs = spark.read.parquet(path)
    order = F.struct(F.col("id").isNull().alias("none"), "id", "_r_file", "_r_row")
    made = simhash.shingle_sets(docs, id_col="doc_id", text_col="text", **simhash.NEAR).cache()
    sets = made.groupBy("set").agg(F.min(order).alias("best"), F.first("n").alias("n"), F.first("print").alias("print"), F.first("bands").alias("bands")).cache()
    shards = sets.select(F.posexplode("bands").alias("band", "key")).groupBy("band", "key").count()
    assert shards.agg(F.max("count")).first()[0] > 40
    links = lambda most: simhash.set_links(docs, sets, simhash.NEAR["words"], simhash.NEAR["n_words"], 0.8, "text", most)
    groups = lambda most: grouped((bytes(r.node), bytes(r.comp)) for r in components(links(most)).collect())
    whole = groups(simhash.SHINGLES)
    assert len(whole) > 0 and whole == groups(3000) == groups(1)


def test_cells_of_bands(spark):
    """Any two rows of a shard share a cell, and no cell is much larger than asked."""
    rows = spark.createDataFrame([(k % 2, k) for k in range(400)] + [(7, 1), (8, 1), (8, 2)], "shard long, name long")
    got = simhash.in_cells(rows, "name", F.lit(1), 50).select("shard", "name", F.explode("cells").alias("cell")).collect()
    cells = {}
    for r in got:
        cells.setdefault((r.shard, r.cell), []).append(r.name)
    assert {s for s, _ in cells} == {0, 1, 8} and max(map(len, cells.values())) <= 90
    for shard in (0, 1, 8):
        names = {n for (s, _), x in cells.items() if s == shard for n in x}
        met = {(a, b) for (s, _), x in cells.items() if s == shard for a in x for b in x}
        assert len(met) == len(names) ** 2
