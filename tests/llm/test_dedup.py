"""Exact dedup, BK-trees and SimHash near-dedup against brute force."""

import hashlib
import re

import numpy as np
import xxhash

from lexiloom.llm import exact_dedup, simhash
from lexiloom.llm.bktree import Forest
from lexiloom.llm.components import components


def test_exact_groups(docs, rows):
    got = exact_dedup.exact_groups(docs, fan_in=2).collect()
    assert len(got) == len(rows)
    normal = lambda t: re.sub(r"[\x20\x09-\x0D]+", "", t or "")
    groups = {}
    for r in rows:
        groups.setdefault(normal(r[1]), []).append((-len(r[1] or ""), r[0] is None, r[0]))
    by_hash = {hashlib.sha256(k.encode()).hexdigest(): sorted(v, key=lambda x: (x[0], x[1], x[2] or 0)) for k, v in groups.items()}
    for r in got:
        members = by_hash[r.text_sha256]
        assert r.group_size == len(members) and r.keep_id == members[0][2]
    kept = [r for r in got if r.kept]
    assert len(kept) == len(by_hash) and all(r.id == r.keep_id for r in kept)


def test_exact_drop(docs, empty):
    left = exact_dedup.drop_exact_copies(docs)
    assert left.columns == docs.columns and all(r._r_file in ("x", None) for r in left.collect())
    texts = [re.sub(r"[\x20\x09-\x0D]+", "", r.text or "") for r in left.collect()]
    assert len(texts) == len(set(texts))
    assert exact_dedup.exact_groups(empty).count() == 0 and exact_dedup.drop_exact_copies(empty).count() == 0


def brute(group, prints, radius):
    comp = list(range(len(prints)))

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if group[i] == group[j] and sum(int(a ^ b).bit_count() for a, b in zip(prints[i], prints[j], strict=True)) <= radius:
                a, b = find(i), find(j)
                comp[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def test_forest_against_brute_force():
    rng = np.random.default_rng(0)
    for words, radius in ((1, 4), (1, 0), (1, 64), (2, 9)):
        for _ in range(6):
            base = rng.integers(0, 2**63, (10, words)).astype(np.uint64)
            p = base[rng.integers(0, 10, 150)]
            for _ in range(rng.integers(1, 8)):
                p = p ^ (np.uint64(1) << rng.integers(0, 64, p.shape).astype(np.uint64))
            whole = np.unique(np.column_stack([np.sort(rng.integers(0, 5, 150)).astype(np.uint64), p]), axis=0)
            group, p = whole[:, 0].astype(np.int64), whole[:, 1:]
            assert Forest(group, p).components(radius).tolist() == brute(group, p, radius)
    assert len(Forest(np.zeros(0, np.int64), np.zeros((0, 1), np.uint64)).components(4)) == 0


def test_components(spark):
    chain = [(i, i + 1) for i in range(60)] + [(100, 100), (101, 102), (102, 101)] + [(200, 201 + i) for i in range(50)]
    got = {r.node: r.comp for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert len({got[i] for i in range(61)}) == 1 and got[101] == got[102] and 100 not in got and len({got[i] for i in range(200, 251)}) == 1
    assert len(set(got.values())) == 3
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def slow_print(text, words):
    own = (text or "").encode().lower().split()
    shingles = [b" ".join(own[k : k + words]) for k in range(max(1, len(own) - words + 1))] if own else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_near_groups(docs, rows, empty):
    got = simhash.near_groups(docs, words=4, radius=4).collect()
    assert len(got) == len(rows)
    prints = {(r[0], r[1]): slow_print(r[1], 4) for r in rows}
    keys = list(prints)
    comp = brute([0] * len(keys), [[prints[k]] for k in keys], 4)
    least = {}
    for k, c in zip(keys, comp, strict=True):
        least[c] = min((x for x in (least.get(c), k[0]) if x is not None), default=None)
    want = sorted(str((k[0], prints[k], least[c])) for k, c in zip(keys, comp, strict=True) for _ in range(sum((r[0], r[1]) == k for r in rows)))
    assert want == sorted(str((r.id, r.print[0] % 2**64, r.component_id)) for r in got)
    assert simhash.near_groups(empty, words=4).count() == 0


def test_near_copies_of_a_similarity(spark, tmp_path, empty):
    import random

    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    rows, want = [], set()
    for k in range(60):
        base = [word() for _ in range(300)]
        rows.append((k * 10, " ".join(base)))
        want.add(k * 10)
        for j in range(1, 4):  # up to five words of 300: a similarity of 0.84 or more
            other = list(base)
            for at in rng.sample(range(300), rng.randint(1, 5)):
                other[at] = word()
            rows.append((k * 10 + j, " ".join(other)))
    path = str(tmp_path / "near.parquet")
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(path)
    left = simhash.drop_near_copies(spark.read.parquet(path))
    ids = {r.doc_id for r in left.collect()}
    assert want <= ids and len(ids - want) <= 0.05 * 180
    assert simhash.drop_near_copies(empty).columns == empty.columns


def test_radius_grows_as_similarity_falls():
    assert simhash.radius_for(1.0, 64) == 0 and simhash.radius_for(0.9, 256) < simhash.radius_for(0.8, 256) < 64
