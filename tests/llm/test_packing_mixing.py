import time
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lexiloom.llm import mixing, packing


def check_places(frame, length):
    assert (frame.groupby("sequence_id").length.sum() <= length).all()
    ordered = frame.sort_values(["sequence_id", "offset"])
    assert (ordered.groupby("sequence_id").length.cumsum() - ordered.length == ordered.offset).all()


def test_pieces_and_places(docs, rows, empty):
    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    got = packing.pack_documents(docs, path, length=64, keep_ids=True).toPandas()
    check_places(got, 64)
    whole = {}
    for _, g in got.groupby(["_r_file", "_r_row"]):
        g = g.sort_values("piece")
        assert g.piece.tolist() == list(range(len(g))) and (g.length.iloc[1:] == 64).all()
        assert g.start.tolist() == [0, *g.length.cumsum().tolist()[:-1]]
        assert all(zlib.crc32(i) == c and len(i) == 4 * n for i, c, n in zip(g.ids, g.ids_crc32, g.length, strict=True))
        whole.setdefault(b"".join(g.ids), []).append(1)
    want = {}
    for r in rows:
        want.setdefault(np.array([*t.encode(r[1] or "", add_special_tokens=False).ids, 2], "<u4").tobytes(), []).append(1)
    assert {k: len(v) for k, v in whole.items()} == {k: len(v) for k, v in want.items()}
    assert packing.pack_documents(empty, path).count() == 0


def test_best_fit_is_exact_on_pairs():
    into, offset, fill = packing.best_fit(np.array([3, 7, 5, 5, 10, 1, 9]), 10)
    assert sorted(fill) == [10, 10, 10, 10] and (offset >= 0).all() and len(set(into)) == 4


def test_levels(spark):
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 1024, 6000)
    items = spark.createDataFrame([(int(i), int(s)) for i, s in enumerate(sizes)], "item long, length long")
    got = packing.pack(items, per_partition=1500, fan_in=3, hosts=20).toPandas().merge(items.toPandas(), on="item")
    assert len(got) == 6000
    check_places(got, 1024)
    assert got.sequence_id.nunique() <= 1.02 * sizes.sum() / 1024
    alike = spark.createDataFrame([(i, 600) for i in range(2000)] + [(2000, 5)], "item long, length long")
    assert packing.pack(alike, per_partition=100, fan_in=4).select("sequence_id").distinct().count() == 2000


def test_targets_and_mix(docs, rows, empty):
    got = mixing.mix(docs, group=8).toPandas()
    assert len(got) == len(rows)
    sizes = {}
    for r in rows:
        sizes[r[3]] = sizes.get(r[3], 0) + len((r[1] or "").encode().split())
    names = sorted(k for k in sizes if k is not None) + [None]
    weight = {k: (5.0, 2.0, 1.0)[i % 3] for i, k in enumerate(names)}
    total, free, want = 1.5 * sum(sizes.values()), set(names), {}
    while True:
        unit = (total - sum(want.values())) / sum(weight[k] for k in free)
        above = {k for k in free if weight[k] * unit > 2 * sizes[k]}
        if not above:
            break
        want |= {k: 2.0 * sizes[k] for k in above}
        free -= above
    want |= {k: weight[k] * unit for k in free}
    got["source"] = got.source.map(lambda x: x if isinstance(x, str) else None)
    for k in names:
        g = got[got.source.isna()] if k is None else got[got.source == k]
        assert (g.source_size == sizes[k]).all() and np.allclose(g.target, want[k])
        assert abs(g.taken.sum() - want[k]) <= max(g["size"].max(), 1)
    assert (got.taken <= 2 * got["size"]).all() and (got.taken == got.copies * got["size"]).all()
    again = mixing.mix(docs, group=8).toPandas()
    key = ["_r_file", "_r_row"]
    assert got.sort_values(key).taken.tolist() == again.sort_values(key).taken.tolist()
    assert mixing.mix(empty).count() == 0


def test_flight_keeps_totals():
    rng = np.random.default_rng(3)
    n = 9000
    group, size = np.sort(rng.integers(0, 7, n)), rng.integers(0, 5000, n)
    p, u = np.full(n, 0.37), rng.integers(0, 2**62, n)
    out = mixing.flight(group, size, p, u)
    for g in range(7):
        m = group == g
        assert abs(out[m].sum() - p[m].sum()) < 1e-3 and abs((out[m] * size[m]).sum() - (p[m] * size[m]).sum()) < 1
        assert ((out[m] > 0) & (out[m] < 1)).sum() < 3
    assert abs((out == 1).mean() - 0.37) < 0.01
    same = mixing.flight(np.zeros(10, int), np.full(10, 4), np.full(10, 0.5), u[:10])
    assert ((same > 0) & (same < 1)).sum() < 3


def test_rows_of_the_mix(docs, rows):
    out = mixing.mixed_rows(docs)
    assert out.columns == docs.columns and all(r._r_file in ("x", None) for r in out.collect())
    assert out.count() == mixing.mix(docs).agg({"copies": "sum"}).first()[0]


PATH = public_tokenizers.path("byte_bpe_50k.json")
OWN = Tokenizer.from_file(PATH)
OWN.encode_special_tokens = True
ENCODE = packing.encoder(PATH)
ids = lambda text: [k for part in ENCODE(text) for k in part]


@pytest.mark.parametrize("unit", [" ", "\n", "a", "!", "\u3000 ", "7"])
def test_long_runs(unit):
    """Five million characters of one kind: no crash, seconds, and the file's ids, alone and within a text."""
    run = unit * (5_000_000 // len(unit))
    assert packing.long_runs(run)
    began = time.monotonic()
    got = ids(run)
    assert time.monotonic() - began < 60 and got == OWN.encode(run, add_special_tokens=False).ids
    text = "some words here " * 100 + unit * 3000 + " and there's more " * 100
    assert ids(text) == OWN.encode(text, add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.sampled_from([" ", "\n", "ab", "é", "日", "!", "7", "\x1c", "\u3000", "a b ", "'s ", "\x85", " \t"]), st.integers(1, 1200)), max_size=5))
def test_ids_of_any_mixture(parts):
    text = "".join(unit * n for unit, n in parts)
    assert ids(text) == OWN.encode(text, add_special_tokens=False).ids


def test_cuts_keep_ids():
    text = "It's a blank, two  blanks, 3 digits and\nlines éà ça <|endoftext|> x_y " * 40
    for size in (1, 7, 50, 1000):
        parts = list(packing.chunks(text, size))
        assert "".join(parts) == text and len(parts) > 1
        assert [k for p in parts for k in OWN.encode(p, add_special_tokens=False).ids] == OWN.encode(text, add_special_tokens=False).ids
