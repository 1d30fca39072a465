import base64
import hashlib
import itertools
import random
import re
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexiloom.llm import html_extract as H
from lexiloom.llm import warc
from lexiloom.llm.dom import INLINE, Page

PAGES = [
    (1, "http://www.a.org/x#f", "<p>one</p>"), (2, "https://b.org:80/y", "<p>two</p>"), (3, None, "<p>one</p>"), (4, "http://a.org/", None), (5, "http://a.org/\r\nEvil: 1", ""), (8, "http://x/?q=a%0Ab", "y"), (9, " http://x/ \n", "y"), (10, "http://x/é\x00", "z"),
    (6, "http://c.net", "WARC/1.1\r\n\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"), (7, "http://c.net", "é" * 70000), (3, None, "<p>one</p>"), (None, "http://d", "x"),
]


def test_round_trip(spark):
    df = spark.createDataFrame([(*p, "clash") for p in PAGES], "page_id long, url string, html string, digest string")
    got = warc.archive(df.repartition(3)).collect()
    assert len(got) == len(PAGES)
    first = {}
    for i, _, h in sorted(PAGES, key=lambda p: (p[0] is None, p[0] or 0)):
        first.setdefault(h or "", i)
    want = [
        (i, u or "", len((h or "").encode()), base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode(), "response" if first[h or ""] == i else "revisit", None if first[h or ""] == i else first[h or ""])
        for i, u, h in PAGES
    ]
    assert sorted(map(str, want)) == sorted(str((r.id, r.url, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)) for r in got)
    keys = [(r.url_key, r.time) for r in got]
    assert keys == sorted(keys)
    assert warc.archive(df.limit(0)).count() == 0


def test_seek_times_and_file_sizes(spark, tmp_path):
    """An index entry is enough to read its record; files are bounded in bytes; capture times come from the table and order histories."""
    import datetime
    import gzip

    rng = random.Random(3)
    body = lambda n: "".join(rng.choice("abcdefghij0123456789<>é") for _ in range(n))
    rows = [(k, f"http://h{k % 3}.org/p", body(rng.randint(0, 3000)), datetime.datetime(2020, 1, 1) + datetime.timedelta(days=rng.randint(0, 900))) for k in range(300)] + [(300, "http://big", body(200_000), None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, seen timestamp")
    path = str(tmp_path / "warc")
    warc.write(pages.repartition(2), path, file_bytes=50_000, time_col="seen")
    runs = warc.read(spark, path, block=7)
    files = {}
    for r in runs.collect():
        name = r.file.removeprefix("file:")
        files.setdefault(name, []).append(r)
        with open(name, "rb") as f:
            f.seek(r.at)
            fields, block = warc.parse(gzip.decompress(f.read(r.length)))
        assert block.partition(b"\r\n\r\n")[2].decode() == rows[r.id][2] and fields["warc-date"] == r.time
        assert r.id == 300 or r.time == rows[r.id][3].strftime("%Y-%m-%dT%H:%M:%SZ")
    assert len(files) > 5
    for name, own in files.items():
        data = open(name, "rb").read()
        assert sum(r.length for r in own) == len(data) and (len(data) < 60_000 or any(r.id == 300 for r in own))
        assert len(gzip.decompress(data)) > len(data)  # plain gzip to any reader
    got = [(r.url_key, r.time, r.id) for r in warc.merged_index(runs, take=20).collect()]
    assert len(got) == len(rows) and got == sorted(got)


def test_members_of_sixteen_megabytes():
    for n in (0, 100, (1 << 24) - 1, 1 << 24, (1 << 24) + 5):
        data = b"x" * n
        files = (warc.member(data) + b"\0") * 2
        found = list(warc.members_of(files))
        assert [c for _, _, c in found] == ([data] * 2 if n else [b""]) and sum(size for _, size, _ in found) == len(files)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.tuples(st.sampled_from("abc"), st.sampled_from("12"), st.one_of(st.none(), st.integers(0, 3))), max_size=30), max_size=6), st.integers(1, 9), st.integers(1, 40), st.integers(0, 20))
def test_merge_of_blocks(runs, block, take, cut):
    """Runs longer than blocks and takes, cut at a range bound as a shuffle does, come out in order."""
    blocks, want = [], []
    for file, run in enumerate(runs):
        rows = sorted(((k, t, i, "", "", None, "", 0, f"f{file}", at, 1) for at, (k, t, i) in enumerate(run)), key=warc.order)
        for k in range(0, len(rows), block):
            own = [r for r in rows[k : k + block] if warc.order(r) >= ("a", "1", True, cut % 4, "", 0)]
            if own:
                blocks.append((warc.order(rows[k]), own))
                want += own
    got = list(warc.merge_blocks(iter(sorted(blocks, key=lambda x: x[0])), take))
    assert got == sorted(want, key=warc.order)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.tuples(st.integers(0, 20), st.integers(0, 5)), max_size=12), max_size=9))
def test_loser_tree(runs):
    runs = [sorted(r) for r in runs]
    assert list(warc.LoserTree([iter(r) for r in runs], lambda x: x)) == sorted(x for r in runs for x in r)


def test_url_key():
    assert warc.url_key("HTTP://user@www.Example.com:80/a?b#c") == "com,example)/a?b" and warc.url_key("") == ")/"


def texts(page):
    return " ".join("".join(" " if t is None else t for _, t in page.flow).split())


def test_reader():
    assert texts(Page("<p>a<b>b</b> c<p>d<br>e<script>x</p></script><!-- y --><li>f<li>g &amp; h")) == "ab c d e f g & h"
    assert texts(Page('<a title="x>y">z</a> 1 < 2 <a href="q>r')) == "z 1 < 2 r"  # a quotation mark without its fellow costs the tag only
    assert texts(Page("<style>p{}")) == "" and texts(Page("")) == "" and texts(Page("plain")) == "plain"


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="<>/ap!-=\"' &;x", max_size=80))
def test_reader_takes_anything(s):
    H.extract_all([s], H.trained(20))


def test_given_pages_by_their_article(spark):
    import html

    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "html").collect()
    got = H.extract_all([r.html for r in rows], H.trained())
    want = [" ".join(html.unescape(re.sub(r"<[^>]+>", " ", re.search(r"<article>(.*?)(</article>|$)", r.html, re.S)[1])).split()) for r in rows]
    assert sum(a == b for a, b in zip(got, want, strict=True)) >= 0.97 * len(rows)


def test_generated_pages_held_out():
    rng, total, right = random.Random(1234), 0, 0
    for _ in range(120):
        s = H.training_page(rng)
        main = texts(Page(re.sub(r"\x02[^<\x01\x02]*", "", s))).replace("\x01", "").split()
        got = H.extract_all([re.sub(r"[\x01\x02]", "", s)], H.trained())[0].split()
        total += len(main) + len(got)
        right += 2 * sum((__import__("collections").Counter(main) & __import__("collections").Counter(got)).values())
    assert right / total > 0.93


def test_page_table(spark, tmp_path):
    rows = [(1, "u", "<article><p>a b</p></article>"), (2, None, None), (None, "v", ""), (1, "u", "<article><p>a b</p></article>")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = H.op7_html(spark, str(tmp_path)).collect()
    assert len(got) == 4 and all(r.n_chars == len(r.text) for r in got)
    assert H.main_texts(spark.read.parquet(str(tmp_path / "pages.parquet")).limit(0)).count() == 0


def test_quotation_marks_cost_one_tag():
    page = Page("""<div><p x=">one</p><p title='a>b'>two</p><p title='c>d'>three</p></div>""")
    assert [t for _, t in page.flow if t] == ["one", "two", "three"]
    assert texts(Page("<p>x <math><mi>y</mi></math> z<object><p>w</p></object>")) == "x y z w"


def test_elements_without_their_end_tags():
    assert texts(Page("<p>a</p><select><option>b<p>c</p>")) == "a b c"  # ends with its parent, not with the page
    assert texts(Page("<noscript><p>a</p><svg>b</svg><p>c</p><template>d")) == "a c d"
    assert texts(Page("<p>a</p><script>b<p>c</p>")) == "a"


@pytest.mark.parametrize("s", ["<div>" * 1_000_000, "<p><button>" + "<div>" * 1_000_000, "</div>" * 1_000_000, "<b></i>" * 500_000, "<li>" * 1_000_000, "<a '>' " * 500_000, "<p x='" * 500_000, "<svg><select>" * 300_000])
def test_reader_is_linear(s):
    began = time.monotonic()
    Page(s)
    assert time.monotonic() - began < 30


def test_deep_page_as_a_whole():
    deep = "<div>" * 100_000 + "<article><p>" + "Words of the article, and more of them. " * 30 + "</p></article>"
    began = time.monotonic()
    H.extract_all([deep], H.trained())
    assert time.monotonic() - began < 60


def total(page, main, margin, own):
    """What a labelling is worth, None if it contradicts itself."""
    worth = 0.0 if not main[0] else -H.SWITCH
    for i in range(len(page.tag)):
        score = np.clip(margin[i], -6, 6) * np.sqrt(own[i])
        worth += score if main[i] else -score
        if i and main[i] != main[p := page.parent[i]]:
            if page.tag[i] in INLINE:
                return None
            if main[i]:
                while p >= 0:  # main text below what is cut from main text
                    if main[p]:
                        return None
                    p = page.parent[p]
            worth -= H.SWITCH if main[i] else H.CUTTING
    return worth


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["<div>", "<p>", "<b>", "</div>", "</b>", "<section>"]), st.floats(-8, 8), st.integers(0, 400)), max_size=8))
def test_decode_against_all_labellings(parts):
    page = Page("".join(tag for tag, _, _ in parts))
    n = len(page.tag)
    margin, own = (np.array([*(x[k] for x in parts), *[0.0] * n][:n], float) for k in (1, 2))
    worths = [w for main in itertools.product([False, True], repeat=n) if (w := total(page, main, margin, own)) is not None]
    got = total(page, H.decode(page, margin, own), margin, own)
    assert got is not None and abs(got - max(worths)) < 1e-6
