"""Main text of web pages: boosted trees over DOM-node features, decoded over the tree.

Every element with text gets features of its subtree, its own attributes, its
ancestors and its siblings. Boosted trees give its log-odds of being main text.
Labels must not contradict along the tree, so they are decoded together: an
element is outside (and may hold main text below), main, or cut from main text;
what is cut or outside of a cut stays so below. A pass up and a pass down the
tree find the best total.

The classifier is trained here, on generated pages with known main text (see
``training_page``), as no table says which parts of a page are its main text.
"""

from __future__ import annotations

import functools
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .boosting import Boosted, train
from .common import table, with_row_key
from .dom import INLINE, Page

#: Generated pages that the classifier is trained on.
TRAINING_PAGES = 400
SEED = 3
#: What a border in the tree has to pay: from outside to main text, and from main text to what is cut from it.
SWITCH, CUTTING = 2.0, 12.0
#: Elements scored at once.
NODES = 1 << 16

# Words of class, id and role attributes that speak for or against main text.
GOOD = frozenset("article articlebody body content copy entry hentry main mainbody page pagebody post postbody prose read story storybody text".split())
BAD = frozenset(
    "ad ads advert advertisement adverts alert author banner bar bio breadcrumb breadcrumbs byline comment comments consent cookie cookies copyright dialog disclaimer discuss disqus "
    "footer foot form gdpr header head hidden infobar legal links list login masthead menu meta modal nav navbar navigation newsletter notice notification pager pagination popup promo "
    "recommended related replies reply respond rss search share sharing shoutbox sidebar side signup skip skyscraper social sponsor sponsored subscribe tags teaser toolbar top widget widgets".split()
)
COMMENT = frozenset("comment comments discuss disqus discussion feedback reply replies respond response responses reader readers user".split())
APART = frozenset("nav footer aside header form menu dialog button label".split())
LINES, INPUTS = frozenset("p br blockquote pre".split()), frozenset("input button select textarea label form".split())
TAGS = {t: k for k, group in enumerate(("article main", "section", "div", "p", "h1 h2 h3 h4 h5 h6", "ul ol menu", "li", "nav", "header", "footer", "aside", "form fieldset button label input", "blockquote pre", "table tbody thead tr", "td th", "figure figcaption", "body html #root", "dl dt dd", "details dialog summary")) for t in group.split()}


def features(page: Page) -> tuple[np.ndarray, np.ndarray]:
    """(features of each element, code points of its own text)."""
    n = len(page.tag)
    parent, tag = page.parent, page.tag
    links, own, own_link, own_words, own_stops = [False] * n, [0] * n, [0] * n, [0] * n, [0] * n
    for i in range(1, n):
        links[i] = tag[i] == "a" or links[parent[i]]
    for at, text in page.flow:
        if text and (size := len(text.strip())):
            own[at] += size
            own_words[at] += text.count(" ") + 1
            own_stops[at] += text.count(".") + text.count(",")
            if links[at]:
                own_link[at] += size
    good, bad, talk = ([0] * n for _ in range(3))
    for i, words in enumerate(page.tokens):
        if words:
            good[i], bad[i], talk[i] = sum(w in GOOD for w in words), sum(w in BAD for w in words), int(any(w in COMMENT for w in words))
    semantic = [t in APART for t in tag]
    counted = np.column_stack([own, own_link, own_words, own_stops, [t in LINES for t in tag], [t == "li" for t in tag], [t in INPUTS for t in tag], [t == "a" for t in tag], np.ones(n), np.add(bad, semantic)]).astype(np.float64)
    for i in range(n - 1, 0, -1):  # children come after their parents
        counted[parent[i]] += counted[i]
    text, link, words, stops, ps, lis, ins, anchors, tags, bads = counted.T
    own = np.array(own, np.float64)
    start = np.cumsum(own) - own
    up_good, up_bad, up_talk, up_article, up_semantic, index, siblings, same = ([0] * n for _ in range(8))
    seen: dict[int, int] = {}
    kinds: dict[tuple[int, str], int] = {}
    for i in range(1, n):
        p = parent[i]
        up_good[i], up_bad[i], up_talk[i] = up_good[p] + good[p], up_bad[p] + bad[p], max(up_talk[p], talk[p])
        up_article[i] = up_article[p] or tag[p] in ("article", "main")
        up_semantic[i] = up_semantic[p] or semantic[p]
        index[i] = seen[p] = seen.get(p, -1) + 1
        kinds[p, tag[i]] = kinds.get((p, tag[i]), 0) + 1
    for i in range(1, n):
        siblings[i] = seen[parent[i]] + 1
        same[i] = kinds[parent[i], tag[i]]
    group = [TAGS.get(t, -1 if t in INLINE else 19) for t in tag]
    above_group = [group[p] if p >= 0 else -2 for p in parent]
    whole = max(text[0], 1.0)
    one = np.maximum(text, 1.0)
    above = np.maximum(text[np.maximum(np.array(parent), 0)], 1.0)
    x = np.column_stack([
        group, above_group, [above_group[p] if p >= 0 else -2 for p in parent], np.array(page.depth), index, siblings, same, np.log1p(text), np.log1p(own), text / whole, text / above,
        link / one, np.log1p(text / tags), stops / np.maximum(words, 1), np.log1p(words / np.maximum(ps + lis, 1)), np.log1p(ps), np.log1p(lis), np.log1p(ins), np.log1p(anchors),
        np.log1p(tags), np.minimum(good, 3), np.minimum(bad, 3), talk, np.minimum(up_good, 4), np.minimum(up_bad, 4), up_talk, up_article, semantic, up_semantic, start / whole, np.log1p(bads),
        [t in ("article", "main") for t in tag], [t == "header" for t in tag], [len(w) > 0 for w in page.tokens],
    ])
    return x, own


def decode(page: Page, margin: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Which elements' own texts are main text: the labels with the largest total of margins, weighed by text, that do not contradict."""
    n = len(page.tag)
    parent = page.parent
    # An inline element, or one without text of its own, says nothing by itself that its block does not.
    weight = np.sqrt(own)
    score = np.clip(margin, -6, 6) * weight
    # best[i]: total below i if i is outside, main, cut. Choosing main for text gains its score, otherwise loses it.
    outside, main, cut = (-score).tolist(), score.tolist(), (-score).tolist()
    for i in range(n - 1, 0, -1):
        p = parent[i]
        if page.tag[i] in INLINE:
            outside[p] += outside[i]
            main[p] += main[i]
        else:
            outside[p] += max(outside[i], main[i] - SWITCH)
            main[p] += max(main[i], cut[i] - CUTTING)
        cut[p] += cut[i]
    state = np.zeros(n, np.int8)
    state[0] = 0 if outside[0] >= main[0] - SWITCH else 1
    for i in range(1, n):
        s = state[parent[i]]
        if s == 2 or page.tag[i] in INLINE:
            state[i] = s
        elif s == 1:
            state[i] = 1 if main[i] >= cut[i] - CUTTING else 2
        else:
            state[i] = 0 if outside[i] >= main[i] - SWITCH else 1
    return state == 1


def text_of_blocks(page: Page, keep: np.ndarray) -> str:
    """Kept texts in page order: white space in a block becomes one space, blocks are joined by one."""
    parts = [" " if text is None else text for at, text in page.flow if text is None or keep[at]]
    return " ".join("".join(parts).split())


def extract_all(sources: list[str | None], model: Boosted) -> list[str]:
    """Main texts of pages; null and empty pages, and pages without main text, give empty ones."""
    out: list[str] = []
    held: list[tuple[Page, np.ndarray, np.ndarray]] = []
    size = 0

    def flush() -> None:
        nonlocal size
        margins = model.margin(np.concatenate([x for _, x, _ in held])) if held else np.zeros(0)
        at = 0
        for page, x, own in held:
            out.append(text_of_blocks(page, decode(page, margins[at : at + len(x)], own)))
            at += len(x)
        held.clear()
        size = 0

    for source in sources:
        page = Page(source or "")
        x, own = features(page)
        held.append((page, x, own))
        size += len(x)
        if size >= NODES:
            flush()
    flush()
    return out


def training_page(rng: random.Random) -> tuple[str, list[bool]]:
    """A generated page, and for each of its marked texts whether it is main text.

    Every text carries a mark, ``\\x01`` for main text and ``\\x02`` for other text,
    which labels are read from. Layouts vary in elements, names, nesting, length
    and in what surrounds and interrupts the article.
    """
    syllables = rng.choice(["an en on th er re ti in ed is ou ha".split(), "le la que de tion ou eux ai pa".split(), "ung er sch ein ver ge keit ach".split(), "lo ra ci ón es mi do ta que".split()])
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))

    def say(n: int, mark: str) -> str:
        words = [word() for _ in range(max(1, n))]
        for k in range(rng.randint(4, 14), len(words), rng.randint(5, 16)):
            words[k] += rng.choice([",", ".", ". "])
        return mark + " ".join(words).capitalize() + rng.choice([".", "", "."] if n > 3 else ["", ""])

    yes, no = (lambda n: say(n, "\x01")), (lambda n: say(n, "\x02"))
    opaque = rng.random() < 0.2
    hashed = lambda: f"c{rng.randrange(16**5):05x}"

    def attrs(*names: str) -> str:
        if not names or rng.random() < 0.12:
            return ""
        name = hashed() if opaque else rng.choice(names)
        if rng.random() < 0.3:
            name += rng.choice([" row", " box", " clearfix", f" {hashed()}", " module", "-wrap", "-inner"])
        return f' {rng.choice(["class", "class", "id"])}="{name}"'

    def box(inner: str, tags: str, *names: str) -> str:
        tag = rng.choice(tags.split())
        return f"<{tag}{attrs(*names)}>{inner}</{tag}>"

    def links(lo: int, hi: int, mark=no) -> str:
        items = [f'<a href="/{word()}">{mark(rng.randint(1, 4))}</a>' for _ in range(rng.randint(lo, hi))]
        kind = rng.random()
        if kind < 0.6:
            return "<ul>" + "".join(f"<li>{x}</li>" if rng.random() < 0.9 else f"<li>{x}" for x in items) + "</ul>"
        return rng.choice([" | ", " ", " &middot; "]).join(items)

    def paragraph() -> str:
        n = rng.choice([rng.randint(1, 6), rng.randint(8, 40), rng.randint(20, 120)])
        text = yes(n)
        if rng.random() < 0.15:
            text += f' <a href="/x">{yes(rng.randint(1, 4))}</a> {yes(rng.randint(2, 12))}'
        if rng.random() < 0.2:
            text = f"<b>{text}" + rng.choice(["</b>", "</b>", "<br>", ""])
        return f"<p>{text}" + rng.choice(["</p>"] * 5 + [""])

    def advert() -> str:
        text = no(rng.randint(2, 25))
        return box(rng.choice([text, f"<p>{text}</p>", f'<a href="/buy">{text}</a>']), "div div aside section", "ad", "ads", "advert", "ad-slot", "sponsored", "promo", "banner", "advertisement")

    def related() -> str:
        return box(f"<h3>{no(2)}</h3>" + links(2, 8), "div aside section nav", "related", "recommended", "more-links", "teaser")

    def signup() -> str:
        return box(f"<form><label>{no(rng.randint(1, 6))}</label><input name=e><button>{no(1)}</button></form>" if rng.random() < 0.6 else f"<form><p>{no(rng.randint(3, 20))}</p><input></form>", "div section aside", "newsletter", "signup", "subscribe", "login", "search", "form")

    def share() -> str:
        return box(links(2, 5), "div ul", "share", "social", "sharing", "tags", "meta")

    def article() -> str:
        parts = []
        if rng.random() < 0.75:
            parts.append(f"<h1>{yes(rng.randint(2, 12))}</h1>")
        body = []
        for _ in range(rng.choice([1, 2, rng.randint(3, 10), rng.randint(5, 30)])):
            kind = rng.random()
            if kind < 0.72:
                body.append(paragraph())
            elif kind < 0.78:
                body.append(f"<h2>{yes(rng.randint(1, 7))}</h2>")
            elif kind < 0.84:
                body.append(rng.choice(["<ul>{}</ul>", "<ol>{}</ol>"]).format("".join(f"<li>{yes(rng.randint(2, 20))}</li>" for _ in range(rng.randint(2, 7)))))
            elif kind < 0.88:
                body.append(f"<blockquote><p>{yes(rng.randint(5, 40))}</p></blockquote>")
            elif kind < 0.91:
                body.append("<table>" + "".join("<tr>" + "".join(f"<td>{yes(rng.randint(1, 4))}</td>" for _ in range(3)) + "</tr>" for _ in range(rng.randint(2, 5))) + "</table>")
            elif kind < 0.95:
                body.append(yes(rng.randint(5, 50)) + "<br>" + yes(rng.randint(5, 30)) + rng.choice(["<br>", "<br><br>"]))
            else:
                body.append(rng.choice([advert, related, share, signup])())
        inner = "".join(body)
        if rng.random() < 0.4:
            inner = box(inner, "div div section", "content", "entry-content", "post-body", "article-body", "story", "text", "copy")
        tail = "".join(f() for f in (share, related, advert) if rng.random() < 0.15)
        whole = "".join(parts) + inner + tail
        return box(whole, rng.choice(["article", "article", "article", "main", "div", "div", "section", "td"]).replace("td", "div"), "article", "post", "main", "content", "story", "entry", "hentry", "page-content")

    def comments() -> str:
        each = "".join(box(rng.choice(["", f"<b>{no(2)}</b>", f"<span>{no(2)}</span>", f"<h4>{no(2)}</h4>"]) + f"<p>{no(rng.randint(3, 60))}</p>", "div li div article", "comment", "reply", "user-comment", "comment-body") for _ in range(rng.randint(1, 8)))
        if "<li" in each:
            each = f"<ol>{each}</ol>"
        return box(f"<h3>{no(rng.randint(1, 3))}</h3>" + each + (signup() if rng.random() < 0.3 else ""), "div section section aside", "comments", "discussion", "responses", "comment-list", "disqus", "reader-comments")

    def menu() -> str:
        return box(links(2, 14), "nav nav nav div ul", "nav", "menu", "navbar", "top-nav", "navigation", "breadcrumb")

    def header() -> str:
        return box(rng.choice([f"<h1>{no(rng.randint(1, 4))}</h1>", f'<a href="/">{no(2)}</a>', f"<p>{no(rng.randint(1, 10))}</p>"]) + (menu() if rng.random() < 0.5 else ""), "header header div", "header", "masthead", "site-header", "top")

    def sidebar() -> str:
        return box("".join(rng.choice([related, advert, signup, lambda: f"<h3>{no(2)}</h3><p>{no(rng.randint(3, 40))}</p>"])() for _ in range(rng.randint(1, 4))), "aside aside div section", "sidebar", "side", "widget", "rail", "widgets")

    def notice() -> str:
        return box(f"<p>{no(rng.randint(5, 40))}</p>" + rng.choice(["", f"<button>{no(1)}</button>"]) if rng.random() < 0.7 else no(rng.randint(4, 30)), "div div section dialog", "cookie", "notice", "cookie-banner", "consent", "alert", "gdpr", "notification")

    def footer() -> str:
        text = rng.choice([f"&copy; \x02{word()}.com &middot; {no(rng.randint(2, 15))}", f"<p>{no(rng.randint(3, 30))}</p>", links(2, 10)])
        return box(text + (links(2, 6) if rng.random() < 0.3 else ""), "footer footer footer div", "footer", "site-footer", "legal", "copyright", "foot")

    pick = lambda p, f: f() if rng.random() < p else ""
    if rng.random() < 0.04:  # little but text
        return "".join(paragraph() for _ in range(rng.randint(1, 6)))
    middle = pick(0.3, sidebar) + article() + pick(0.35, sidebar)
    after = pick(0.4, comments) + pick(0.2, related) + pick(0.2, advert)
    middle = middle + after if rng.random() < 0.6 else middle.replace("</article>", after + "</article>", 1) if "</article>" in middle else middle + after
    for _ in range(rng.randint(0, 3)):
        middle = box(middle, "div div main section", "wrapper", "container", "page", "layout", "row", "content", "main")
    head = f'<head><meta charset="utf-8"><title>{word()}</title><style>p{{margin:0}}</style></head>' if rng.random() < 0.9 else ""
    page = pick(0.5, notice) + pick(0.55, header) + pick(0.7, menu) + pick(0.45, advert) + middle + pick(0.15, notice) + pick(0.8, footer)
    return f"<!DOCTYPE html><html>{head}<body>{page}" + rng.choice(["</body></html>", ""])


@functools.lru_cache(maxsize=2)
def trained(pages: int = TRAINING_PAGES, seed: int = SEED) -> Boosted:
    """The classifier, from ``pages`` generated pages; the same for the same arguments."""
    rng = random.Random(seed)
    xs, ys, ws = [], [], []
    for _ in range(pages):
        page = Page(training_page(rng))
        n = len(page.tag)
        main, other = np.zeros(n), np.zeros(n)
        for at, text in page.flow:
            if text:
                for part in re.findall(r"[\x01\x02][^\x01\x02]*", text):
                    (main if part[0] == "\x01" else other)[at] += len(part) - 1
        for i in range(n - 1, 0, -1):
            main[page.parent[i]] += main[i]
            other[page.parent[i]] += other[i]
        page.flow = [(at, text and re.sub(r"[\x01\x02]", "", text)) for at, text in page.flow]
        x, own = features(page)
        some = main + other > 0
        purity = np.abs(main - other) / np.maximum(main + other, 1)
        xs.append(x[some])
        ys.append((main > other)[some])
        # Mixed elements teach little; those that decoding weighs, with text of their own, most.
        ws.append(((0.1 + purity) * (0.3 + np.minimum(3.0, np.sqrt(own) / 5)))[some])
    return train(np.concatenate(xs), np.concatenate(ys).astype(float), np.concatenate(ws))


def main_texts(pages: DataFrame, model: Boosted | None = None, id_col: str = "page_id", html_col: str = "html", keep: tuple[str, ...] = ()) -> DataFrame:
    """Every row of ``pages`` with its main text.

    Columns: id, _r_file, _r_row, text, and the columns ``keep`` of ``pages`` in
    front, by their own names. Null and empty pages have empty text; null ids
    stay null; repeated rows are read each for itself; other columns are ignored;
    an empty table gives no rows. Whole pages are read, however long or deeply nested.
    """
    model = model or trained()
    names = [*keep, "id", "_r_file", "_r_row", "text"]
    kinds = dict(pages.dtypes)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(k, 128) for k in range(0, len(whole), 128)):
                texts = extract_all(batch.column(len(names) - 1).to_pylist(), model)
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], names)

    rows = with_row_key(pages).select(*keep, F.col(id_col).alias("id"), "_r_file", "_r_row", F.col(html_col).alias("text"))
    return rows.mapInArrow(make, ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), f"id {kinds[id_col]}, _r_file long, _r_row long, text string"]))


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = main_texts(table(spark, sf_dir, "pages"), keep=("url",))
    return found.select(F.col("id").alias("page_id"), "url", "text", F.char_length("text").cast("long").alias("n_chars"))


QUERIES = {"op7_html": op7_html}
ORACLES: dict[str, str] = {}
